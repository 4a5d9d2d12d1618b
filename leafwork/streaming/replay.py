"""Edit replay: one session's history event by event, over sorted partitions in batch, and as a stream that keeps each session's state until it has been idle."""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from leafwork.operators.runs import packed

OUT = "session_id long, effective array<bigint>, undo_depth long, redo_depth long, dirty boolean, last_used timestamp"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH, MICRO = datetime(1970, 1, 1, tzinfo=UTC), timedelta(microseconds=1)


class History:
    """Edits by depth: those up to ``undo`` are in effect, those from there to ``total`` can be done again. Every event costs the same, whatever the depth.

    An edit is put at the next depth and ends all redo; undo and redo move the place, and do nothing at the ends. ``put`` has the depths written since it was last emptied.
    """

    def __init__(self, undo: int = 0, total: int = 0, dirty: bool = False, last: int | None = None):
        self.undo, self.total, self.dirty, self.last = undo, total, dirty, last
        self.put: dict[int, int] = {}

    def step(self, kind: str, seq: int, at: int | None, idle: int | None) -> bool:
        """One event, at microseconds ``at``; one that comes more than ``idle`` after the one before it in order of seq finds a new history. Whether it did."""
        anew = idle is not None and at is not None and self.last is not None and at - self.last > idle
        if anew:
            self.__init__()
        self.last = at
        if kind == "edit":
            self.undo = self.total = self.undo + 1
            self.put[self.undo] = seq
        elif kind == "undo" and self.undo > 0:
            self.undo -= 1
        elif kind == "redo" and self.undo < self.total:
            self.undo += 1
        else:
            return anew
        self.dirty = True
        return anew


def folded(events: DataFrame, idle_minutes: float | None = None) -> DataFrame:
    """OUT for each session of events (session_id, seq, kind, ts), in order of seq: rows come to a task sorted by session, which holds one history at a time and no session's events."""
    idle = None if idle_minutes is None else int(idle_minutes * 60_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, now, done = None, None, []

        def row():
            return now, [h.put[d] for d in range(1, h.undo + 1)], h.undo, h.total - h.undo, h.dirty, h.last

        def out() -> pa.RecordBatch:
            ids, effective, undo, redo, dirty, last = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(effective, pa.list_(pa.int64())), pa.array(undo, pa.int64()), pa.array(redo, pa.int64()), pa.array(dirty, pa.bool_()), pa.array(last, pa.timestamp("us", tz="UTC"))], names)

        names = ["session_id", "effective", "undo_depth", "redo_depth", "dirty", "last_used"]
        for b in batches:
            times = b.column("at").to_pylist()
            for session, seq, kind, at in zip(b.column("session_id").to_pylist(), b.column("seq").to_pylist(), b.column("kind").to_pylist(), times, strict=True):
                if h is None or session != now:
                    if h is not None:
                        done.append(row())
                    h, now = History(), session
                    if len(done) >= 1000:
                        yield out()
                        done = []
                h.step(kind, seq, at, idle)
        if h is not None:
            done.append(row())
            yield out()

    rows = events.select(F.col("session_id").cast("long"), F.col("seq").cast("long"), "kind", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return rows.repartition("session_id").sortWithinPartitions("session_id", "seq", "kind").mapInArrow(run, OUT)


#: Depths in one entry of the map of a session's older edits.
BLOCK = 1024


class SessionReplay(StatefulProcessor):
    """The history of a session in the state store. Its value has places, times and the newest edits; full blocks of edits below those are a map, so an ordinary session is read and written in one call each.

    One timer a session waits for the end of the idle time. Where the session was used meanwhile, it is set anew; else value and map are cleared.
    """

    def __init__(self, idle_minutes: float, block: int = BLOCK):
        self.idle, self.block = int(idle_minutes * 60_000_000), block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.edits = handle.getMapState("edits", "block long", "seqs array<bigint>")
        self.place = handle.getValueState("place", "undo long, total long, dirty boolean, last long, top array<bigint>")

    def expiry(self, last: int) -> int:
        return (last + self.idle) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = self.place.get()
        h, top = (History(*kept[:4]), kept[4]) if kept else (History(), [])
        before, timed, size = h.total, h.last is not None, self.block
        below = before - len(top)
        fresh = False
        for seq, kind, at in sorted((e for r in rows for e in zip(r.seq, r.kind, r.at, strict=True)), key=itemgetter(0, 1)):
            fresh = h.step(kind, seq, at, self.idle) or fresh
        old = top
        if below:
            if fresh:
                self.edits.clear()
            else:
                blocks = {n[0]: seqs[0] for n, seqs in self.edits.iterator()}
                old = [int(s) for n in range(below // size) for s in blocks[n]] + top
        # depths that this batch didn't write are as they were
        depths = [h.put[d] if d in h.put else old[d - 1] for d in range(1, h.total + 1)]
        first = 0 if fresh else min(min(h.put, default=below + 1) - 1, below) // size
        full = h.total // size
        for n in range(first, full):
            self.edits.updateValue((n,), (depths[n * size : (n + 1) * size],))
        for n in range(full, 0 if fresh else below // size):
            self.edits.removeKey((n,))
        self.place.update((h.undo, h.total, h.dirty, h.last, depths[full * size :]))
        if not timed and h.last is not None:
            self.handle.registerTimer(self.expiry(h.last))
        used = None if h.last is None else EPOCH + h.last * MICRO
        yield Row(session_id=key[0], effective=depths[: h.undo], undo_depth=h.undo, redo_depth=h.total - h.undo, dirty=h.dirty, last_used=used)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kept = self.place.get()
        if kept and kept[3] is not None:  # without a time, the next event sets the timer
            if (at := self.expiry(kept[3])) > timerValues.getCurrentWatermarkInMs():
                self.handle.registerTimer(at)
            else:
                if kept[1] > len(kept[4]):
                    self.edits.clear()
                self.place.clear()
        return iter(())

    def close(self) -> None:
        pass


def replay_edits_stream(events: DataFrame, idle_minutes: float = 60, late_minutes: float = 10) -> DataFrame:
    """R2: the stream of each session's state after every batch with events of it (update mode), over events (session_id, seq, kind, ts).

    Events must arrive in order of seq from batch to batch; within one they are sorted. A session idle for ``idle_minutes`` by the events' own time is forgotten, by its next
    event or, where none comes, by a timer once the watermark is past that time; so the result doesn't depend on how events fall into batches.
    Events of a session that lie next to one another are packed before their shuffle and reach the state as one row. Rows older than the watermark, ``late_minutes`` behind the
    newest, are dropped; a packed row is as old as its newest event.
    """
    rows = events.select(F.col("session_id").cast("long"), F.col("seq").cast("long"), "kind", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    timed = packed(rows, ["session_id"]).withColumn("ts", F.timestamp_micros(F.array_max("at"))).withWatermark("ts", f"{math.ceil(late_minutes * 60)} seconds")
    return timed.groupBy("session_id").transformWithState(SessionReplay(idle_minutes), OUT, "update", "eventTime")


def replay_files(spark: SparkSession, path: str, schema, checkpoint: str, sink: str, files_per_batch: int | None = None, idle_minutes: float = 60, late_minutes: float = 10) -> DataFrame:
    """The event files under ``path`` that the checkpoint hasn't seen run through the stream, all at once or ``files_per_batch`` at a time in order of their times; each session's last state (OUT).

    Fewest rows reach the state where a file has the events of a session next to one another. State is kept by the RocksDB store. A run that broke off goes on from the checkpoint, and a batch that is written again replaces its own folder.
    """
    reader = spark.readStream.schema(schema)
    events = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, PROVIDER)
    try:
        query = replay_edits_stream(events, idle_minutes, late_minutes).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()
    finally:
        spark.conf.set(store, before)
    states = spark.read.schema(f"{OUT}, batch int").parquet(sink)
    last = states.groupBy("session_id").agg(F.max("batch").alias("batch"))
    return states.join(last, ["session_id", "batch"]).drop("batch")


def kept_sessions(states: DataFrame, most: int = 32) -> DataFrame:
    """``states`` with ``kept``: whether the session is one of the ``most`` used last, those used longest ago being out first."""
    newest = states.select("session_id", "last_used").orderBy(F.desc("last_used"), "session_id").limit(most)
    marked = states.join(F.broadcast(newest.select("session_id", F.lit(True).alias("kept"))), "session_id", "left")
    return marked.withColumn("kept", F.coalesce("kept", F.lit(False)))
