"""Matching of blocks in rounds, and edit replay in batch and as a stream, against plain loops."""

import random
from datetime import datetime, timedelta
from types import SimpleNamespace

from pyspark.sql import functions as F

from leafwork.operators import history, revisions
from leafwork.streaming.replay import SessionReplay, kept_sessions, replay_edits_stream, replay_files

from test_operators import EVENTS, logged

BLOCKS = "doc_id long, page_no long, block_id long, text string, x double, y double, width double, height double"


def brute_matching(pairs):
    taken, used = set(), set()
    for page, a, b, sim in sorted(pairs, key=lambda p: (p[0], -p[3], p[1], p[2])):
        if (page, "a", a) not in used and (page, "b", b) not in used:
            taken.add((page, a, b))
            used |= {(page, "a", a), (page, "b", b)}
    return taken


def test_matching_is_the_greedy_choice(spark):
    r = random.Random(5)
    pairs = [(d, a, b, r.choice([0.3, 0.5, 0.5, 0.7, 0.9])) for d in range(6) for a in range(12) for b in range(12) if r.random() < 0.3]
    df = spark.createDataFrame([(d, 0, a, b, s) for d, a, b, s in pairs], "doc_id long, page_no long, orig_block_id long, rev_block_id long, sim double")
    got, rounds = revisions.dominant_matching(df)
    assert {(x.doc_id, x.orig_block_id, x.rev_block_id) for x in got.collect()} == brute_matching(pairs) and rounds > 1
    none, _ = revisions.dominant_matching(df.filter("false"))
    assert none.count() == 0


def test_matching_page_by_page_is_the_greedy_choice_without_rounds(spark):
    r = random.Random(6)
    pairs = [(d, a, b, r.choice([0.3, 0.5, 0.5, 0.7, 0.9])) for d in range(6) for a in range(12) for b in range(12) if r.random() < 0.3]
    df = spark.createDataFrame([(d, 0, a, b, s) for d, a, b, s in pairs], "doc_id long, page_no long, orig_block_id long, rev_block_id long, sim double")
    got = revisions.greedy_matching(df)
    assert {(x.doc_id, x.orig_block_id, x.rev_block_id) for x in got.collect()} == brute_matching(pairs)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") and revisions.greedy_matching(df.filter("false")).count() == 0


def test_a_block_whose_first_choice_is_taken_gets_its_next(spark):
    rows = lambda *r: spark.createDataFrame([(1, 0, i, t, 50.0, y, 9.0, 9.0) for i, (t, y) in enumerate(r)], BLOCKS)
    a, b = rows(("the quick brown fox", 700.0), ("the quick brown cat", 692.0)), rows(("the quick brown fax", 700.0), ("the quick brawn dog", 692.0))
    got = [(x.kind, x.original_text, x.revised_text) for x in revisions.diff(a, b).orderBy("seq").collect()]
    assert got == [("modified", "the quick brown fox", "the quick brown fax"), ("modified", "the quick brown cat", "the quick brawn dog")]


def test_lengths_bound_likeness(spark):
    texts = ["", "a", "ab", "kitten", "sitting", "a much longer line of text", " trimmed "]
    df = spark.createDataFrame([(x, y) for x in texts for y in texts], "a string, b string").select(F.trim("a").alias("a"), F.trim("b").alias("b"))
    got = df.select(revisions.similarity(F.col("a"), F.col("b")).alias("s"), revisions.likeness_bound(F.col("a"), F.col("b")).alias("m")).collect()
    assert all(r.s <= r.m for r in got)


def brute_replay(events, idle=None):
    """events: (seq, kind, minute), sorted."""
    undo, redo, dirty, last = [], [], False, None
    for seq, kind, at in events:
        if idle is not None and last is not None and at - last > idle:
            undo, redo, dirty = [], [], False
        last = at
        if kind == "edit":
            undo, redo, dirty = [*undo, seq], [], True
        elif kind == "undo" and undo:
            redo.append(undo.pop())
            dirty = True
        elif kind == "redo" and redo:
            undo.append(redo.pop())
            dirty = True
    return undo, len(undo), len(redo), dirty


def random_log(seed, n=600, sessions=8):
    r = random.Random(seed)
    return [(r.randrange(sessions), i + 1, r.choice(["edit", "edit", "undo", "undo", "redo", "other"])) for i in range(n)]


def state(r):
    return r.effective, r.undo_depth, r.redo_depth, r.dirty


def test_replay_is_a_loop_over_the_log(spark):
    log = random_log(1)
    for idle in (None, 20):
        got = {r.session_id: state(r) for r in history.replay_edits(logged(spark, log).repartition(5), idle).collect()}
        assert got == {s: brute_replay([(q, k, q) for x, q, k in log if x == s], idle) for s in range(8)}


def test_replay_gathers_no_session(spark):
    plan = history.replay_edits(logged(spark, [(1, 1, "edit")]))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Aggregate" not in plan


def stream(spark, tmp_path, **options):
    schema = logged(spark, [(1, 1, "edit")]).schema
    return replay_files(spark, str(tmp_path / "in"), schema, str(tmp_path / "checkpoint"), str(tmp_path / "out"), **options)


def test_the_stream_forgets_idle_sessions_and_goes_on_from_its_checkpoint(spark, tmp_path):
    log = random_log(2, n=240)
    before = {k: spark.conf.get(k) for k in ("spark.sql.streaming.noDataMicroBatches.enabled", "spark.sql.streaming.stateStore.providerClass")}
    got = None
    for lo, hi in ((1, 80), (81, 160), (161, 240)):  # each run is a new query that finds the last one's state
        logged(spark, [e for e in log if lo <= e[1] <= hi]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = stream(spark, tmp_path, idle_minutes=15, late_minutes=1)
    assert {r.session_id: state(r) for r in got.collect()} == {s: brute_replay([(q, k, q) for x, q, k in log if x == s], 15) for s in range(8)}
    assert before == {k: spark.conf.get(k) for k in before}


def test_expiry_clears_the_store(spark, tmp_path):
    for rows in ([(1, 1, "edit"), (2, 2, "edit")], [(2, 100, "edit")], [(2, 200, "undo")]):
        logged(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = stream(spark, tmp_path, idle_minutes=10, late_minutes=1)
    assert {r.session_id: state(r) for r in got.collect()} == {1: ([1], 1, 0, True), 2: ([], 0, 0, False)}
    kept = spark.read.format("statestore").option("stateVarName", "place").load(str(tmp_path / "checkpoint"))
    assert {r.key.session_id for r in kept.collect()} == {2}


class Store:
    """A value, a map and timers of one session, as the state store has them."""

    def __init__(self):
        self.value, self.map, self.timers = None, {}, []

    def getValueState(self, *_):
        put = lambda v: setattr(self, "value", v)
        return SimpleNamespace(get=lambda: self.value, update=put, clear=lambda: put(None))

    def getMapState(self, *_):
        return SimpleNamespace(iterator=lambda: iter(list(self.map.items())), updateValue=self.map.__setitem__, removeKey=self.map.__delitem__, clear=self.map.clear)

    def registerTimer(self, at):
        self.timers.append(at)


def test_deep_histories_lie_in_blocks_and_idle_ones_are_cleared():
    r, minute = random.Random(5), 60_000_000
    for size in (1, 2, 3, 50):
        store, log, at = Store(), [], 0
        replay = SessionReplay(20, size)
        replay.init(store)
        for batch in range(60):
            new = []
            for _ in range(r.randrange(1, 9)):
                at += 25 if r.random() < 0.01 else 1
                new.append((len(log) + len(new), r.choice(["edit", "edit", "undo", "redo"] if batch % 20 < 12 else ["undo", "undo", "edit"]), at))
            log += new
            packs = [SimpleNamespace(seq=[e[0] for e in p], kind=[e[1] for e in p], at=[e[2] * minute for e in p]) for p in (new[1:], new[:1])]
            (got,) = replay.handleInputRows((1,), iter(packs), None)
            assert state(got) == brute_replay(log, 20)
            total = got.undo_depth + got.redo_depth
            assert sorted(store.map) == [(n,) for n in range(total // size)] and len(store.timers) == 1
        early, late = (SimpleNamespace(getCurrentWatermarkInMs=lambda m=m: m * 60_000) for m in (at, at + 21))
        assert not list(replay.handleExpiredTimer((1,), early, None)) and store.value and store.timers[1:] == [(at + 20) * 60_000 + 1]
        assert not list(replay.handleExpiredTimer((1,), late, None)) and store.value is None and not store.map


def test_events_are_packed_before_the_state(spark, tmp_path):
    schema = logged(spark, [(1, 1, "edit")]).schema
    plan = replay_edits_stream(spark.readStream.schema(schema).parquet(str(tmp_path)))._jdf.queryExecution().analyzed().toString()
    assert plan.index("TransformWithState") < plan.index("EventTimeWatermark") < plan.index("MapInArrow")


def test_sessions_whose_times_lie_behind_are_not_dropped(spark):
    from leafwork.plans import history as plans, registry

    registry.queries()
    log = [(s, s * 100 + i, "undo" if i % 3 == 2 else "edit") for s in range(8) for i in range(9)]
    day = datetime(2024, 1, 1)
    # every session has the same days; those that arrive later are no newer
    rows = [(s, q, k, 1, day + timedelta(hours=10 * (q % 100) + s % 3)) for s, q, k in log]
    t = SimpleNamespace(spark=spark, edit_event=spark.createDataFrame(rows, EVENTS))
    got = {r.session_id: (r.effective, r.undo_depth, r.redo_depth, r.dirty) for r in plans.r2_replay_edits_stream(t).collect()}
    want = {s: brute_replay([(q, k, 0) for x, q, k in log if x == s]) for s in range(8)}
    assert got == {s: (",".join(map(str, w[0])), *w[1:]) for s, w in want.items()}


def test_a_session_was_last_used_by_its_last_event(spark):
    day = datetime(2024, 1, 1)
    rows = [(1, 1, "edit", 1, day + timedelta(minutes=60)), (1, 2, "edit", 1, day), (1, 3, "edit", 1, day + timedelta(minutes=65))]
    got = history.replay_edits(spark.createDataFrame(rows, EVENTS), 20).first()
    assert got.effective == [3] and history.replay_edits(spark.createDataFrame(rows[:2], EVENTS)).first().last_used == day


def test_sessions_used_longest_ago_are_out(spark):
    states = history.replay_edits(logged(spark, [(s, s * 3 + 1, "edit") for s in range(6)]))
    assert {r.session_id for r in kept_sessions(states, 2).filter("kept").collect()} == {4, 5}


def test_retention_goes_by_the_time_of_use(spark):
    # session 1 has the larger seq, session 2 was used later
    rows = logged(spark, [(1, 50, "edit", 10), (2, 4, "edit", 10), (2, 5, "undo", 0)])
    rows = rows.withColumn("ts", F.when(F.col("session_id") == 2, F.col("ts") + F.expr("INTERVAL 5 HOURS")).otherwise(F.col("ts")))
    assert [r.session_id for r in history.history_retention(rows, 100, 1000, 1).collect()] == [2]
