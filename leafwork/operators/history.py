"""Edit history: replay of undo and redo, what is retained, and what was opened last. Events: session_id, seq, kind (edit, undo, redo), byte_size, ts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from leafwork.streaming.replay import folded

def replay_edits(events: DataFrame, idle_minutes: float | None = None) -> DataFrame:
    """Per session the edits in effect, by seq, the depth of undo and redo, whether anything changed, and when it was last used.

    Events count in order of seq. An edit ends all redo, undo takes the last edit back, redo applies it again; with nothing to take, nothing happens. After more than
    ``idle_minutes`` without an event a session begins anew. Linear in events: they are sorted within partitions and folded as they pass, and no session is gathered.
    """
    return folded(events, idle_minutes)


def history_retention(events: DataFrame, budget: int, corpus_budget: int, most_sessions: int = 32) -> DataFrame:
    """Edits that are kept: of each session the newest whose sizes add up to ``budget`` at most, one at least; of the sessions the ones used last, ``most_sessions`` at most, while all their sizes fit ``corpus_budget``.

    Any event, undo and redo too, is a use, at its ``ts``; sessions used at the same time go by session_id.
    """
    newest = Window.partitionBy("session_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    edits = events.filter("kind = 'edit'").withColumns({"_sum": F.sum("byte_size").over(newest), "_nth": F.row_number().over(newest.rowsBetween(Window.unboundedPreceding, 0))})
    kept = edits.filter((F.col("_sum") <= budget) | (F.col("_nth") == 1))
    # the sessions that can stay are the last used ones, most_sessions at most
    uses = events.groupBy("session_id").agg(F.max("ts").alias("_last"))
    used = kept.groupBy("session_id").agg(F.sum("byte_size").alias("_bytes")).join(uses, "session_id").orderBy(F.desc("_last"), "session_id").limit(most_sessions)
    so_far = Window.orderBy(F.desc("_last"), "session_id").rowsBetween(Window.unboundedPreceding, 0)
    used = used.withColumns({"_total": F.sum("_bytes").over(so_far), "_place": F.row_number().over(so_far)}).filter((F.col("_total") <= corpus_budget) | (F.col("_place") == 1))
    return kept.join(F.broadcast(used.select("session_id")), "session_id", "left_semi").select("session_id", "seq", "byte_size")


def recent_items(opens: DataFrame, n: int = 10) -> DataFrame:
    """Per user the ``n`` names opened last, each once with its latest time, newest first."""
    latest = opens.groupBy("user_id", "name").agg(F.max("ts").alias("ts"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "name"))
    return latest.withColumn("place", place).filter(F.col("place") <= n)
