"""Queries of edit history and of the action pipeline."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from leafwork.operators import history as h, pipeline
from leafwork.operators.scratch import shared_dir
from leafwork.streaming.replay import kept_sessions, replay_files

from .graphs import REACH
from .registry import Tables, query


#: Event by event: the stacks of edits done and undone of every session; after an idle time (in seconds) both are empty.
REPLAY = """WITH RECURSIVE e AS (SELECT session_id, seq, kind, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > {idle} * CAST(1000000 AS BIGINT), false) AS anew, row_number() OVER w AS n FROM edit_event WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
 s AS (SELECT session_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS undo, CAST([] AS BIGINT[]) AS redo, false AS dirty, ts AS last_used FROM e WHERE n = 1
 UNION ALL SELECT session_id, n, CASE WHEN kind = 'edit' THEN list_append(u, seq) WHEN kind = 'undo' AND len(u) > 0 THEN u[:-2] WHEN kind = 'redo' AND len(r) > 0 THEN list_append(u, r[-1]) ELSE u END,
 CASE WHEN kind = 'edit' THEN CAST([] AS BIGINT[]) WHEN kind = 'undo' AND len(u) > 0 THEN list_append(r, u[-1]) WHEN kind = 'redo' AND len(r) > 0 THEN r[:-2] ELSE r END,
 (dirty AND NOT anew) OR kind = 'edit' OR kind = 'undo' AND len(u) > 0 OR kind = 'redo' AND len(r) > 0, ts
 FROM (SELECT e.*, s.dirty, CASE WHEN anew THEN CAST([] AS BIGINT[]) ELSE undo END AS u, CASE WHEN anew THEN CAST([] AS BIGINT[]) ELSE redo END AS r FROM s JOIN e ON e.session_id = s.session_id AND e.n = s.n + 1) x),
 f AS (SELECT session_id, array_to_string(undo, ',') AS effective, CAST(len(undo) AS BIGINT) AS undo_depth, CAST(len(redo) AS BIGINT) AS redo_depth, dirty, epoch_us(last_used) AS last_used FROM s WHERE n = (SELECT max(n) FROM e WHERE e.session_id = s.session_id))"""
NEVER, IDLE_HOURS = 10**12, 24


def shown(states: DataFrame) -> DataFrame:
    return states.withColumns({"effective": F.array_join("effective", ","), "last_used": F.unix_micros("last_used")})


@query(REPLAY.format(idle=NEVER) + " SELECT * FROM f")
def r1_replay_edits(t: Tables) -> DataFrame:
    return shown(h.replay_edits(t.edit_event))


def lateness(events: DataFrame, bounds: list[int], least: float = 10) -> float:
    """Minutes by which the oldest event of a range of seq lies behind the newest of the ranges before it: the stream may drop none of them."""
    number = sum((F.col("seq") >= b).cast("int") for b in bounds[1:-1]) if bounds else F.lit(0)
    ends = events.groupBy(number.alias("n")).agg(*(f(F.unix_micros(F.col("ts").cast("timestamp"))) for f in (F.min, F.max))).orderBy("n").collect()
    newest, late = None, 0
    for _, first, last in ends:
        if first is not None:
            late = late if newest is None else max(late, newest - first)
            newest = last if newest is None else max(newest, last)
    return least + late / 60_000_000


@query(REPLAY.format(idle=IDLE_HOURS * 3600) + " SELECT *, row_number() OVER (ORDER BY last_used DESC, session_id) <= 32 AS kept FROM f")
def r2_replay_edits_stream(t: Tables) -> DataFrame:
    """The stream forgets sessions that were idle for a day, and the 32 used last are kept."""
    base = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    events = t.edit_event.select("session_id", "seq", "kind", "byte_size", "ts")
    lo, hi = events.agg(F.min("seq"), F.max("seq")).first()
    # four ranges of ascending seq arrive one after the other, each in as many files as its tasks write, and the stream goes on from its checkpoint
    bounds = [] if lo is None else [lo + (hi + 1 - lo) * i // 4 for i in range(5)]
    late = lateness(events, bounds)
    out = h.replay_edits(events.filter("false"))
    for a, b in zip(bounds, bounds[1:], strict=False):
        arriving = events.filter(F.col("seq").between(a, b - 1)).repartition("session_id").sortWithinPartitions("session_id", "seq")
        arriving.write.mode("append").parquet(f"{base}/in")
        out = replay_files(t.spark, f"{base}/in", events.schema, f"{base}/checkpoint", f"{base}/out", idle_minutes=IDLE_HOURS * 60, late_minutes=late)
    return shown(kept_sessions(out))


@query("""WITH e AS (SELECT session_id, seq, byte_size, sum(byte_size) OVER w AS s, row_number() OVER w AS n FROM edit_event WHERE kind = 'edit' WINDOW w AS (PARTITION BY session_id ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), k AS (SELECT * FROM e WHERE s <= 200000 OR n = 1),
 u AS (SELECT session_id, (SELECT max(ts) FROM edit_event x WHERE x.session_id = k.session_id) AS l, sum(byte_size) AS b FROM k GROUP BY session_id ORDER BY l DESC, session_id LIMIT 32), c AS (SELECT session_id, sum(b) OVER (ORDER BY l DESC, session_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t, row_number() OVER (ORDER BY l DESC, session_id) AS p FROM u)
 SELECT k.session_id, k.seq, k.byte_size FROM k JOIN c ON c.session_id = k.session_id WHERE t <= 3000000 OR p = 1""")
def w12_history_retention(t: Tables) -> DataFrame:
    return h.history_retention(t.edit_event, 200_000, 3_000_000)


@query("""WITH l AS (SELECT user_id, event_type AS name, max(ts) AS ts FROM events GROUP BY ALL), r AS (SELECT user_id, name, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, name) AS place FROM l) SELECT user_id, name, CAST(ts AS VARCHAR) AS opened, place FROM r WHERE place <= 3""")
def w14_recent_items(t: Tables) -> DataFrame:
    opens = t.events.select("user_id", F.col("event_type").alias("name"), "ts")
    return h.recent_items(opens, 3).select("user_id", "name", F.col("ts").cast("string").alias("opened"), "place")


SPEC = """{"name": "publish", "steps": [{"action_type": "redact_text", "params": {"search_text": "the"}}, {"action_type": "redact_text", "params": {"search_text": ""}}, {"action_type": "add_watermark", "params": {"text": "DRAFT"}},
 {"action_type": "add_page_numbers", "params": {"position": "bottom-left", "start_number": 5}}, {"action_type": "flatten_form"}, {"action_type": "optimize"}, {"action_type": "rotate_pages", "params": {"rotation": 180}},
 {"action_type": "remove_metadata"}, {"action_type": "convert_to_pdfa"}]}"""


@query(f"""{REACH.format(start="annot_id", of="annotation WHERE annot_id LIKE '%-3'")}, refused AS (SELECT doc_id FROM font WHERE NOT embedded), l AS (SELECT doc_id, page_no, max(block_id) AS m FROM text_block GROUP BY ALL),
 f AS (SELECT doc_id, value, CAST(0 AS BIGINT) AS page_no, row_number() OVER (PARTITION BY doc_id ORDER BY name) AS n FROM form_field WHERE name <> 'customer'),
 b AS (SELECT doc_id, page_no, block_id, replace(text, 'the', '[REDACTED]') AS text FROM text_block UNION ALL SELECT doc_id, page_no, -1, CAST(page_no + 5 AS VARCHAR) FROM page UNION ALL SELECT f.doc_id, f.page_no, coalesce(m, -1) + n, value FROM f LEFT JOIN l ON l.doc_id = f.doc_id AND l.page_no = f.page_no),
 o AS (SELECT a.doc_id, annot_id, subtype FROM annotation a WHERE EXISTS (SELECT 1 FROM w WHERE w.doc_id = a.doc_id AND w.node = a.annot_id)), out AS (
 SELECT 'text' AS part, b.doc_id, b.page_no, CAST(block_id AS VARCHAR) AS id, text, (rotation + 180) % 360 AS rotation FROM b JOIN page p ON p.doc_id = b.doc_id AND p.page_no = b.page_no
 UNION ALL SELECT 'annotation', doc_id, page_no, 'wm-' || doc_id, 'DRAFT', NULL FROM page UNION ALL SELECT 'annotation', doc_id, page_no, annot_id, contents, NULL FROM annotation WHERE subtype <> 'Widget'
 UNION ALL SELECT 'object', doc_id, NULL, annot_id, subtype, NULL FROM o WHERE subtype <> 'Text') SELECT * FROM out WHERE doc_id NOT IN (SELECT doc_id FROM refused)""")
def x2_run_pipeline(t: Tables) -> DataFrame:
    placed = t.form_field.withColumns({"page_no": F.when(F.col("name") != "customer", F.lit(0).cast("long")), "x": F.lit(100.0), "y": F.lit(200.0)})
    objects = t.annotation.select("doc_id", F.col("annot_id").alias("node"), F.when(F.col("subtype") == "Text", "Metadata").otherwise(F.col("subtype")).alias("type"))
    tables = {"page": t.page, "text_block": t.text_block, "annotation": t.annotation, "object": objects, "ref_edge": t.ref_edge, "root": objects.filter("node LIKE '%-3'").select("doc_id", "node"), "form_field": placed, "font": t.font}
    out = pipeline.run_pipeline(tables, SPEC)
    null = F.lit(None).cast("long")
    text = out["text_block"].join(out["page"].select("doc_id", "page_no", "rotation"), ["doc_id", "page_no"]).select(F.lit("text").alias("part"), "doc_id", "page_no", F.col("block_id").cast("string").alias("id"), "text", "rotation")
    marks = out["annotation"].select(F.lit("annotation"), "doc_id", "page_no", "annot_id", "contents", null)
    return text.union(marks).union(out["object"].select(F.lit("object"), "doc_id", null, "node", "type", null))
