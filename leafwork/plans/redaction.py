"""Queries of region joins and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leafwork.functions.text import text_width
from leafwork.operators import regions as g

from .registry import Tables, query
from .scalars import WIDTH


@query(f"""WITH b AS (SELECT *, {WIDTH} * font_size AS adv FROM text_block) SELECT b.doc_id, b.page_no, block_id, text, coalesce(b.x < r.x + r.w AND b.x + adv > r.x AND b.y BETWEEN r.y AND r.y + r.h, false) AS removed FROM b LEFT JOIN redact_rect r ON r.doc_id = b.doc_id AND r.page_no = b.page_no""")
def j1_redact_region(t: Tables) -> DataFrame:
    return g.redact_region(t.text_block, t.redact_rect, text_width(F.col("text"), F.col("font_size"))).select("doc_id", "page_no", "block_id", "text", "removed")


@query("""WITH RECURSIVE w AS (SELECT a.doc_id, annot_id AS node, [annot_id] AS path FROM annotation a JOIN redact_rect r ON r.doc_id = a.doc_id AND r.page_no = a.page_no WHERE a.x < r.x + r.w AND a.x + a.w > r.x AND a.y < r.y + r.h AND a.y + a.h > r.y
 UNION ALL SELECT e.doc_id, e.dst, list_append(w.path, e.dst) FROM ref_edge e JOIN w ON e.doc_id = w.doc_id AND e.src = w.node WHERE NOT list_contains(w.path, e.dst)) SELECT annot_id, annot_id IN (SELECT node FROM w) AS removed FROM annotation""")
def j2_boxes_intersect(t: Tables) -> DataFrame:
    return g.remove_field_trees(t.annotation, t.redact_rect, t.ref_edge).select("annot_id", "removed")


@query("""SELECT b.doc_id, b.page_no, block_id FROM text_block b LEFT JOIN redact_rect r ON r.doc_id = b.doc_id AND r.page_no = b.page_no WHERE NOT coalesce(b.x BETWEEN r.x - 60 AND r.x + r.w + 60 AND b.y BETWEEN r.y - 60 AND r.y + r.h + 60, false)""")
def j3_remove_text_in_rect(t: Tables) -> DataFrame:
    return g.remove_text_in_rect(t.text_block, t.redact_rect, slack=60).filter("NOT removed").select("doc_id", "page_no", "block_id")


@query("""WITH d AS (SELECT i.doc_id, i.image_id, coalesce(min(greatest(1, least(px_w / (w / 72), px_h / (h / 72)))), 72) AS dpi FROM image i LEFT JOIN placement p ON p.doc_id = i.doc_id AND p.image_id = i.image_id GROUP BY ALL) SELECT doc_id, image_id, round(CAST(dpi AS DOUBLE), 6) AS dpi, dpi < 150 AS low FROM d""")
def j9_image_effective_dpi(t: Tables) -> DataFrame:
    return g.image_effective_dpi(t.image, t.placement).withColumn("dpi", F.round("dpi", 6))


@query("""SELECT a.doc_id, a.annot_id AS node_id, CASE WHEN contents = '' THEN 'Untitled' ELSE contents END AS title, coalesce(p.page_no, 0) AS page_index FROM annotation a LEFT JOIN page p ON p.doc_id = a.doc_id AND p.page_no = a.page_no""")
def j10_resolve_bookmarks(t: Tables) -> DataFrame:
    outline = t.annotation.select("doc_id", F.col("annot_id").alias("node_id"), F.col("contents").alias("title"), F.col("page_no").alias("dest"))
    return g.resolve_bookmarks(outline, t.page.select("doc_id", F.col("page_no").alias("page_id"), F.col("page_no").alias("page_index")))


@query("""SELECT doc_id, page_no, block_id, CAST(CASE WHEN x < 100 THEN 0 WHEN x <= 200 THEN 1 WHEN x <= 300 THEN 2 ELSE 3 END AS INTEGER) AS col FROM grid_block""")
def j11_nearest_anchor(t: Tables) -> DataFrame:
    anchors = F.array(*(F.lit(float(a)) for a in (50, 150, 250, 350)))
    return t.grid_block.select("doc_id", "page_no", "block_id", g.nearest_anchor(F.col("x"), anchors).alias("col"))


@query("""SELECT doc_id, name, type, CASE WHEN name = 'priority' AND doc_id % 3 = 0 THEN 'URGENT' ELSE value END AS value FROM form_field""")
def j12_fill_forms(t: Tables) -> DataFrame:
    values = t.form_field.filter("name = 'priority' AND doc_id % 3 = 0").select("doc_id", F.explode(F.array(F.lit("priority"), F.lit("nowhere"))).alias("name"), F.lit("URGENT").alias("new_value"))
    return g.fill_forms(t.form_field, values)


@query("""SELECT f.doc_id, CASE WHEN s.doc_id IS NOT NULL THEN 'signed' WHEN encrypted THEN 'encrypted' END AS blocked FROM doc_flags f LEFT JOIN (SELECT DISTINCT doc_id FROM signature) s ON s.doc_id = f.doc_id""")
def j14_guard_unsigned(t: Tables) -> DataFrame:
    return g.guard_unsigned(t.doc_flags, t.signature).select("doc_id", "blocked")


@query("SELECT doc_id, page_no, block_id, contains(text, 'tion') AS removed FROM text_block")
def j17_drop_matching_runs(t: Tables) -> DataFrame:
    return g.drop_matching_runs(t.text_block, "tion").select("doc_id", "page_no", "block_id", "removed")


@query("""WITH v AS (SELECT *, b0 + b1 <= b2 AND b0 + b1 <= file_size AND b2 + b3 <= file_size AND b3 >= 0 AS valid FROM signature) SELECT doc_id, field_name, valid, CASE WHEN valid THEN b1 + b3 END AS covered, CASE WHEN valid THEN file_size - b1 - b3 END AS uncovered FROM v""")
def j18_signature_coverage(t: Tables) -> DataFrame:
    return g.signature_coverage(t.signature)
