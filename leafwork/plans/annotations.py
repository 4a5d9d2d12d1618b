"""Queries of annotations and forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leafwork.operators import annotations as a

from .registry import Tables, query

COLUMNS = "doc_id, annot_id, in_reply_to, subtype, author, contents, page_no, status, x, y, w, h"


@query("""SELECT p.annot_id, count(r.annot_id) AS n_replies, coalesce(string_agg(concat(r.author, ': ', r.contents), '|' ORDER BY r.annot_id) FILTER (r.annot_id IS NOT NULL), '') AS replies FROM annotation p LEFT JOIN annotation r ON r.doc_id = p.doc_id AND r.in_reply_to = p.annot_id GROUP BY p.annot_id""")
def j4_thread_replies(t: Tables) -> DataFrame:
    return a.thread_replies(t.annotation).select("annot_id", F.size("replies").cast("long").alias("n_replies"), F.array_join(F.transform("replies", lambda r: F.concat(r["author"], F.lit(": "), r["contents"])), "|").alias("replies"))


@query("""WITH b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY annot_id) AS id, annot_id AS name, in_reply_to, page_no FROM annotation) SELECT b.doc_id, b.id, b.name, r.id AS reply_to_id FROM b JOIN page p ON p.doc_id = b.doc_id AND p.page_no = b.page_no LEFT JOIN (SELECT b.* FROM b JOIN page q ON q.doc_id = b.doc_id AND q.page_no = b.page_no) r ON r.doc_id = b.doc_id AND r.name = b.in_reply_to""")
def j13_resolve_reply_names(t: Tables) -> DataFrame:
    nth = F.expr("row_number() OVER (PARTITION BY doc_id ORDER BY annot_id)")
    batch = t.annotation.select("doc_id", nth.cast("long").alias("id"), F.col("annot_id").alias("name"), "in_reply_to", "page_no")
    return a.resolve_reply_names(batch, t.page).select("doc_id", "id", "name", "reply_to_id")


@query(f"""SELECT annot_id, subtype, page_no, x, y, w, h, NULL AS color, NULL AS opacity, NULL AS angle, NULL AS q2 FROM annotation
 UNION ALL SELECT concat('wm-', p.doc_id), 'Watermark', page_no, 5e1, 5e1, 1e2, 2e1, '#808080', 3e-1, 45, NULL FROM page p
 UNION ALL SELECT concat('hl-', p.doc_id), 'Highlight', page_no, 7e1, 7e2, 2e2, 2e1, '#00ff00', 4e-1, 0, 72e1 FROM page p WHERE page_no = 0
 UNION ALL SELECT concat('st-', p.doc_id), 'Stamp', page_no, 5e1, 5e1, 15e1, 4e1, '#ff0000', 1e0, 0, NULL FROM page p WHERE page_no = 1""")
def u5_add_annotations(t: Tables) -> DataFrame:
    num = lambda v: F.lit(v).cast("double")
    kinds = (("wm", "Watermark", None, None), ("hl", "Highlight", 0, (70.0, 700.0, 200.0, 20.0)), ("st", "Stamp", 1, None))
    made = [
        F.struct(F.lit(k).alias("k"), F.lit(s).alias("subtype"), F.lit(p).cast("long").alias("page_no"), *(num(v).alias(c) for c, v in zip("xywh", box or (None,) * 4, strict=True)), F.lit("#00ff00" if k == "hl" else None).cast("string").alias("color"))
        for k, s, p, box in kinds
    ]
    new = t.documents.select("doc_id", F.explode(F.array(*made)).alias("n")).select("doc_id", F.concat("n.k", F.lit("-"), F.col("doc_id").cast("string")).alias("annot_id"), "n.*", F.lit("me").alias("author"), F.lit("").alias("contents"), F.lit(None).cast("double").alias("opacity"), F.lit(None).cast("int").alias("angle")).drop("k")
    return a.add_annotations(t.annotation, new, t.page).select("annot_id", "subtype", "page_no", "x", "y", "w", "h", "color", "opacity", "angle", F.col("quad")[1].alias("q2"))


FIELDS = "SELECT doc_id, name, value, CASE WHEN name <> 'customer' THEN 0 END AS page_no FROM form_field"


@query("""WITH l AS (SELECT doc_id, page_no, max(block_id) AS m FROM text_block GROUP BY ALL), f AS (SELECT doc_id, name, value, CAST(0 AS BIGINT) AS page_no, row_number() OVER (PARTITION BY doc_id ORDER BY name) AS n FROM form_field WHERE name <> 'customer')
 SELECT doc_id, page_no, block_id, text, x, y, font_size FROM text_block UNION ALL SELECT f.doc_id, f.page_no, coalesce(m, -1) + n, value, 102e0, 202e0, 1e1 FROM f LEFT JOIN l ON l.doc_id = f.doc_id AND l.page_no = f.page_no""")
def u6_flatten_forms(t: Tables) -> DataFrame:
    placed = t.form_field.withColumns({"page_no": F.when(F.col("name") != "customer", F.lit(0).cast("long")), "x": F.lit(100.0), "y": F.lit(200.0)})
    return a.flatten_forms(placed, t.text_block)[0]


@query(f"""SELECT annot_id, in_reply_to, contents, page_no, CASE WHEN status = '' THEN 'Completed' ELSE status END AS status, x, y FROM annotation UNION ALL SELECT concat(annot_id, '-r'), annot_id, 'agreed', page_no, 'Completed', x, y FROM annotation WHERE in_reply_to IS NULL""")
def u7_reply_and_status(t: Tables) -> DataFrame:
    roots = t.annotation.filter("in_reply_to IS NULL")
    replies = roots.select("doc_id", F.concat("annot_id", F.lit("-r")).alias("annot_id"), F.col("annot_id").alias("in_reply_to"), F.lit("me").alias("author"), F.lit("agreed").alias("contents"))
    both = a.add_reply(t.annotation, replies)
    return a.set_status(both, both.filter("status = ''").select("doc_id", "annot_id", F.lit("Completed").alias("new_status"))).select("annot_id", "in_reply_to", "contents", "page_no", "status", "x", "y")


@query("SELECT doc_id, concat('p', page_no) AS title, page_no FROM page UNION ALL SELECT doc_id, 'start', CAST(0 AS BIGINT) FROM documents")
def u7_add_bookmark(t: Tables) -> DataFrame:
    outline = t.page.select("doc_id", F.concat(F.lit("p"), F.col("page_no").cast("string")).alias("title"), "page_no")
    return a.add_bookmark(outline, t.documents.select("doc_id", F.lit("start").alias("title"), F.lit(0).cast("long").alias("page_no")), t.page)


@query("SELECT doc_id, string_agg(concat(name, '=', value), ';' ORDER BY name) AS fields, (SELECT count(DISTINCT doc_id) FROM form_field) AS total_files FROM form_field GROUP BY doc_id")
def a11_aggregate_forms(t: Tables) -> DataFrame:
    return a.aggregate_forms(t.form_field).select("doc_id", F.array_join(F.transform("fields", lambda f: F.concat(f["name"], F.lit("="), f["value"])), ";").alias("fields"), "total_files")


@query("SELECT doc_id, max(value) FILTER (name = 'status') AS status, max(value) FILTER (name = 'priority') AS priority, max(value) FILTER (name = 'customer') AS customer FROM form_field GROUP BY doc_id")
def a11_forms_wide(t: Tables) -> DataFrame:
    return a.forms_wide(t.form_field, ["status", "priority", "customer"])


@query("""WITH c AS (SELECT doc_id, CAST(value AS DOUBLE) AS v FROM form_field WHERE name = 'customer') SELECT doc_id, name, type, value FROM form_field UNION ALL SELECT doc_id, 'double', 'Tx', CAST(v * 2 + 1 AS VARCHAR) FROM c
 UNION ALL SELECT doc_id, 'ratio', 'Tx', CAST(CASE WHEN v = 100 THEN 0e0 ELSE -1 / (v - 100) * 2 - -3 END AS VARCHAR) FROM c""")
def x1_calculated_field(t: Tables) -> DataFrame:
    doubled = a.calculated_field(t.form_field, "double", "customer * 2 + status + 1", ["customer", "status"])
    return a.calculated_field(doubled, "ratio", "-1 / (customer - 100) * 2 - -3", ["customer"])
