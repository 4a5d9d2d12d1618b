"""Queries of OCR words."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leafwork.functions.text import text_width
from leafwork.operators import ocr as o

from .registry import Tables, query
from .scalars import WIDTH

STATS = "SELECT doc_id, page_no, coalesce(avg(conf) FILTER (conf > 0), 85) AS mean_conf, count(*) FILTER (conf < 75 AND trim(text) <> '') AS suspects FROM ocr_word GROUP BY ALL"


@query(f"SELECT doc_id, page_no, round(mean_conf, 6) AS mean_conf, suspects FROM ({STATS}) s")
def a3_ocr_page_stats(t: Tables) -> DataFrame:
    return o.ocr_page_stats(t.ocr_word).withColumn("mean_conf", F.round("mean_conf", 6))


@query("SELECT doc_id, page_no, block_num, par_num, line_num, word_num, text, conf FROM ocr_word WHERE conf < 75 AND trim(text) <> ''")
def a3_suspects(t: Tables) -> DataFrame:
    return o.suspects(t.ocr_word)


@query(f"SELECT doc_id, round(avg(mean_conf), 6) AS mean_conf, count(*) AS pages, CAST(sum(suspects) AS BIGINT) AS suspects FROM ({STATS}) s GROUP BY doc_id")
def a4_ocr_doc_stats(t: Tables) -> DataFrame:
    return o.ocr_doc_stats(o.ocr_page_stats(t.ocr_word)).withColumn("mean_conf", F.round("mean_conf", 6))


LINES = """SELECT doc_id, page_no, block_num, par_num, line_num, min(x_left) AS x_left, min(y_top) AS y_top, max(x_left + width) - min(x_left) AS width, max(y_top + height) - min(y_top) AS height, coalesce(avg(conf) FILTER (conf >= 0), 80) AS conf,
 greatest((max(y_top + height) - min(y_top)) * 85e-2, 10) AS font_size, string_agg(text, ' ' ORDER BY word_num, text) AS text FROM ocr_word WHERE trim(text) <> '' GROUP BY ALL"""


@query(f"SELECT doc_id, page_no, block_num, par_num, line_num, x_left, y_top, width, height, round(conf, 6) AS conf, round(font_size, 6) AS font_size, text FROM ({LINES}) l")
def a5_ocr_lines(t: Tables) -> DataFrame:
    return o.ocr_lines(t.ocr_word).withColumns({"conf": F.round("conf", 6), "font_size": F.round("font_size", 6)})


def with_lines(t: Tables) -> DataFrame:
    """The words and, in every other block, a row of level 4 for each line, wider and higher than its words; every seventh word is of no confidence, every fifth in CJK letters."""
    cjk = F.when(F.col("word_num") % 5 == 2, F.regexp_replace("text", "[a-m]", "漢")).otherwise(F.col("text"))
    words = t.ocr_word.withColumns({"conf": F.when(F.col("word_num") == 6, -1.0).otherwise(F.col("conf")), "text": cjk})
    line = ["doc_id", "page_no", "block_num", "par_num", "line_num"]
    rows = t.ocr_word.filter("block_num % 2 = 1").groupBy(*line).agg((F.min("x_left") - 5).alias("x_left"), (F.min("y_top") - 3).alias("y_top"), F.lit(900.0).alias("width"), F.lit(44.0).alias("height"))
    return words.unionByName(rows.withColumns({"level": F.lit(4), "word_num": F.lit(0).cast("long"), "conf": F.lit(-1.0), "text": F.lit("")}))


@query("""WITH w AS (SELECT * REPLACE (CASE WHEN word_num = 6 THEN -1e0 ELSE conf END AS conf, CASE WHEN word_num % 5 = 2 THEN regexp_replace(text, '[a-m]', '漢', 'g') ELSE text END AS text) FROM ocr_word),
 o AS (SELECT *, lag(text) OVER k AS prev, row_number() OVER k AS n FROM w WHERE trim(text) <> '' WINDOW k AS (PARTITION BY doc_id, page_no, block_num, par_num, line_num ORDER BY word_num, text)),
 g AS (SELECT doc_id, page_no, block_num, par_num, line_num, coalesce(avg(conf) FILTER (conf >= 0), 80) AS conf, string_agg(CASE WHEN prev IS NOT NULL AND regexp_matches(prev, '[\\x00-\\x7F]$') AND regexp_matches(text, '^[\\x00-\\x7F]') THEN concat(' ', text) ELSE text END, '' ORDER BY n) AS text,
 min(x_left) AS x0, min(y_top) AS y0, max(x_left + width) AS x1, max(y_top + height) AS y1 FROM o GROUP BY ALL), m AS (SELECT doc_id, page_no, block_num, par_num, line_num, min(x_left) AS x0, min(y_top) AS y0 FROM ocr_word WHERE block_num % 2 = 1 GROUP BY ALL),
 b AS (SELECT g.* EXCLUDE (x0, y0, x1, y1), coalesce(m.x0 - 5, g.x0) AS x_left, coalesce(m.y0 - 3, g.y0) AS y_top, CASE WHEN m.x0 IS NULL THEN x1 - g.x0 ELSE 9e2 END AS width, CASE WHEN m.x0 IS NULL THEN y1 - g.y0 ELSE 44e0 END AS height FROM g LEFT JOIN m USING (doc_id, page_no, block_num, par_num, line_num))
 SELECT doc_id, page_no, block_num, par_num, line_num, x_left, y_top, width, height, round(conf, 6) AS conf, round(greatest(height * 85e-2, 10), 6) AS font_size, text FROM b""")
def a5_line_boxes(t: Tables) -> DataFrame:
    return o.ocr_lines(with_lines(t), cjk=True).withColumns({"conf": F.round("conf", 6), "font_size": F.round("font_size", 6)})


@query("""WITH w AS (SELECT *, lag(par_num) OVER k AS pp, lag(line_num) OVER k AS pl, row_number() OVER k AS n FROM ocr_word WHERE trim(text) <> '' WINDOW k AS (PARTITION BY doc_id, page_no ORDER BY block_num, par_num, line_num, word_num))
 SELECT doc_id, page_no, concat(string_agg(concat(CASE WHEN n = 1 THEN '' WHEN pp <> par_num OR pl <> line_num THEN chr(10) ELSE ' ' END, text), '' ORDER BY n), chr(10)) AS text FROM w GROUP BY ALL""")
def a6_ocr_text(t: Tables) -> DataFrame:
    return o.ocr_text(t.ocr_word)


@query("""WITH r AS (SELECT doc_id, page_no, block_num, par_num, line_num, word_num, text, conf, row_number() OVER (PARTITION BY doc_id ORDER BY conf, page_no, block_num, par_num, line_num, word_num) AS rank FROM ocr_word WHERE conf < 75 AND trim(text) <> '') SELECT * FROM r WHERE rank <= 5""")
def t6_worst_suspects(t: Tables) -> DataFrame:
    return o.worst_suspects(t.ocr_word, 5)


@query("""WITH b AS (SELECT doc_id, page_no, string_agg(text, ' ' ORDER BY block_id) AS text FROM text_block WHERE doc_id % 3 <> 0 GROUP BY ALL), w AS (SELECT *, lag(par_num) OVER k AS pp, lag(line_num) OVER k AS pl, row_number() OVER k AS n FROM ocr_word WHERE trim(text) <> '' WINDOW k AS (PARTITION BY doc_id, page_no ORDER BY block_num, par_num, line_num, word_num)),
 x AS (SELECT doc_id, page_no, concat(string_agg(concat(CASE WHEN n = 1 THEN '' WHEN pp <> par_num OR pl <> line_num THEN chr(10) ELSE ' ' END, text), '' ORDER BY n), chr(10)) AS text FROM w GROUP BY ALL)
 SELECT p.doc_id, p.page_no, CASE WHEN b.text IS NULL THEN 'ocr' ELSE 'native' END AS source, coalesce(b.text, x.text, '') AS text FROM page p LEFT JOIN b ON b.doc_id = p.doc_id AND b.page_no = p.page_no LEFT JOIN x ON x.doc_id = p.doc_id AND x.page_no = p.page_no""")
def j15_ocr_fallback(t: Tables) -> DataFrame:
    pages = t.page.select("doc_id", "page_no", F.lit(" ").alias("text"))
    return o.ocr_fallback(pages, t.text_block.filter("doc_id % 3 <> 0"), t.ocr_word)


@query(f"""WITH l AS ({LINES}), r AS (SELECT doc_id, page_no, greatest(x_left * (595e0 / 1654) - 2, 0) AS x, greatest(842 - (y_top + height) * (842e0 / 2339) - 2, 0) AS y, width * (595e0 / 1654) + 4 AS w, height * (842e0 / 2339) + 4 AS h FROM l WHERE contains(lower(text), 'the')),
 b AS (SELECT *, {WIDTH} * font_size AS adv FROM text_block) SELECT DISTINCT b.doc_id, b.page_no, b.block_id FROM b JOIN r ON r.doc_id = b.doc_id AND r.page_no = b.page_no AND b.x < r.x + r.w AND b.x + adv > r.x AND b.y BETWEEN r.y AND r.y + r.h""")
def j16_redact_by_ocr(t: Tables) -> DataFrame:
    blocks = t.text_block.withColumn("advance", text_width(F.col("text"), F.col("font_size")))
    return o.redact_by_ocr(blocks, t.ocr_word, "The").filter("removed").select("doc_id", "page_no", "block_id")


@query("""WITH w AS (SELECT *, max(x_left + width) OVER (PARTITION BY doc_id, page_no) / 2 AS mid FROM ocr_word), s AS (SELECT unnest(generate_series(-20, 20)) AS step), b AS (SELECT doc_id, page_no, step, floor((y_top + (x_left - mid) * tan(radians(step / 2e0))) / 10) AS bin, count(*) AS n FROM w, s GROUP BY ALL),
 v AS (SELECT doc_id, page_no, step, round(sum(n * n) / (max(bin) - min(bin) + 1) - (sum(n) / (max(bin) - min(bin) + 1)) * (sum(n) / (max(bin) - min(bin) + 1)), 9) AS var FROM b GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY var DESC, step) AS k FROM v)
 SELECT doc_id, page_no, step / 2e0 AS angle FROM r WHERE k = 1""")
def a19_skew_estimate(t: Tables) -> DataFrame:
    return o.skew_estimate(t.ocr_word)
