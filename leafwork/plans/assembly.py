"""Queries of page assembly and numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leafwork.operators import pages as p

from .registry import Tables, query


@query("SELECT doc_id, page_no, concat('CASE-', format('{:06d}', page_no + 1)) AS bates, concat('C', format('{:06d}', row_number() OVER (ORDER BY doc_id, page_no) + 999989)) AS corpus_bates FROM page")
def w1_bates_number(t: Tables) -> DataFrame:
    own = p.bates_number(t.page, "CASE-")
    return own.join(p.bates_number(t.page, "C", 999990, corpus=True).withColumnRenamed("bates", "corpus_bates"), ["doc_id", "page_no"])


@query("SELECT doc_id, page_no, CAST(page_no + 10 AS VARCHAR) AS text, greatest(width - 50 - length(CAST(page_no + 10 AS VARCHAR)) * 0.55 * 12, 1e1) AS x, height - 30 AS y FROM page")
def w2_page_numbers(t: Tables) -> DataFrame:
    return p.page_numbers(t.page, "top-right", start=10)


@query("SELECT doc_id, page_no, concat('Page ', page_no + 1, ' of ', count(*) OVER (PARTITION BY doc_id)) AS header, concat('- ', page_no + 1, ' -') AS footer FROM page")
def w3_header_footer(t: Tables) -> DataFrame:
    return p.header_footer(t.page, "Page {page} of {total}", "- {page} -")


@query("WITH n AS (SELECT doc_id, count(*) + 1 AS n FROM page GROUP BY doc_id) SELECT doc_id, CAST(coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_page FROM n")
def w10_merge_offsets(t: Tables) -> DataFrame:
    return p.merge_offsets(t.page.groupBy("doc_id").agg(F.count("*").alias("n")), separator=True)


@query("""WITH n AS (SELECT doc_id, count(*) AS n FROM page GROUP BY doc_id), f AS (SELECT doc_id, n, CAST(coalesce(sum(n + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS f FROM n)
 SELECT p.page_no + f AS page_no, p.doc_id, 'page' AS kind, NULL AS text, NULL AS x FROM page p JOIN f ON f.doc_id = p.doc_id UNION ALL
 SELECT f + n, doc_id, 'separator', concat('doc ', doc_id), CAST(greatest(10, (595 - length(concat('doc ', doc_id)) * 0.55 * 18) / 2) AS DOUBLE) FROM f WHERE doc_id < (SELECT max(doc_id) FROM n)""")
def u1_merge_documents(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"), F.lit(False).alias("encrypted"))
    return p.merge_documents(t.page, docs)[0]


@query("""WITH n AS (SELECT doc_id, count(*) AS n FROM page GROUP BY doc_id), f AS (SELECT doc_id, CAST(coalesce(sum(n + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS f FROM n)
 SELECT concat('doc ', doc_id) AS title, f AS page_no FROM f UNION ALL SELECT concat('page ', page_no), f + page_no FROM page JOIN f USING (doc_id) WHERE page_no % 2 = 1""")
def u1_bookmarks(t: Tables) -> DataFrame:
    """The bookmarks of the merged document: one for each input, and the inputs' own."""
    docs = t.documents.select("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"), F.lit(False).alias("encrypted"))
    own = t.page.filter("page_no % 2 = 1").select("doc_id", F.concat(F.lit("page "), F.col("page_no").cast("string")).alias("title"), "page_no")
    return p.merge_documents(t.page, docs, bookmarks=own)[1].select("title", "page_no")


def _long(t: Tables) -> DataFrame:
    """Pages of ten lines each, so that documents have several."""
    return t.doc_lines.filter("pos % 10 = 0").select("doc_id", F.expr("pos div 10").alias("page_no"), F.col("line").alias("head"))


LONG = "SELECT doc_id, CAST(floor(pos / 10) AS BIGINT) AS page_no, line AS head FROM doc_lines WHERE pos % 10 = 0"
COUNT = f"WITH l AS ({LONG}), n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id)"


def _some(t: Tables, least: int) -> DataFrame:
    return _long(t).groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


@query(f"{COUNT} SELECT doc_id, CASE WHEN n < 2 THEN page_no WHEN page_no = 0 THEN n - 1 ELSE page_no - 1 END AS page_no, head FROM l JOIN n USING (doc_id)")
def t2_move_page(t: Tables) -> DataFrame:
    return p.move_page(_long(t), _some(t, 2).select("doc_id", F.lit(0).alias("src"), (F.col("n") - 1).alias("dst")))


@query(f"{COUNT} SELECT doc_id, CASE WHEN n >= 2 AND page_no > 0 THEN page_no + 1 ELSE page_no END AS page_no, head FROM l JOIN n USING (doc_id) UNION ALL SELECT doc_id, CAST(1 AS BIGINT), head FROM l JOIN n USING (doc_id) WHERE n >= 2 AND page_no = 0")
def t3_duplicate_page(t: Tables) -> DataFrame:
    return p.duplicate_page(_long(t), _some(t, 2).select("doc_id", F.lit(0).alias("src")))


@query(f"{COUNT} SELECT doc_id, CASE WHEN n >= 2 THEN page_no - 1 ELSE page_no END AS page_no, head FROM l JOIN n USING (doc_id) WHERE n < 2 OR page_no > 0")
def t4_delete_page(t: Tables) -> DataFrame:
    return p.delete_page(_long(t), _some(t, 2).select("doc_id", F.lit(0).alias("src")))


@query(f"{COUNT}, s AS (SELECT doc_id, unnest([n - 1, 0, 0, 99999]) AS page_no, generate_subscripts([1, 2, 3, 4], 1) AS pos FROM n) SELECT doc_id, CAST(pos - 1 AS BIGINT) AS page_no, page_no AS source_page FROM s WHERE page_no < 99999")
def t5_extract_pages(t: Tables) -> DataFrame:
    return p.extract_pages(_long(t), _some(t, 1).select("doc_id", F.array(F.col("n") - 1, F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(99999).cast("long")).alias("sel")))


@query("SELECT DISTINCT doc_id, page_no FROM text_block")
def a20_distinct_pages(t: Tables) -> DataFrame:
    return p.distinct_pages(t.text_block.select("doc_id", "page_no"))
