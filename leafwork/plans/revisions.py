"""Queries of revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leafwork.operators import revisions as r
from leafwork.sources import writers

from .registry import Tables, query
from .scans import through_files

#: Both revisions laid out as blocks, those of every fourth document so close that a block is near its neighbours; characters beyond ASCII are question marks, as the oracle's edit distance counts bytes.
LAID = "doc_id, CAST(floor(pos / 45) AS BIGINT) AS page_no, {id} AS block_id, regexp_replace(line, '[^\\x00-\\x7F]', '?', 'g') AS text, 5e1 AS x, CAST(790 - CASE WHEN doc_id % 4 = 1 THEN 8 ELSE 16 END * (pos % 45) AS DOUBLE) AS y, CAST(5 * length(line) AS DOUBLE) AS width, CAST(13 + pos % 3 AS DOUBLE) AS height"
ADDED = "CASE WHEN line = concat('added line ', pos) THEN 1 ELSE 0 END"
ORIG = f"SELECT {LAID.format(id='pos * 2')} FROM doc_lines WHERE line <> ''"
REV = f"SELECT {LAID.format(id=f'pos * 2 + {ADDED}')} FROM doc_pair_rev WHERE line <> ''"


def _laid(lines: DataFrame, added: bool) -> DataFrame:
    pos = F.col("pos")
    extra = F.when(F.col("line") == F.concat(F.lit("added line "), pos.cast("string")), 1).otherwise(0) if added else F.lit(0)
    text = F.regexp_replace("line", r"[^\x00-\x7F]", "?").alias("text")
    return lines.filter("line <> ''").select("doc_id", F.expr("pos div 45").alias("page_no"), (pos * 2 + extra).alias("block_id"), text, F.lit(50.0).alias("x"), (790 - F.when(F.col("doc_id") % 4 == 1, 8).otherwise(16) * (pos % 45)).cast("double").alias("y"), (5 * F.length("line")).cast("double").alias("width"), (13 + pos % 3).cast("double").alias("height"))


def sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    return _laid(t.doc_lines, False), _laid(t.doc_pair_rev, True)


TRIM = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
EXACT = f"""WITH RECURSIVE o AS (SELECT *, {TRIM} AS k, row_number() OVER (PARTITION BY doc_id, page_no, {TRIM} ORDER BY block_id) AS nth FROM ({ORIG}) a), r AS (SELECT *, {TRIM} AS k, row_number() OVER (PARTITION BY doc_id, page_no, {TRIM} ORDER BY block_id) AS nth FROM ({REV}) b),
 e AS (SELECT coalesce(o.doc_id, r.doc_id) AS doc_id, coalesce(o.page_no, r.page_no) AS page_no, o.block_id AS orig_block_id, r.block_id AS rev_block_id, o.text AS orig_text, r.text AS rev_text, o.x AS orig_x, o.y AS orig_y, r.x AS rev_x, r.y AS rev_y, o.width AS orig_width, o.height AS orig_height, r.width AS rev_width, r.height AS rev_height
 FROM o FULL JOIN r ON o.doc_id = r.doc_id AND o.page_no = r.page_no AND o.k = r.k AND o.nth = r.nth)"""
RANKS = "row_number() OVER (PARTITION BY doc_id, page_no, orig_block_id ORDER BY sim DESC, rev_block_id) AS ra, row_number() OVER (PARTITION BY doc_id, page_no, rev_block_id ORDER BY sim DESC, orig_block_id) AS rb"
#: Pairs that are each other's best, round by round, until no pair of two free blocks is left.
FUZZY = f"""{EXACT}, n AS (SELECT a.doc_id, a.page_no, a.orig_block_id, b.rev_block_id, a.orig_text, b.rev_text, b.rev_x, b.rev_y, greatest(a.orig_width, b.rev_width) AS width, greatest(a.orig_height, b.rev_height) AS height, 1 - levenshtein(regexp_replace(a.orig_text, '^\\s+|\\s+$', '', 'g'), regexp_replace(b.rev_text, '^\\s+|\\s+$', '', 'g')) / CAST(greatest(length(regexp_replace(a.orig_text, '^\\s+|\\s+$', '', 'g')), length(regexp_replace(b.rev_text, '^\\s+|\\s+$', '', 'g'))) AS DOUBLE) AS sim, abs(a.orig_y - b.rev_y) AS dy
 FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.page_no = b.page_no WHERE a.rev_block_id IS NULL AND b.orig_block_id IS NULL AND abs(a.orig_y - b.rev_y) < 12),
 c AS (SELECT * FROM n WHERE sim > 0.3 OR dy < 6),
 m AS (SELECT *, {RANKS} FROM c UNION ALL SELECT * EXCLUDE (ra, rb, oa, ob), {RANKS} FROM (SELECT *, bool_or(ra = 1 AND rb = 1) OVER (PARTITION BY doc_id, page_no, orig_block_id) AS oa, bool_or(ra = 1 AND rb = 1) OVER (PARTITION BY doc_id, page_no, rev_block_id) AS ob FROM m) x WHERE NOT oa AND NOT ob),
 p AS (SELECT * FROM m WHERE ra = 1 AND rb = 1)"""
DIFF = f"""{FUZZY}, d AS (SELECT doc_id, page_no, 'modified' AS kind, orig_text AS original_text, rev_text AS revised_text, rev_x AS x, rev_y AS y, width, height, rev_block_id AS seq FROM p
 UNION ALL SELECT doc_id, page_no, 'deleted', orig_text, '', orig_x, orig_y, orig_width, orig_height, orig_block_id FROM e WHERE rev_block_id IS NULL AND NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = e.doc_id AND p.page_no = e.page_no AND p.orig_block_id = e.orig_block_id)
 UNION ALL SELECT doc_id, page_no, 'added', '', rev_text, rev_x, rev_y, rev_width, rev_height, rev_block_id FROM e WHERE orig_block_id IS NULL AND NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = e.doc_id AND p.page_no = e.page_no AND p.rev_block_id = e.rev_block_id))"""


@query(f"{EXACT} SELECT doc_id, page_no, orig_block_id, rev_block_id FROM e")
def j5_match_exact(t: Tables) -> DataFrame:
    return r.match_blocks_exact(*sides(t)).select("doc_id", "page_no", "orig_block_id", "rev_block_id")


@query(f"{FUZZY} SELECT doc_id, page_no, orig_block_id, rev_block_id, round(sim, 6) AS sim FROM p")
def j6_match_fuzzy(t: Tables) -> DataFrame:
    left, right = r.without_exact(*sides(t))
    return r.match_blocks_fuzzy(left, right).select("doc_id", "page_no", "orig_block_id", "rev_block_id", F.round("sim", 6).alias("sim"))


@query(f"{DIFF} SELECT * FROM d")
def j6_diff(t: Tables) -> DataFrame:
    return r.diff(*sides(t))


@query(f"{DIFF} SELECT doc_id, page_no, count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'deleted') AS deleted, count(*) FILTER (kind = 'modified') AS modified, count(*) AS total FROM d GROUP BY ROLLUP (doc_id, page_no)")
def a2_diff_summary(t: Tables) -> DataFrame:
    return r.diff_summary(r.diff(*sides(t)))


@query("""WITH a AS (SELECT doc_id, CAST(floor(pos / 10) AS BIGINT) AS page_no, string_agg(line, chr(10) ORDER BY pos) AS text FROM doc_lines GROUP BY ALL), b AS (SELECT doc_id, CAST(floor(pos / 10) AS BIGINT) AS page_no, string_agg(line, chr(10) ORDER BY pos, line) AS text FROM doc_pair_rev GROUP BY ALL)
 SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, count(*) FILTER (a.text = b.text) AS same, count(*) FILTER (a.text <> b.text) AS different, count(b.text) - count(a.text) AS page_count_diff, CAST(coalesce(sum(length(b.text)), 0) - coalesce(sum(length(a.text)), 0) AS BIGINT) AS size_diff
 FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.page_no = b.page_no GROUP BY 1""")
def j7_compare_pages(t: Tables) -> DataFrame:
    paged = lambda d: d.groupBy("doc_id", F.expr("pos div 10").alias("page_no")).agg(writers.in_order(F.col("line"), "\n", "pos", "line").alias("text"))
    return r.compare_pages(paged(t.doc_lines), paged(t.doc_pair_rev))


@query(f"SELECT doc_id, page_no, {TRIM} AS text FROM ({REV}) r EXCEPT ALL SELECT doc_id, page_no, {TRIM} FROM ({ORIG}) o")
def u2_added_blocks(t: Tables) -> DataFrame:
    return r.added_blocks(*sides(t))


@query(f"SELECT doc_id, page_no, {TRIM} AS text FROM ({ORIG}) o EXCEPT ALL SELECT doc_id, page_no, {TRIM} FROM ({REV}) r")
def u2_deleted_blocks(t: Tables) -> DataFrame:
    orig, rev = sides(t)
    return r.added_blocks(rev, orig)


@query(f"SELECT doc_id, page_no, {TRIM} AS text FROM ({ORIG}) o INTERSECT ALL SELECT doc_id, page_no, {TRIM} FROM ({REV}) r")
def u3_unchanged_blocks(t: Tables) -> DataFrame:
    return r.unchanged_blocks(*sides(t))


ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
GONE, NEW = f"'<del>' || {ESCAPED.format('original_text')} || '</del>'", f"'<ins>' || {ESCAPED.format('revised_text')} || '</ins>'"


@query(f"""{DIFF}, rows_of AS (SELECT doc_id, page_no, seq, kind, concat('<div class="diff-row ', kind, '">', CASE kind WHEN 'modified' THEN {GONE} || ' &rarr; ' || {NEW} WHEN 'added' THEN {NEW} ELSE {GONE} END, '</div>') AS row_ FROM d),
 pages_of AS (SELECT doc_id, page_no, string_agg(row_, '' ORDER BY seq, row_) AS rows_, count(*) FILTER (kind = 'added') AS a, count(*) FILTER (kind = 'deleted') AS g, count(*) FILTER (kind = 'modified') AS m FROM rows_of GROUP BY ALL)
 SELECT doc_id, concat('<!DOCTYPE html><html><body><p>+ ', sum(a), ' - ', sum(g), ' ~ ', sum(m), '</p>', string_agg(concat('<h3>Page ', page_no + 1, '</h3>', rows_), '' ORDER BY page_no), '</body></html>') AS html FROM pages_of GROUP BY doc_id""")
def s12_diff_report(t: Tables) -> DataFrame:
    return through_files(t, writers.diff_report_html(r.diff(*sides(t))), "json", "doc_id")
