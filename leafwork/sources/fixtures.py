"""Input tables of the document operators, derived from the test tables as chains of common table expressions.

The same text serves Spark and the SQL oracle, but for the explode views, which each engine writes in its own way.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SPARK = {
    "doc_lines": 'SELECT doc_id, CAST(pos AS BIGINT) AS pos, line FROM (SELECT doc_id, posexplode(split(text, chr(10))) AS (pos, line) FROM documents)',
    "doc_words": "SELECT doc_id, CAST(pos AS BIGINT) AS pos, word FROM (SELECT doc_id, posexplode(split(text, concat('[ ', chr(10), ']+'))) AS (pos, word) FROM documents)",
    "page_text": "SELECT doc_id, page_no, listagg(text, '') WITHIN GROUP (ORDER BY seq) AS text FROM paint_op WHERE text IS NOT NULL GROUP BY doc_id, page_no",
}
DUCKDB = {
    "doc_lines": 'SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents',
    "doc_words": "SELECT doc_id, generate_subscripts(regexp_split_to_array(text, concat('[ ', chr(10), ']+')), 1) - 1 AS pos, unnest(regexp_split_to_array(text, concat('[ ', chr(10), ']+'))) AS word FROM documents",
    "page_text": "SELECT doc_id, page_no, string_agg(text, '' ORDER BY seq) AS text FROM paint_op WHERE text IS NOT NULL GROUP BY doc_id, page_no",
}
#: Each view reads test tables and views above it.
VIEWS = {
    'text_block': "SELECT doc_id, CAST(floor(pos / 45) AS BIGINT) AS page_no, pos % 45 AS block_id, line AS text, CAST(50 AS DOUBLE) AS x, CAST(790 - 16 * (pos % 45) AS DOUBLE) AS y, CAST(13.2 AS DOUBLE) AS height, 'F1' AS font_name, CAST(11 AS DOUBLE) AS font_size, '#000000' AS color FROM doc_lines WHERE line <> ''",
    'grid_block': "SELECT doc_id, CAST(floor(pos / 200) AS BIGINT) AS page_no, pos % 200 AS block_id, word AS text, CAST(50 + 100 * (pos % 5) + pos % 3 AS DOUBLE) AS x, CAST(790 - 16 * (CAST(floor(pos / 5) AS BIGINT) % 40) + pos % 4 AS DOUBLE) AS y, CAST(11 AS DOUBLE) AS font_size FROM doc_words WHERE word <> ''",
    'page': 'SELECT doc_id, CAST(floor(pos / 45) AS BIGINT) AS page_no, CAST(CASE doc_id % 4 WHEN 0 THEN 595.28 WHEN 1 THEN 612 WHEN 2 THEN 200 ELSE 500 END AS DOUBLE) AS width, CAST(CASE doc_id % 4 WHEN 0 THEN 841.89 WHEN 1 THEN 792 WHEN 2 THEN 300 ELSE 500 END AS DOUBLE) AS height, CAST((doc_id * 90) % 360 AS BIGINT) AS rotation FROM doc_lines WHERE pos % 45 = 0',
    'paint_op': "SELECT doc_id, page_no, block_id * 5 + k AS seq, CASE k WHEN 0 THEN 'BT' WHEN 1 THEN 'Tf' WHEN 2 THEN CASE WHEN block_id % 2 = 0 THEN 'Tm' ELSE 'Td' END WHEN 3 THEN 'Tj' ELSE 'ET' END AS op, CASE k WHEN 1 THEN font_size WHEN 2 THEN x END AS a, CASE k WHEN 2 THEN y END AS b, CASE k WHEN 3 THEN text END AS text FROM text_block CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) ks",
    'redact_rect': 'SELECT doc_id, CAST(0 AS BIGINT) AS page_no, CAST(100 AS DOUBLE) AS x, CAST(600 AS DOUBLE) AS y, CAST(200 AS DOUBLE) AS w, CAST(100 AS DOUBLE) AS h FROM documents WHERE doc_id % 3 = 0',
    'doc_pair_rev': "SELECT doc_id, pos, CASE WHEN pos % 7 = 3 THEN concat(line, ' rev') ELSE line END AS line FROM doc_lines WHERE pos % 11 <> 10 UNION ALL SELECT doc_id, pos, concat('added line ', CAST(pos AS STRING)) AS line FROM doc_lines WHERE pos % 13 = 5",
    'ocr_word': "SELECT doc_id, CAST(floor(pos / 300) AS BIGINT) AS page_no, 5 AS level, CAST(floor(pos / 100) AS BIGINT) % 3 AS block_num, CAST(floor(pos / 50) AS BIGINT) % 2 AS par_num, CAST(floor(pos / 10) AS BIGINT) % 5 AS line_num, pos % 10 AS word_num, CAST(100 + 60 * (pos % 10) AS DOUBLE) AS x_left, CAST(100 + 20 * (CAST(floor(pos / 10) AS BIGINT) % 30) AS DOUBLE) AS y_top, CAST(10 * length(word) AS DOUBLE) AS width, CAST(18 + pos % 4 AS DOUBLE) AS height, CAST(40 + (doc_id * 31 + pos * 17) % 61 AS DOUBLE) AS conf, word AS text FROM doc_words WHERE word <> ''",
    'ink_op': "SELECT CAST(floor(l_orderkey / 100) AS BIGINT) AS doc_id, l_orderkey % 100 AS page_no, CASE l_returnflag WHEN 'A' THEN 'K' WHEN 'N' THEN 'k' ELSE 'rg' END AS op, l_quantity / 50 AS c, l_discount * 8 AS m, l_tax * 10 AS y, CAST(l_linenumber % 5 AS DOUBLE) / 5 AS k FROM lineitem",
    'font': "SELECT p_partkey % 50 AS doc_id, p_brand AS name, CASE WHEN p_partkey % 9 = 0 THEN 'Type0' ELSE 'TrueType' END AS subtype, p_size % 3 <> 0 AS embedded FROM part",
    'image': "SELECT p_partkey % 50 AS doc_id, p_partkey AS image_id, p_size * 40 AS px_w, p_size * 30 AS px_h, CASE p_partkey % 3 WHEN 0 THEN 'DeviceRGB' WHEN 1 THEN 'DeviceCMYK' ELSE 'ICCBased' END AS colorspace FROM part",
    'placement': 'SELECT p_partkey % 50 AS doc_id, p_partkey AS image_id, CAST(72 * (1 + p_partkey % 6) AS DOUBLE) AS w, CAST(72 * (1 + p_partkey % 4) AS DOUBLE) AS h FROM part WHERE p_partkey % 4 <> 0',
    'annotation': "SELECT conv_id AS doc_id, concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS annot_id, CASE WHEN turn > 0 THEN concat(CAST(conv_id AS STRING), '-', CAST(turn - 1 AS STRING)) END AS in_reply_to, CASE turn % 3 WHEN 0 THEN 'Highlight' WHEN 1 THEN 'Text' ELSE 'Widget' END AS subtype, role AS author, text AS contents, turn % 3 AS page_no, CASE turn % 4 WHEN 0 THEN 'Accepted' WHEN 1 THEN 'Rejected' WHEN 2 THEN 'Completed' ELSE '' END AS status, CAST(50 + 20 * turn AS DOUBLE) AS x, CAST(560 + 30 * turn AS DOUBLE) AS y, CAST(100 AS DOUBLE) AS w, CAST(20 AS DOUBLE) AS h FROM conversations",
    'ref_edge': 'SELECT doc_id, in_reply_to AS src, annot_id AS dst FROM annotation WHERE in_reply_to IS NOT NULL UNION ALL SELECT doc_id, max(annot_id) AS src, min(annot_id) AS dst FROM annotation WHERE doc_id % 2 = 0 GROUP BY doc_id',
    'page_tree': "SELECT r_regionkey AS doc_id, concat('r', CAST(r_regionkey AS STRING)) AS node_id, CAST(NULL AS STRING) AS parent_id, CAST(0 AS BIGINT) AS ordinal, 'Pages' AS kind, CAST(612 AS DOUBLE) AS box_w FROM region UNION ALL SELECT n_regionkey, concat('n', CAST(n_nationkey AS STRING)), concat('r', CAST(n_regionkey AS STRING)), CAST(n_nationkey AS BIGINT), 'Pages', CASE WHEN n_nationkey % 3 = 0 THEN CAST(500 AS DOUBLE) END FROM nation UNION ALL SELECT n_regionkey, concat('c', CAST(c_custkey AS STRING)), concat('n', CAST(n_nationkey AS STRING)), c_custkey, 'Page', CASE WHEN c_custkey % 10 = 0 THEN CAST(420 AS DOUBLE) END FROM customer JOIN nation ON c_nationkey = n_nationkey",
    'struct_tree': "SELECT p_partkey % 20 AS doc_id, p_partkey AS node_id, CASE WHEN p_partkey >= 20 THEN 20 * CAST(floor((CAST(floor(p_partkey / 20) AS BIGINT) - 1) / 2) AS BIGINT) + p_partkey % 20 END AS parent_id, CASE p_size % 4 WHEN 0 THEN 'Figure' WHEN 1 THEN 'Table' WHEN 2 THEN 'TR' ELSE 'P' END AS kind, p_size % 5 = 0 AS has_alt FROM part",
    'form_field': "SELECT o_orderkey AS doc_id, 'status' AS name, 'Ch' AS type, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'priority', 'Tx', o_orderpriority FROM orders UNION ALL SELECT o_orderkey, 'customer', 'Tx', CAST(o_custkey AS STRING) FROM orders",
    'signature': "SELECT o_orderkey AS doc_id, 'Sig1' AS field_name, CASE WHEN o_custkey % 2 = 0 THEN 'signer' END AS signer, CAST(0 AS BIGINT) AS b0, CAST(1000 AS BIGINT) AS b1, 1000 + o_custkey AS b2, CASE WHEN o_orderkey % 20 = 0 THEN 200000 - 1000 - o_custkey ELSE 999999 END AS b3, CAST(200000 AS BIGINT) AS file_size FROM orders WHERE o_orderkey % 10 = 0",
    'doc_flags': "SELECT c_custkey AS doc_id, CASE c_custkey % 4 WHEN 0 THEN '1.3' WHEN 1 THEN '1.4' WHEN 2 THEN '1.7' ELSE '2.0' END AS version, c_custkey % 5 = 0 AS encrypted, c_custkey % 7 = 0 AS has_javascript, c_custkey % 3 = 0 AS has_intent, c_custkey % 6 = 0 AS has_icc, c_custkey % 2 = 0 AS marked, c_custkey % 8 <> 0 AS has_id, c_custkey % 2 = 1 AS has_title, c_custkey % 3 = 1 AS has_lang, c_custkey % 11 = 0 AS has_lzw, c_custkey % 13 = 0 AS has_transparency FROM customer",
    'edit_event': "SELECT user_id AS session_id, event_id AS seq, ts, CASE event_type WHEN 'error' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE 'edit' END AS kind, CAST(floor(value * 1000) AS BIGINT) AS byte_size FROM events",
}


def chain(sql: str, dialect: dict[str, str]) -> list[tuple[str, str]]:
    """The views that ``sql`` reads, directly or through others, those it needs first at the head."""
    known = dialect | {k: v for k, v in VIEWS.items() if k not in dialect}
    found: dict[str, str] = {}

    def visit(text: str) -> None:
        for name in re.findall(r"\w+", text):
            if name in known and name not in found and known[name] is not text:
                visit(known[name])
                found.setdefault(name, known[name])

    visit(sql)
    return list(found.items())


def with_views(sql: str, dialect: dict[str, str], tables: dict[str, str] | None = None) -> str:
    """``sql`` behind the views it needs; ``tables`` says how to read the test tables where they aren't registered."""
    views = chain(sql, dialect)
    text = " ".join([sql, *(v for _, v in views)])
    heads = [(t, read) for t, read in (tables or {}).items() if re.search(rf"\b{t}\b", text)] + views
    if not heads:
        return sql
    ctes = ",\n".join(f"{name} AS ({body})" for name, body in heads)
    recursive = "RECURSIVE " if sql.lstrip().upper().startswith("WITH RECURSIVE") else ""
    own = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", ",\n", sql, flags=re.I) if re.match(r"\s*WITH\b", sql, re.I) else f"\n{sql}"
    return f"WITH {recursive}{ctes}{own}"


def oracle(sql: str) -> str:
    return with_views(sql, DUCKDB)


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table or derived view as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tables = {t: f"SELECT * FROM parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    return spark.sql(with_views(f"SELECT * FROM {name}", SPARK, tables))
