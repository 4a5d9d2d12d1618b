"""Queries of projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leafwork.functions import colour, geometry as geo, text as tx
from leafwork.operators import text_ops as ops
from leafwork.operators.pages import rotate

from .registry import Tables, query

#: text_width in SQL, of ``text`` and a size
WIDTH = (
    "(length(regexp_replace(text, '[^ ilIj!.:;'']', '', 'g')) * 0.28 + length(regexp_replace(text, '[^frt()\\[\\]]', '', 'g')) * 0.35"
    " + length(regexp_replace(text, '[^mwMW]', '', 'g')) * 0.85 + length(regexp_replace(text, '[^A-Za-z0-9]|[ilIjfrtmwMW]', '', 'g')) * 0.55"
    " + length(regexp_replace(text, '[^\"#$%&*+,\\-/<=>?@\\\\^_`{|}~]', '', 'g')) * 0.40 + length(regexp_replace(text, '[^、。，．]', '', 'g')) * 0.65 + length(regexp_replace(text, '[^「」『』（）]', '', 'g')) * 0.60"
    " + length(regexp_replace(text, '[ -~、。，．「」『』（）]', '', 'g')) * 1.0)"
)


@query("SELECT doc_id, page_no, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS matches, text FROM page_text WHERE contains(text, 'the')")
def p1_search_text(t: Tables) -> DataFrame:
    return ops.search_text(t.page_text, "the")


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 'FEFF' || array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN unicode(c) < 65536 THEN printf('%04X', unicode(c)) ELSE printf('%04X%04X', 55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024) END), '') ELSE hex(encode(text)) END AS raw_hex,
 text AS decoded, text = text AS same FROM documents""")
def p2_text_bytes(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "text", tx.encode_text(F.col("text")).alias("raw"))
    return d.select("doc_id", F.hex("raw").alias("raw_hex"), tx.decode_bytes(F.col("raw")).alias("decoded"), (tx.decode_bytes(F.col("raw")) == F.col("text")).alias("same"))


@query("""SELECT doc_id, replace(replace(replace(replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS xml4,
 replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS xml5,
 replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html5 FROM documents""")
def p3_escape_markup(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", *(tx.escape_markup(F.col("text"), f).alias(f) for f in ("xml4", "xml5", "html5")))


@query(f"SELECT doc_id, round({WIDTH} * 11e0, 4) AS width FROM documents")
def p4_text_width(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(tx.text_width(F.col("text"), 11), 4).alias("width"))


def font_widths(t: Tables) -> DataFrame:
    """A font table from the parts, listed twice: a width for the code of each small letter, from the sizes of the parts that have its number."""
    largest = t.part.groupBy((F.col("p_partkey") % 26).alias("code")).agg(F.max("p_size").alias("size"))
    one = largest.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "size"))), lambda p: (p["size"] * 10 + 200).cast("double")).alias("widths"))
    font = one.select(F.lit("F1").alias("font_name"), F.lit(97).alias("first"), "widths", F.lit(False).alias("composite"), F.lit(1000.0).alias("default"))
    return font.union(font)


@query("""WITH w AS (SELECT p_partkey % 26 + 97 AS code, max(p_size) * 10 + 200 AS w FROM part GROUP BY 1),
 b AS (SELECT doc_id, page_no, block_id, text FROM text_block),
 c AS (SELECT doc_id, page_no, block_id, unnest(string_split(text, '')) AS text FROM b),
 m AS (SELECT c.doc_id, c.page_no, c.block_id, CASE WHEN w.w > 0 THEN w.w / 1000.0 * 11 ELSE """ + WIDTH + """ * 11e0 END AS width FROM c LEFT JOIN w ON ascii(c.text) = w.code AND length(c.text) = 1 WHERE c.text <> '')
 SELECT doc_id, page_no, block_id, round(sum(width), 4) AS width FROM m GROUP BY ALL""")
def p5_width_with_font(t: Tables) -> DataFrame:
    return ops.width_with_font(t.text_block, font_widths(t)).select("doc_id", "page_no", "block_id", F.round("width", 4).alias("width"))


@query("SELECT doc_id, string_agg(CASE WHEN length(word) = 2 THEN chr(966) ELSE chr(CAST(length(word) + 64 AS INTEGER)) END, '' ORDER BY pos) AS text FROM doc_words GROUP BY doc_id")
def p6_dict_decode(t: Tables) -> DataFrame:
    codes = t.doc_words.select("doc_id", "pos", (F.length("word") + 64).alias("code"))
    cmap = t.spark.range(1).select(F.lit(66).alias("code"), F.lit("φ").alias("mapped"))
    return ops.dict_decode(codes, cmap)


HEX = "concat('#', lower(printf('%02x', CAST(trunc(c * 255) AS INTEGER))), lower(printf('%02x', CAST(trunc(m * 255) AS INTEGER))), lower(printf('%02x', CAST(trunc(y * 255) AS INTEGER))))"
PARTS = "SELECT DISTINCT least(c, 1e0) AS c, least(m, 1e0) AS m, least(y, 1e0) AS y FROM ink_op"


@query(f"SELECT c, m, y, {HEX} AS hex, round(trunc(c * 255) / 255, 6) AS r, round(trunc(m * 255) / 255, 6) AS g, round(trunc(y * 255) / 255, 6) AS b FROM ({PARTS}) p")
def p7_parse_color(t: Tables) -> DataFrame:
    p = t.ink_op.select(*(F.least(F.col(c), F.lit(1.0)).alias(c) for c in "cmy")).distinct()
    p = p.withColumn("hex", colour.to_hex(F.col("c"), F.col("m"), F.col("y")))
    rgb = colour.parse_color(F.col("hex"))
    return p.select("c", "m", "y", "hex", *(F.round(rgb[n], 6).alias(n) for n in "rgb"))


@query(f"""WITH p AS ({PARTS}), k AS (SELECT *, 1 - greatest(c, m, y) AS kk FROM p), q AS (SELECT c AS r, m AS g, y AS b,
 CASE WHEN kk >= 1 THEN 0 ELSE CAST(trunc((1 - c - kk) / nullif(1 - kk, 0) * 100) AS INTEGER) END AS c, CASE WHEN kk >= 1 THEN 0 ELSE CAST(trunc((1 - m - kk) / nullif(1 - kk, 0) * 100) AS INTEGER) END AS m,
 CASE WHEN kk >= 1 THEN 0 ELSE CAST(trunc((1 - y - kk) / nullif(1 - kk, 0) * 100) AS INTEGER) END AS y, CASE WHEN kk >= 1 THEN 100 ELSE CAST(trunc(kk * 100) AS INTEGER) END AS k FROM k)
 SELECT r, g, b, c, m, y, k, CAST(trunc(255 * (1 - c / 100) * (1 - k / 100)) AS INTEGER) AS r255, CAST(trunc(255 * (1 - m / 100) * (1 - k / 100)) AS INTEGER) AS g255, CAST(trunc(255 * (1 - y / 100) * (1 - k / 100)) AS INTEGER) AS b255 FROM q""")
def p8_cmyk(t: Tables) -> DataFrame:
    p = t.ink_op.select(*(F.least(F.col(c), F.lit(1.0)).alias(n) for c, n in zip("cmy", "rgb", strict=True))).distinct()
    p = p.withColumn("q", colour.rgb_to_cmyk(F.col("r"), F.col("g"), F.col("b"))).select("r", "g", "b", "q.*")
    back = colour.cmyk_to_rgb(*(F.col(n) for n in "cmyk"))
    return p.select("*", *(back[n].alias(f"{n}255") for n in "rgb"))


@query("""WITH p AS (SELECT doc_id, page_no, op, least(c, 1e0) AS r, least(m, 1e0) AS g, least(y, 1e0) AS b FROM ink_op), k AS (SELECT *, 1 - greatest(r, g, b) AS kk FROM p)
 SELECT doc_id, page_no, CASE WHEN op = 'rg' THEN 'k' ELSE op END AS op, CASE WHEN op <> 'rg' THEN r WHEN kk >= 1 THEN 0 ELSE trunc((1 - r - kk) / nullif(1 - kk, 0) * 100) / 100 END AS a1, CASE WHEN op <> 'rg' THEN g WHEN kk >= 1 THEN 0 ELSE trunc((1 - g - kk) / nullif(1 - kk, 0) * 100) / 100 END AS a2,
 CASE WHEN op <> 'rg' THEN b WHEN kk >= 1 THEN 0 ELSE trunc((1 - b - kk) / nullif(1 - kk, 0) * 100) / 100 END AS a3, CASE WHEN op <> 'rg' THEN NULL WHEN kk >= 1 THEN 1e0 ELSE trunc(kk * 100) / 100 END AS a4 FROM k""")
def p9_convert_rgb_ops(t: Tables) -> DataFrame:
    p = t.ink_op.select("doc_id", "page_no", "op", F.array(*(F.least(F.col(c), F.lit(1.0)) for c in "cmy")).alias("num"))
    q = colour.rgb_to_cmyk(*(F.col("num")[i] for i in range(3)))
    rgb = F.col("op").isin("rg", "RG")
    num = F.when(rgb, F.array(*(q[n] / 100 for n in "cmyk"))).otherwise(F.col("num"))
    return p.select("doc_id", "page_no", F.when(F.col("op") == "rg", "k").when(F.col("op") == "RG", "K").otherwise(F.col("op")).alias("op"), *(F.get(num, F.lit(i)).alias(f"a{i + 1}") for i in range(4)))


@query("""WITH n AS (SELECT doc_id, count(*) AS n FROM page GROUP BY doc_id), s AS (SELECT doc_id, n, generate_series AS i FROM n, generate_series(1, 40) WHERE generate_series <= n)
 SELECT doc_id, string_agg(CAST(i - 1 AS VARCHAR), ',' ORDER BY i) AS pages FROM s WHERE i BETWEEN 1 AND 5 OR i = 8 OR i BETWEEN 11 AND 11 + doc_id % 3 GROUP BY doc_id""")
def p10_parse_page_spec(t: Tables) -> DataFrame:
    n = t.page.groupBy("doc_id").agg(F.count("*").alias("n"))
    spec = F.concat(F.lit("1-5, 8, x, "), (F.col("doc_id") % 3 + 11).cast("string"), F.lit("-11, 4-"))
    return n.select("doc_id", F.array_join(tx.parse_page_spec(spec, F.col("n")), ",").alias("pages"))


@query("""SELECT doc_id, page_no, CASE doc_id % 4 WHEN 0 THEN 'A4 (210 x 297 mm)' WHEN 1 THEN 'Letter (216 x 279 mm)' WHEN 2 THEN '71 x 106 mm' ELSE '176 x 176 mm' END AS label FROM page""")
def p11_paper_size(t: Tables) -> DataFrame:
    return t.page.select("doc_id", "page_no", geo.paper_label(F.col("width"), F.col("height")).alias("label"))


@query("SELECT doc_id, page_no, rotation % 360 AS rotation, CASE WHEN rotation % 180 = 90 THEN height ELSE width END AS view_width, CASE WHEN rotation % 180 = 90 THEN width ELSE height END AS view_height FROM page")
def p12_page_viewport(t: Tables) -> DataFrame:
    v = t.page.select("doc_id", "page_no", geo.viewport(F.col("width"), F.col("height"), F.col("rotation")).alias("v"))
    return v.select("doc_id", "page_no", "v.rotation", F.col("v.width").alias("view_width"), F.col("v.height").alias("view_height"))


@query("""SELECT doc_id, page_no, block_id, CASE rotation WHEN 90 THEN y WHEN 180 THEN width - x - 100 WHEN 270 THEN p.height - y - b.height ELSE x END AS vx,
 CASE rotation WHEN 90 THEN x WHEN 180 THEN y WHEN 270 THEN width - x - 100 ELSE p.height - y - b.height END AS vy, x AS back_x, y AS back_y FROM text_block b JOIN page p USING (doc_id, page_no)""")
def p13_map_box(t: Tables) -> DataFrame:
    b = t.text_block.withColumnRenamed("height", "h").join(t.page, ["doc_id", "page_no"])
    page = [F.col("width"), F.col("height"), F.col("rotation")]
    b = b.withColumn("v", geo.box_to_visual(F.col("x"), F.col("y"), F.lit(100.0), F.col("h"), *page))
    b = b.withColumn("back", geo.box_from_visual(*(F.col(f"v.{n}") for n in ("x", "y", "width", "height")), *page))
    return b.select("doc_id", "page_no", "block_id", F.col("v.x").alias("vx"), F.col("v.y").alias("vy"), F.round("back.x", 6).alias("back_x"), F.round("back.y", 6).alias("back_y"))


MESSAGE = "CASE event_type WHEN 'error' THEN concat('PASSWORD_REQUIRED: ', props) WHEN 'signup' THEN 'SIGNED_PDF_MUTATION_ERROR' WHEN 'click' THEN concat('tool timed out after ', user_id) ELSE props END"


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'PasswordRequired' WHEN 'signup' THEN 'SignedPdfMutationBlocked' WHEN 'click' THEN 'Timeout' ELSE 'General' END AS error_type FROM events")
def p14_classify_error(t: Tables) -> DataFrame:
    return t.events.select("event_id", tx.classify_error(F.expr(MESSAGE)).alias("error_type"))


@query("""SELECT c_custkey, concat('cannot open (/srv/data/', lower(c_mktsegment), '/', c_name, '.pdf), see https://example.org/a/b or C:\\tmp\\', c_custkey, '.txt') AS message, concat('cannot open (', c_name, '.pdf), see https://example.org/a/b or ', c_custkey, '.txt') AS shown FROM customer""")
def p15_strip_paths(t: Tables) -> DataFrame:
    msg = F.concat(F.lit("cannot open (/srv/data/"), F.lower("c_mktsegment"), F.lit("/"), "c_name", F.lit(".pdf), see https://example.org/a/b or C:\\tmp\\"), F.col("c_custkey").cast("string"), F.lit(".txt"))
    return t.customer.select("c_custkey", msg.alias("message"), tx.strip_paths(msg).alias("shown"))


@query("""SELECT c_custkey, CAST(-4 - (CASE WHEN c_custkey % 2 = 0 THEN 2052 ELSE 0 END) - (CASE WHEN c_custkey % 3 = 0 THEN 1288 ELSE 0 END) - (CASE WHEN c_custkey % 5 = 0 THEN 16 ELSE 0 END) - (CASE WHEN c_custkey % 7 = 0 THEN 32 ELSE 0 END) AS INTEGER) AS flags,
 c_custkey % 2 <> 0 AS can_print, c_custkey % 3 <> 0 AS can_modify, c_custkey % 5 <> 0 AS can_copy, c_custkey % 7 <> 0 AS can_annotate FROM customer""")
def p16_permission_bits(t: Tables) -> DataFrame:
    allowed = dict(zip(tx.PERMISSIONS, (F.col("c_custkey") % n != 0 for n in (2, 3, 5, 7)), strict=True))
    d = t.customer.select("c_custkey", tx.permission_flags(allowed).alias("flags"))
    return d.select("*", *(tx.permitted(F.col("flags"), name).alias(f"can_{name}") for name in tx.PERMISSIONS))


@query("""SELECT doc_id, page_no, block_num, par_num, line_num, word_num, round(greatest(x_left * 595 / 1654 - 2, 0), 6) AS x, round(greatest(842 - (y_top + height) * 842 / 2339 - 2, 0), 6) AS y, round(width * 595 / 1654 + 4, 6) AS w, round(height * 842 / 2339 + 4, 6) AS h FROM ocr_word""")
def p17_ocr_box_to_page(t: Tables) -> DataFrame:
    box = geo.pixels_to_points(F.col("x_left"), F.col("y_top"), F.col("width"), F.col("height"), F.lit(1654.0), F.lit(2339.0), F.lit(595.0), F.lit(842.0), pad=2.0)
    keys = ["doc_id", "page_no", "block_num", "par_num", "line_num", "word_num"]
    return t.ocr_word.select(*keys, *(F.round(box[a], 6).alias(b) for a, b in (("x", "x"), ("y", "y"), ("width", "w"), ("height", "h"))))


@query("SELECT annot_id, x AS q1, y + h AS q2, x + w AS q3, y + h AS q4, x AS q5, y AS q6, x + w AS q7, y AS q8 FROM annotation WHERE subtype = 'Highlight'")
def p18_quad_points(t: Tables) -> DataFrame:
    q = geo.quad(*(F.col(c) for c in "xywh"))
    return t.annotation.filter("subtype = 'Highlight'").select("annot_id", *(q[i].alias(f"q{i + 1}") for i in range(8)))


@query("""WITH p AS (SELECT doc_id, pos, CASE WHEN contains(line, chr(9)) THEN string_split(line, chr(9)) WHEN contains(line, '  ') THEN regexp_split_to_array(line, '\\s+') WHEN contains(line, ',') THEN string_split(line, ',') ELSE [line] END AS parts FROM doc_lines),
 q AS (SELECT doc_id, pos, list_filter(list_transform(parts, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS cols FROM p)
 SELECT doc_id, pos, CAST(len(cols) AS BIGINT) AS n_columns, array_to_string(cols, '|') AS cells FROM q""")
def p19_split_columns(t: Tables) -> DataFrame:
    d = t.doc_lines.withColumn("cols", tx.split_columns(F.col("line")))
    return d.select("doc_id", "pos", F.size("cols").cast("long").alias("n_columns"), F.array_join("cols", "|").alias("cells"))


@query("""SELECT 'block' AS kind, concat(doc_id, '-', page_no, '-', block_id) AS id, CASE WHEN block_id % 4 = 3 THEN text ELSE replace(text, 'the', 'THE') END AS text, CASE WHEN contains(text, 'the') AND block_id % 4 <> 3 THEN '#ff0000' ELSE color END AS color FROM text_block
 UNION ALL SELECT 'annotation', annot_id, replace(contents, 'the', 'THE'), NULL FROM annotation""")
def p20_replace_text(t: Tables) -> DataFrame:
    # every fourth block is in a composite font, which is listed twice
    text = t.text_block.withColumn("font_name", F.when(F.col("block_id") % 4 == 3, "F2").otherwise("F1"))
    fonts = t.part.select(F.lit("F2").alias("font_name"), (F.col("p_partkey") > 0).alias("composite")).distinct()
    blocks = ops.replace_text(text, fonts, "the", "THE", color="#ff0000")
    annots = ops.replace_in_annotations(t.annotation, "the", "THE")
    key = F.concat_ws("-", "doc_id", "page_no", "block_id")
    return blocks.select(F.lit("block").alias("kind"), key.alias("id"), "text", "color").union(annots.select(F.lit("annotation"), "annot_id", "contents", F.lit(None).cast("string")))


@query("SELECT doc_id, page_no, block_id, text, CASE WHEN page_no = 0 THEN '#0000ff' ELSE color END AS color, CASE WHEN page_no = 0 THEN 14e0 ELSE font_size END AS font_size FROM text_block")
def p21_restyle_text(t: Tables) -> DataFrame:
    return ops.restyle_text(t.text_block, 0, color="#0000ff", old_color="#000000", size=14).select("doc_id", "page_no", "block_id", "text", "color", "font_size")


@query("""SELECT doc_id, name, subtype, embedded, CASE WHEN lower(name) <> 'brand#1' THEN 'unchanged' WHEN subtype = 'Type0' THEN 'composite' WHEN embedded THEN 'metrics' ELSE 'replaced' END AS status,
 CASE WHEN lower(name) = 'brand#1' AND subtype <> 'Type0' AND NOT embedded THEN 'Courier' ELSE name END AS new_name FROM font""")
def p22_replace_font(t: Tables) -> DataFrame:
    return ops.replace_font(t.font.withColumn("has_widths", F.col("embedded")), " /BRAND#1", "Courier").drop("has_widths")


@query("""SELECT doc_id, page_no, block_id, CASE WHEN block_id % 10 = 1 THEN x + 20 ELSE x END AS x, CASE WHEN block_id % 10 = 1 THEN y - 5 ELSE y END AS y, CASE WHEN block_id % 10 = 2 THEN concat('edited ', text) ELSE text END AS text, font_size FROM text_block WHERE block_id % 10 <> 3""")
def p23_apply_changes(t: Tables) -> DataFrame:
    b = t.text_block
    kind = F.when(F.col("block_id") % 10 == 1, "move").when(F.col("block_id") % 10 == 2, "edit").when(F.col("block_id") % 10 == 3, "delete")
    changes = b.select(*ops.BLOCK, kind.alias("kind"), (F.col("x") + 20).alias("new_x"), (F.col("y") - 5).alias("new_y"), F.concat(F.lit("edited "), "text").alias("new_text")).filter("kind IS NOT NULL")
    return ops.apply_changes(b, changes).select("doc_id", "page_no", "block_id", "x", "y", "text", "font_size")


@query("SELECT doc_id, page_no, (rotation + 270) % 360 AS rotation, concat(CAST(10 AS VARCHAR), ',', CAST(20 AS VARCHAR), ',', CAST(110 AS VARCHAR), ',', CAST(170 AS VARCHAR)) AS crop FROM page")
def p24_rotate_crop(t: Tables) -> DataFrame:
    crop = geo.crop_box(*(F.lit(v) for v in (10, 20, 100, 150))).cast("array<string>")
    return t.page.select("doc_id", "page_no", rotate(F.col("rotation"), -90).alias("rotation"), F.array_join(crop, ",").alias("crop"))


@query("SELECT event_id, strftime(ts, 'D:%Y%m%d%H%M%SZ') AS pdf_date FROM events")
def p25_pdf_date(t: Tables) -> DataFrame:
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return t.events.select("event_id", tx.pdf_date(seconds).alias("pdf_date"))


@query("SELECT doc_id, '1.7' AS version, substr(sha256(concat('1.7|', string_agg(annot_id, ',' ORDER BY annot_id))), 1, 32) AS fingerprint FROM annotation GROUP BY doc_id")
def p26_content_fingerprint(t: Tables) -> DataFrame:
    return ops.content_fingerprint(t.annotation.select("doc_id", F.lit("1.7").alias("version"), F.col("annot_id").alias("object_id")))


@query("SELECT DISTINCT doc_id, page_no FROM paint_op WHERE op IN ('Tj', 'TJ')")
def p27_pages_with_text(t: Tables) -> DataFrame:
    return ops.pages_with_text(t.paint_op)


@query(f"""WITH d AS (SELECT doc_id, page_no, width, height, CAST(page_no + 1 AS VARCHAR) AS text FROM page), w AS (SELECT *, {WIDTH} * 12 AS tw FROM d), p AS (SELECT unnest(['top-left', 'top-center', 'top-right', 'bottom-left', 'bottom-center', 'bottom-right']) AS place)
 SELECT doc_id, page_no, place, round(CASE WHEN place LIKE '%left' THEN 50 WHEN place LIKE '%center' THEN greatest((width - tw) / 2, 10) ELSE greatest(width - 50 - tw, 10) END, 6) AS x, CASE WHEN place LIKE 'top%' THEN height - 30 ELSE 30 END AS y FROM w, p""")
def p28_position_text(t: Tables) -> DataFrame:
    text = (F.col("page_no") + 1).cast("string")
    names = ["top-left", "top-center", "top-right", "bottom-left", "bottom-center", "bottom-right"]
    at = F.explode(F.array(*(F.struct(F.lit(n).alias("place"), geo.anchor(text, 12, F.col("width"), F.col("height"), n).alias("p")) for n in names)))
    return t.page.select("doc_id", "page_no", at.alias("a")).select("doc_id", "page_no", "a.place", F.round("a.p.x", 6).alias("x"), F.col("a.p.y").alias("y"))
