"""Queries of rule sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leafwork.operators import graph, pipeline, rules as r

from .registry import Tables, query

INK = "CASE WHEN op IN ('k', 'K') THEN c + m + y + k END"


@query(f"SELECT doc_id, page_no, round(coalesce(max({INK}), 0) * 100, 6) AS max_coverage, round(coalesce(avg({INK}), 0) * 100, 6) AS avg_coverage, coalesce(max({INK}), 0) > 3 AS warning FROM ink_op GROUP BY ALL")
def a7_ink_coverage(t: Tables) -> DataFrame:
    return r.ink_coverage(t.ink_op).withColumns({c: F.round(c, 6) for c in ("max_coverage", "avg_coverage")})


@query("""WITH u AS (SELECT doc_id, page_no, op = 'rg' AS rgb, op = 'k' OR (op = 'K' AND page_no % 7 <> 1) AS cmyk, op = 'K' AND page_no % 7 = 1 AS gray FROM ink_op UNION ALL SELECT doc_id, CAST(0 AS BIGINT), contains(colorspace, 'RGB'), contains(colorspace, 'CMYK'), false FROM image), p AS (SELECT doc_id, page_no, bool_or(rgb) AS rgb, bool_or(cmyk) AS cmyk, bool_or(gray) AS gray FROM u GROUP BY ALL)
 SELECT *, bool_or(rgb) OVER (PARTITION BY doc_id) AS needs_cmyk FROM p""")
def a8_color_usage(t: Tables) -> DataFrame:
    # every seventh page names colour spaces in place of colours
    by_name = F.col("page_no") % 7 == 1
    named = F.when(F.col("op") == "rg", "CalRGB").when(F.col("op") == "k", "DeviceCMYK").otherwise("DeviceGray")
    ops = t.ink_op.select("doc_id", "page_no", F.when(by_name & (F.col("op") == "K"), "CS").when(by_name, "cs").otherwise(F.col("op")).alias("op"), F.when(by_name, named).alias("name"))
    return r.color_usage(ops, t.image.select("doc_id", F.lit(0).cast("long").alias("page_no"), "colorspace"))


@query("SELECT doc_id, count(*) AS total, count(*) FILTER (embedded) AS embedded, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (NOT embedded), '') AS not_embedded FROM font GROUP BY doc_id")
def a9_font_inventory(t: Tables) -> DataFrame:
    return r.font_inventory(t.font).withColumn("not_embedded", F.array_join("not_embedded", ","))


@query(f"""WITH f AS (SELECT doc_id, count(DISTINCT name) FILTER (NOT embedded) AS e FROM font GROUP BY doc_id), c AS (SELECT doc_id, bool_or(contains(colorspace, 'RGB')) AS rgb, bool_or(contains(colorspace, 'CMYK')) AS cmyk FROM image GROUP BY doc_id),
 i AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, page_no FROM ink_op GROUP BY ALL HAVING max({INK}) > 3) x GROUP BY doc_id), p AS (SELECT doc_id, count(*) AS n FROM page WHERE width < 300 OR height < 300 GROUP BY doc_id),
 s AS (SELECT d.doc_id, coalesce(f.e, 0) AS errors, CASE WHEN rgb AND cmyk THEN 1 ELSE 0 END + coalesce(i.n, 0) + coalesce(p.n, 0) AS warnings FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id LEFT JOIN p ON p.doc_id = d.doc_id)
 SELECT doc_id, errors, warnings, greatest(0, 100 - 10 * errors - 5 * warnings) AS score, errors = 0 AS passed FROM s""")
def a10_preflight(t: Tables) -> DataFrame:
    return r.preflight(t.documents, t.font, t.ink_op, t.image, t.page)


@query("""SELECT doc_id, CAST(0 AS BIGINT) AS "index", field_name AS name, coalesce(signer, '') AS signer, 'signed_unverified_cms' AS status, CAST(1 AS BIGINT) AS "count" FROM signature""")
def a12_signature_report(t: Tables) -> DataFrame:
    report = r.signature_report(t.signature)
    return r.select_signature(report, t.signature.select("doc_id", F.lit(0).alias("index")).distinct()).withColumn("index", F.col("index").cast("long"))


#: Flags that the fixture lacks, made of the document's number.
MORE = {"has_xmp": 2, "has_xfa": 17, "has_postscript": 19, "has_opi": 23, "has_embedded_files": 29, "has_external_refs": 31}


def objects_of(t: Tables) -> DataFrame:
    """Object rows of documents, a catalog, an information dictionary, a page tree, fonts and whatever the document's flags call for, each flag in more than one spelling."""
    # a row of flags is small and makes many objects, so rows are dealt out first
    f, k = t.doc_flags.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "doc_id"), F.col("doc_id")
    every = lambda n: k % n == 0
    some = lambda c, key, v: (c, key, v)
    made: list[Column] = []

    def put(num: int, kind: str, *entries: tuple[Column | None, str, Column | str], when: Column | None = None, length: int | None = None, stream: Column | str | None = None) -> None:
        pairs = [F.when(F.lit(True) if c is None else c, F.struct(F.lit(key).alias("key"), (v if isinstance(v, Column) else F.lit(v)).alias("value"))) for c, key, v in entries]
        whole = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p.isNotNull())) if pairs else F.create_map().cast("map<string,string>")
        text = stream if isinstance(stream, Column) else F.lit(stream).cast("string")
        row = F.struct(F.lit(num).alias("obj_num"), F.lit(kind).alias("type"), whole.alias("dict"), F.lit(length).cast("long").alias("stream_len"), text.alias("stream"))
        made.append(F.when(F.lit(True) if when is None else when, row))

    put(0, "Trailer", some(None, "Root", "1 0 R"), some(None, "Info", "2 0 R"), some(None, "Version", F.col("version")), some(F.col("encrypted"), "Encrypt", "<< /V 1 >>"), some(F.col("has_id"), "ID", "[<aa> <bb>]"))
    intents = F.when(every(2), "[10 0 R 11 0 R]").otherwise("[<< /S /GTS_PDFA1 /DestOutputProfile 12 0 R >> 11 0 R]")
    put(1, "Catalog", some(None, "Pages", "3 0 R"), some(F.col("marked"), "MarkInfo", F.when(every(4), "<< /Marked true >>").otherwise("9 0 R")), some(F.col("has_intent"), "OutputIntents", intents), some(None, "Metadata", "13 0 R"), some(every(29), "Names", "14 0 R"))
    put(2, "Info", some(every(5), "Trapped", F.when(every(2), "/True").otherwise("/False")), some(~every(5), "Trapped", "/Unknown"))
    put(3, "Pages", some(None, "Kids", "[4 0 R 5 0 R]"), some(None, "MediaBox", "[0 0 595 842]"), some(every(3), "TrimBox", "[0 0 500 800]"), some(every(7), "Resources", "30 0 R"))
    put(4, "Pages", some(None, "Parent", "3 0 R"), some(k % 3 == 1, "BleedBox", "[0 0 590 840]"))
    put(5, "Page", some(None, "Parent", "4 0 R"))
    put(6, "Page", some(None, "Parent", "3 0 R"), some(k % 3 == 1, "TrimBox", "[0 0 1 1]"), some(every(9), "Resources", "<< /ExtGState << /G 32 0 R >> >>"))
    put(9, "", some(None, "Marked", "true"))
    put(10, "OutputIntent", some(None, "S", "/GTS_PDFA1"), some(None, "DestOutputProfile", "12 0 R"))
    put(11, "OutputIntent", some(None, "S", F.when(every(4), "/GTS_PDFX").otherwise("/Other")))
    put(12, "", some(F.col("has_icc"), "N", "3"), length=10)
    put(13, "Metadata", length=20, stream=F.when(k % 2 != 0, "<?xpacket?> pdfaid:part 1").otherwise("<x:xmpmeta>"))
    put(14, "", some(None, "EmbeddedFiles", "15 0 R"), when=every(29))
    put(20, "Font", some(None, "BaseFont", "/One"), some(None, "FontDescriptor", "21 0 R"))
    put(21, "FontDescriptor", some(~every(10), "FontFile2", "22 0 R"))
    put(23, "Font", some(None, "BaseFont", "/Courier"), when=every(11))
    put(24, "Font", some(None, "FontFile", "22 0 R"))
    put(30, "", some(None, "ExtGState", "<< /G0 31 0 R >>"), some(None, "XObject", "<< /I 33 0 R >>"))
    put(31, "ExtGState", some(F.col("has_transparency"), "ca", "0.5"), some(None, "CA", "1.0"))
    put(32, "", some(None, "BM", "/Multiply"))
    put(33, "XObject", some(None, "Subtype", "/Image"), some(None, "ColorSpace", F.when(every(14), "/DeviceRGB").otherwise("/DeviceGray")), length=5)
    put(40, "Action", some(every(2), "JS", "(alert)"), some(~every(2), "JavaScript", "41 0 R"), when=F.col("has_javascript"))
    put(42, "", some(None, "XFA", "[]"), when=every(17))
    put(43, "XObject", some(None, "Subtype", "/PS"), when=every(19))
    put(44, "", some(None, "OPI", "<< >>"), when=every(23))
    put(45, "", some(None, "Filter", F.when(every(2), "/LZWDecode").otherwise("[/ASCII85Decode /LZWDecode]")), when=F.col("has_lzw"), length=9)
    put(46, "", some(None, "F", F.when(every(31), "(other.pdf)").otherwise("/Name")))
    put(47, "", some(None, "Group", "<< /S /Other >>"))
    return f.select("doc_id", F.explode(F.filter(F.array(*made), lambda o: o.isNotNull())).alias("o")).select("doc_id", "o.*")


@query("""WITH v AS (SELECT doc_id, list_filter([CASE WHEN version = '1.3' THEN 'version' END, CASE WHEN doc_id % 10 = 0 OR doc_id % 11 = 0 THEN 'fonts_embedded' END, CASE WHEN NOT (has_intent AND has_icc) THEN 'output_intent' END, CASE WHEN doc_id % 2 = 0 THEN 'xmp_part' END, CASE WHEN NOT marked THEN 'mark_info' END,
 CASE WHEN encrypted THEN 'no_encryption' END, CASE WHEN NOT has_id THEN 'file_id' END, CASE WHEN has_javascript THEN 'no_javascript' END, CASE WHEN doc_id % 17 = 0 THEN 'no_xfa' END, CASE WHEN doc_id % 19 = 0 THEN 'no_postscript' END, CASE WHEN doc_id % 23 = 0 THEN 'no_opi' END, CASE WHEN has_lzw THEN 'no_lzw' END,
 CASE WHEN has_transparency THEN 'no_transparency' END, CASE WHEN doc_id % 29 = 0 THEN 'no_embedded_files' END, CASE WHEN doc_id % 31 = 0 THEN 'no_external_refs' END], lambda x: x IS NOT NULL) AS l FROM doc_flags)
 SELECT doc_id, CAST(15 - len(l) AS BIGINT) AS n_passed, array_to_string(list_sort(l), ',') AS violations, len(l) = 0 AS compliant FROM v""")
def a13_archival_rules(t: Tables) -> DataFrame:
    report = r.rule_report(r.archival_rules(objects_of(t), "A"))
    return report.select("doc_id", F.size("passed").cast("long").alias("n_passed"), F.array_join("violations", ",").alias("violations"), "compliant")


@query("""WITH o AS (SELECT doc_id, bool_or(op = 'rg') AS rg FROM ink_op GROUP BY doc_id), d AS (SELECT f.doc_id, has_intent AND f.doc_id % 4 = 0 AS intent, f.doc_id % 5 = 0 AS trapped, f.doc_id % 3 <> 2 AS boxes, f.doc_id % 10 <> 0 AS fonts, f.doc_id % 14 = 0 OR coalesce(rg, false) AS rgb, (has_transparency AND f.doc_id % 7 = 0) OR f.doc_id % 9 = 0 AS trans
 FROM doc_flags f LEFT JOIN o ON o.doc_id = f.doc_id), s AS (SELECT 'X-1a' AS standard UNION ALL SELECT 'X-4'), v AS (SELECT doc_id, standard, list_filter([CASE WHEN NOT intent THEN 'output_intent' END, CASE WHEN NOT trapped THEN 'trapped' END, CASE WHEN NOT boxes THEN 'boxes' END, CASE WHEN NOT fonts THEN 'fonts_embedded' END,
 CASE WHEN standard = 'X-1a' AND rgb THEN 'no_rgb' END, CASE WHEN standard = 'X-1a' AND trans THEN 'no_transparency' END], lambda x: x IS NOT NULL) AS l FROM d, s)
 SELECT doc_id, standard, array_to_string(list_sort(l), ',') AS violations, len(l) = 0 AS compliant FROM v""")
def a14_print_rules(t: Tables) -> DataFrame:
    objects = objects_of(t)
    of = lambda s: r.rule_report(r.print_rules(objects, t.ink_op, s)).select("doc_id", F.lit(s).alias("standard"), F.array_join("violations", ",").alias("violations"), "compliant")
    return of("X-1a").unionByName(of("X-4"))


WALK = """WITH RECURSIVE walk AS (SELECT doc_id, node_id, kind, has_alt FROM struct_tree WHERE parent_id IS NULL UNION ALL SELECT s.doc_id, s.node_id, s.kind, s.has_alt FROM struct_tree s JOIN walk w ON s.doc_id = w.doc_id AND s.parent_id = w.node_id),
 g AS (SELECT doc_id, count(*) FILTER (kind = 'Figure' AND NOT has_alt) AS figures_without_alt, count(*) FILTER (kind = 'Table') AS tables, count(*) FILTER (kind = 'TR') AS "rows" FROM walk GROUP BY doc_id)"""


@query(WALK + """, w AS (SELECT doc_id, count(*) AS n FROM annotation WHERE subtype = 'Widget' AND length(contents) % 2 = 0 GROUP BY doc_id), e AS (SELECT d.doc_id, CASE WHEN marked THEN 0 ELSE 1 END + coalesce(figures_without_alt, 0) AS errors, CASE WHEN has_title THEN 0 ELSE 1 END + CASE WHEN has_lang THEN 0 ELSE 1 END + CASE WHEN coalesce(tables, 0) > 0 AND coalesce(g."rows", 0) = 0 THEN 1 ELSE 0 END + coalesce(n, 0) AS warnings FROM doc_flags d LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN w ON w.doc_id = d.doc_id)
 SELECT doc_id, errors, warnings, greatest(0, 100 - 20 * errors - 10 * warnings) AS score FROM e""")
def a15_accessibility_check(t: Tables) -> DataFrame:
    widgets = t.annotation.filter("subtype = 'Widget'").select("doc_id", (F.length("contents") % 2 == 1).alias("has_tooltip"))
    return r.accessibility_check(t.doc_flags, graph.structure_walk(t.struct_tree), widgets)


@query("SELECT doc_id, CASE WHEN has_title THEN concat('doc ', doc_id) ELSE 'Untitled' END AS title, CASE WHEN has_lang THEN 'de' ELSE 'en' END AS lang, true AS marked FROM doc_flags")
def a16_accessibility_fix(t: Tables) -> DataFrame:
    d = t.doc_flags.select("doc_id", F.when(F.col("has_title"), F.concat(F.lit("doc "), F.col("doc_id").cast("string"))).alias("title"), F.when(F.col("has_lang"), "de").otherwise(" ").alias("lang"), "marked")
    return r.accessibility_fix(d)


@query("SELECT annot_id, CASE WHEN length(contents) % 2 = 0 THEN annot_id ELSE contents END AS tooltip FROM annotation WHERE subtype = 'Widget'")
def a16_fix_tooltips(t: Tables) -> DataFrame:
    w = t.annotation.filter("subtype = 'Widget'").select("annot_id", F.col("annot_id").alias("name"), F.when(F.length("contents") % 2 == 1, F.col("contents")).alias("tooltip"))
    return r.fix_tooltips(w).select("annot_id", "tooltip")


@query("""SELECT doc_id, CASE WHEN subtype = 'Text' THEN 'Metadata' ELSE 'JavaScript' END AS kind, count(*) AS removed FROM annotation WHERE subtype <> 'Widget' GROUP BY ALL UNION ALL SELECT doc_id, 'Annotation', count(*) FROM annotation GROUP BY doc_id""")
def a17_sanitize(t: Tables) -> DataFrame:
    objects = t.annotation.select("doc_id", F.when(F.col("subtype") == "Text", "Metadata").when(F.col("subtype") == "Widget", "Page").otherwise("JavaScript").alias("type"))
    return r.sanitize(objects, t.annotation)[1]


@query("""WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), b AS (SELECT l_orderkey, l_linenumber, l_extendedprice, least(255, floor((l_extendedprice - lo) / (hi - lo) * 256)) AS b FROM lineitem, e), h AS (SELECT b, count(*) AS n FROM b GROUP BY b),
 c AS (SELECT b, CAST(floor(sum(n) OVER (ORDER BY b) * 255 / sum(n) OVER ()) AS BIGINT) AS equalized FROM h) SELECT l_orderkey, l_linenumber, l_extendedprice, equalized FROM b JOIN c USING (b)""")
def a18_bucket_equalize(t: Tables) -> DataFrame:
    return r.bucket_equalize(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice")


@query("SELECT doc_id, NOT bool_or(NOT embedded) AS allowed, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (NOT embedded), '') AS refused_for FROM font GROUP BY doc_id")
def x3_pipeline_gate(t: Tables) -> DataFrame:
    return pipeline.pipeline_gate(t.font).withColumn("refused_for", F.array_join("refused_for", ","))
