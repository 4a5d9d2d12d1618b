"""Rule sets over documents: every set is one pass of flags per document, then one row a rule."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .objects import archival_flags, print_flags

PAGE = ["doc_id", "page_no"]


def ink_coverage(ops: DataFrame, limit: float = 3.0) -> DataFrame:
    """Per page the largest and the mean sum of inks that k and K set, in percent, and whether it is above the limit; 0 without any."""
    ink = F.when(F.col("op").isin("k", "K"), F.col("c") + F.col("m") + F.col("y") + F.col("k"))
    most = F.coalesce(F.max(ink), F.lit(0.0))
    return ops.groupBy(*PAGE).agg((most * 100).alias("max_coverage"), (F.coalesce(F.avg(ink), F.lit(0.0)) * 100).alias("avg_coverage"), (most > limit).alias("warning"))


def color_usage(ops: DataFrame, images: DataFrame) -> DataFrame:
    """Per page which colour models its operations (op, name) and images (colorspace) use, and whether the document needs conversion to CMYK."""
    op, name = F.col("op"), F.coalesce("name", F.lit(""))
    space = op.isin("cs", "CS")
    seen = ops.select(*PAGE, (op.isin("rg", "RG") | (space & name.contains("RGB"))).alias("rgb"), (op.isin("k", "K") | (space & name.contains("CMYK"))).alias("cmyk"), (op.isin("g", "G") | (space & name.contains("Gray"))).alias("gray"))
    drawn = images.select(*PAGE, F.col("colorspace").contains("RGB").alias("rgb"), F.col("colorspace").contains("CMYK").alias("cmyk"), F.col("colorspace").contains("Gray").alias("gray"))
    page = seen.unionByName(drawn).groupBy(*PAGE).agg(*(F.bool_or(c).alias(c) for c in ("rgb", "cmyk", "gray")))
    return page.withColumn("needs_cmyk", F.bool_or("rgb").over(Window.partitionBy("doc_id")))


def font_inventory(fonts: DataFrame) -> DataFrame:
    """Per document its fonts, how many are embedded, and the names of those that are not, each once, in order."""
    return fonts.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if("embedded").alias("embedded"), F.array_sort(F.collect_set(F.when(~F.col("embedded"), F.col("name")))).alias("not_embedded"))


def preflight(docs: DataFrame, fonts: DataFrame, ops: DataFrame, images: DataFrame, pages: DataFrame) -> DataFrame:
    """A10: issues of each document and its score, 100 less 10 an error and 5 a warning, 0 at least; passed without an error.

    Errors: fonts that aren't embedded, one each. Warnings: both RGB and CMYK, CMYK without a profile, a page with over
    300 % ink, a page with a side under 300 points.
    """
    f = fonts.groupBy("doc_id").agg(F.count_distinct(F.when(~F.col("embedded"), F.col("name"))).alias("unembedded"))
    c = images.groupBy("doc_id").agg(F.bool_or(F.col("colorspace").contains("RGB")).alias("rgb"), F.bool_or(F.col("colorspace").contains("CMYK")).alias("cmyk"), F.bool_or(F.col("colorspace").isin("ICCBased", "DeviceCMYK")).alias("icc"))
    i = ink_coverage(ops).groupBy("doc_id").agg(F.count_if("warning").alias("inky"))
    p = pages.groupBy("doc_id").agg(F.count_if((F.col("width") < 300) | (F.col("height") < 300)).alias("small"))
    rows = docs.select("doc_id")
    for part in (f, c, i, p):
        rows = rows.join(part, "doc_id", "left")
    no, zero = F.lit(False), F.lit(0)
    rgb, cmyk, icc = (F.coalesce(x, no) for x in ("rgb", "cmyk", "icc"))
    errors = F.coalesce("unembedded", zero)
    warnings = (rgb & cmyk).cast("long") + (cmyk & ~icc).cast("long") + F.coalesce("inky", zero) + F.coalesce("small", zero)
    return rows.select("doc_id", errors.alias("errors"), warnings.alias("warnings"), F.greatest(zero, 100 - 10 * errors - 5 * warnings).alias("score"), (errors == 0).alias("passed"))


def signature_report(signatures: DataFrame) -> DataFrame:
    """One row a signature field, its place in the document, name and signer with defaults, and what can be said of it: a complete byte range has an unverified signature, anything else structure alone."""
    complete = F.exists(F.array("b1", "b2", "b3"), lambda v: v > 0) & F.col("b0").isNotNull()
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("field_name")) - 1
    return signatures.select("doc_id", place.alias("index"), F.coalesce("field_name", F.lit("SignatureField")).alias("name"), F.coalesce("signer", F.lit("")).alias("signer"), F.when(F.coalesce(complete, F.lit(False)), "signed_unverified_cms").otherwise("structure_only").alias("status"), F.count("*").over(Window.partitionBy("doc_id")).alias("count"))


def select_signature(report: DataFrame, wanted: DataFrame) -> DataFrame:
    """The signatures with the given index (doc_id, index); one out of range fails the query."""
    rows = wanted.join(report, ["doc_id", "index"], "left")
    return rows.withColumn("status", F.when(F.col("status").isNull(), F.raise_error(F.lit("no signature of that index"))).otherwise(F.col("status")))


def rule_rows(flags: DataFrame, rules: Iterable[tuple[str, Column]]) -> DataFrame:
    """One row (doc_id, rule_id, passed) for each document and rule, of a table with one row a document."""
    wide = flags.select("doc_id", *(F.coalesce(ok, F.lit(False)).alias(name) for name, ok in rules))
    return wide.unpivot(["doc_id"], wide.columns[1:], "rule_id", "passed")


def rule_report(rows: DataFrame) -> DataFrame:
    """Per document the rules passed, those violated, in order of name, and whether it complies."""
    names = lambda ok: F.array_sort(F.collect_list(F.when(F.col("passed") == ok, F.col("rule_id"))))
    return rows.groupBy("doc_id").agg(names(True).alias("passed"), names(False).alias("violations")).withColumn("compliant", F.size("violations") == 0)


#: Constructs that archival conformance forbids.
FORBIDDEN = ("javascript", "xfa", "postscript", "opi", "lzw", "transparency", "embedded_files", "external_refs")


def archival_rules(objects: DataFrame, level: str = "B") -> DataFrame:
    """The 15 rules of archival conformance, level A or B (MarkInfo counts for A alone), a row each for every document, from its object rows (see ``objects``)."""
    rules = [
        ("version", F.col("version_ok")), ("fonts_embedded", ~F.col("bare_font")), ("output_intent", F.col("intent") & F.col("icc")), ("xmp_part", F.col("xmp_part")),
        ("mark_info", F.col("marked") if level == "A" else F.lit(True)), ("no_encryption", ~F.col("encrypted")), ("file_id", F.col("file_id")), *((f"no_{c}", ~F.col(c)) for c in FORBIDDEN),
    ]
    return rule_rows(archival_flags(objects), rules)


def print_rules(objects: DataFrame, ops: DataFrame, standard: str = "X-1a") -> DataFrame:
    """Print exchange rules of X-1a or X-4, a row each for every document: intent, trapped, boxes (inherited), fonts; X-1a forbids RGB and transparency, too. From object rows and drawing operations (doc_id, op)."""
    strict, yes = standard == "X-1a", F.lit(True)
    rules = [
        ("output_intent", F.col("intent")), ("trapped", F.col("trapped")), ("boxes", ~F.col("boxless")), ("fonts_embedded", ~F.col("bare_font")),
        ("no_rgb", ~F.col("rgb") if strict else yes), ("no_transparency", ~F.col("transparency") if strict else yes),
    ]
    return rule_rows(print_flags(objects, ops), rules)


def accessibility_check(docs: DataFrame, structure: DataFrame, widgets: DataFrame) -> DataFrame:
    """Errors: no tags, each Figure without a text; warnings: no title, no language, each Table without rows, each Widget without a tooltip. Score 100 less 20 and 10, 0 at least.

    ``structure``: doc_id, figures_without_alt, tables, rows; ``widgets``: doc_id, has_tooltip.
    """
    w = widgets.groupBy("doc_id").agg(F.count_if(~F.col("has_tooltip")).alias("_bare"))
    d = docs.join(structure, "doc_id", "left").join(w, "doc_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    errors = (~F.col("marked")).cast("long") + n("figures_without_alt")
    warnings = (~F.col("has_title")).cast("long") + (~F.col("has_lang")).cast("long") + F.when((n("tables") > 0) & (n("rows") == 0), 1).otherwise(0) + n("_bare")
    return d.select("doc_id", errors.alias("errors"), warnings.alias("warnings"), F.greatest(F.lit(0), 100 - 20 * errors - 10 * warnings).alias("score"))


def accessibility_fix(docs: DataFrame, title: str = "Untitled", lang: str = "en") -> DataFrame:
    """Documents (title, lang, marked) with defaults where something is missing."""
    fill = lambda c, d: F.when(F.coalesce(F.trim(c), F.lit("")) == "", d).otherwise(F.col(c))
    return docs.withColumns({"title": fill("title", title), "lang": fill("lang", lang), "marked": F.lit(True)})


def fix_tooltips(widgets: DataFrame) -> DataFrame:
    """Widgets (name, tooltip) with their name for a tooltip where it is missing."""
    return widgets.withColumn("tooltip", F.when(F.coalesce("tooltip", F.lit("")) == "", F.col("name")).otherwise(F.col("tooltip")))


#: Object types that sanitizing removes.
REMOVED = ("Info", "Metadata", "JavaScript", "EmbeddedFile", "Thumb")


def sanitize(objects: DataFrame, annots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects (doc_id, type) that stay, and how many of each kind were removed; all annotations go."""
    gone = objects.filter(F.col("type").isin(*REMOVED)).select("doc_id", F.col("type").alias("kind"))
    counts = gone.unionByName(annots.select("doc_id", F.lit("Annotation").alias("kind"))).groupBy("doc_id", "kind").agg(F.count("*").alias("removed"))
    return objects.filter(~F.col("type").isin(*REMOVED)), counts


def bucket_equalize(values: DataFrame, column: str, buckets: int = 256) -> DataFrame:
    """``values`` with ``equalized``, 0 to 255: the cumulative share of their bucket; the lookup has at most ``buckets`` rows and is broadcast."""
    ends = values.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    place = F.least(F.lit(buckets - 1), F.floor((F.col(column) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * buckets))
    rows = values.join(F.broadcast(ends)).withColumn("_b", F.coalesce(place, F.lit(0)))
    hist = rows.groupBy("_b").agg(F.count("*").alias("n"))
    so_far = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    lookup = hist.select("_b", F.floor(F.sum("n").over(so_far) * 255 / F.sum("n").over(Window.partitionBy())).cast("long").alias("equalized"))
    return rows.join(F.broadcast(lookup), "_b").select(*values.columns, "equalized")


