"""Evidence for rules from object rows (doc_id, obj_num, type, dict, stream_len, stream): what objects have, and what the objects that they refer to have.

``dict`` maps keys to values as they are written: names begin with a slash, references are ``12 0 R``, strings in brackets, arrays and inner dictionaries whole. The trailer
is the row of type Trailer, with the header's version as ``Version``. ``stream`` is a stream's decoded text, where there is any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .graph import levels
from .scratch import checkpointed, met_by_sort

#: Keys whose references are followed.
LINKS = ("Root", "Info", "FontDescriptor", "OutputIntents", "DestOutputProfile", "Metadata", "MarkInfo", "ExtGState", "XObject")
FONT_FILES = ("FontFile", "FontFile2", "FontFile3")
#: Page attributes that are inherited.
INHERITED = ("Resources", "MediaBox", "CropBox", "Rotate", "BleedBox", "TrimBox", "ArtBox")
#: Fonts that print rules don't ask to be embedded.
STANDARD_FONTS = ("Helvetica", "Times-Roman", "Courier")
REFERENCE = r"(\d{1,9})\s+\d{1,5}\s+R\b"


def has(*keys: str) -> Column:
    return F.coalesce(F.greatest(*(F.map_contains_key("dict", k) for k in keys), F.lit(False)), F.lit(False))


def value(key: str) -> Column:
    return F.try_element_at("dict", F.lit(key))


def says(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def refers_to(text: Column) -> Column:
    """The numbers of the objects that a value refers to, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)), lambda n: n.cast("int"))


def opacity_below_one() -> Column:
    return says(value("ca").try_cast("double") < 0.999) | says(value("CA").try_cast("double") < 0.999)


def links(objects: DataFrame) -> DataFrame:
    """(doc_id, src, src_type, key, dst, to): references under LINKS with what is known of the object they lead to; a reference to nothing is left out."""
    some = objects.select("doc_id", F.col("obj_num").alias("src"), F.col("type").alias("src_type"), F.explode(F.filter(F.map_entries("dict"), lambda m: m["key"].isin(*LINKS))).alias("m"))
    e = some.select("doc_id", "src", "src_type", "m.key", F.explode(refers_to(F.col("m.value"))).alias("dst"))
    text = F.coalesce("stream", F.lit(""))
    facts = F.struct(
        has(*FONT_FILES).alias("font_file"), value("S").alias("s"), (F.col("stream_len").isNotNull() & says(value("N").isin("1", "3", "4"))).alias("profile"), (text.contains("xpacket") | text.contains("xmpmeta")).alias("xmp"),
        text.contains("pdfaid:part").alias("part"), says(value("Marked") == "true").alias("marked"), says(value("Trapped").isin("/True", "/False")).alias("trapped"),
        (opacity_below_one() | says(~value("BM").isin("/Normal", "/Compatible"))).alias("transparent"), says((value("Subtype") == "/Image") & (value("ColorSpace") == "/DeviceRGB")).alias("rgb_image"),
    )
    return met_by_sort(e, objects.select("doc_id", F.col("obj_num").alias("dst"), facts.alias("to")), ["doc_id", "dst"])


def from_catalog(linked: DataFrame) -> DataFrame:
    """The links of the catalog, the object that the trailer's Root refers to."""
    roots = linked.filter("src_type = 'Trailer' AND key = 'Root'").select("doc_id", F.col("dst").alias("src"))
    return met_by_sort(linked, roots, ["doc_id", "src"], "left_semi")


def catalogs(objects: DataFrame) -> DataFrame:
    roots = objects.filter("type = 'Trailer'").select("doc_id", F.get(refers_to(value("Root")), F.lit(0)).alias("obj_num"))
    return met_by_sort(objects, roots, ["doc_id", "obj_num"], "left_semi")


def intents(objects: DataFrame, linked: DataFrame, standard: str) -> DataFrame:
    """(doc_id, intent, icc): a row for each output intent of the catalog with S = ``standard``, whether it has a profile; intents written in the catalog itself count, too."""
    own = linked.filter("key = 'DestOutputProfile' AND to.profile").select("doc_id", F.col("src").alias("dst"), F.lit(True).alias("_icc")).distinct()
    named = met_by_sort(from_catalog(linked).filter("key = 'OutputIntents'"), own, ["doc_id", "dst"], "left")
    inline = catalogs(objects).filter(F.coalesce(value("OutputIntents"), F.lit("")).rlike(rf"/S\s*/{standard}\b")).select("doc_id", F.lit(True).alias("_inline"))
    named = met_by_sort(named, inline, ["doc_id"], "left")
    # what an inline intent refers to is its profile
    found = named.filter((F.col("to.s") == f"/{standard}") | (F.col("_inline") & F.col("to.profile"))).select("doc_id", F.lit(True).alias("intent"), (says(F.col("_icc")) | F.col("to.profile")).alias("icc"))
    return found.unionByName(inline.select("doc_id", F.lit(True).alias("intent"), F.lit(False).alias("icc")))


def bare_fonts(objects: DataFrame, linked: DataFrame) -> DataFrame:
    """(doc_id, name): fonts without a font file, their descriptor's if they refer to one and else their own."""
    described = linked.filter("key = 'FontDescriptor'").select("doc_id", F.col("src").alias("obj_num"), F.col("to.font_file").alias("_file"))
    fonts = met_by_sort(objects.filter("type = 'Font'"), described, ["doc_id", "obj_num"], "left")
    refers = F.size(F.coalesce(refers_to(value("FontDescriptor")), F.array().cast("array<int>"))) > 0
    embedded = F.when(refers, says(F.col("_file"))).otherwise(has(*FONT_FILES))
    return fonts.filter(~embedded).select("doc_id", F.coalesce(F.ltrim(value("BaseFont"), F.lit("/")), F.lit("Unknown")).alias("name"))


def together(docs: DataFrame, rows: list[DataFrame], flags: list[str]) -> DataFrame:
    """One row a document: for each flag whether any row says so; one aggregate over all evidence."""
    out = docs
    for r in rows:
        out = out.unionByName(r, allowMissingColumns=True)
    return out.groupBy("doc_id").agg(*(F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in flags))


def archival_flags(objects: DataFrame) -> DataFrame:
    """What A13 asks of each document (doc_id): version_ok, bare_font, intent, icc, xmp_part, marked, encrypted, file_id, and the eight constructs it forbids."""
    linked = checkpointed(links(objects))
    version = F.split(value("Version"), r"\.")
    major, minor = F.get(version, F.lit(0)).try_cast("int"), F.get(version, F.lit(1)).try_cast("int")
    group, of = value("Group"), F.col("type")
    own = objects.select(
        "doc_id", ((of == "Trailer") & says((major >= 2) | ((major == 1) & (minor >= 4)))).alias("version_ok"), ((of == "Trailer") & has("Encrypt")).alias("encrypted"), ((of == "Trailer") & says(value("ID").startswith("["))).alias("file_id"),
        has("JS", "JavaScript").alias("javascript"), has("XFA").alias("xfa"), says(value("Subtype") == "/PS").alias("postscript"), has("OPI").alias("opi"), says(value("Filter").rlike(r"/LZWDecode\b")).alias("lzw"),
        (has("SMask") | says(~group.startswith("<<") | group.rlike(r"/S\s*/Transparency\b")) | (says(of == "ExtGState") & opacity_below_one())).alias("transparency"),
        has("EmbeddedFiles").alias("embedded_files"), says(value("F").startswith("(")).alias("external_refs"),
    )
    root = from_catalog(linked)
    rows = [
        intents(objects, linked, "GTS_PDFA1"), bare_fonts(objects, linked).select("doc_id", F.lit(True).alias("bare_font")), root.filter("key = 'Metadata'").select("doc_id", F.expr("to.xmp AND to.part").alias("xmp_part")),
        root.filter("key = 'MarkInfo'").select("doc_id", F.col("to.marked").alias("marked")), catalogs(objects).select("doc_id", says(value("MarkInfo").rlike(r"/Marked\s+true\b")).alias("marked")),
    ]
    return together(own, rows, [*own.columns[1:], "intent", "icc", "bare_font", "xmp_part", "marked"])


def inherited_pages(objects: DataFrame) -> DataFrame:
    """J8 over object rows: pages (doc_id, node_id) with INHERITED attributes of their own or of the nearest ancestor that has them."""
    tree = objects.filter("type IN ('Page', 'Pages')").select("doc_id", F.col("obj_num").alias("node_id"), F.get(refers_to(value("Parent")), F.lit(0)).alias("parent_id"), F.col("type").alias("kind"), *(value(a).alias(a) for a in INHERITED))
    nearest = {a: F.coalesce(F.col(f"c.{a}"), F.col(f"p.{a}")) for a in INHERITED}
    return levels(tree, nearest).filter("kind = 'Page'").select("doc_id", "node_id", *INHERITED)


def print_flags(objects: DataFrame, ops: DataFrame) -> DataFrame:
    """What A14 asks of each document (doc_id): intent, trapped, boxless (a page without a MediaBox, or with neither TrimBox nor BleedBox), bare_font, rgb and transparency.

    Boxes and resources are inherited. Transparency and RGB images count where a page's resources lead to them, at once or by an object of their own; RGB
    operations (``ops``: doc_id, op) count on any page.
    """
    linked = checkpointed(links(objects))
    pages = checkpointed(inherited_pages(objects))
    boxless = F.col("MediaBox").isNull() | (F.col("TrimBox").isNull() & F.col("BleedBox").isNull())
    resources = pages.select("doc_id", F.explode(refers_to(F.col("Resources"))).alias("dst")).distinct()
    by_object = met_by_sort(linked.filter("key IN ('ExtGState', 'XObject')"), resources.withColumnRenamed("dst", "src"), ["doc_id", "src"], "left_semi").select("doc_id", "dst").union(resources).distinct()
    shown = met_by_sort(objects.withColumnRenamed("obj_num", "dst"), by_object, ["doc_id", "dst"], "left_semi").select(
        "doc_id", (opacity_below_one() | says(~value("BM").isin("/Normal", "/Compatible"))).alias("transparency"), says((value("Subtype") == "/Image") & (value("ColorSpace") == "/DeviceRGB")).alias("rgb")
    )
    bare = bare_fonts(objects, linked).filter(~F.col("name").isin(*STANDARD_FONTS)).select("doc_id", F.lit(True).alias("bare_font"))
    trapped = linked.filter("src_type = 'Trailer' AND key = 'Info'").select("doc_id", F.col("to.trapped").alias("trapped"))
    used = ops.select("doc_id", F.col("op").isin("rg", "RG").alias("rgb"))
    rows = [intents(objects, linked, "GTS_PDFX").drop("icc"), trapped, pages.select("doc_id", boxless.alias("boxless")), shown, bare, met_by_sort(used, objects.select("doc_id").distinct(), ["doc_id"], "left_semi")]
    return together(objects.select("doc_id").distinct(), rows, ["intent", "trapped", "boxless", "transparency", "rgb", "bare_font"])
