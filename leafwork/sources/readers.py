"""Sources: byte probes, object salvage, OCR and annotation files, HTML and plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leafwork.functions.text import text_lines

#: Markers by flag, each in all its spellings.
FLAGS = {
    "has_xref_stream": ("/Type /XRef", "/Type/XRef"), "linearized": ("Linearized",), "encrypted": ("/Encrypt",), "has_object_stream": ("/ObjStm",),
    "has_portfolio": ("/Collection",), "has_attachments": ("/EmbeddedFile",),
}
#: Annotation elements, in lower case, and the subtypes they stand for.
XFDF = {
    "highlight": "Highlight", "text": "Text", "underline": "Underline", "strikeout": "StrikeOut", "freetext": "FreeText",
    "square": "Square", "circle": "Circle", "line": "Line", "ink": "Ink",
}


def format_probe(files: DataFrame) -> DataFrame:
    """Per file its version and marker flags, ``rejected`` where it doesn't begin as a PDF; all else in those is null."""
    raw = F.decode("content", "ISO-8859-1")
    f = files.select("path", raw.alias("raw")).withColumn("rejected", ~F.coalesce(F.col("raw").startswith("%PDF-"), F.lit(False)))
    ok = lambda c: F.when(~F.col("rejected"), c)
    has = {name: ok(F.greatest(*(F.col("raw").contains(m) for m in marks), F.lit(False))) for name, marks in FLAGS.items()}
    return f.select("path", "rejected", ok(F.regexp_extract("raw", r"^%PDF-([^\r\n]*)", 1)).alias("version"), *(c.alias(n) for n, c in has.items()), ok(F.regexp_count("raw", F.lit("/Type /Sig"))).cast("long").alias("signatures"))


def object_scan(files: DataFrame) -> DataFrame:
    """S3: objects salvaged from bytes, ``N G obj ... endobj``; of several definitions of a number the last counts. A file without any gives a row with an error."""
    f = files.select("path", F.decode("content", "ISO-8859-1").alias("raw"))
    shape = r"(?s)(\d{1,9})\s+(\d{1,5})\s+obj\b(.*?)\bendobj"
    groups = [F.regexp_extract_all("raw", F.lit(shape), F.lit(i)) for i in (1, 2, 3)]
    found = f.select("path", F.posexplode_outer(F.arrays_zip(*(g.alias(n) for g, n in zip(groups, ("n", "g", "body"), strict=True)))).alias("pos", "o"))
    rows = found.select("path", F.col("o.n").cast("int").alias("obj_num"), F.col("o.g").cast("int").alias("gen"), "pos", "o.body")
    last = rows.groupBy("path", "obj_num", "gen").agg(F.max_by("body", "pos").alias("body"))
    kind = F.nullif(F.regexp_extract("body", r"/Type\s*/(\w+)", 1), F.lit(""))
    return last.select("path", "obj_num", "gen", F.trim("body").alias("body"), kind.alias("type"), F.when(F.col("obj_num").isNull(), "no objects found").alias("error"))


OCR_COLUMNS = "level page_num block_num par_num line_num word_num x_left y_top width height conf text".split()


def ocr_row(cells: list[Column]) -> list[Column]:
    """The columns of an OCR row from its twelve cells: a bad integer is 0, a bad confidence -1, text is trimmed."""
    whole = [F.coalesce(F.trim(c).try_cast("int"), F.lit(0)).alias(n) for c, n in zip(cells, OCR_COLUMNS[:10], strict=False)]
    return [*whole, F.coalesce(F.trim(cells[10]).try_cast("double"), F.lit(-1.0)).alias("conf"), F.trim(F.coalesce(cells[11], F.lit(""))).alias("text")]


def parse_ocr_tsv(lines: DataFrame) -> DataFrame:
    """OCR rows from lines (column ``value``): the header and rows of fewer than 12 columns go."""
    cells = lines.select(F.split("value", "\t").alias("c")).filter((F.size("c") >= 12) & (F.col("c")[0] != "level"))
    return cells.select(*ocr_row([F.col("c")[i] for i in range(12)]))


def _xfdf_color(c: Column) -> Column:
    """``#rrggbb`` (what follows is ignored), or three numbers of 255ths or from 0 to 1; red if there is none of these, and for each part that isn't a number."""
    c = F.trim(F.coalesce(c, F.lit("")))
    digits = F.regexp_replace(c, "^#+", "")
    hexed = c.startswith("#") & (F.length(digits) >= 6)
    parts = F.transform(F.split(c, ","), lambda p: F.trim(p).try_cast("double"))
    missing = (255.0, 0.0, 0.0)
    number = [F.coalesce(F.get(parts, F.lit(i)), F.lit(missing[i])) for i in range(3)]
    scale = F.when(F.greatest(*number) > 1, 255.0).otherwise(1.0)

    def part(i: int) -> Column:
        two = F.substring(digits, 1 + 2 * i, 2)
        from_hex = F.when(two.rlike("^[0-9A-Fa-f]{2}$"), F.conv(two, 16, 10).cast("double")).otherwise(missing[i]) / 255
        return F.when(hexed, from_hex).when(F.size(parts) >= 3, number[i] / scale).otherwise(missing[i] / 255)

    return F.array(*(part(i) for i in range(3)))


#: What is read of an annotation element; names match in any case.
XFDF_ELEMENT = "_page STRING, _name STRING, _title STRING, _inreplyto STRING, _color STRING, _left STRING, _top STRING, _width STRING, _height STRING, contents STRING"
XFDF_KINDS = ", ".join(f"{tag} ARRAY<STRUCT<{XFDF_ELEMENT}>>" for tag in XFDF)


def _xfdf_order(xml: Column) -> Column:
    """The annotation elements' names in the order of their start tags. In well-formed XML, ``<`` only begins markup once comments, CDATA and instructions are gone; contents are left out, too."""
    bare = F.regexp_replace(xml, r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>", "")
    bare = F.regexp_replace(bare, r"(?is)<(?:[\w.-]+:)?(contents(?:-richtext)?)\b[^>]*(?<!/)>.*?</(?:[\w.-]+:)?\1\s*>", "")
    return F.transform(F.regexp_extract_all(bare, F.lit(rf"(?i)<(?:[\w.-]+:)?({'|'.join(XFDF)})(?=[\s/>])"), F.lit(1)), lambda t: F.lower(t))


def read_xfdf(docs: DataFrame) -> DataFrame:
    """Annotations of XFDF documents (doc_id, xfdf): one row for each of the nine elements, in any case and with any prefix, by Spark's XML parser.

    The elements stand below the root or in wrappers named ``annots`` (the standard's) or ``annotations``. Quotes of either kind,
    character and entity references, CDATA and comments are read as any parser does; malformed XML fails the query, a null document has no rows.
    ``page`` counts from 0, one less than in the file but not below 0, and is 0 where it isn't a number; ``left`` and ``top`` are 0 and sides 100 where missing.
    ``pos`` is the element's place in its document; where a document has elements in several kinds of wrapper, those of one name go by wrapper.
    """
    wrapper = f"ARRAY<STRUCT<{XFDF_KINDS}>>"
    # white space in contents is text
    options = {"mode": "FAILFAST", "ignoreNamespace": "true", "ignoreSurroundingSpaces": "false"}
    parsed = docs.select("doc_id", "xfdf", F.from_xml("xfdf", f"annots {wrapper}, annotations {wrapper}, {XFDF_KINDS}", options).alias("x"))
    none = F.array().cast(f"ARRAY<STRUCT<{XFDF_ELEMENT}>>")
    inside = lambda w, tag: F.flatten(F.transform(F.coalesce(F.col(f"x.{w}"), F.array().cast(wrapper)), lambda e: F.coalesce(e[tag], none)))
    of_tag = lambda tag: F.concat(F.coalesce(F.col(f"x.{tag}"), none), inside("annots", tag), inside("annotations", tag))
    order = parsed.select("doc_id", "x", _xfdf_order(F.col("xfdf")).alias("order"))
    starts = F.transform("order", lambda t, i: F.struct(t.alias("t"), i.alias("i")))

    def tagged(tag: str) -> Column:
        # the nth start tag of a name belongs to the nth element of that name
        places = F.transform(F.filter(starts, lambda s: s["t"] == tag), lambda s: s["i"])
        return F.transform(F.arrays_zip(of_tag(tag).alias("e"), places.alias("pos")), lambda z: F.struct(F.lit(tag).alias("tag"), z["pos"].alias("pos"), z["e"].alias("e")))

    rows = order.select("doc_id", F.explode(F.concat(*map(tagged, XFDF))).alias("f")).select("doc_id", "f.*").filter("e IS NOT NULL")
    number = lambda n, d: F.coalesce(F.trim(f"e._{n}").try_cast("double"), F.lit(d)).alias(n)
    page = F.when(F.col("e._page").rlike("^[+]?[0-9]+$"), F.greatest(F.lit(0), F.col("e._page").try_cast("int") - 1))
    text = lambda c: F.coalesce(f"e.{c}", F.lit(""))
    return rows.select(
        "doc_id", "pos", F.coalesce(*(F.when(F.col("tag") == k, v) for k, v in XFDF.items())).alias("subtype"), F.coalesce(page, F.lit(0)).cast("long").alias("page_no"), text("_name").alias("name"),
        text("_title").alias("author"), F.col("e._inreplyto").alias("in_reply_to"), _xfdf_color(F.col("e._color")).alias("color"), number("left", 0.0), number("top", 0.0), number("width", 100.0), number("height", 100.0),
        text("contents").alias("contents"),
    )


#: What a tag puts into the text; tags by name, all others put nothing.
TAG_TEXT = (
    (r"(?:p|br|/p|div|/div|tr|/tr)(?:\s[^>]*)?", "\n"), (r"h[1-6][^>]*", "\n"), (r"li(?:\s[^>]*)?", "\n• "),
    (r"(?:td|th)(?:\s[^>]*)?", "  |  "), (r"hr(?:\s[^>]*)?", "\n" + "-" * 40 + "\n"), (r"blockquote(?:\s[^>]*)?", "\n> "),
)
#: Entities, in the order of decoding.
HTML_ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"))


def html_to_text(html: Column) -> Column:
    """A page's text: scripts and styles go, tags become separators, entities are decoded, lines trimmed, runs of blank lines become one; ``HTML Document`` if nothing is left."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>", "")
    for tag, put in TAG_TEXT:
        t = F.regexp_replace(t, f"(?i)<{tag}>", put)
    t = F.regexp_replace(t, "<[^>]*>", "")
    for name, char in HTML_ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t\r\f]*\n[ \t\r\f]*", "\n"), r"^[ \t\r\f]+|[ \t\r\f]+$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\n+", "\n")
    t = F.when(t.endswith("\n"), t).otherwise(F.concat(t, F.lit("\n")))
    return F.when(F.regexp_replace(t, r"\s+", "") == "", "HTML Document").otherwise(t)


def paginate_text(docs: DataFrame, lines_per_page: int = 45) -> DataFrame:
    """Texts laid out, ``lines_per_page`` lines a page of 595 by 842; an empty text still has one empty page."""
    lines = docs.select("doc_id", F.posexplode(text_lines(F.col("text"))).alias("pos", "text"))
    slot = F.col("pos") % lines_per_page
    return lines.select("doc_id", F.expr(f"pos div {lines_per_page}").alias("page_no"), slot.cast("long").alias("slot"), "text", F.lit(50.0).alias("x"), (790.0 - 16 * slot).alias("y"), F.lit(11.0).alias("size"))
