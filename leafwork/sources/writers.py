"""Sinks: documents as manifests, markup, JSON and grids, one row a document or page, for Spark's writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leafwork.functions.text import blank_trim, escape_markup


def in_order(items: Column, sep: str, *keys: str) -> Column:
    """``items`` of a group joined in the order of ``keys``."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*keys, items.alias("_item")))), lambda x: x["_item"]), sep)


def doc_manifest(docs: DataFrame, pages: DataFrame, flags: DataFrame) -> DataFrame:
    """One row per document with size in bytes, pages, title, author, version and encryption; blanks where nothing is known."""
    n = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"))
    known = flags.select("doc_id", "version", "encrypted")
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), F.col("source").alias("title"), F.col("lang").alias("author"))
    rows = rows.join(n, "doc_id", "left").join(known, "doc_id", "left")
    return rows.select("doc_id", "size", F.coalesce("page_count", F.lit(0)).alias("page_count"), text("title"), text("author"), text("version"), F.coalesce("encrypted", F.lit(False)).alias("encrypted"))


def write_xfdf(annots: DataFrame, fields: DataFrame) -> DataFrame:
    """One XFDF document (doc_id, xfdf) for each with annotations or fields: annotations by page and id, then fields by name.

    ``color`` (array of three doubles from 0 to 1) is written as 255ths, cut off; red where ``annots`` has no such column or no three numbers.
    Numbers are written as they are, without a fraction where they have none.
    """
    esc = lambda c: escape_markup(F.coalesce(F.col(c), F.lit("")), "xml5")
    num = lambda c: F.when(F.col(c) == F.floor(c), F.floor(c).cast("string")).otherwise(F.col(c).cast("string"))
    color = F.lit("255,0,0")
    if "color" in annots.columns:
        three = F.slice("color", 1, 3)
        parts = F.transform(three, lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v * 255))).cast("string"))
        color = F.when((F.size(three) == 3) & ~F.exists(three, lambda v: v.isNull()), F.array_join(parts, ",")).otherwise(color)
    reply = F.when(F.col("in_reply_to").isNotNull(), F.concat(F.lit(' inreplyto="annot_'), esc("in_reply_to"), F.lit('"'))).otherwise("")
    open_ = F.concat(
        F.lit("<"), "subtype", F.lit(' page="'), (F.col("page_no") + 1).cast("string"), F.lit('" name="annot_'), esc("annot_id"), F.lit('" title="'), esc("author"), F.lit('" color="'), color, F.lit('" left="'), num("x"),
        F.lit('" top="'), num("y"), F.lit('" width="'), num("w"), F.lit('" height="'), num("h"), F.lit('"'), reply, F.lit(">"),
    )
    body = F.when(F.coalesce("contents", F.lit("")) == "", "").otherwise(F.concat(F.lit("<contents>"), esc("contents"), F.lit("</contents>")))
    a = annots.select("doc_id", "page_no", "annot_id", F.concat(open_, body, F.lit("</"), "subtype", F.lit(">")).alias("xml")).groupBy("doc_id").agg(in_order(F.col("xml"), "", "page_no", "annot_id").alias("annots"))
    f = fields.select("doc_id", "name", F.concat(F.lit('<field name="'), esc("name"), F.lit('"><value>'), esc("value"), F.lit("</value></field>")).alias("xml")).groupBy("doc_id").agg(in_order(F.col("xml"), "", "name").alias("fields"))
    part = lambda c, tag, always: F.when(F.col(c).isNull(), f"<{tag}></{tag}>" if always else "").otherwise(F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>")))
    xml = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><xfdf xmlns="http://ns.adobe.com/xfdf/" xml:space="preserve">'), part("annots", "annotations", True), part("fields", "fields", False), F.lit("</xfdf>"))
    return a.join(f, "doc_id", "full").select("doc_id", xml.alias("xfdf"))


def column_letters(index: Column) -> Column:
    """A to Z, AA to ZZ, AAA ... for a column's number from 0, below 18278."""
    letter = lambda c: F.char(c % 26 + 65)
    second, third = F.floor(index / 26) - 1, F.floor((index - 26) / 676) - 1
    return F.concat(F.when(index >= 702, letter(third)).otherwise(""), F.when(index >= 26, letter(second)).otherwise(""), letter(index))


def letters_of(index: int) -> str:
    """The letters of one column's number, from 0."""
    return (letters_of(index // 26 - 1) if index >= 26 else "") + chr(65 + index % 26)


def split_chapters(docs: DataFrame, between: str = "\n\n") -> DataFrame:
    """Chapters of a text, split at blank lines, empty ones left out, numbered from 1, each line a paragraph."""
    parts = F.filter(F.split("text", between), lambda c: blank_trim(c) != "")
    rows = docs.select("doc_id", F.posexplode(parts).alias("pos", "body"))
    para = F.array_join(F.transform(F.split("body", "\n"), lambda x: F.concat(F.lit("<p>"), escape_markup(x, "html5"), F.lit("</p>"))), "")
    number = (F.col("pos") + 1).cast("long")
    return rows.select("doc_id", number.alias("chapter"), F.concat(F.lit("<h1>Chapter "), number.cast("string"), F.lit("</h1>"), para).alias("html"))


def portfolio_manifest(files: DataFrame) -> DataFrame:
    """Base name and size of each file (path, size), with its place in the order of names."""
    return files.select(F.regexp_extract("path", r"[^/\\]+$", 0).alias("name"), "size")


def diff_report_html(diffs: DataFrame) -> DataFrame:
    """An HTML report per pair (doc_id) of diff rows (doc_id, page_no, seq, kind, original_text, revised_text): counts, then a section a page."""
    esc = lambda c: escape_markup(F.coalesce(F.col(c), F.lit("")), "html5")
    gone, new = F.concat(F.lit("<del>"), esc("original_text"), F.lit("</del>")), F.concat(F.lit("<ins>"), esc("revised_text"), F.lit("</ins>"))
    what = F.when(F.col("kind") == "modified", F.concat(gone, F.lit(" &rarr; "), new)).when(F.col("kind") == "added", new).otherwise(gone)
    rows = diffs.withColumn("row", F.concat(F.lit('<div class="diff-row '), "kind", F.lit('">'), what, F.lit("</div>")))
    count = lambda k: F.count_if(F.col("kind") == k).alias(k)
    page = rows.groupBy("doc_id", "page_no").agg(in_order(F.col("row"), "", "seq").alias("rows"), *(count(k) for k in ("added", "deleted", "modified")))
    section = F.concat(F.lit("<h3>Page "), (F.col("page_no") + 1).cast("string"), F.lit("</h3>"), "rows")
    doc = page.withColumn("section", section).groupBy("doc_id").agg(in_order(F.col("section"), "", "page_no").alias("body"), *(F.sum(k).alias(k) for k in ("added", "deleted", "modified")))
    head = F.concat(F.lit("<!DOCTYPE html><html><body><p>+ "), F.col("added").cast("string"), F.lit(" - "), F.col("deleted").cast("string"), F.lit(" ~ "), F.col("modified").cast("string"), F.lit("</p>"))
    return doc.select("doc_id", F.concat(head, "body", F.lit("</body></html>")).alias("html"))


def layout_json(blocks: DataFrame, pages: DataFrame, with_layout: bool = True) -> DataFrame:
    """Per page its number from 1, size, text and blocks as JSON; the layout is null when there are no blocks or none is asked for."""
    block = F.struct(F.col("block_id").alias("id"), "text", "x", "y", F.col("font_size").alias("size"))
    own = blocks.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(block)).alias("blocks"), in_order(F.col("text"), " ", "block_id").alias("text"))
    layout = F.when(F.col("blocks").isNotNull() & F.lit(with_layout), F.struct("blocks", F.size("blocks").alias("count")))
    page = F.struct((F.col("page_no") + 1).alias("page"), "width", "height", F.coalesce("text", F.lit("")).alias("text"), layout.alias("layout"))
    return pages.join(own, ["doc_id", "page_no"], "left").select("doc_id", "page_no", F.to_json(page, {"ignoreNullFields": "false"}).alias("json"))


def document_text(blocks: DataFrame) -> DataFrame:
    """Block texts with spaces between, pages with a blank line between; pages without blocks are skipped."""
    page = blocks.groupBy("doc_id", "page_no").agg(in_order(F.col("text"), " ", "block_id").alias("text"))
    return page.groupBy("doc_id").agg(in_order(F.col("text"), "\n\n", "page_no").alias("text"))


def text_to_html(docs: DataFrame) -> DataFrame:
    """Paragraphs, split at blank lines, in a minimal document."""
    paras = F.transform(F.split(F.coalesce("text", F.lit("")), "\n{2,}"), lambda p: F.concat(F.lit("<p>"), escape_markup(p, "html3"), F.lit("</p>")))
    return docs.select("doc_id", F.concat(F.lit("<!DOCTYPE html><html><body>"), F.array_join(paras, ""), F.lit("</body></html>")).alias("html"))
