"""Operators that number, order and assemble pages. Corpus-wide numbers are sums over documents plus ranks within one, never a window over all pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from leafwork.functions.geometry import DEFAULT_WIDTH, anchor

from .scratch import checkpointed


def in_doc() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("page_no")


def doc_offsets(counts: DataFrame, n: str = "n") -> DataFrame:
    """doc_id, ``offset``: the sum of ``n`` over all documents of smaller doc_id.

    Sums run within ranges of doc_ids, as many as the session's shuffles have partitions and of about equal numbers of documents however ids are
    spread, then over the ranges: no task sees more than one range, and the window over all has one row a range.
    """
    ranged = checkpointed(counts.repartitionByRange("doc_id").withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(F.sum(n).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("_range").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(starts), "_range").select("doc_id", (F.col("_start") + F.coalesce(F.sum(n).over(own), F.lit(0))).alias("offset"))


def bates_number(pages: DataFrame, prefix: str, start: int = 1, corpus: bool = False) -> DataFrame:
    """``prefix`` and a number of six digits or more, from ``start``, counted in each document or through the corpus by doc_id."""
    rows = pages.select("doc_id", "page_no", F.row_number().over(in_doc()).alias("_i"))
    number = F.col("_i") - 1 + start
    if corpus:
        rows = rows.join(doc_offsets(pages.groupBy("doc_id").agg(F.count("*").alias("n"))), "doc_id")
        number = number + F.col("offset")
    return rows.select("doc_id", "page_no", F.concat(F.lit(prefix), F.format_string("%06d", number.cast("long"))).alias("bates"))


def page_numbers(pages: DataFrame, position: str = "bottom-center", start: int = 1, size: float = 12) -> DataFrame:
    """Each page's number as text and where it goes."""
    rows = pages.withColumn("text", (F.row_number().over(in_doc()) - 1 + start).cast("string"))
    at = anchor(F.col("text"), size, F.col("width"), F.col("height"), position)
    return rows.select("doc_id", "page_no", "text", at["x"].alias("x"), at["y"].alias("y"))


def header_footer(pages: DataFrame, header: str, footer: str) -> DataFrame:
    """Header and footer with {page} and {total} put in."""
    own = Window.partitionBy("doc_id")
    page, total = F.row_number().over(in_doc()).cast("string"), F.count("*").over(own).cast("string")
    fill = lambda s: F.replace(F.replace(F.lit(s), F.lit("{page}"), page), F.lit("{total}"), total)
    return pages.select("doc_id", "page_no", fill(header).alias("header"), fill(footer).alias("footer"))


def merge_offsets(docs: DataFrame, separator: bool = False) -> DataFrame:
    """The first page of each document (doc_id, n) when all are put together in order, with a page between any two if asked for."""
    return doc_offsets(docs.withColumn("_n", F.col("n") + int(separator)), "_n").withColumnRenamed("offset", "first_page")


def merge_documents(pages: DataFrame, docs: DataFrame, separator: bool = True, bookmarks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All pages as one document: (page_no, doc_id, kind, text, x), and its bookmarks (title, page_no).

    ``docs``: doc_id, name, encrypted. An encrypted one fails the query. A separator page has the name of the document
    that follows in its middle.
    """
    checked = docs.withColumn("name", F.when(F.col("encrypted"), F.raise_error(F.concat(F.lit("encrypted input: "), F.col("doc_id").cast("string")))).otherwise(F.col("name")))
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("n")).join(checked.select("doc_id", "name"), "doc_id")
    first = merge_offsets(counts.select("doc_id", "n"), separator)
    merged = pages.join(first, "doc_id").select((F.col("first_page") + F.col("page_no")).alias("page_no"), "doc_id", F.lit("page").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("x"))
    if separator:
        last = counts.agg(F.max("doc_id").alias("_last"))
        after = counts.join(first, "doc_id").join(F.broadcast(last)).filter("doc_id < _last")
        wide = F.length(F.regexp_replace("name", r"[\x00-\x7F]", ""))
        width = (wide * 1.0 + (F.length("name") - wide) * 0.55) * 18
        merged = merged.unionByName(after.select((F.col("first_page") + F.col("n")).alias("page_no"), "doc_id", F.lit("separator").alias("kind"), F.col("name").alias("text"), F.greatest(F.lit(10.0), (DEFAULT_WIDTH - width) / 2).alias("x")))
    marks = counts.join(first, "doc_id").select("doc_id", F.col("name").alias("title"), F.col("first_page").alias("page_no"))
    if bookmarks is not None:
        marks = marks.unionByName(bookmarks.join(first, "doc_id").select("doc_id", "title", (F.col("page_no") + F.col("first_page")).alias("page_no")))
    return merged, marks


def _one_of(spec: DataFrame, pages: DataFrame) -> DataFrame:
    return pages.join(spec, "doc_id", "left")


def move_page(pages: DataFrame, moves: DataFrame) -> DataFrame:
    """The page ``src`` of each document of ``moves`` (doc_id, src, dst) goes to ``dst`` of the pages without it. A number that is no page of the document fails the query."""
    p, a, b = F.col("page_no"), F.col("src"), F.col("dst")
    n = F.count("*").over(Window.partitionBy("doc_id"))
    out = ~(a.between(0, F.col("_n") - 1) & b.between(0, F.col("_n") - 1))
    new = F.when(a.isNull() & b.isNull(), p).when(F.coalesce(out, F.lit(True)), F.raise_error(F.concat(F.lit("page out of range in "), F.col("doc_id").cast("string"))).cast("long")).when(p == a, b).when((a < b) & p.between(a + 1, b), p - 1).when((b < a) & p.between(b, a - 1), p + 1).otherwise(p)
    return _one_of(moves, pages).withColumn("_n", n).withColumn("page_no", new).select(*pages.columns)


def duplicate_page(pages: DataFrame, which: DataFrame) -> DataFrame:
    """The page ``src`` of each document of ``which`` (doc_id, src) twice, the copy next."""
    rows = _one_of(which, pages)
    shifted = rows.withColumn("page_no", F.col("page_no") + F.when(F.col("page_no") > F.col("src"), 1).otherwise(0)).select(*pages.columns)
    return shifted.unionByName(rows.filter("page_no = src").withColumn("page_no", F.col("page_no") + 1).select(*pages.columns))


def delete_page(pages: DataFrame, which: DataFrame) -> DataFrame:
    """T4: pages without the page ``src`` of each document of ``which`` (doc_id, src). To delete a document's only page fails the query."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    rows = _one_of(which, pages).withColumn("_n", n)
    only = (F.col("page_no") == F.col("src")) & (F.col("_n") == 1)
    rows = rows.withColumn("page_no", F.when(only, F.raise_error(F.lit("the only page cannot be deleted")).cast("long")).otherwise(F.col("page_no")))
    rows = rows.filter(F.col("src").isNull() | (F.col("page_no") != F.col("src")))
    return rows.withColumn("page_no", F.col("page_no") - F.when(F.col("page_no") > F.col("src"), 1).otherwise(0)).select(*pages.columns)


def extract_pages(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """T5: per document of ``chosen`` (doc_id, sel array) its pages in that order, repeated as often as named; numbers without a page are skipped, a document left without pages fails the query."""
    wanted = chosen.select("doc_id", F.posexplode("sel").alias("pos", "page_no"))
    got = wanted.join(pages, ["doc_id", "page_no"])
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    empty = chosen.join(got.select("doc_id").distinct(), "doc_id", "left_anti").select(F.raise_error(F.concat(F.lit("no page left of "), F.col("doc_id").cast("string"))).cast("long").alias("doc_id"))
    rows = got.withColumn("source_page", F.col("page_no")).withColumn("page_no", order.cast("long"))
    return rows.select("doc_id", "page_no", "source_page").unionByName(empty.select("doc_id", F.lit(0).cast("long").alias("page_no"), F.lit(0).cast("long").alias("source_page")))


def distinct_pages(selections: DataFrame) -> DataFrame:
    """Each page of a selection once."""
    return selections.dropDuplicates(["doc_id", "page_no"])


def rotate(rotation: Column, by: int) -> Column:
    return F.pmod(rotation + by, F.lit(360))
