"""Annotations (doc_id, annot_id, in_reply_to, subtype, author, contents, page_no, status, x, y, w, h) and form fields (doc_id, name, type, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leafwork.functions.formula import arithmetic
from leafwork.functions.geometry import quad

#: What a new annotation of each subtype has where nothing is given: colour, opacity, angle, width, height.
DEFAULTS = {
    "Highlight": ("#ffff00", 0.4, 0, None, None), "Underline": ("#ff0000", 1.0, 0, None, None), "Text": ("#ffff00", 1.0, 0, 20.0, 20.0),
    "Square": ("#ff0000", 1.0, 0, None, None), "Circle": ("#ff0000", 1.0, 0, None, None), "Line": ("#ff0000", 1.0, 0, None, None),
    "Stamp": ("#ff0000", 1.0, 0, 150.0, 40.0), "Watermark": ("#808080", 0.3, 45, None, None), "FreeText": ("#000000", 1.0, 0, None, None), "Widget": ("#000000", 1.0, 0, 150.0, 20.0),
}
DEFAULT_BOX = (50.0, 50.0, 70.0, 70.0)


def thread_replies(annots: DataFrame) -> DataFrame:
    """Each annotation with its direct replies, (annot_id, author, contents) in order of id."""
    own = annots.filter("in_reply_to IS NOT NULL").groupBy("doc_id", F.col("in_reply_to").alias("annot_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("annot_id").alias("id"), "author", "contents"))).alias("replies"))
    return annots.join(own, ["doc_id", "annot_id"], "left").withColumn("replies", F.coalesce("replies", F.array().cast("array<struct<id:string,author:string,contents:string>>")))


def resolve_reply_names(batch: DataFrame, pages: DataFrame) -> DataFrame:
    """Imported annotations (doc_id, id, name, in_reply_to, page_no) with the reply's name as an id of the same batch, null if unknown; those on pages that the document has not are dropped, and no reply finds them.

    Of several with one name the last, by id, is the one that replies find.
    """
    kept = batch.join(pages.select("doc_id", "page_no"), ["doc_id", "page_no"], "left_semi")
    ids = kept.groupBy("doc_id", F.col("name").alias("in_reply_to")).agg(F.max("id").alias("reply_to_id"))
    return kept.join(ids, ["doc_id", "in_reply_to"], "left")


def _default(i: int, kind: str) -> Column:
    return F.coalesce(*(F.when(F.col("subtype") == k, F.lit(v[i]).cast(kind)) for k, v in DEFAULTS.items()))


def add_annotations(annots: DataFrame, new: DataFrame, pages: DataFrame) -> DataFrame:
    """``annots`` and the ``new`` ones with what their subtype has by default: color, opacity, angle, box, and the quad of markup.

    ``new``: doc_id, annot_id, page_no (null: every page), subtype, author, contents, x, y, w, h, color, opacity, angle, nulls where nothing is
    given. Pages out of range are dropped.
    """
    everywhere = new.filter("page_no IS NULL").drop("page_no").join(pages.select("doc_id", "page_no"), "doc_id")
    here = new.filter("page_no IS NOT NULL").join(pages.select("doc_id", "page_no"), ["doc_id", "page_no"], "left_semi")
    rows = here.unionByName(everywhere.select(*here.columns))
    side = lambda c, i, d: F.coalesce(F.col(c), _default(i, "double"), F.lit(d)).alias(c)
    rows = rows.select(
        "doc_id", "annot_id", F.lit(None).cast("string").alias("in_reply_to"), "subtype", "author", "contents", "page_no", F.lit("").alias("status"),
        F.coalesce("x", F.lit(50.0)).alias("x"), F.coalesce("y", F.lit(50.0)).alias("y"), side("w", 3, 100.0), side("h", 4, 20.0),
        F.coalesce("color", _default(0, "string")).alias("color"), F.coalesce("opacity", _default(1, "double")).alias("opacity"), F.coalesce("angle", _default(2, "int")).alias("angle"),
    )
    rows = rows.withColumn("quad", F.when(F.col("subtype").isin("Highlight", "Underline"), quad(*(F.col(c) for c in "xywh"))))
    return annots.unionByName(rows, allowMissingColumns=True)


def flatten_forms(fields: DataFrame, blocks: DataFrame, size: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """Blocks with the values of all placed fields (page_no, x, y) as text at their place, numbered after the page's own; and the fields that are left, those without a place."""
    placed = fields.filter("page_no IS NOT NULL AND value IS NOT NULL AND value <> ''")
    last = blocks.groupBy("doc_id", "page_no").agg(F.max("block_id").alias("_last"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("name"))
    new = placed.join(last, ["doc_id", "page_no"], "left").select("doc_id", "page_no", (F.coalesce("_last", F.lit(-1)) + nth).alias("block_id"), F.col("value").alias("text"), (F.col("x") + 2).alias("x"), (F.col("y") + 2).alias("y"), F.lit(size).alias("font_size"))
    return blocks.select(*new.columns).unionByName(new), fields.filter("page_no IS NULL")


def add_reply(annots: DataFrame, replies: DataFrame) -> DataFrame:
    """Replies (doc_id, annot_id, in_reply_to, author, contents) with their parent's page and box; a missing parent fails the query."""
    parents = annots.select("doc_id", F.col("annot_id").alias("in_reply_to"), F.col("page_no").alias("_page"), *(F.col(c).alias(f"_{c}") for c in "xywh"), F.lit(True).alias("_known"))
    rows = replies.join(parents, ["doc_id", "in_reply_to"], "left")
    page = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("no annotation "), "in_reply_to")).cast("long")).otherwise(F.col("_page"))
    box = [F.coalesce(f"_{c}", F.lit(d)).alias(c) for c, d in zip("xywh", DEFAULT_BOX, strict=True)]
    new = rows.select("doc_id", "annot_id", "in_reply_to", F.lit("Text").alias("subtype"), "author", "contents", page.alias("page_no"), F.lit("").alias("status"), *box)
    return annots.unionByName(new)


def set_status(annots: DataFrame, changes: DataFrame) -> DataFrame:
    """The status of annotations by id (doc_id, annot_id, new_status)."""
    return annots.join(changes.select("doc_id", "annot_id", "new_status"), ["doc_id", "annot_id"], "left").withColumn("status", F.coalesce("new_status", "status")).select(*annots.columns)


def add_bookmark(outline: DataFrame, new: DataFrame, pages: DataFrame) -> DataFrame:
    """Bookmarks (doc_id, title, page_no) added; a page that the document has not fails the query."""
    known = pages.select("doc_id", "page_no", F.lit(True).alias("_known"))
    rows = new.join(known, ["doc_id", "page_no"], "left")
    page = F.when(F.col("_known").isNull(), F.raise_error(F.lit("no such page")).cast("long")).otherwise(F.col("page_no"))
    return outline.unionByName(rows.select("doc_id", "title", page.alias("page_no")))


def aggregate_forms(fields: DataFrame) -> DataFrame:
    """Per document its fields in order of name, as (name, type, value), and how many documents there are in all."""
    own = fields.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("name", "type", "value"))).alias("fields"))
    return own.join(F.broadcast(own.agg(F.count("*").alias("total_files"))))


def forms_wide(fields: DataFrame, names: list[str]) -> DataFrame:
    """One row per document, a column for each name."""
    return fields.groupBy("doc_id").pivot("name", names).agg(F.first("value"))


def calculated_field(fields: DataFrame, name: str, formula: str, inputs: list[str]) -> DataFrame:
    """A field more in each document, computed from its ``inputs`` by a formula of their names, numbers, ``+ - * / ( )`` and nothing else.

    An input that is missing or no number counts as 0. The field is 0 where the formula has no value, as where anything is divided by 0.
    """

    def of(word: str) -> Column:
        if word not in inputs:
            raise ValueError(f"{word} is none of {inputs}")
        return F.coalesce(F.col(f"`{word}`").try_cast("double"), F.lit(0.0))

    value = arithmetic(formula, of)
    result = F.coalesce(value.cast("double"), F.lit(0.0)).cast("string").alias("value")
    return fields.unionByName(forms_wide(fields, inputs).select("doc_id", F.lit(name).alias("name"), F.lit("Tx").alias("type"), result))
