"""Operators on regions of pages: redaction and what lies where. Joins are equi joins on document and page with the geometry as further condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .graph import closure

PAGE = ["doc_id", "page_no"]


def per_page(rects: DataFrame, *cols: str) -> DataFrame:
    """A page's rectangles as one array, so that a page's runs meet them in one row."""
    return rects.groupBy(*PAGE).agg(F.collect_list(F.struct(*cols)).alias("_rects"))


def split_by(rows: DataFrame, rects: DataFrame, hit) -> DataFrame:
    """``rows`` with ``removed``: whether ``hit`` holds for any rectangle (x, y, w, h) of the page. One join on the page, no row is multiplied."""
    joined = rows.join(per_page(rects, "x", "y", "w", "h"), PAGE, "left")
    return joined.withColumn("removed", F.coalesce(F.exists("_rects", hit), F.lit(False))).drop("_rects")


def redact_region(runs: DataFrame, rects: DataFrame, advance: Column) -> DataFrame:
    """Runs with ``removed``: those that a rectangle meets, strictly along the line from x to x + ``advance``, with the baseline in it, edges included."""
    x, y = F.col("x"), F.col("y")
    runs = runs.withColumn("_adv", advance)
    return split_by(runs, rects, lambda r: (x < r["x"] + r["w"]) & (x + F.col("_adv") > r["x"]) & y.between(r["y"], r["y"] + r["h"])).drop("_adv")


def boxes_intersect(boxes: DataFrame, rects: DataFrame) -> DataFrame:
    """Boxes (x, y, w, h of either sign) with ``removed``: those that overlap a rectangle in more than an edge."""
    lo, hi = lambda a, d: F.least(a, a + d), lambda a, d: F.greatest(a, a + d)
    x, y, w, h = (F.col(c) for c in "xywh")
    over = lambda a, d, b, e: (lo(a, d) < hi(b, e)) & (hi(a, d) > lo(b, e))
    return split_by(boxes, rects, lambda r: over(x, w, r["x"], r["w"]) & over(y, h, r["y"], r["h"]))


def remove_field_trees(boxes: DataFrame, rects: DataFrame, edges: DataFrame) -> DataFrame:
    """Boxes (doc_id, annot_id, ...) with ``removed``: those that overlap a rectangle and all that is below them in their field's tree (doc_id, src, dst), wherever it lies."""
    hit = boxes_intersect(boxes, rects)
    gone = closure(edges, hit.filter("removed").select("doc_id", F.col("annot_id").alias("node"))).select("doc_id", F.col("node").alias("annot_id"), F.lit(True).alias("_gone"))
    return hit.join(gone, ["doc_id", "annot_id"], "left").withColumn("removed", F.coalesce("_gone", F.lit(False))).drop("_gone")


def remove_text_in_rect(blocks: DataFrame, rects: DataFrame, slack: float = 20.0) -> DataFrame:
    """Blocks with ``removed``: those whose origin is in a rectangle widened by ``slack`` points on all sides, edges included."""
    x, y = F.col("x"), F.col("y")
    return split_by(blocks, rects, lambda r: x.between(r["x"] - slack, r["x"] + r["w"] + slack) & y.between(r["y"] - slack, r["y"] + r["h"] + slack))


def drop_matching_runs(runs: DataFrame, term: str) -> DataFrame:
    """Runs with ``removed``: those that contain ``term``, gone whole. An empty term is refused."""
    if not term.strip():
        raise ValueError("nothing to look for")
    return runs.withColumn("removed", F.coalesce(F.col("text").contains(term), F.lit(False)))


def guard_unsigned(docs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Documents with ``blocked``: why no operator may change them, null if they may be changed: a signature with a byte range, or encryption."""
    signed = signatures.filter("b2 > 0 OR b1 > 0").select("doc_id").distinct().withColumn("_signed", F.lit(True))
    return docs.join(signed, "doc_id", "left").withColumn("blocked", F.when(F.col("_signed"), "signed").when(F.col("encrypted"), "encrypted")).drop("_signed")


def image_effective_dpi(images: DataFrame, placements: DataFrame, low: float = 150.0) -> DataFrame:
    """Each image's smallest resolution over its placements, 1 at least, 72 where it is placed nowhere, and whether that is low."""
    at = F.greatest(F.lit(1.0), F.least(F.col("px_w") / (F.col("w") / 72), F.col("px_h") / (F.col("h") / 72)))
    dpi = images.join(placements, ["doc_id", "image_id"], "left").groupBy("doc_id", "image_id").agg(F.coalesce(F.min(at), F.lit(72.0)).alias("dpi"))
    return dpi.withColumn("low", F.col("dpi") < low)


def resolve_bookmarks(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """Bookmarks (doc_id, node_id, title, dest) with the index of their page (doc_id, page_id, page_index), the first page if it is unknown, and a title."""
    known = pages.select("doc_id", F.col("page_id").alias("dest"), "page_index")
    title = F.when(F.coalesce("title", F.lit("")) == "", "Untitled").otherwise(F.col("title")).alias("title")
    return outline.join(known, ["doc_id", "dest"], "left").select("doc_id", "node_id", title, F.coalesce("page_index", F.lit(0)).alias("page_index"))


def nearest_anchor(x: Column, anchors: Column) -> Column:
    """The number, from 0, of the anchor nearest to ``x``, the first of equally near ones."""
    far = F.transform(anchors, lambda a, i: F.struct(F.abs(x - a).alias("d"), i.alias("i")))
    return F.array_min(far)["i"]


def fill_forms(fields: DataFrame, values: DataFrame) -> DataFrame:
    """Fields with the values given by exact name (doc_id, name, new_value); names that no field has change nothing.

    Of several values for one field the last counts, by ``seq`` where ``values`` has such a column, else by value.
    """
    last = F.max_by("new_value", "seq") if "seq" in values.columns else F.max("new_value")
    one = values.groupBy("doc_id", "name").agg(last.alias("new_value"))
    return fields.join(one, ["doc_id", "name"], "left").withColumn("value", F.coalesce("new_value", "value")).select(*fields.columns)


def signature_coverage(signatures: DataFrame) -> DataFrame:
    """Whether each byte range (b0 to b3) is in order and within the file, and the bytes that it covers and leaves out."""
    first, second = F.col("b0") + F.col("b1"), F.col("b2") + F.col("b3")
    parts = [F.col(f"b{i}") >= 0 for i in range(4)]
    ok = parts[0] & parts[1] & parts[2] & parts[3] & (first <= F.col("b2")) & (first <= F.col("file_size")) & (second <= F.col("file_size"))
    ok = F.coalesce(ok, F.lit(False))
    covered = F.when(ok, F.col("b1") + F.col("b3"))
    return signatures.select("doc_id", "field_name", ok.alias("valid"), covered.alias("covered"), (F.col("file_size") - covered).alias("uncovered"))
