"""Comparison of two revisions: block sets (doc_id, page_no, block_id, text, x, y, width, height)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from leafwork.functions.text import blank_trim

from .scratch import checkpointed

PAGE = ["doc_id", "page_no"]


def match_blocks_exact(orig: DataFrame, rev: DataFrame) -> DataFrame:
    """Blocks of a page with equal trimmed text, the k-th of equal ones with the k-th, each once; what has no partner has null on the other side."""

    def side(blocks: DataFrame, prefix: str) -> DataFrame:
        rows = blocks.withColumn("_key", blank_trim(F.col("text")))
        nth = F.row_number().over(Window.partitionBy(*PAGE, "_key").orderBy("block_id"))
        return rows.select(*PAGE, "_key", nth.alias("_nth"), *(F.col(c).alias(f"{prefix}_{c}") for c in ("block_id", "text", "x", "y", "width", "height")))

    return side(orig, "orig").join(side(rev, "rev"), [*PAGE, "_key", "_nth"], "full").drop("_key", "_nth")


def similarity(a: Column, b: Column) -> Column:
    """1 for equal trimmed texts, 0 if one is empty, else 1 less the edit distance over the longer length."""
    a, b = blank_trim(a), blank_trim(b)
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def likeness_bound(a: Column, b: Column) -> Column:
    """What ``similarity`` of two trimmed texts can be at most: an edit distance is the difference of the lengths at least."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1 - F.abs(F.length(a) - F.length(b)) / longer)


def nearby_pairs(orig: DataFrame, rev: DataFrame, dx: float = 40.0, dy: float = 12.0) -> DataFrame:
    """Pairs of blocks of a page (orig_block_id, rev_block_id, sim) less than ``dx`` and ``dy`` apart that are alike (sim over 0.3), or all but in one place.

    Bands of ``dy`` points keep it an equi join: each block of ``rev`` is in its own band and the two beside it. Texts whose lengths rule out likeness are not compared.
    """
    side = lambda d, p: d.select(*PAGE, F.col("block_id").alias(f"{p}_block_id"), blank_trim(F.col("text")).alias(f"_{p}"), F.col("x").alias(f"_{p}x"), F.col("y").alias(f"_{p}y"))
    a = side(orig, "orig").withColumn("_band", F.floor(F.col("_origy") / dy))
    b = side(rev, "rev").withColumn("_band", F.explode(F.array(*(F.floor(F.col("_revy") / dy) + i for i in (-1, 0, 1)))))
    far_x, far_y = F.abs(F.col("_origx") - F.col("_revx")), F.abs(F.col("_origy") - F.col("_revy"))
    here = (far_x < 10) & (far_y < 6)
    met = a.join(b, [*PAGE, "_band"]).filter((far_x < dx) & (far_y < dy) & (here | (likeness_bound(F.col("_orig"), F.col("_rev")) > 0.3)))
    pairs = met.select(*PAGE, "orig_block_id", "rev_block_id", similarity(F.col("_orig"), F.col("_rev")).alias("sim"), here.alias("_here"))
    return pairs.filter((F.col("sim") > 0.3) | F.col("_here")).drop("_here")


def dominant_matching(pairs: DataFrame) -> tuple[DataFrame, int]:
    """The pairs that a choice by falling ``sim`` (then orig_block_id, rev_block_id) takes, each block once, and the rounds it took.

    A round takes all pairs that are each other's best of what is left, and then leaves out all pairs of their blocks; a block whose first choice is taken so gets
    its next. Of the pairs with the highest sim, the first by ids is always such a pair, so every round takes one at least from each page that has any, and rounds end.
    """
    best = lambda own, *order: F.row_number().over(Window.partitionBy(*PAGE, own).orderBy(F.desc("sim"), *order)) == 1
    left, taken, rounds = checkpointed(pairs), None, 0
    while taken is None or not left.isEmpty():
        ranked = left.withColumns({"_a": best("orig_block_id", "rev_block_id"), "_b": best("rev_block_id", "orig_block_id")})
        now = checkpointed(ranked.filter("_a AND _b").select(left.columns))
        taken, rounds = now if taken is None else taken.unionByName(now), rounds + 1
        for own in ("orig_block_id", "rev_block_id"):
            left = left.join(now.select(*PAGE, own), [*PAGE, own], "left_anti")
        left = checkpointed(left.select(now.columns))
    return taken, rounds


def greedy_matching(pairs: DataFrame) -> DataFrame:
    """What ``dominant_matching`` takes, without rounds: pairs come to a task page by page by falling ``sim`` (then orig_block_id, rev_block_id), and each whose blocks are both free is taken. A task holds one page's taken blocks."""
    columns = [*PAGE, "orig_block_id", "rev_block_id", "sim"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, left, right = None, set(), set()
        for b in batches:
            free = []
            for doc, no, x, y in zip(*(b.column(c).to_pylist() for c in columns[:4]), strict=True):
                if page != (doc, no):
                    page, left, right = (doc, no), set(), set()
                free.append(x not in left and y not in right)
                if free[-1]:
                    left.add(x), right.add(y)
            yield b.filter(pa.array(free, pa.bool_()))

    rows = pairs.select(columns)
    return rows.repartition(*PAGE).sortWithinPartitions(*PAGE, F.desc("sim"), "orig_block_id", "rev_block_id").mapInArrow(run, rows.schema)


def match_blocks_fuzzy(orig: DataFrame, rev: DataFrame, dx: float = 40.0, dy: float = 12.0) -> DataFrame:
    """Blocks near each other that are alike, paired by ``greedy_matching``, with both texts, the revised place, the larger of both sizes and sim."""
    pairs = greedy_matching(nearby_pairs(orig, rev, dx, dy))
    a = orig.select(*PAGE, F.col("block_id").alias("orig_block_id"), F.col("text").alias("orig_text"), F.col("width").alias("_width"), F.col("height").alias("_height"))
    b = rev.select(*PAGE, F.col("block_id").alias("rev_block_id"), F.col("text").alias("rev_text"), F.col("x").alias("rev_x"), F.col("y").alias("rev_y"), "width", "height")
    both = pairs.join(a, [*PAGE, "orig_block_id"]).join(b, [*PAGE, "rev_block_id"])
    larger = [F.greatest(f"_{c}", c).alias(c) for c in ("width", "height")]
    return both.select(*PAGE, "orig_block_id", "rev_block_id", "orig_text", "rev_text", "rev_x", "rev_y", *larger, "sim")


def without_exact(orig: DataFrame, rev: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks of both sides that have no exact partner; matched once and kept."""
    rest = checkpointed(match_blocks_exact(orig, rev).filter("orig_block_id IS NULL OR rev_block_id IS NULL"))
    side = lambda p, other: rest.filter(f"{other}_block_id IS NULL").select(*PAGE, *(F.col(f"{p}_{c}").alias(c) for c in ("block_id", "text", "x", "y", "width", "height")))
    return side("orig", "rev"), side("rev", "orig")


def diff(orig: DataFrame, rev: DataFrame) -> DataFrame:
    """Changes between revisions: (doc_id, page_no, kind, original_text, revised_text, x, y, width, height, seq). Exact pairs are no changes; the rest is paired by likeness, with the larger of both sizes, or added, or deleted."""
    left, right = without_exact(orig, rev)
    pairs = checkpointed(match_blocks_fuzzy(left, right))
    deleted = left.join(pairs.select(*PAGE, F.col("orig_block_id").alias("block_id")), [*PAGE, "block_id"], "left_anti")
    added = right.join(pairs.select(*PAGE, F.col("rev_block_id").alias("block_id")), [*PAGE, "block_id"], "left_anti")
    empty = F.lit("")
    shape = lambda d, kind, a, b, x, y, seq: d.select(*PAGE, F.lit(kind).alias("kind"), a.alias("original_text"), b.alias("revised_text"), F.col(x).alias("x"), F.col(y).alias("y"), "width", "height", F.col(seq).alias("seq"))
    return (
        shape(pairs, "modified", F.col("orig_text"), F.col("rev_text"), "rev_x", "rev_y", "rev_block_id")
        .unionByName(shape(deleted, "deleted", F.col("text"), empty, "x", "y", "block_id"))
        .unionByName(shape(added, "added", empty, F.col("text"), "x", "y", "block_id"))
    )


def diff_summary(diffs: DataFrame) -> DataFrame:
    """A2: changes by kind for each page, each document (null page) and all (null document)."""
    count = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return diffs.rollup("doc_id", "page_no").agg(count("added"), count("deleted"), count("modified"), F.count("*").alias("total"))


def compare_pages(a: DataFrame, b: DataFrame) -> DataFrame:
    """Page by page, same or different by content (doc_id, page_no, text), over the pages that both have; and what one has more."""
    x = a.select(*PAGE, F.sha2("text", 256).alias("_a"), F.length("text").alias("_na"))
    y = b.select(*PAGE, F.sha2("text", 256).alias("_b"), F.length("text").alias("_nb"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return x.join(y, PAGE, "full").groupBy("doc_id").agg(
        F.count_if(both & (F.col("_a") == F.col("_b"))).alias("same"), F.count_if(both & (F.col("_a") != F.col("_b"))).alias("different"),
        (F.count("_b") - F.count("_a")).alias("page_count_diff"), (F.coalesce(F.sum("_nb"), F.lit(0)) - F.coalesce(F.sum("_na"), F.lit(0))).alias("size_diff"),
    )


def _texts(blocks: DataFrame) -> DataFrame:
    return blocks.select(*PAGE, blank_trim(F.col("text")).alias("text"))


def added_blocks(orig: DataFrame, rev: DataFrame) -> DataFrame:
    """Texts that the revision has more often than the original, page by page, as often as the difference."""
    return _texts(rev).exceptAll(_texts(orig))


def unchanged_blocks(orig: DataFrame, rev: DataFrame) -> DataFrame:
    """Texts that both have, as often as both do."""
    return _texts(orig).intersectAll(_texts(rev))
