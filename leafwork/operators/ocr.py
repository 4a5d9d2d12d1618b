"""OCR words (doc_id, page_no, level, block_num, par_num, line_num, word_num, x_left, y_top, width, height, conf, text) and what is made of them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from leafwork.functions.geometry import pixels_to_points
from leafwork.functions.text import blank_trim
from leafwork.sources.writers import in_order

from .regions import per_page, split_by
from .runs import gathered, packed

PAGE = ["doc_id", "page_no"]
LINE = [*PAGE, "block_num", "par_num", "line_num"]


def suspects(words: DataFrame, below: float = 75.0) -> DataFrame:
    """A3: words of low confidence that have a text."""
    return words.filter((F.col("conf") < below) & (blank_trim(F.col("text")) != "")).select(*LINE, "word_num", "text", "conf")


def ocr_page_stats(words: DataFrame, below: float = 75.0) -> DataFrame:
    """A3: per page the mean of the positive confidences, 85 if there is none, and the number of suspects."""
    bad = (F.col("conf") < below) & (blank_trim(F.col("text")) != "")
    return words.groupBy(*PAGE).agg(F.coalesce(F.avg(F.when(F.col("conf") > 0, F.col("conf"))), F.lit(85.0)).alias("mean_conf"), F.count_if(bad).alias("suspects"))


def ocr_doc_stats(pages: DataFrame) -> DataFrame:
    """A4: per document the mean of its pages' means, its pages and its suspects."""
    return pages.groupBy("doc_id").agg(F.avg("mean_conf").alias("mean_conf"), F.count("*").alias("pages"), F.sum("suspects").alias("suspects"))


def _joined(words: Column, cjk: bool) -> Column:
    """Words with spaces between; in CJK text only between two ASCII characters."""
    if not cjk:
        return F.array_join(words, " ")
    ascii_ = lambda c: c.rlike(r"^[\x00-\x7F]$")
    glue = lambda a, w: F.when((a == "") | (w == ""), F.concat(a, w)).when(ascii_(F.right(a, F.lit(1))) & ascii_(F.left(w, F.lit(1))), F.concat(a, F.lit(" "), w)).otherwise(F.concat(a, w))
    return F.aggregate(words, F.lit(""), glue)


def ocr_lines(words: DataFrame, cjk: bool = False) -> DataFrame:
    """A5: lines with box, confidence, font size and text. A row of level 4 gives the box, else the union of the words' boxes; confidence is the mean of those not negative, 80 if there is none; the size is 0.85 of the height, 10 at least."""
    word, line = (F.col("level") == 5) & F.col("text").rlike(r"\S"), F.col("level") == 4
    right, bottom = F.col("x_left") + F.col("width"), F.col("y_top") + F.col("height")
    sure = F.when(F.col("conf") >= 0, F.col("conf").cast("double"))
    total = lambda c, start: F.aggregate(c, F.lit(start), lambda a, v: a + F.coalesce(v, F.lit(start)))
    # words that follow one another in a line become one row where they are read, their texts one text: the shuffle moves little more than that
    runs = packed(words.filter(word).select(*LINE, "word_num", "text", F.col("x_left").alias("_x0"), F.col("y_top").alias("_y0"), right.alias("_x1"), bottom.alias("_y1"), sure.alias("_conf")), LINE)
    rising = F.col("word_num") == F.sort_array(F.array_distinct("word_num"))
    plain = ~F.array_join("text", "").contains("\n")
    runs = runs.select(
        *LINE, F.array_min("_x0").alias("_x0"), F.array_min("_y0").alias("_y0"), F.array_max("_x1").alias("_x1"), F.array_max("_y1").alias("_y1"), total("_conf", 0.0).alias("_conf"), F.size(F.array_compact("_conf")).alias("_sure"),
        F.col("word_num").alias("_nums"), (rising & plain).alias("_done"), F.when(plain, F.array_join("text", "\n")).alias("_text"), F.when(~plain, F.col("text")).alias("_texts"),
    )
    boxes = words.filter(line).select(*LINE, F.col("x_left").alias("_x"), F.col("y_top").alias("_y"), F.col("width").alias("_w"), F.col("height").alias("_h"))
    lines = gathered(runs.unionByName(boxes, allowMissingColumns=True), LINE).withColumn("_n", F.size(F.array_compact("_sure"))).filter("_n > 0")
    # most lines are one run in order; the others' words are sorted
    one = (F.col("_n") == 1) & F.coalesce(F.array_max("_done"), F.lit(False))
    parts = F.filter(F.arrays_zip("_nums", "_text", "_texts"), lambda r: r["_nums"].isNotNull())
    numbered = F.transform(parts, lambda r: F.arrays_zip(r["_nums"].alias("n"), F.coalesce(F.split(r["_text"], "\n"), r["_texts"]).alias("t")))
    ordered = F.transform(F.array_sort(F.flatten(numbered)), lambda x: x["t"])
    only = F.array_max("_text")
    text = F.when(one, _joined(F.split(only, "\n"), cjk) if cjk else F.replace(only, F.lit("\n"), F.lit(" "))).otherwise(_joined(ordered, cjk))
    agg = lines.select(
        *LINE, *(F.array_max(c).alias(c) for c in ("_x", "_y", "_w", "_h", "_x1", "_y1")), *(F.array_min(c).alias(c) for c in ("_x0", "_y0")),
        F.coalesce(F.try_divide(total("_conf", 0.0), total("_sure", 0)), F.lit(80.0)).alias("conf"), text.alias("text"),
    )
    h = F.coalesce("_h", F.col("_y1") - F.col("_y0"))
    return agg.select(
        *LINE, F.coalesce("_x", "_x0").alias("x_left"), F.coalesce("_y", "_y0").alias("y_top"), F.coalesce("_w", F.col("_x1") - F.col("_x0")).alias("width"), h.alias("height"), "conf",
        F.greatest(h * 0.85, F.lit(10.0)).alias("font_size"), "text",
    )


def ocr_text(words: DataFrame) -> DataFrame:
    """A page's text in word order, a newline where paragraph or line change, else a space, and one at the end."""
    order = ["block_num", "par_num", "line_num", "word_num"]
    w = Window.partitionBy(*PAGE).orderBy(*order)
    changed = (F.lag("par_num").over(w) != F.col("par_num")) | (F.lag("line_num").over(w) != F.col("line_num"))
    lead = F.when(F.row_number().over(w) == 1, "").when(changed, "\n").otherwise(" ")
    rows = words.filter(blank_trim(F.col("text")) != "").withColumn("_t", F.concat(lead, "text"))
    return rows.groupBy(*PAGE).agg(F.concat(in_order(F.col("_t"), "", *order), F.lit("\n")).alias("text"))


def worst_suspects(words: DataFrame, k: int) -> DataFrame:
    """The ``k`` words of lowest confidence of each document, ties in reading order."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("conf", "page_no", "block_num", "par_num", "line_num", "word_num"))
    return suspects(words).withColumn("rank", place).filter(F.col("rank") <= k)


def ocr_fallback(pages: DataFrame, blocks: DataFrame, words: DataFrame) -> DataFrame:
    """The texts of pages (doc_id, page_no, text) that have blocks or a text of their own; the others' from their OCR words, and only those."""
    own = blocks.groupBy(*PAGE).agg(in_order(F.col("text"), " ", "block_id").alias("_blocks"))
    rows = pages.join(own, PAGE, "left")
    bare = F.col("_blocks").isNull() & (blank_trim(F.coalesce("text", F.lit(""))) == "")
    native = rows.filter(~bare).select(*PAGE, F.lit("native").alias("source"), F.coalesce("_blocks", "text").alias("text"))
    read = rows.filter(bare).select(*PAGE).join(ocr_text(words), PAGE, "left")
    return native.unionByName(read.select(*PAGE, F.lit("ocr").alias("source"), F.coalesce("text", F.lit("")).alias("text")))


def redact_by_ocr(blocks: DataFrame, words: DataFrame, term: str, px: tuple[float, float] = (1654.0, 2339.0), page: tuple[float, float] = (595.0, 842.0)) -> DataFrame:
    """Blocks with ``removed``: those that meet a line of OCR text with ``term``, any case, widened by 2 points. A blank term, or one found nowhere, fails the query."""
    if not term.strip():
        raise ValueError("nothing to look for")
    hits = ocr_lines(words).filter(F.lower("text").contains(term.lower()))
    box = pixels_to_points(F.col("x_left"), F.col("y_top"), F.col("width"), F.col("height"), *map(F.lit, (*px, *page)), pad=2.0)
    rects = hits.select(*PAGE, box["x"].alias("x"), box["y"].alias("y"), box["width"].alias("w"), box["height"].alias("h")).dropna(subset=PAGE)
    # counted where the rectangles of a page are together, in the columns that the join reads, so that both read one shuffle of the words
    found = per_page(rects, "x", "y", "w", "h").agg(F.sum(F.size("_rects")).alias("_n")).select(F.when(F.coalesce("_n", F.lit(0)) == 0, F.raise_error(F.lit("the term is on no page")).cast("long")).otherwise(F.col("_n")).alias("_n"))
    x, y = F.col("x"), F.col("y")
    marked = split_by(blocks, rects, lambda r: (x < r["x"] + r["w"]) & (x + F.col("advance") > r["x"]) & y.between(r["y"], r["y"] + r["h"]))
    return marked.join(F.broadcast(found), F.col("_n") > 0).drop("_n")


#: A19's angles, in half degrees.
STEPS = range(-20, 21)


TANGENTS = np.array([math.tan(math.radians(step / 2)) for step in STEPS])


def _bin_figures(mid: float, xs: np.ndarray, ys: np.ndarray, bin_height: float) -> tuple[np.ndarray, np.ndarray]:
    """For each of STEPS the sum of the squared numbers of boxes in a bin, and how many bins there are from the first to the last; a few steps at a time on pages of very many boxes."""
    squares, bins = [], []
    some = max(1, 4_000_000 // len(xs))
    for i in range(0, len(TANGENTS), some):
        at = np.sort(np.floor((ys + np.outer(TANGENTS[i : i + some], xs - mid)) / bin_height), axis=1)
        starts = np.ones(at.shape, dtype=bool)
        starts[:, 1:] = at[:, 1:] != at[:, :-1]
        places = np.flatnonzero(starts)
        n = np.diff(places, append=at.size)
        squares.append(np.add.reduceat(n * n, np.searchsorted(places, np.arange(len(at)) * len(xs))))
        bins.append((at[:, -1] - at[:, 0]).astype(np.int64) + 1)
    return np.concatenate(squares), np.concatenate(bins)


def skew_estimate(words: DataFrame, bin_height: float = 10.0) -> DataFrame:
    """Per page the angle from -10 to 10 degrees, in half degrees, at which the words' boxes fall into the most uneven rows; the first of equally good ones.

    A page's places come together once and are turned there, so no word is multiplied by the angles; words without a place are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for b in batches:
            xs, ys = b.column("xs"), b.column("ys")
            found = [_bin_figures(mid, xs[i].values.to_numpy(), ys[i].values.to_numpy(), bin_height) for i, mid in enumerate(b.column("mid").to_pylist())]
            figures = [pa.array([f[k] for f in found], kind) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("page_no"), b.column("total"), *figures], ["doc_id", "page_no", "total", "squares", "bins"])

    place = words.filter(F.col("x_left").isNotNull() & F.col("y_top").isNotNull()).select(*PAGE, F.col("x_left").cast("double").alias("x"), F.col("y_top").cast("double").alias("y"), (F.col("x_left") + F.col("width")).cast("double").alias("right"))
    page = place.groupBy(*PAGE).agg((F.max("right") / 2).alias("mid"), F.collect_list("x").alias("xs"), F.collect_list("y").alias("ys"), F.count("*").alias("total")).filter("mid IS NOT NULL")
    types = {f.name: f.dataType.simpleString() for f in page.schema}
    turned = page.select(*PAGE, "mid", "xs", "ys", "total").mapInArrow(run, f"doc_id {types['doc_id']}, page_no {types['page_no']}, total long, squares array<bigint>, bins array<bigint>")
    mean = lambda n: F.col("total") / n
    scored = F.transform(F.arrays_zip("squares", "bins"), lambda f, i: F.struct(F.round(f["squares"] / f["bins"] - mean(f["bins"]) * mean(f["bins"]), 9).alias("variance"), (-(i + STEPS[0])).alias("back")))
    return turned.select(*PAGE, (-F.array_max(scored)["back"] / 2).alias("angle"))
