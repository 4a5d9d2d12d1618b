"""Quality rules: counts within a document, and lines that too many documents of a host share.

Lines are normalised, hashed and counted by host over distinct texts, so that exact copies of one document count once.
A line above the limits is removed; a document that keeps too little of itself is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpointed, join_by_weight, lower_ascii, packed, text_of, unpacked

#: What separates words, and what counts as a symbol.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _repeated(words: list[bytes], width: int = 5) -> int:
    """How many words lie in a window of ``width`` words that is found twice or more."""
    if len(words) <= width:
        return 0
    number: dict[bytes, int] = {}
    fresh = count()
    ids = np.fromiter((number[w] if w in number else number.setdefault(w, next(fresh)) for w in words), np.int64, len(words))
    # windows of 1, 2, 3 ... words, numbered so that equal windows have equal numbers
    window = ids
    for k in range(1, width):
        _, window = np.unique(window[:-1] * len(words) + ids[k:], return_inverse=True)
    twice = np.bincount(window)[window] > 1
    if not twice.any():
        return 0
    steps = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + width, -1)
    return int((np.cumsum(steps) > 0).sum())


def measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), _repeated(words)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for batch in batches:
        rows = [measures(t.as_py()) for t in batch.column("text")]
        counts = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * 5
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_id"), batch.column("_key"), *counts], ["doc_id", "_id", "_key", *names])


def _normal(line: Column) -> Column:
    return F.trim(lower_ascii(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def _keyed(docs: DataFrame, host: str) -> DataFrame:
    """A row's key is its doc_id and a hash of its contents: repeated rows share it, and share one verdict."""
    d = text_of(docs, F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"))
    return d.withColumns({"_id": F.coalesce("doc_id", F.lit(-1)), "_key": F.xxhash64("_host", "text")})


def _removals(d: DataFrame, min_docs: int, share: float) -> DataFrame:
    """_id, _key, _removed: the positions of a document's lines above the limits, and the words they have."""
    text_hash = F.xxhash64("text").alias("_text")
    lines = d.select("_id", "_key", "_host", text_hash, F.posexplode(F.split("text", "\n")).alias("_pos", "_line"))
    lines = lines.withColumn("_line", _normal(F.col("_line"))).filter("_line <> ''")
    lines = lines.withColumns({"_words": F.size(F.split("_line", " ")), "_line": F.xxhash64("_line")})
    hosts = checkpointed(d.select("_host", text_hash).distinct().groupBy("_host").agg(F.count("*").alias("_docs")))
    total = hosts.agg(F.sum("_docs")).first()[0] or 0
    by_text = lines.groupBy("_host", "_line", "_text").agg(F.count("*").alias("_rows"))
    counts = by_text.groupBy("_host", "_line").agg(F.count("*").alias("_found"), F.sum("_rows").alias("_rows")).filter(F.col("_found") >= min_docs)
    counts = join_by_weight(counts, hosts, ["_host"], "_docs", total, F.col("_line"))
    over = checkpointed(counts.filter(F.col("_found") > F.col("_docs") * share).select("_host", "_line", "_rows"))
    # the lines to remove are the frequent ones
    rows = over.agg(F.sum("_rows")).first()[0] or 0
    gone = join_by_weight(lines, over, ["_host", "_line"], "_rows", rows, F.col("_key")).filter("_rows IS NOT NULL")
    return gone.groupBy("_id", "_key").agg(F.collect_set(F.struct("_pos", "_words")).alias("_removed"))


def _verdicts(d: DataFrame, min_docs: int, share: float, keep_share: float, min_words: int) -> DataFrame:
    base = d.select("doc_id", "_id", "_key", "text").mapInArrow(
        _measured, "doc_id long, _id long, _key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    )
    rows = base.join(_removals(d, min_docs, share), ["_id", "_key"], "left")
    gone = F.coalesce(F.aggregate("_removed", F.lit(0).cast("long"), lambda a, x: a + x["_words"]), F.lit(0).cast("long"))
    rows = rows.withColumn("n_removed_words", gone).withColumn("base_failed", F.expr(f"n_words < {min_words} OR 100 * n_repeat_words > 20 * n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & ((left < min_words) | (left < keep_share * F.col("n_words")))
    return rows.withColumns({"depleted": depleted, "kept": ~F.col("base_failed") & ~depleted})


def quality_rules(docs: DataFrame, host: str = "source", min_docs: int = 10, share: float = 0.02, keep_share: float = 0.3, min_words: int = 10) -> DataFrame:
    """One row per input row with its counts and its verdict.

    A line is removed if at least ``min_docs`` distinct texts of the host have it and these are more than ``share`` of
    the host's distinct texts. A document is depleted if lines were removed and fewer than ``min_words`` words, or less
    than ``keep_share`` of its words, are left. Null texts count as empty and fail the base rules, a null host is a host
    of its own, repeated rows get equal verdicts, lines without a word are never counted or removed, very long texts are
    read whole, other columns are not read, and an empty table gives an empty result.
    """
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")
    return _verdicts(_keyed(docs, host), min_docs, share, keep_share, min_words).select(*cols)


def clean(docs: DataFrame, host: str = "source", min_docs: int = 10, share: float = 0.02, keep_share: float = 0.3, min_words: int = 10) -> DataFrame:
    """The documents that the rules keep, without their lines above the limits; all columns of ``docs`` stay, n_chars is counted anew."""
    d = _keyed(docs, host)
    kept = _verdicts(d, min_docs, share, keep_share, min_words).filter("kept").select("_id", "_key", F.transform("_removed", lambda x: x["_pos"]).alias("_gone")).dropDuplicates(["_id", "_key"])
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = packed(docs, _id=F.coalesce("doc_id", F.lit(-1)), _key=F.xxhash64(F.coalesce(F.col(host).cast("string"), F.lit("")), text)).join(kept, ["_id", "_key"])
    lines = F.transform(F.split("_row.text", "\n"), lambda x, i: F.struct(x.alias("line"), i.alias("i")))
    rest = F.array_join(F.transform(F.filter(lines, lambda x: ~F.array_contains("_gone", x["i"])), lambda x: x["line"]), "\n")
    return unpacked(rows, F.when(F.col("_gone").isNotNull(), rest))
