"""Ranked lexical search: accumulator-limited term-at-a-time over blocks of documents.

Spark counts terms and documents, spreads the documents and merges the best of each task. Within a block of documents, an item's terms are taken rarest first.
A document gets an accumulator when a term meets it; once the bounds of the terms that are left cannot reach the kth best partial score, no accumulator is
made any more, and the survivors are updated exactly. What a task has found in its blocks so far is a bound for its next ones.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import lower_ascii, written

#: Fixed value: a term is a maximal match.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Items are searched for in blocks of about so many terms (repeats in an item not counted), which bounds what is broadcast.
BLOCK_TERMS = 1_000_000
#: A block of documents ends at so many postings; each document is in one block.
BLOCK_POSTINGS = 4_000_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
INDEX = "doc_id long, n long, terms array<int>, tfs array<int>"
FOUND = "item int, doc_id long, score long, task int"


def pieces(text: str, size: int = 1_000_000) -> Iterator[str]:
    """A text in pieces of about ``size`` characters that end at the end of a term, so that the terms of a very long one are never held at once."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + size)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def counted(text: str | None, number: dict[str, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """How many terms the text has, A-Z in lower case, and of those in ``number`` the numbers and occurrences."""
    n, which, tfs = 0, [], []
    for piece in pieces(text or ""):
        terms = re.findall(TERM, piece.encode().translate(LOWER).decode())
        n += len(terms)
        one = np.unique(np.fromiter((t for t in map(number.get, terms) if t is not None), np.int32), return_counts=True)
        which.append(one[0])
        tfs.append(one[1])
    if len(which) < 2:
        return n, which[0] if which else np.zeros(0, np.int32), tfs[0] if tfs else np.zeros(0, np.int64)
    all_of, at = np.unique(np.concatenate(which), return_inverse=True)
    return n, all_of, np.bincount(at, np.concatenate(tfs), len(all_of)).astype(np.int64)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def indexed(docs: DataFrame, terms: dict[str, int]) -> DataFrame:
    """For each document with a term: doc_id, n, and of the ``terms`` that it has their numbers and occurrences (INDEX). The texts are read once."""
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for b in batches:
            ids, n, terms_out, tfs = [], [], [], []
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                words, which, tf = counted(text.as_py(), number)
                if not words:
                    continue
                ids.append(doc_id.as_py())
                n.append(words)
                terms_out.append(which)
                tfs.append(tf.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(terms_out, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, INDEX)


class Block:
    """The postings of some documents by term, with what each adds to a score before its weight."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, count: int, total: int):
        self.ids = ids
        m = 50 + np.array([50 * int(x) * count // total for x in n], np.int64)
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        order = np.argsort(terms, kind="stable")
        self.docs, terms, tf = doc[order], terms[order], tfs[order].astype(np.int64)
        self.worth = 1_000_000_000 * tf // (1000 * tf + 20 * m[self.docs])
        self.terms, starts = np.unique(terms, return_index=True)
        self.starts = np.append(starts, len(terms))
        self.most = np.maximum.reduceat(self.worth, starts) if len(terms) else np.zeros(0, np.int64)

    def search(self, wanted: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """doc positions and scores of those that may be among the ``k`` best for the terms ``wanted``, rarest first; a score below ``floor`` can't."""
        at = np.searchsorted(self.terms, wanted)
        there = at < len(self.terms)
        there[there] = self.terms[at[there]] == wanted[there]
        at, w = at[there], weights[there]
        # left[i]: what terms from the ith on can add to a document at most
        left = np.append(np.cumsum((w * self.most[at])[::-1])[::-1], 0)
        score, grow = np.zeros(len(self.ids), np.int64), True
        for i, (t, weight_) in enumerate(zip(at, w, strict=True)):
            docs = self.docs[self.starts[t] : self.starts[t + 1]]
            added = weight_ * self.worth[self.starts[t] : self.starts[t + 1]]
            if grow:
                # a newcomer with exactly the kth score may still win by its doc_id
                bar = floor
                if left[i] < score.max(initial=0) and len(score) > k:
                    bar = max(bar, int(np.partition(score, -k)[-k]))
                grow = left[i] >= bar
            if not grow:
                has = score[docs] > 0
                docs, added = docs[has], added[has]
            score[docs] += added
        best = np.flatnonzero(score > max(0, floor - 1))
        if len(best) > k:
            kth = np.partition(score[best], -k)[-k]
            best = best[score[best] >= kth]
        return best, score[best]


def searched(index: DataFrame, items: list[tuple[int, list[int]]], weights: np.ndarray, df: np.ndarray, count: int, total: int, k: int) -> DataFrame:
    """For each item number the ``k`` best documents of each task (FOUND), by score, then doc_id (null first)."""
    wanted = []
    for number, terms in items:
        t = np.array(terms, np.int32)
        t = t[np.lexsort((t, df[t]))]
        wanted.append((number, t))
    shared = index.sparkSession.sparkContext.broadcast((wanted, weights))

    def best_of(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
        return np.lexsort((ids, -scores))[:k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights = shared.value
        # null doc_ids go by the smallest number, so that they sort first
        none = np.iinfo(np.int64).min
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def search(rows: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(rows).combine_chunks()
            ids = t.column("doc_id").fill_null(none).to_numpy()
            sizes = pc.list_value_length(t.column("terms")).to_numpy()
            block = Block(ids, t.column("n").to_numpy(), sizes, pc.list_flatten(t.column("terms")).to_numpy(), pc.list_flatten(t.column("tfs")).to_numpy(), count, total)
            for number, terms in wanted:
                had = found.get(number)
                floor = int(had[1][-1]) if had is not None and len(had[0]) == k else 1
                at, scores = block.search(terms, weights[terms], k, floor)
                if len(at):
                    new = block.ids[at], scores
                    both = new if had is None else (np.concatenate([had[0], new[0]]), np.concatenate([had[1], new[1]]))
                    keep = best_of(*both)
                    found[number] = both[0][keep], both[1][keep]

        held, postings = [], 0
        for b in batches:
            held.append(b)
            postings += len(b.column("terms").flatten())
            if postings >= BLOCK_POSTINGS:
                search(held)
                held, postings = [], 0
        if held:
            search(held)
        if found:
            numbers = np.concatenate([np.full(len(x[0]), i, np.int32) for i, x in found.items()])
            ids = np.concatenate([x[0] for x in found.values()])
            columns = [pa.array(numbers), pa.array(ids, mask=ids == none), pa.array(np.concatenate([x[1] for x in found.values()])), pa.array(np.full(len(ids), zlib.crc32(ids.tobytes()) % 997, np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score", "task"])

    return index.select("doc_id", "n", "terms", "tfs").mapInArrow(run, FOUND)


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 50, item_id: str = "item_id") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` documents with the highest scores above 0 for each item, equal scores by ascending doc_id.

    A null or empty text has no term: such a document counts in no figure and is never found, such an item finds nothing. Texts are read whole. Every row of
    ``docs`` is a document, so repeated rows are found and counted each; null doc_ids come first among equal scores. Rows of ``items`` with
    one id are one item with the terms of all of them, those of a null id as well. Columns other than doc_id, text and the item's id aren't read. Empty tables give no rows.
    """
    spark = docs.sparkSession
    words = items.select(F.col(item_id).alias("item_id"), F.explode(F.array_distinct(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(TERM), F.lit(0)))).alias("term"))
    words = written(words.distinct())
    blocks = max(1, -(-words.count() // BLOCK_TERMS))
    out = None
    for i in range(blocks):
        mine = words.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i)
        # one block of items with about BLOCK_TERMS terms, whatever the number of items
        lists = mine.groupBy("item_id").agg(F.collect_list("term").alias("terms")).toArrow().to_pydict()
        number: dict[str, int] = {}
        of = [[number.setdefault(t, len(number)) for t in terms] for terms in lists["terms"]]
        index = written(indexed(docs, number))
        count, total = index.agg(F.count("*"), F.sum("n")).first()
        if not count or not number:
            continue
        df = np.zeros(len(number), np.int64)
        held = index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()
        df[held.column("t").to_numpy()] = held.column("df").to_numpy()
        weights = np.array([weight(count, int(x)) for x in df], np.int64)
        found = searched(index, list(enumerate(of)), weights, df, count, total, k)
        # the best of each task meet in two steps, so that no item's rows of all tasks are in one task
        order = [F.desc("score"), F.asc_nulls_first("doc_id")]
        some = found.withColumn("r", F.row_number().over(W.partitionBy("item", "task").orderBy(*order))).filter(F.col("r") <= k)
        best = some.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
        ids = spark.createDataFrame(pa.table({"item": pa.array(range(len(of)), pa.int32()), "item_id": pa.array(lists["item_id"], pa.int64())}))
        one = best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")
        out = one if out is None else out.union(one)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out
