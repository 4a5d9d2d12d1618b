"""Sparse suffix-array dedup: passages that repeat across documents.

Suffixes are kept where a minimiser begins: of every ``window`` successive runs of ``key`` words the one with the least
hash, so that wherever a passage of ``min_words`` words stands, the same of its suffixes are kept. They are sorted by their heads
and by the words around these, and each is compared with its neighbour in that order, the document before it (of the first document, the one after it),
word by word, to the right and to the left. Where suffixes of one head have different words around it, those with equal words are neighbours, and the
first and the last of each such run are sorted once more, by every whole passage of ``min_words`` words around the head.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import claims, forget, join_by_weight, join_counted, packed, text_of, unpacked, written
from .simhash import _repeats_ids as repeats_ids

FACTOR = 0x9E3779B97F4A7C15
BACK = pow(FACTOR, -1, 1 << 64)


class _Hashes(dict):
    """64-bit hashes of words, remembered; at most ``most`` of them."""

    most = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = 1 << n.bit_length()
            self.up = np.multiply.accumulate(np.append(np.uint64(1), np.full(m - 1, FACTOR, np.uint64)))
            self.down = np.multiply.accumulate(np.append(np.uint64(1), np.full(m - 1, BACK, np.uint64)))
        return self.up[:n], self.down[:n]


def _slide(a: np.ndarray, width: int, take) -> np.ndarray:
    """``take`` (minimum or maximum) over every ``width`` successive values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        a = take(a[: len(a) - step], a[step:])
        done += step
    return a


def _sums(words: list[bytes], hashes: _Hashes, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the words' hashes, each times its place's power, and the powers that take places out again."""
    n = len(words)
    up, down = powers.get(n + 1)
    return np.append(np.uint64(0), np.cumsum(np.fromiter(map(hashes.__getitem__, words), np.uint64, n) * up[:n])), down


def _runs(sums: np.ndarray, down: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words from ``first`` to before ``end``, wherever they stand."""
    h = (sums[end] - sums[first]) * down[first]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _heads(sums: np.ndarray, down: np.ndarray, key: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every run of ``key`` words, and the least of every ``window`` successive ones."""
    first = np.arange(len(sums) - key)
    heads = _runs(sums, down, first, first + key)
    return heads, _slide(heads, window, np.minimum)


def suffixes(words: list[bytes], hashes: _Hashes, powers: _Powers, key: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the kept suffixes and the hashes of their first ``key`` words; none in a text of fewer than key + window - 1 words."""
    at, heads, _ = _kept(words, hashes, powers, key, window)
    return at, heads


def _kept(words: list[bytes], hashes: _Hashes, powers: _Powers, key: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``suffixes`` and the hashes of all words that a passage of key + window - 1 words through the head can have, with the head's place among them."""
    n = len(words)
    if n < key + window - 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    sums, down = _sums(words, hashes, powers)
    heads, least = _heads(sums, down, key, window)
    # a head is kept if it is the least of some window it lies in
    edge = np.zeros(window - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), window, np.maximum) == heads)
    first, end = np.maximum(at - window + 1, 0), np.minimum(at + key + window - 1, n)
    around = _runs(sums, down, first, end) + ((at - first) * 4096 + end - at).astype(np.uint64) * np.uint64(FACTOR)
    return at, heads[at], around


def passages(words: list[bytes], kept: np.ndarray, hashes: _Hashes, powers: _Powers, key: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """All passages of key + window - 1 words whose least head is one of those that begin at ``kept``: where the first such head begins, and the passage's hash."""
    sums, down = _sums(words, hashes, powers)
    heads, least = _heads(sums, down, key, window)
    first = np.flatnonzero(np.isin(least, heads[kept]))
    same = np.flatnonzero(np.isin(heads, heads[kept]))
    # of the heads from the passage's start on, the first that is its least
    next_same = np.searchsorted(same, first)
    while (off := heads[same[next_same]] != least[first]).any():
        next_same += off
    at = same[next_same]
    return at, _runs(sums, down, first, first + key + window - 1)


class _Suffixes:
    def __init__(self, key: int, window: int):
        self.key, self.window = key, window

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers = _Hashes(), _Powers()
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                found = [_kept(t.as_py().encode().lower().split(), hashes, powers, self.key, self.window) for t in part.column("text")]
                many = np.array([len(at) for at, _, _ in found])
                ids = part.column("doc_id").take(pa.array(np.repeat(np.arange(len(many)), many)))
                at, heads, around = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([ids, pa.array(at.astype(np.int32)), pa.array(heads.view(np.int64)), pa.array(around.view(np.int64))], ["doc_id", "pos", "head", "around"])


class _Passages:
    def __init__(self, key: int, window: int):
        self.key, self.window = key, window

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers = _Hashes(), _Powers()
        for batch in batches:
            for doc, text, kept in zip(batch.column("doc_id"), batch.column("text"), batch.column("at"), strict=True):
                at, runs = passages(text.as_py().encode().lower().split(), kept.values.to_numpy(), hashes, powers, self.key, self.window)
                for a in range(0, len(at), 100_000):
                    part = at[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), doc.as_py(), np.int64)), pa.array(part.astype(np.int32)), pa.array(runs[a : a + len(part)].view(np.int64))], ["doc_id", "pos", "head"])


class _Neighbours:
    """Of sorted rows (by, doc_id, pos): each with its neighbour of another document and the same ``by``, the last row of the document before it, or of the first document the first row after it.

    Of a partition, the rows whose neighbour may be in another one come with a null neighbour and ``open``; its last row comes with a null neighbour.
    With ``whole`` no value of ``by`` goes on in another partition, only rows that are ``open`` get neighbours, and nothing else comes.
    """

    names = ("by", "doc_id", "pos")

    def __init__(self, whole: bool = False):
        self.whole = whole

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first_by = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy() for c in self.names]
            done = ~batch.column("open").to_numpy(zero_copy_only=False) if self.whole else np.zeros(batch.num_rows, bool)
            if held is None:
                held, first_by = [c[:0] for c in (*rows, done)], rows[0][0]
            rows = [np.concatenate(x) for x in zip(held, (*rows, done), strict=True)]
            by, doc, pos, done = rows
            # runs of one document, and for each the run before and after it with the same ``by``
            start = np.flatnonzero(np.append(True, (by[1:] != by[:-1]) | (doc[1:] != doc[:-1])))
            last = np.append(start[1:], len(by)) - 1
            before = np.append(False, by[start[1:]] == by[start[:-1]])
            after = np.append(before[1:], False)
            run = np.repeat(np.arange(len(start)), last - start + 1)
            other = np.where(before, np.append(0, last[:-1]), np.where(after, np.append(start[1:], 0), -1))[run]
            ready = np.flatnonzero(~done & (other >= 0))
            yield self.rows(rows, ready, other[ready])
            done[ready] = True
            if first_by is not None and not self.whole:
                # the partition's first document may have one before it elsewhere
                if len(start) > 1:
                    yield self.rows(rows, np.arange(last[0] + 1))
                    first_by = None
            # what the next rows need: the last row of the run before the last, and the last run, or its last row where it has its neighbours
            keep = [last[-2]] if before[-1] else []
            keep += [last[-1]] if done[start[-1] :].all() else list(range(start[-1], len(by)))
            held = [c[keep] for c in rows]
        if held is not None and not self.whole:
            if first_by is not None:
                yield self.rows(held, np.arange(len(held[0])))
            else:
                yield self.rows(held, np.flatnonzero(~held[3]))
            yield self.rows(held, np.array([len(held[0]) - 1]), tail=True)

    def rows(self, rows: list[np.ndarray], at: np.ndarray, other: np.ndarray | None = None, tail: bool = False) -> pa.RecordBatch:
        own = [pa.array(c[at]) for c in rows[:3]]
        theirs = [pa.nulls(len(at), c.type) for c in own[1:]] if other is None else [pa.array(c[other]) for c in rows[1:3]]
        return pa.RecordBatch.from_arrays([*own, *theirs, pa.array(np.full(len(at), other is None and not tail))], [*self.names, "other_id", "other_pos", "open"])


def neighbours(rows: DataFrame) -> DataFrame:
    """doc_id, pos, other_id, other_pos: the rows (by, doc_id, pos) sorted over all partitions, each with its neighbour of another document and the same ``by``.

    The order is by ranges, so that rows of one ``by``, however many, are spread over tasks; where ranges meet, a few rows of each task are compared once more.
    """
    kinds = "by long, doc_id long, pos int, other_id long, other_pos int, open boolean"
    keys = ["by", "doc_id", "pos"]
    met = written(rows.select(*keys).repartitionByRange("by", "doc_id").sortWithinPartitions(*keys).mapInArrow(_Neighbours(), kinds))
    edges = met.filter("other_id IS NULL").groupBy(*keys).agg(F.bool_or("open").alias("open"))
    across = edges.repartition("by").sortWithinPartitions(*keys).mapInArrow(_Neighbours(True), kinds)
    out = written(met.filter("other_id IS NOT NULL").unionByName(across).select("doc_id", "pos", "other_id", "other_pos"))
    forget(met)
    return out


def extend(a: list[bytes], b: list[bytes], i: int, j: int) -> tuple[int, int]:
    """How many words before a[i] and b[j] agree, and how many from there on."""
    left = 0
    while left < i and left < j and a[i - left - 1] == b[j - left - 1]:
        left += 1
    right, most = 0, min(len(a) - i, len(b) - j)
    while right < most and a[i + right] == b[j + right]:
        right += 1
    return left, right


class _Extended:
    def __init__(self, min_words: int):
        self.min_words = min_words

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, other, text, its, pairs in zip(*(batch.column(c) for c in ("doc_id", "other_id", "text", "other_text", "pairs")), strict=True):
                a, b = text.as_py().encode().lower().split(), its.as_py().encode().lower().split()
                done: dict[int, int] = {}  # for each difference of positions, up to where it has been compared
                for pair in pairs.as_py():
                    i, j = pair["pos"], pair["other_pos"]
                    if i < done.get(i - j, 0):
                        continue
                    left, right = extend(a, b, i, j)
                    done[i - j] = i + right
                    if left + right >= self.min_words:
                        rows.append((doc.as_py(), other.as_py(), i - left, i + right, j - left))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "other_id", "first_word", "end_word", "other_first_word"])


def repeats(docs: DataFrame, min_words: int = 50, key: int = 25) -> DataFrame:
    """doc_id, other_id, first_word, end_word, other_first_word: passages of a document that another one has, too.

    Words are split at white space and compared after lower-casing A-Z. Of the documents that share a passage of ``min_words``
    words each is paired with the one before it, by doc_id, the first with the second, for every such
    passage by itself: all words of all passages are in some row, whatever shorter runs other documents have, and no group grows into all its pairs.
    Passages go as far as words agree on both sides, over ``min_words`` at least. Null texts count as empty, null doc_ids are left out,
    rows that repeat a doc_id count as one document (its least text), very long texts are read whole, other columns aren't read, an empty table
    gives an empty result.
    """
    window = min_words - key + 1
    d = text_of(docs).filter("doc_id IS NOT NULL")
    if repeats_ids(docs):
        d = written(d.groupBy("doc_id").agg(F.min("text").alias("text")))
    found = written(d.mapInArrow(_Suffixes(key, window), "doc_id long, pos int, head long, around long"))

    def shared(rows: DataFrame, *more) -> DataFrame:
        """The rows whose ``head`` two documents or more have."""
        groups = written(rows.groupBy("head").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"), *more).filter("lo <> hi").drop("lo", "hi"))
        out = written(join_by_weight(rows.filter(claims(groups, "head")), groups, ["head"], "n", rows.count(), F.xxhash64("doc_id", "pos")).filter("n IS NOT NULL").drop("n"))
        forget(rows, groups, shuffles=True)
        return out

    met = shared(found, (F.min("around") == F.max("around")).alias("whole"))
    # equal heads among equal words: neighbours agree in all words that a passage through the head can have
    alike = neighbours(met.select(F.xxhash64("head", "around").alias("by"), "doc_id", "pos"))
    # heads among different words: the first and the last of each run are divided by whole passages
    at = F.struct("doc_id", "pos")
    ends = met.filter("NOT whole").groupBy("head", "around").agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    ends = ends.select(F.explode(F.array("lo", "hi")).alias("x")).select("x.*")
    kept = written(ends.groupBy("doc_id").agg(F.collect_set("pos").alias("at")))
    fine = written(d.filter(claims(kept, "doc_id")).join(kept, "doc_id").select("doc_id", "text", "at").mapInArrow(_Passages(key, window), "doc_id long, pos int, head long"))
    again = shared(fine)
    divided = neighbours(again.select(F.col("head").alias("by"), "doc_id", "pos"))
    pairs = alike.union(divided).distinct().groupBy("doc_id", "other_id").agg(F.array_sort(F.collect_list(F.struct("pos", "other_pos"))).alias("pairs"))
    pairs = written(pairs)
    forget(met, kept, again, alike, divided, shuffles=True)
    named = written(pairs.select("doc_id").union(pairs.select("other_id")).distinct())
    texts = written(d.filter(claims(named, "doc_id")).join(named, "doc_id", "left_semi"))
    both = written(join_counted(pairs, texts, ["doc_id"], F.col("other_id")))
    both = join_counted(both, texts.select(F.col("doc_id").alias("other_id"), F.col("text").alias("other_text")), ["other_id"], F.col("doc_id"))
    return both.select("doc_id", "other_id", "text", "other_text", "pairs").mapInArrow(_Extended(min_words), "doc_id long, other_id long, first_word long, end_word long, other_first_word long")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            raw = text.as_py().encode()
            if spans:
                words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
                rest, at = [], 0
                for span in sorted(spans, key=lambda x: (x["a"], x["b"])):
                    if words[span["b"] - 1][1] > at:
                        rest.append(raw[at : max(at, words[span["a"]][0])])
                        at = words[span["b"] - 1][1]
                raw = b"".join(rest) + raw[at:]
            texts.append(raw.decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def without_repeats(docs: DataFrame, min_words: int = 50, key: int = 25) -> DataFrame:
    """``docs`` with each repeated passage only in one of the documents that share it, that of the smaller doc_id of a pair.

    All rows and columns stay; texts that lose a passage, and n_chars with them, change. Rows whose doc_id is null or
    repeated keep their texts as they are unless they are the least text of their id.
    """
    found = repeats(docs, min_words, key)
    size = F.col("end_word") - F.col("first_word")
    later = found.withColumn("_later", F.col("doc_id") > F.col("other_id"))
    first = F.when(F.col("_later"), F.col("first_word")).otherwise(F.col("other_first_word"))
    spans = later.select(F.greatest("doc_id", "other_id").alias("doc_id"), F.struct(first.alias("a"), (first + size).alias("b")).alias("s")).groupBy("doc_id").agg(F.collect_set("s").alias("spans"))
    spans = written(spans)
    old = text_of(docs).filter(claims(spans, "doc_id")).join(spans, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    new = old.join(spans, "doc_id").select("doc_id", "text", F.col("spans").alias("spans")).mapInArrow(_without, "doc_id long, text string")
    new = old.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_was")).join(new.select(F.col("doc_id").alias("_id"), F.col("text").alias("_new")), "_id")
    rows = packed(docs, _id=F.col("doc_id"), _was=F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    return unpacked(rows.join(new, ["_id", "_was"], "left"), F.col("_new"))
