"""Language-model scores by prediction by partial matching over bytes.

The trie lives in a table: one row per context of up to five bytes and next byte, with its count in the training texts.
Contexts run over a text's words and the spaces between them (``across_words``), or begin at the start of their word, and
a text's code length is then the sum over its words and its end. Texts are dealt into chunks of bounded size; a chunk's
distinct words and byte contexts are counted, the counts are summed over all chunks, the probabilities of all contexts
follow order by order with escapes and exclusion of the symbols that longer contexts have seen, and each chunk gets back
the figures of its own words and contexts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import forget, join_by_weight, text_of, written

SPACE = 0x20
#: A task counts several chunks, one after the other, where there are more.
MOST_TASKS = 100_000


def contexts(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each word and its closing space: context and byte as one integer, and the word it belongs to.

    The integer's lowest byte is the symbol and those above are the ``order`` bytes before it, spaces before the word.
    """
    long = np.fromiter(map(len, words), np.int64, len(words)) + 1
    stream = np.frombuffer(b" ".join([b" " * (order - 1), *words, b""]) if order else b" ".join([*words, b""]), np.uint8).astype(np.int64)
    # every word is followed by its closing space; what stands before a word's start counts as spaces
    of = np.repeat(np.arange(len(words)), long)
    n = int(long.sum())
    inside = np.arange(n) - np.repeat(np.cumsum(long) - long, long)
    symbols = stream[len(stream) - n :]
    gram = symbols.copy()
    for back in range(1, order + 1):
        before = np.full(n, SPACE, np.int64)
        reach = np.flatnonzero(inside >= back)
        before[reach] = symbols[reach - back]
        gram |= before << (8 * back)
    return gram, of


def running_contexts(texts: list[list[bytes]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text's words, a space after each word and one at its end: context and byte as in ``contexts``, and the text it belongs to.

    Contexts run across words; spaces stand before a text.
    """
    streams = [b" ".join([*words, b"", b""]) for words in texts]
    long = np.fromiter(map(len, streams), np.int64, len(streams))
    symbols = np.frombuffer(b"".join(b" " * order + s for s in streams), np.uint8).astype(np.int64)
    of = np.repeat(np.arange(len(streams)), long)
    at = np.arange(len(of)) + (of + 1) * order
    gram = symbols.copy()
    for back in range(1, order + 1):
        gram[back:] |= symbols[:-back] << (8 * back)
    return gram[at], of


class _Counts:
    """Per chunk: distinct words and contexts with their counts in training texts, zero where only held-out texts have them."""

    def __init__(self, order: int, most: int, across_words: bool):
        self.order, self.most, self.across_words = order, most, across_words
        self.start()

    def start(self) -> None:
        self.grams, self.sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting, self.size = {False: [], True: []}, 0

    def add(self, words: list[bytes], out: bool) -> None:
        self.waiting[out].append(words)
        self.size += sum(map(len, words)) + len(words)
        if self.size > 2_000_000:
            self.settle()

    def settle(self) -> None:
        """Counts the contexts of the texts that wait."""
        for out, texts in self.waiting.items():
            if texts:
                gram, n = np.unique(running_contexts(texts, self.order)[0], return_counts=True)
                self.grams, at = np.unique(np.append(self.grams, gram), return_inverse=True)
                self.sums = np.bincount(at, np.append(self.sums, n * (not out)), len(self.grams)).astype(np.int64)
        self.waiting, self.size = {False: [], True: []}, 0

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, train, other = None, Counter(), set()
        for batch in batches:
            for k, out, text in zip(batch.column("chunk").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text"), strict=True):
                if train or other:
                    if k != chunk or len(train) + len(other) > self.most:
                        yield from self.flush(chunk, train, other)
                        train, other = Counter(), set()
                chunk = k
                words = text.as_py().encode().lower().split()
                if self.across_words:
                    self.add(words.copy(), out)
                words.append(b"")
                if out:
                    other.update(words)
                else:
                    train.update(words)
        if train or other:
            yield from self.flush(chunk, train, other)

    def flush(self, chunk: int, train: Counter, other: set) -> Iterator[pa.RecordBatch]:
        words = [*train, *other.difference(train)]
        counts = np.zeros(len(words), np.int64)
        counts[: len(train)] = list(train.values())
        names = ["chunk", "word", "gram", "n"]
        for a in range(0, len(words), 100_000):
            part = words[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk, "i4")), pa.array([w.decode("latin1") for w in part], pa.string()), pa.nulls(len(part), pa.int64()), pa.array(counts[a : a + len(part)])], names)
        # block by block, as a word has many contexts
        self.settle()
        grams, sums = self.grams, self.sums
        self.start()
        for a in range(0, 0 if self.across_words else len(words), 50_000):
            gram, of = contexts(words[a : a + 50_000], self.order)
            grams, at = np.unique(np.append(grams, gram), return_inverse=True)
            sums = np.bincount(at, np.append(sums, counts[a + of]), len(grams)).astype(np.int64)
        for a in range(0, len(grams), 100_000):
            part = grams[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk, "i4")), pa.nulls(len(part), pa.string()), pa.array(part), pa.array(sums[a : a + len(part)])], names)


def probabilities(grams: DataFrame, order: int) -> DataFrame:
    """gram, p: the probability of each context's symbol, from counts (gram, n) of the longest contexts.

    Escapes are estimated by the number of distinct symbols a context has seen (of total count T and d symbols, a symbol
    seen n times has (2n - 1) / 2T, escape has d / 2T); symbols seen in the longer context are excluded from the
    shorter one's counts. The last resort spreads evenly over the bytes never seen. No context has over 256 rows.
    """
    below = None
    for k in range(order + 1):
        mask = (1 << (8 * (k + 1))) - 1
        level = grams.groupBy(F.col("gram").bitwiseAND(F.lit(mask)).alias("g")).agg(F.sum("n").alias("n"))
        w = Window.partitionBy(F.shiftright("g", 8))
        seen = F.col("n") > 0
        if below is None:
            level = level.withColumns({"T": F.sum("n").over(w), "d": F.sum(seen.cast("long")).over(w)})
            level = level.withColumn("u", 1 / F.greatest(F.lit(1), 256 - F.col("d")))
        else:
            level = level.withColumn("b", F.col("g").bitwiseAND(F.lit(mask >> 8))).join(below.select(F.col("g").alias("b"), F.col("n").alias("bn"), F.col("T").alias("bT"), F.col("d").alias("bd"), F.col("u").alias("bu")), "b")
            level = level.withColumns({"T": F.sum("n").over(w), "d": F.sum(seen.cast("long")).over(w), "x": F.sum(F.when(seen, F.col("bn"))).over(w)})
            # what the shorter context has left without the symbols seen here
            t, e = F.col("bT") - F.coalesce("x", F.lit(0)), F.col("bd") - F.col("d")
            u = F.when(F.col("bn") > 0, (2 * F.col("bn") - 1) / F.nullif(2 * t, F.lit(0))).otherwise(F.when(e > 0, e / (2 * t)).otherwise(1.0) * F.col("bu"))
            level = level.withColumn("u", F.when(seen, F.lit(None)).otherwise(u))
        p = F.when(seen, (2 * F.col("n") - 1) / (2 * F.col("T"))).otherwise(F.when(F.col("d") > 0, F.col("d") / (2 * F.col("T"))).otherwise(1.0) * F.col("u"))
        if k == order:
            return level.select(F.col("g").alias("gram"), p.alias("p"))
        below = level.select("g", "n", "T", "d", "u")


def _scores(order: int, tokens: int, kinds: int, across_words: bool):
    def score(docs: pa.Table, figures: pa.Table) -> pa.Table:
        is_word = figures.column("word").is_valid()
        of_words, of_grams = figures.filter(is_word), figures.filter(pc.invert(is_word))
        words = [w.encode("latin1") for w in of_words.column("word").to_pylist()]
        counts = of_words.column("v").to_numpy()
        grams, logs = of_grams.column("gram").to_numpy(), of_grams.column("v").to_numpy()
        by = np.argsort(grams)
        grams, logs = grams[by], logs[by]
        model = np.empty(len(words))
        for a in range(0, 0 if across_words else len(words), 50_000):
            gram, of = contexts(words[a : a + 50_000], order)
            model[a : a + 50_000] = np.bincount(of, logs[np.searchsorted(grams, gram)])
        base = np.log10((counts + 1) / (tokens + kinds + 1))
        number = {w: i for i, w in enumerate(words)}
        rows, waiting, size, running = [], [], 0, []

        def settle() -> None:
            gram, of = running_contexts(waiting, order)
            gram, at = np.unique(gram, return_inverse=True)
            running.append(np.bincount(of, logs[np.searchsorted(grams, gram)][at], len(waiting)))
            waiting.clear()

        for text in docs.column("text"):
            own = text.as_py().encode().lower().split()
            if across_words:
                waiting.append(own.copy())
                size += len(text.as_py())
                if size > 500_000:
                    settle()
                    size = 0
            own.append(b"")
            ids = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
            rows.append((len(own), int((counts[ids] > 0).sum()), float(base[ids].sum()), 0.0 if across_words else float(model[ids].sum())))
        n, known, b, s = map(list, zip(*rows, strict=True))
        if across_words:
            if waiting:
                settle()
            s = np.concatenate(running)
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([tokens] * len(n), pa.int64()), "base_score": pa.array(b, pa.float64()), "score": pa.array(s, pa.float64())})

    return score


def ppm_scores(docs: DataFrame, held_out, order: int = 5, chunk_mb: float = 16, most_words: int = 1_000_000, across_words: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per input row.

    Texts are lower-cased (A-Z) and read as words and one end; ``score`` is the log10 probability of that sequence under
    the model pretrained on all rows for which the column ``held_out`` is false, ``base_score`` that of smoothed token
    counts. With ``across_words`` a byte's context is whatever stands before it in its text, else it begins at the start of its word. Null and empty texts are an end alone; without training rows all bytes are equally likely; repeated rows are
    counted and scored one by one; very long texts stay whole; other columns aren't read; an empty table gives an empty result.
    """
    d = text_of(docs).withColumn("held_out", held_out)
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, round(size / (chunk_mb * 1e6)))
    d = d.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")).repartition(min(chunks, MOST_TASKS), "chunk")
    # all that the corpus gives: distinct words and contexts of each chunk
    found = written(d.sortWithinPartitions("chunk").mapInArrow(_Counts(order, most_words, across_words), "chunk int, word string, gram long, n long"))
    in_words, in_grams = found.filter("word IS NOT NULL").select("chunk", "word", "n"), found.filter("gram IS NOT NULL").select("chunk", "gram", "n")
    size = found.count()
    forget(shuffles=True)
    # a word or context has a row for each chunk that has it; the frequent ones are in all chunks
    words = written(in_words.groupBy("word").agg(F.sum("n").alias("total"), F.count("*").alias("chunks")))
    tokens, kinds = words.filter("total > 0").agg(F.sum("total"), F.count("*")).first()
    counts = written(in_grams.groupBy("gram").agg(F.sum("n").alias("n"), F.count("*").alias("chunks")))
    forget(shuffles=True)
    grams = written(probabilities(counts, order).join(counts.select("gram", "chunks"), "gram").select("gram", "chunks", F.log10("p").alias("v")))
    forget(counts, shuffles=True)
    of_words = join_by_weight(in_words.select("chunk", "word"), words, ["word"], "chunks", size, F.col("chunk")).select("chunk", "word", F.lit(None).cast("long").alias("gram"), F.col("total").cast("double").alias("v"))
    of_grams = join_by_weight(in_grams.select("chunk", "gram"), grams, ["gram"], "chunks", size, F.col("chunk")).select("chunk", F.lit(None).cast("string").alias("word"), "gram", "v")
    figures = written(of_words.unionByName(of_grams))
    forget(found, words, grams, shuffles=True)
    scored = d.groupBy("chunk").cogroup(figures.groupBy("chunk")).applyInArrow(_scores(order, tokens or 0, kinds or 0, across_words), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored
