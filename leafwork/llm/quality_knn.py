"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space.

A bounded sample of labelled rows gives term weights, a truncated singular value decomposition and the labelled vectors;
all three are broadcast and their sizes are fixed by parameters. Every document is projected, its cosines with all
labelled vectors are exact matrix products by blocks, and its nearest neighbours vote by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import text_of

GRAMS = 1 << 12
#: Bins of each measure of a text's form, ten each.
MEASURES, BINS = 6, 10
FEATURES = GRAMS + MEASURES * BINS
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


#: Characters that a text's n-grams are counted by at a time.
PIECE = 1 << 18


def _form(text: str) -> list[float]:
    """Six numbers from 0 to 1: symbols, capitals, repeated lines, repeated pairs of words, repeated words, length."""
    raw = text.encode("utf-8", "surrogatepass")
    n, lines, words = max(1, len(text)), [x for x in text.split("\n") if x], raw.split()
    of = np.bincount(np.frombuffer(raw, np.uint8), minlength=128)[:128]
    capitals = of[65:91].sum()
    other = of[33:].sum() - capitals - of[97:123].sum() - of[48:58].sum() - of[46] - of[44]
    return [
        min(1, 5 * float(other) / n), float(capitals) / n, 1 - len(set(lines)) / max(1, len(lines)),
        1 - len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1), 1 - len(set(words)) / max(1, len(words)), min(1, np.log2(1 + len(words)) / 16),
    ]


def features(text: str) -> np.ndarray:
    """Hashed n-grams of one to three characters, counts damped and brought to unit length, then the bins of the text's form."""
    out, counts = np.zeros(FEATURES, np.float32), np.zeros(GRAMS, np.int64)
    for a in range(0, len(text), PIECE):
        # n-grams that begin in this piece
        wide = np.frombuffer(text[a : a + PIECE + 2].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        key = wide
        for n, factor in enumerate(FACTORS):
            if n:
                key = (key[:-1] << np.uint64(21)) | wide[n:]
            counts += np.bincount(((key[:PIECE] * factor) >> np.uint64(64 - 12)).astype(np.int64), minlength=GRAMS)
    out[:GRAMS] = np.log1p(counts)
    for i, x in enumerate(_form(text)):
        out[GRAMS + i * BINS + min(BINS - 1, int(x * BINS))] = 1
    return out


def _leading(x: np.ndarray, rank: int, rounds: int = 6) -> np.ndarray:
    """The leading right singular vectors of ``x`` by subspace iteration, which needs no matrix larger than ``x``."""
    if not len(x):
        return np.zeros((x.shape[1], 1), np.float32)
    q = np.random.default_rng(0).standard_normal((x.shape[1], rank + 16)).astype(np.float32)
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    return q @ np.linalg.svd(x @ q, full_matrices=False)[2][:rank].T


class Space:
    """The latent space of a sample and its labelled vectors."""

    def __init__(self, sample: np.ndarray, labels: np.ndarray, rank: int, neighbours: int, form: float = 0.5):
        self.labels, self.neighbours, self.form = labels.astype(np.float32), min(neighbours, len(labels)), form
        seen = (sample > 0).sum(axis=0)
        self.weights = np.log((1 + len(sample)) / (1 + seen)).astype(np.float32) + 0.1
        x = self.weighted(sample)
        self.basis = _leading(x, rank)
        self.vectors = self.project(x)

    def weighted(self, x: np.ndarray) -> np.ndarray:
        x = x * self.weights  # a new array
        x[:, :GRAMS] /= np.maximum(1e-9, np.linalg.norm(x[:, :GRAMS], axis=1, keepdims=True))
        x[:, GRAMS:] = (x[:, GRAMS:] > 0) * np.float32(self.form)
        return x

    def project(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.basis
        return y / np.maximum(1e-9, np.linalg.norm(y, axis=1, keepdims=True))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The part of label 1 among the nearest labelled vectors, each weighted by its cosine; all that tie with the last of them vote, too."""
        if not len(self.labels):
            return np.full(len(x), 0.5)
        cosine = self.project(self.weighted(x)) @ self.vectors.T
        last = np.partition(cosine, len(self.labels) - self.neighbours, axis=1)[:, len(self.labels) - self.neighbours]
        # vectors of equal texts differ by rounding at most
        weight = np.where(cosine >= last[:, None] - 1e-6, np.maximum(np.float32(1e-6), cosine), np.float32(0))
        weight *= weight
        weight *= weight
        return (weight @ self.labels) / np.maximum(np.float32(1e-30), weight.sum(axis=1))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()).astype(np.float16).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())], ["doc_id", "label", "x"])


class _Vote:
    def __init__(self, space, threshold: float, block: int = 256):
        self.space, self.threshold, self.block = space, threshold, block

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for a in range(0, batch.num_rows, self.block):
                texts = batch.column("text").slice(a, self.block)
                scores += self.space.value.score(np.array([features(t.as_py()) for t in texts])).clip(0, 1).tolist()
            predicted = pa.array([int(s >= self.threshold) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), predicted], ["doc_id", "held_out", "score", "predicted"])


def quality_votes(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "quality", sample: int = 3000, rank: int = 64, neighbours: int = 25, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted: one row per input row, from its text alone.

    Learns from at most ``sample`` labelled documents that aren't ``held_out``, those with the smallest hash of doc_id;
    that bounds what the driver holds and broadcasts. Null labels and ids whose labels contradict each other are left
    out, of rows that repeat a sampled doc_id one is learned from. Null and empty texts are scored as texts without
    n-grams; with nothing to learn from, all scores are 0.5. Neighbours that tie with the last one vote like it. Very long texts count whole, piece by piece, other columns aren't read, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL").filter(~held_out)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_most")).filter("label = _most").select("doc_id", "label")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = text_of(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    got = rows.mapInArrow(_sampled, "doc_id long, label int, x binary").orderBy("doc_id").limit(sample).collect()
    x = np.zeros((len(got), FEATURES), np.float32)
    for row, r in zip(x, got, strict=True):
        row[:] = np.frombuffer(r.x, np.float16)
    space = spark.sparkContext.broadcast(Space(x, np.array([r.label for r in got]), rank, neighbours))
    return text_of(docs, held_out.alias("held_out")).mapInArrow(_Vote(space, threshold), "doc_id long, held_out boolean, score double, predicted int")
