"""Language identification: multinomial naive Bayes over hashed character n-grams.

Each task adds up the n-gram counts of its rows by language, and Spark sums those of all tasks; the log-probabilities,
languages times ``features`` numbers, are broadcast, and batches are scored in numpy from their sparse counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpointed

FEATURES = 1 << 13
#: Odd factors that spread the n-grams of each length over the features.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


#: Characters that a text's n-grams are counted by at a time.
PIECE = 1 << 18


def gram_counts(text: str, features: int = FEATURES) -> np.ndarray:
    """How many of the n-grams of one to three characters, in lower case, fall on each feature."""
    shift = np.uint64(64 - features.bit_length() + 1)
    text, counts = text.lower(), np.zeros(features, np.int64)
    for a in range(0, len(text), PIECE):
        # n-grams that begin in this piece
        chars = np.frombuffer(text[a : a + PIECE + 2].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        key = chars
        for n, factor in enumerate(FACTORS):
            if n:
                key = (key[:-1] << np.uint64(21)) | chars[n:]
            counts += np.bincount(((key[:PIECE] * factor) >> shift).astype(np.int64), minlength=features)
    return counts


class _Train:
    """A task's n-gram counts by language, as (lang, feature, n); under feature -1 the number of its texts."""

    def __init__(self, features: int):
        self.features = features

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                own = sums.setdefault(lang, np.zeros(self.features + 1, np.int64))
                own[-1] += 1
                own[:-1] += gram_counts(text.as_py(), self.features)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.where(at == self.features, -1, at).astype(np.int32)), pa.array(own[at])], ["lang", "feature", "n"])


class Model:
    def __init__(self, langs: list[str], docs: np.ndarray, counts: np.ndarray, smooth: float = 0.5):
        """counts: a row of feature counts for each language."""
        self.langs = langs
        smoothed = counts + smooth
        self.logs = np.log(smoothed / smoothed.sum(axis=1, keepdims=True)).T.copy()
        self.prior = np.log((docs + 1) / (docs.sum() + len(docs)))

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its posterior; ``und`` and 0 for texts without a letter, or when nothing was learned."""
        rows, cols, values, some = [], [], [], []
        for i, text in enumerate(texts):
            if text and self.langs and any(map(str.isalpha, text)):
                some.append(i)
                counts = gram_counts(text, len(self.logs))
                at = np.flatnonzero(counts)
                rows.append(len(at))
                cols.append(at)
                values.append(counts[at])
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if some:
            starts = np.cumsum(rows) - rows
            total = np.add.reduceat(self.logs[np.concatenate(cols)] * np.concatenate(values)[:, None], starts, axis=0) + self.prior
            best = total.argmax(axis=1)
            post = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            for i, b, p in zip(some, best.tolist(), post.tolist(), strict=True):
                langs[i], scores[i] = self.langs[b], p
        return langs, scores


class _Predict:
    def __init__(self, model, batch: int = 64):
        self.model, self.batch = model, batch

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for a in range(0, batch.num_rows, self.batch):
                x, y = self.model.value.score(batch.column("text").slice(a, self.batch).to_pylist())
                langs += x
                scores += y
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


def language_id(docs: DataFrame, held_out: Column, features: int = FEATURES, most_langs: int = 1000) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per input row.

    Learns from the texts of all rows with a non-null lang that are not ``held_out``. Texts that are null or have no
    letter get ``und`` and 0, as do all if no row can be learned from. The score is the posterior of the predicted
    language. Ties go to the first language in order. Long texts count whole, piece by piece, repeated rows count each time, other
    columns aren't read, an empty table gives an empty result. The matrix has ``features`` times languages numbers; more than ``most_langs``
    languages are refused, so its size is bounded.
    """
    spark = docs.sparkSession
    d = docs.select("doc_id", "text", "lang", held_out.alias("held_out"))
    train = d.filter("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(_Train(features), "lang string, feature int, n long")
    sums = checkpointed(train.groupBy("lang", "feature").agg(F.sum("n").alias("n")))
    langs = sorted(r.lang for r in sums.select("lang").distinct().limit(most_langs + 1).collect())
    if len(langs) > most_langs:
        raise ValueError(f"over {most_langs} languages")
    # at most features + 1 rows a language
    counts = np.zeros((len(langs), features + 1), np.int64)
    number = {lang: i for i, lang in enumerate(langs)}
    for lang, feature, n in sums.collect():
        counts[number[lang], feature] = n
    model = spark.sparkContext.broadcast(Model(langs, counts[:, -1], counts[:, :-1]))
    return d.select("doc_id", "held_out", "text").mapInArrow(_Predict(model), "doc_id long, held_out boolean, lang_pred string, score double")
