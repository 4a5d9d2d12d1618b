"""Exact dedup by a log-structured merge index.

Each task fills a memtable, digest to identifier and count, and flushes it as a run sorted by digest and cut by shard,
each segment with a filter. Compaction merges a shard's segments two by two: only keys that the other segment's filter
claims are looked up there. Hits, keys of more than one row, are then verified byte by byte against the text that stays.
A text held by a third of all rows is one entry in each memtable.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import claims, join_by_weight, lower_ascii, packed, unpacked, written

WORD = np.dtype("<u8")


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    """Four places in a filter of ``bits`` bits for each key; keys are hexadecimal digests as fixed-width bytes."""
    halves = np.array([[int(k[:8] or b"0", 16), int(k[8:16] or b"0", 16)] for k in keys.tolist()], np.uint64).reshape(-1, 2)
    step = halves[:, 1] | np.uint64(1)
    return ((halves[:, :1] + np.arange(4, dtype=np.uint64) * step[:, None]) % np.uint64(bits)).astype(np.int64)


class Segment:
    """A sorted run: distinct keys with identifier and count, and a filter of ten bits a key."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray, bits: np.ndarray | None = None):
        self.keys, self.ids, self.counts = keys, ids, counts
        if bits is None:
            bits = np.zeros(max(64, 10 * len(keys)), bool)
            bits[_places(keys, len(bits))] = True
        self.bits = bits

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        return self.bits[_places(keys, len(self.bits))].all(axis=1)

    def merge(self, other: Segment, keep: str) -> Segment:
        """Both as one: identifiers of equal keys give way to the smallest, or largest; counts add up."""
        ids, counts = self.ids.copy(), self.counts.copy()
        fresh = np.ones(len(other.keys), bool)
        claimed = np.flatnonzero(self.may_have(other.keys))
        at = np.minimum(np.searchsorted(self.keys, other.keys[claimed]), len(self.keys) - 1)
        same = self.keys[at] == other.keys[claimed]
        at, claimed = at[same], claimed[same]
        ids[at] = (np.minimum if keep == "min" else np.maximum)(ids[at], other.ids[claimed])
        counts[at] += other.counts[claimed]
        fresh[claimed] = False
        keys = np.concatenate([self.keys, other.keys[fresh]])
        order = np.argsort(keys, kind="stable")
        return Segment(keys[order], np.concatenate([ids, other.ids[fresh]])[order], np.concatenate([counts, other.counts[fresh]])[order])


class _Memtables:
    def __init__(self, shards: int, most: int, keep: str):
        self.shards, self.most, self.keep = shards, most, keep

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, none = (min, np.iinfo("i8").max) if self.keep == "min" else (max, np.iinfo("i8").min)
        table: dict[str, list[int]] = {}
        for batch in batches:
            for key, doc in zip(batch.column("digest").to_pylist(), batch.column("doc_id").to_pylist(), strict=True):
                doc = none if doc is None else doc
                if (entry := table.get(key)) is None:
                    table[key] = [doc, 1]
                else:
                    entry[0], entry[1] = best(entry[0], doc), entry[1] + 1
            if len(table) >= self.most:
                yield self.flush(table)
                table = {}
        if table:
            yield self.flush(table)

    def flush(self, table: dict[str, list[int]]) -> pa.RecordBatch:
        by_shard: dict[int, list[str]] = {}
        for key in sorted(table):
            by_shard.setdefault(int(key[:6].ljust(6, "0"), 16) * self.shards >> 24, []).append(key)
        rows = []
        for shard, keys in by_shard.items():
            s = Segment(np.array([k.encode() for k in keys]), np.array([table[k][0] for k in keys], np.int64), np.array([table[k][1] for k in keys], np.int64))
            rows.append((shard, s.keys.itemsize, s.keys.tobytes(), s.ids.tobytes(), s.counts.tobytes(), np.packbits(s.bits).tobytes(), len(s.bits)))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()), strict=True)],
            ["shard", "width", "keys", "ids", "counts", "bits", "n_bits"],
        )


def _compaction(keep: str):
    def compact(batch: pa.Table) -> pa.Table:
        segments = [
            Segment(np.frombuffer(r["keys"], f"S{r['width']}"), np.frombuffer(r["ids"], "i8"), np.frombuffer(r["counts"], "i8"), np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n_bits"]).astype(bool))
            for r in batch.to_pylist()
        ]
        while len(segments) > 1:
            segments.sort(key=lambda s: -len(s.keys))
            small, less = segments.pop(), segments.pop()
            segments.append(less.merge(small, keep))
        s = segments[0]
        hit = s.counts > 1
        ids = pa.array(s.ids[hit], mask=np.isin(s.ids[hit], (np.iinfo("i8").max, np.iinfo("i8").min)))
        return pa.table({"digest": pa.array([k.decode() for k in s.keys[hit].tolist()], pa.string()), "keep_id": ids, "group_size": pa.array(s.counts[hit])})

    return compact


def exact_dedup(docs: DataFrame, keep: str = "min", digest_digits: int = 64, memtable: int = 100_000, shard_rows: int = 500_000, filter_bits: int = 1 << 23) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row, dropped ones too.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    smallest (``keep="min"``) or largest doc_id stays. Rows that repeat text and doc_id get equal results. Null doc_ids
    stay only where a group has no other, with a null keep_id. Long texts are hashed and compared whole, other columns aren't read,
    an empty table gives an empty result. ``digest_digits`` shortens the index's digests; rows whose digests agree while
    their bytes differ are grouped by their bytes.
    """
    d = docs.select("doc_id", lower_ascii(F.coalesce(F.col("text"), F.lit(""))).alias("_text"))
    d = d.withColumn("text_sha256", F.sha2(F.col("_text").cast("binary"), 256)).withColumn("digest", F.substring("text_sha256", 1, digest_digits))
    total = docs.count()
    shards = max(1, -(-total // shard_rows))
    runs = d.select("doc_id", "digest").mapInArrow(_Memtables(shards, memtable, keep), "shard int, width int, keys binary, ids binary, counts binary, bits binary, n_bits long")
    hits = written(runs.groupBy("shard").applyInArrow(_compaction(keep), "digest string, keep_id long, group_size long"))

    marked = d.withColumn("_claimed", claims(hits, "digest", filter_bits))
    alone = marked.filter("NOT _claimed").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    found = join_by_weight(marked.filter("_claimed").drop("_claimed"), hits, ["digest"], "group_size", total, F.xxhash64("doc_id"))
    found = written(found)
    # claimed by the filter, but no hit
    more = found.filter("group_size IS NULL").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")

    # byte verification: the text that stays goes to one place for every 64 rows of its group
    rows = found.filter("group_size > 1").withColumn("_slots", F.expr("CAST(ceil(group_size / 64) AS INT)"))
    stays = rows.filter("doc_id <=> keep_id").select("digest", "_slots", F.col("_text").alias("_kept")).groupBy("digest", "_slots").agg(F.min("_kept").alias("_kept"))
    stays = stays.select("digest", "_kept", F.explode(F.sequence(F.lit(0), F.col("_slots") - 1)).alias("_slot"))
    rows = rows.withColumn("_slot", F.pmod(F.xxhash64("doc_id"), F.col("_slots")).cast("int")).join(stays, ["digest", "_slot"])
    rows = rows.select("doc_id", "digest", "text_sha256", F.when(F.col("_text") == F.col("_kept"), "").otherwise(F.concat(F.lit("+"), "_text")).alias("_class"))
    rows = written(rows)
    chosen = (F.min if keep == "min" else F.max)("doc_id").alias("keep_id")
    classes = written(rows.groupBy("digest", "_class").agg(chosen, F.count("*").alias("group_size")))
    many = join_by_weight(rows, classes, ["digest", "_class"], "group_size", total, F.xxhash64("doc_id"))
    out = alone.unionByName(more).unionByName(many.select("doc_id", "keep_id", "group_size", "text_sha256"))
    return out.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, keep: str = "min") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they are; of rows that repeat id and text, one stays."""
    stay = exact_dedup(docs, keep).filter("kept").select(F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    sha = F.sha2(lower_ascii(F.coalesce(F.col("text"), F.lit(""))).cast("binary"), 256)
    once = packed(docs, _id=F.coalesce("doc_id", F.lit(-1)), _sha=sha).join(stay, ["_id", "_sha"], "left_semi")
    return unpacked(once.dropDuplicates(["_id", "_sha"]))
