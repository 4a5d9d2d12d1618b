"""Best-fit packing into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CAPACITIES = (256, 512, 1024, 2048, 4096)


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: float = 16) -> tuple[list[int], list[int], list[int], list[int]]:
    """For each item, in falling order of length: bin and offset; for each bin: final capacity and tokens used.

    An item goes to the open bin that it fills best. If none has room, the bin opened is the one whose price, its
    capacity plus ``overhead``, is least for each token it can be expected to hold: the item and as many items of the
    mean length still to come as fit beside it. In the end each bin shrinks to the smallest capacity for its contents.
    """
    if any(a < b for a, b in zip(lengths, lengths[1:], strict=False)):
        raise ValueError("lengths must fall")
    sizes = sorted(capacities)
    if lengths and lengths[0] > sizes[-1]:
        raise ValueError("an item is longer than the largest capacity")
    bins, offsets, used = [], [], []
    room: dict[int, list[int]] = {}  # open bins by what is left in them
    lefts: list[int] = []
    capacity: list[int] = []
    rest = sum(lengths)
    for i, n in enumerate(lengths):
        rest -= n
        at = bisect_left(lefts, n)
        if at < len(lefts):
            left = lefts[at]
            b = room[left].pop()
            if not room[left]:
                del room[left], lefts[at]
        else:
            mean = max(1, rest / (len(lengths) - i - 1)) if i + 1 < len(lengths) else 0
            expected = lambda c: n + (c - n) // mean * mean if mean else n  # noqa: B023, E731
            left = min((c for c in sizes if c >= n), key=lambda c: ((c + overhead) / max(1, expected(c)), c))
            b = len(capacity)
            capacity.append(left)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        if (left := left - n) or not n:
            if left not in room:
                insort(lefts, left)
                room[left] = []
            room[left].append(b)
    return bins, offsets, [sizes[bisect_left(sizes, u)] for u in used], used


def _shard(capacities: tuple[int, ...], overhead: float):
    def place(rows: pa.Table) -> pa.Table:
        ids, keys, lengths = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("_row", "_key", "length"))
        most = max(capacities)
        pieces = np.maximum(1, -(-lengths // most))
        of = np.repeat(np.arange(len(lengths)), pieces)
        piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(most, lengths[of] - piece * most)
        order = np.lexsort((piece, keys[of], ids[of], -size))
        of, piece, size = of[order], piece[order], size[order]
        bins, offsets, capacity, used = pack(size.tolist(), capacities, overhead)
        base = int(rows.column("_shard")[0].as_py()) << 32
        take = lambda c: rows.column(c).take(pa.array(of))
        bins = np.array(bins, np.int64)
        return pa.table({
            "doc_id": take("doc_id"), "piece": pa.array(piece.astype(np.int64)), "n_pieces": pa.array(pieces[of].astype(np.int64)), "first_word": pa.array((piece * most).astype(np.int64)), "length": pa.array(size.astype(np.int64)),
            "bin_id": pa.array(bins + base), "bin_offset": pa.array(np.array(offsets, np.int64)), "bin_capacity": pa.array(np.array(capacity, np.int64)[bins]), "bin_used": pa.array(np.array(used, np.int64)[bins]), "_row": take("_row"), "_key": take("_key"),
        })

    return place


PLACED = "doc_id long, piece long, n_pieces long, first_word long, length long, bin_id long, bin_offset long, bin_capacity long, bin_used long"


def _placed(docs: DataFrame, capacities: tuple[int, ...], overhead: float, shard_rows: int) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    items = docs.select("doc_id", F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("length"), F.coalesce("doc_id", F.lit(-1)).alias("_row"), F.xxhash64("doc_id", text).alias("_key"))
    shards = max(1, -(-docs.count() // shard_rows))
    items = items.withColumn("_shard", F.pmod("_key", F.lit(shards)).cast("int"))
    return items.groupBy("_shard").applyInArrow(_shard(capacities, overhead), PLACED + ", _row long, _key long")


def best_fit_packing(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: float = 16, shard_rows: int = 100_000) -> DataFrame:
    """doc_id, piece, n_pieces, first_word, length, bin_id, bin_offset, bin_capacity, bin_used: one row per piece of a document.

    Lengths are words. A document of more words than the largest capacity is cut into pieces of that length and a rest;
    every word of every row is in one piece. Null texts count as empty; empty texts are pieces of length 0 and fit
    anywhere; repeated rows are placed one by one; ties go by doc_id; an empty table gives an empty result. Documents
    are dealt by hash into shards of about ``shard_rows`` rows that are packed apart, so each shard's last bins alone
    have room that another could have filled. Only lengths and ids are shuffled.
    """
    return _placed(docs, capacities, overhead, shard_rows).drop("_row", "_key")


def _cut(batches):
    for batch in batches:
        texts = []
        for text, first, n, pieces in zip(batch.column("text"), batch.column("first_word").to_pylist(), batch.column("length").to_pylist(), batch.column("n_pieces").to_pylist(), strict=True):
            text = text.as_py()
            texts.append(text if pieces == 1 else b" ".join(text.encode().split()[first : first + n]).decode())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(texts, pa.string())], [*(c for c in batch.schema.names if c != "text"), "text"])


def packed_texts(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: float = 16, shard_rows: int = 100_000) -> DataFrame:
    """As ``best_fit_packing``, with each piece's text: the whole text of an uncut document, else the piece's words with single spaces."""
    placed = _placed(docs, capacities, overhead, shard_rows)
    text = F.coalesce(F.col("text"), F.lit(""))
    # repeated rows are placed one by one, but their text is the same
    texts = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("_row"), F.xxhash64("doc_id", text).alias("_key"), text.alias("text")).dropDuplicates(["_row", "_key"])
    return placed.join(texts, ["_row", "_key"]).drop("_row", "_key").mapInArrow(_cut, PLACED + ", text string")
