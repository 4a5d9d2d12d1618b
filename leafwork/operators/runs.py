"""Rows that follow one another with the same keys, packed before they are shuffled, and keys gathered after it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, StructField, StructType


def changes(b: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """The rows of a batch, but for the first, whose keys aren't those of the row before; nulls are equal."""
    found = np.zeros(max(0, b.num_rows - 1), dtype=bool)
    for k in keys:
        c = b.column(k)
        found |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
        if c.null_count:
            null = pc.is_null(c).to_numpy(zero_copy_only=False)
            found |= null[1:] != null[:-1]
    return np.flatnonzero(found) + 1


#: What stands between texts that are one value: a byte that UTF-8 never has.
BETWEEN = b"\xff"


def _pack(rows: DataFrame, keys: list[str], whole: bool, joined: tuple[str, ...] = ()) -> DataFrame:
    others = [c for c in rows.columns if c not in keys]
    fields = {f.name: f for f in rows.schema}

    def lists(b: pa.RecordBatch, at: np.ndarray) -> pa.RecordBatch:
        offsets = pa.array(np.append(at, b.num_rows), pa.int32())
        heads = [b.column(k).take(pa.array(at)) for k in keys]
        column = lambda c: pc.binary_join(pa.ListArray.from_arrays(offsets, pc.fill_null(b.column(c).cast(pa.binary()), b"")), BETWEEN) if c in joined else pa.ListArray.from_arrays(offsets, b.column(c))
        return pa.RecordBatch.from_arrays([*heads, *map(column, others)], [*keys, *others])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []  # the last run so far, where it may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            if not whole:
                yield lists(b, np.append(0, changes(b, keys)))
                continue
            at = changes(b, keys)
            if open_:
                last = open_[-1].select(keys)
                joint = pa.concat_batches([last.slice(last.num_rows - 1), b.select(keys).slice(0, 1)])
                at = np.append(0, at) if len(changes(joint, keys)) else at
            if len(at):
                done = pa.concat_batches([*open_, b.slice(0, at[-1])])
                before = sum(o.num_rows for o in open_)
                starts = at[:-1] + before if at[0] or open_ else at[:-1]
                if done.num_rows:
                    yield lists(done, np.append(0, starts[starts > 0]))
                open_ = [b.slice(at[-1])]
            else:
                open_.append(b)
        if open_:
            yield lists(pa.concat_batches(open_), np.zeros(1, dtype=np.int64))

    schema = StructType([*(StructField(k, fields[k].dataType) for k in keys), *(StructField(c, BinaryType() if c in joined else ArrayType(fields[c].dataType)) for c in others)])
    return rows.select(*keys, *others).mapInArrow(run, schema)


def packed(rows: DataFrame, keys: list[str], joined: tuple[str, ...] = ()) -> DataFrame:
    """One row for each run of ``rows`` with the same ``keys``: the keys once, and the other columns as arrays in the order of the rows.

    A shuffle then moves keys and row headers once a run and not once a row. Rows in any order are right: a run ends where a key changes or an Arrow batch does, so
    a key may have several runs, which ``gathered`` brings together. Columns of text that are ``joined`` are one binary value with ``BETWEEN`` between the texts, null ones empty: an array has 16 bytes for each word of
    five letters. ``apart`` takes them apart.
    """
    return _pack(rows, keys, False, joined)


def apart(values: pa.Array) -> pa.Array:
    """The texts of ``joined`` values, one after the other, as binary ones."""
    return pc.split_pattern(values, BETWEEN).flatten()


def gathered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each of ``keys``, the other columns as arrays, in any order: rows are dealt out and sorted by key and packed as they pass, so nothing is grouped before the shuffle and only one key's rows are held."""
    return _pack(rows.repartition(*keys).sortWithinPartitions(*keys), keys, True)
