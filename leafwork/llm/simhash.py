"""SimHash near-dedup: fingerprints of word shingles, compared exactly tile by tile.

Two fingerprints that differ in at most ``radius`` bits agree in one of radius + 1 blocks of bits. Distinct fingerprints
meet in tiles, the fingerprints that share a block; within a tile numpy compares by exclusive-or and bit counts, parts
whose population counts differ by more than the radius are skipped. A block shared by too many fingerprints is cut into
a grid of tiles by population count and, where one count is too much for a tile, by parts of it; only pairs of tiles whose
counts are within the radius are formed. All links are found at any size.

``near_copies`` goes on where fingerprints end: it links documents by the similarity of their sets of shingles, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import SMALL, claims, components, forget, join_by_weight, join_counted, packed, text_of, unpacked, written

#: The bits of each byte value, first the highest.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
SEED = 42


def fingerprint(text: str, width: int = 3) -> int:
    """Of the words' shingles, repeats included: a bit is 1 if over half of the hashes have it."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.append(0, ends[:-1] + 1)
    view = memoryview(joined)
    hashes = np.fromiter((digest(view[a:b], SEED) for a, b in zip(first[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)), ">u8", len(words) - width + 1)
    # how often each byte value stands at each of the 8 places, then how often each bit is set
    places = hashes.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
    set_bits = np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ BITS
    return int.from_bytes(np.packbits(2 * set_bits.ravel() > len(hashes)).tobytes(), "big")


class _Fingerprints:
    def __init__(self, width: int):
        self.width = width

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), self.width) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def links_of(fps: np.ndarray, tiles: np.ndarray, base: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of the same tile, at least one of them a base; a spanning part of them, so that tiles keep together what is linked.

    All rows of a tile stand together, in order of population count: row i meets row i + 1, i + 2 ... while the tile
    lasts and the counts are within the radius.
    """
    count = np.bitwise_count(fps).astype(np.int64)
    order = np.lexsort((fps, count, tiles))
    fps, tiles, base, count = fps[order], tiles[order], base[order], count[order]
    left, right = [], []
    at, step = np.arange(len(fps)), 1
    while len(at):
        at = at[at + step < len(fps)]
        # beyond the tile or the radius for this step means beyond it for all larger ones
        at = at[(tiles[at] == tiles[at + step]) & (count[at + step] - count[at] <= radius)]
        near = at[(base[at] | base[at + step]) & (np.bitwise_count(fps[at] ^ fps[at + step]) <= radius)]
        left.append(near)
        right.append(near + step)
        step += 1
    if not left:
        return fps[:0], fps[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    # of what hangs together in the tiles keep one link a fingerprint, to the smallest it hangs on
    root = np.arange(len(fps))
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        np.minimum.at(new, a, new[root[a]])
        np.minimum.at(new, b, new[root[b]])
        while (next_ := new[new]) is not None and (next_ != new).any():
            new = next_
        if (new == root).all():
            break
        root = new
    hang = np.flatnonzero(root != np.arange(len(fps)))
    return fps[hang], fps[root[hang]]


class _Tiles:
    """Tiles of a sorted partition, as many at a time as there are whole ones in what has arrived."""

    def __init__(self, keys: list[str], radius: int):
        self.keys, self.radius = keys, radius

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            tiles = self.numbers(held)
            if len(tiles) and (whole := int(np.searchsorted(tiles, tiles[-1]))):
                yield from self.out(held.slice(0, whole), tiles[:whole])
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from self.out(held, self.numbers(held))

    def numbers(self, t: pa.Table) -> np.ndarray:
        keys = [t.column(c).to_numpy() for c in self.keys]
        new = np.zeros(t.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        return np.cumsum(new)

    def out(self, t: pa.Table, tiles: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = links_of(t.column("fp").to_numpy().view(np.uint64), tiles, t.column("base").to_numpy(zero_copy_only=False), self.radius)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def links(fps: DataFrame, radius: int, most: int = 4096) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints ``fp`` that together hold all components of links of up to ``radius`` bits.

    No tile has more than about twice ``most`` rows.
    """
    bands = radius + 1
    edges = [64 * i // bands for i in range(bands + 1)]
    block = lambda i: F.shiftrightunsigned("fp", edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))
    routed = fps.select("fp", F.posexplode(F.array(*(block(i) for i in range(bands)))).alias("band", "block")).withColumn("count", F.bit_count("fp").cast("int"))
    routed = written(routed)
    by_count = routed.groupBy("band", "block", "count").agg(F.count("*").alias("rows"))
    sizes = written(by_count.groupBy("band", "block").agg(F.sum("rows").alias("size"), F.map_from_entries(F.collect_list(F.struct("count", "rows"))).alias("counts")).filter("size > 1"))
    met = join_by_weight(routed, sizes, ["band", "block"], "size", fps.count() * bands, F.xxhash64("fp")).filter("size IS NOT NULL")
    small = met.filter(F.col("size") <= most).select("band", "block", F.lit(0).alias("tile"), F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", F.lit(True).alias("base"))
    # of a crowded block, a tile has as base one part of the fingerprints of one count, and as guests one part of those with it or the counts just above
    near = met.filter(F.col("size") > most).select("band", "block", "fp", "count", "counts", F.explode(F.sequence(F.lit(0), F.lit(radius))).alias("down")).withColumn("tile", F.col("count") - F.col("down"))
    found = lambda k: F.coalesce(F.element_at("counts", F.col("tile") + k), F.lit(0))
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / most)).cast("int")
    near = near.withColumns({"own": found(0), "is": parts(found(0)), "js": parts(sum((found(k) for k in range(1, radius + 1)), found(0)))}).filter("own > 0")
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    part = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    bases = near.filter("down = 0").select("band", "block", "tile", part("is").alias("i"), F.explode(all_of("js")).alias("j"), "fp", F.lit(True).alias("base"))
    guests = near.filter("down > 0 OR `is` > 1 OR js > 1").select("band", "block", "tile", F.explode(all_of("is")).alias("i"), part("js").alias("j"), "fp", F.lit(False).alias("base"))
    tiles = small.unionByName(bases).unionByName(guests)
    keys = ["band", "block", "tile", "i", "j"]
    return tiles.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_Tiles(keys, radius), "a long, b long").filter("a <> b").distinct()


def simhash(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: one row per input row.

    Rows whose fingerprints differ in at most ``radius`` bits are linked; component_id is the smallest doc_id that
    links reach, the row's own included. Fewer words than ``width`` are one shingle, none (null or empty texts) give
    fingerprint zero, which links like any other. Equal texts and repeated rows meet as one fingerprint. A null doc_id
    belongs to a component without giving its name, null only if no row there has an id. Very long texts are hashed
    whole, other columns aren't read, an empty table gives an empty result.
    """
    rows = written(text_of(docs).mapInArrow(_Fingerprints(width), "doc_id long, fp long"))
    kinds = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")))
    of = components(links(kinds.select("fp"), radius))
    named = kinds.join(of.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = written(named)
    firsts = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = written(named.join(firsts, "component").select("fp", "component_id", "rows"))
    total = named.agg(F.sum("rows")).first()[0] or 0
    out = join_by_weight(rows, named, ["fp"], "rows", total, F.xxhash64("doc_id"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Odd factors and a finalizer that make further hashes out of one.
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Bits of the sketches that candidates are compared by.
SKETCH = 2048


def mixed(h: np.ndarray, seed: int) -> np.ndarray:
    h = h + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) & (1 << 64) - 1)
    for factor, shift in zip(_MIX, (30, 27), strict=True):
        h = (h ^ (h >> np.uint64(shift))) * factor
    return h ^ (h >> np.uint64(31))


def shingles(text: str, width: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted; fewer words are one shingle, none give none."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + width]), SEED) for i in range(len(words) - width + 1)), np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of a set of hashes."""
    places = hashes.astype(">u8").view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
    set_bits = np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ BITS
    return int.from_bytes(np.packbits(2 * set_bits.ravel() > len(hashes)).tobytes(), "big") if len(hashes) else 0


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Bit i is the parity of the number of hashes that fall on it: two sets differ in at least as many elements as their sketches in bits."""
    return np.packbits(np.bincount((mixed(hashes, 1) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH).astype(np.uint8) & 1)


class Signatures:
    """What sets of a Jaccard similarity of ``similarity`` or more have in common, however they are made.

    Such sets differ in a bounded number of elements, so if the universe of elements is dealt to more buckets than that, the sets
    agree in the whole of some bucket. Sets meet at the level of the larger one's size: its number of buckets is fixed by the
    largest sizes there. An empty bucket says nothing, so it is a signature only of a set that has too few others.
    """

    def __init__(self, similarity: float):
        if not 0.7 <= similarity <= 1:
            raise ValueError("similarity must be from 0.7 to 1")
        self.similarity = similarity
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, edges[-1] * 3 // 2))
        self.edges = np.array(edges)
        # the largest sets of each level differ in so many elements at most
        self.differ = np.floor((1 - similarity) / (1 + similarity) * 2 * (self.edges[1:] - 1) + 1e-6).astype(np.int64)
        self.buckets = np.ceil(1.15 * (self.differ + 1) + np.sqrt(self.differ + 1)).astype(np.int64) + 4

    def of(self, hashes: np.ndarray) -> np.ndarray:
        n = len(hashes)
        if not n:
            return np.zeros(0, np.int64)
        own = int(np.searchsorted(self.edges, n, "right")) - 1
        out = [self.at(hashes, own)]
        for level in range(own + 1, len(self.buckets)):
            if self.edges[level] > n / self.similarity + 1e-6:
                break
            out.append(self.at(hashes, level))
        return np.concatenate(out).view(np.int64)

    def at(self, hashes: np.ndarray, level: int) -> np.ndarray:
        buckets = int(self.buckets[level])
        h = mixed(hashes, 2)
        where = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(where)
        where, h = where[order], h[order]
        first = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
        at, sums = where[first], np.add.reduceat(mixed(h, 3), first)
        if len(at) <= self.differ[level]:
            every = np.zeros(buckets, np.uint64)
            every[at] = sums
            at, sums = np.arange(buckets), every
        return mixed(sums ^ mixed((at + (level << 44)).astype(np.uint64), 4), 5)


class _Sets:
    """Of each text's set of shingles: its size, a hash of all, the fingerprint, the sketch and the signatures."""

    def __init__(self, width: int, similarity: float):
        self.width, self.signatures = width, Signatures(similarity)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                sets = [shingles(t.as_py(), self.width) for t in part.column("text")]
                own = [self.signatures.of(x) for x in sets]
                ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
                columns = {
                    "doc_id": part.column("doc_id"),
                    "same": pa.array(np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)),
                    "n": pa.array([len(x) for x in sets], pa.int64()),
                    "fp": pa.array(np.array([majority(x) for x in sets], np.uint64).view(np.int64)),
                    "sketch": pa.array([sketch(x).tobytes() for x in sets], pa.binary()),
                    "signatures": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own))),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH // 64)


def _may_hold(n: np.ndarray, one: np.ndarray, i: np.ndarray, m: np.ndarray, two: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the pairs of rows (i, j) sizes and sketches don't rule out, as positions."""
    at = np.flatnonzero(np.minimum(n[i], m[j]) >= similarity * np.maximum(n[i], m[j]) - 1e-6)
    most = (1 - similarity) / (1 + similarity) * (n[i[at]] + m[j[at]]) + 1e-6
    apart = np.zeros(len(at), np.int64)
    for a in range(0, one.shape[1], 8):
        apart += np.bitwise_count(one[i[at], a : a + 8] ^ two[j[at], a : a + 8]).sum(axis=1, dtype=np.int64)
        close = apart <= most
        at, most, apart = at[close], most[close], apart[close]
    return at


class _Candidates(_Tiles):
    """Pairs (own, other) of a tile whose labels differ and whose sizes and sketches allow the similarity, each named by the row that takes it as one of its ``partners``.

    A pair of rows that both have theirs is left, and (null, null) says so.
    """

    def __init__(self, keys: list[str], similarity: float, partners: int):
        self.keys, self.similarity, self.partners = keys, similarity, partners

    def out(self, t: pa.Table, tiles: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, labels, n = (t.column(c).to_numpy() for c in ("id", "label", "n"))
        order = np.lexsort((ids, n, tiles))
        tiles, ids, labels, n = tiles[order], ids[order], labels[order], n[order]
        sketches = _sketches(t.column("sketch"))[order]
        at, step, left = np.arange(len(ids)), 1, False
        met = np.zeros(len(ids), np.int64)
        while len(at):
            at = at[at + step < len(ids)]
            at = at[(tiles[at] == tiles[at + step]) & (n[at] >= self.similarity * n[at + step] - 1e-6)]
            near = at[labels[at] != labels[at + step]]
            near = near[_may_hold(n, sketches, near, n, sketches, near + step, self.similarity)]
            ahead = np.where(ids[near] > ids[near + step], near, near + step)
            own = np.where(met[ahead] < self.partners, ahead, 2 * near + step - ahead)
            room = met[own] < self.partners
            left |= not room.all()
            near, own = near[room], own[room]
            np.add.at(met, own, 1)
            if len(near):
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[2 * near + step - own])], ["own", "other"])
            step += 1
        if left:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], ["own", "other"])


class _Possible:
    """The pairs that sizes and sketches don't rule out."""

    def __init__(self, similarity: float):
        self.similarity = similarity

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.arange(batch.num_rows)
            at = _may_hold(batch.column("n").to_numpy(), _sketches(batch.column("sketch")), rows, batch.column("m").to_numpy(), _sketches(batch.column("its")), rows, self.similarity)
            yield batch.select(["own", "other"]).take(pa.array(at))


#: Signatures that a task gathers, as a rule, and the slots it takes them in, one at a time.
DEALT, SLOTS = 1 << 20, 8


class _Dealt:
    """The signatures of a few documents (doc_id, n, signatures) by slot: one row for each slot, with the doc_id and n of each signature."""

    def __init__(self, slots: int):
        self.slots = slots

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 4096):
                batch = whole.slice(a, 4096)
                lists = batch.column("signatures")
                sigs, of = lists.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                if not len(sigs):
                    continue
                slot = np.mod(sigs, self.slots)
                order = np.argsort(slot, kind="stable")
                slot, of = slot[order], pa.array(of[order])
                first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
                ends = pa.array(np.append(first, len(slot)), pa.int32())
                columns = (pa.array(sigs[order]), batch.column("doc_id").take(of), batch.column("n").take(of))
                yield pa.RecordBatch.from_arrays([pa.array(slot[first]), *(pa.ListArray.from_arrays(ends, c) for c in columns)], ["slot", "sig", "doc_id", "n"])


class _Shared:
    """The rows (sig, doc_id, n) of signatures that several documents have; rows of a slot stand together.

    What is held is a slot's signatures that were met once, those that were met twice, and up to ``most`` rows that were not looked at: rows of a signature that many documents have pass by.
    """

    def __init__(self, most: int = DEALT):
        self.most = most

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, held, known, fresh = None, [], np.zeros(0, np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column("slot").to_numpy()
            edges = np.flatnonzero(np.append(True, at[1:] != at[:-1])).tolist()
            for a, b in zip(edges, [*edges[1:], len(at)], strict=True):
                if held and at[a] != slot:
                    found, _, _ = self.folded(held, known)
                    yield from self.out(found)
                    held, known, fresh = [], known[:0], 0
                slot, part = at[a], batch.slice(a, b - a)
                held.append([part.column(c).flatten().to_numpy() for c in ("sig", "doc_id", "n")])
                fresh += len(held[-1][0])
                if fresh >= self.most:
                    found, left, known = self.folded(held, known)
                    yield from self.out(found)
                    held, fresh = [left], 0
        if held:
            yield from self.out(self.folded(held, known)[0])

    def folded(self, held: list[list[np.ndarray]], known: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """The rows of signatures that are held twice or in ``known``, the others, and all signatures known by now."""
        rows = [np.concatenate(c) for c in zip(*held, strict=True)]
        order = np.argsort(rows[0], kind="stable")
        rows = [c[order] for c in rows]
        same = rows[0][1:] == rows[0][:-1]
        shared = np.append(same, False) | np.append(False, same) | np.isin(rows[0], known)
        return [c[shared] for c in rows], [c[~shared] for c in rows], np.union1d(known, rows[0][shared])

    def out(self, rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(rows[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 16)]) for c in rows], ["sig", "doc_id", "n"])


def shared_signatures(rows: DataFrame) -> DataFrame:
    """sig, doc_id, n: the signatures of ``rows`` (doc_id, n, signatures) that several documents have, each with its documents.

    Signatures are dealt out by slot, packed, in one shuffle, and nothing is grouped before it. Slots and tasks grow with the signatures, so what a task holds doesn't.
    """
    # a set of n elements has n + 20 signatures at most
    most = rows.agg(F.sum(F.col("n") + 20)).first()[0] or 0
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-most // DEALT))
    # a part of them at a time, so that batches of rows stay small however long the texts
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("signatures")), F.lit(128)), lambda i: F.slice("signatures", i, 128))
    dealt = rows.select("doc_id", "n", F.explode(pieces).alias("signatures")).mapInArrow(_Dealt(SLOTS * tasks), "slot long, sig array<long>, doc_id array<long>, n array<long>")
    return dealt.repartition(tasks, "slot").sortWithinPartitions("slot").mapInArrow(_Shared(), "sig long, doc_id long, n long")


class _Similar:
    def __init__(self, width: int, similarity: float):
        self.width, self.similarity = width, similarity

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("text"), batch.column("other"), strict=True):
                x, y = shingles(x.as_py(), self.width), shingles(y.as_py(), self.width)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= self.similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 3, most: int = 4096) -> DataFrame:
    """doc_id, component_id: one row per distinct non-null doc_id. Documents whose sets of shingles of ``width`` words have a Jaccard similarity of ``similarity`` or more are linked.

    First fingerprints of the sets that differ in up to ``radius`` bits are linked where their sets hold the similarity. Then sets
    that share a signature meet, as all similar ones do. At first each is checked against the first of a group that it shares most signatures with;
    then those of different components are compared by their sketches, which rule out pairs but never a similar one, and what is left is checked by the
    sets themselves. A row gets few partners in a round, more in each later one (8 times as many, 64 where most pairs of the round were similar or there were none), and rounds go on until no pair is left that isn't joined or checked: the
    components are exact, and pairs grow with rows and not with their squares unless the sketches can't tell. No task holds more than twice ``most`` rows
    of a group at once. Texts without words have equal, empty sets. Null texts count as empty, rows that repeat a doc_id count once (their least text), very
    long texts are read whole, other columns aren't read, an empty table gives an empty result.
    """
    return _near(docs, width, similarity, radius, most)[0]


#: Groups of up to so many rows are paired at once, so that each pair is compared once however many groups it is in.
FEW = 8


def _near(docs: DataFrame, width: int, similarity: float, radius: int, most: int) -> tuple[DataFrame, list[int]]:
    """``near_copies``, and how many pairs each round checked."""
    d = text_of(docs).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("text").alias("text")) if _repeats_ids(docs) else text_of(docs).filter("doc_id IS NOT NULL")
    rows = written(d.mapInArrow(_Sets(width, similarity), "doc_id long, same long, n long, fp long, sketch binary, signatures array<long>"))
    # equal sets meet as one kind, named after its smallest document
    kinds = written(rows.groupBy("same").agg(F.min("doc_id").alias("id"), F.min("fp").alias("fp"), F.count("*").alias("rows")))
    total = rows.count()
    checked: list[int] = []

    def verified(pairs: DataFrame) -> DataFrame:
        checked.append(pairs.count())
        ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        few = ids.count() <= SMALL
        of = written((d if few else d.filter(claims(ids, "doc_id"))).join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"))
        both = written(join_counted(pairs, of.withColumnRenamed("doc_id", "a"), ["a"], F.col("b")))
        both_texts = join_counted(both, of.select(F.col("doc_id").alias("b"), F.col("text").alias("other")), ["b"], F.col("a"))
        held = written(both_texts.select("a", "b", "text", "other").mapInArrow(_Similar(width, similarity), "a long, b long"))
        forget(ids, of, both)
        return held

    # by fingerprints: each kind and the first of its fingerprint, and the firsts of linked fingerprints
    first = written(kinds.groupBy("fp").agg(F.min("id").alias("a"), F.count("*").alias("many")))
    alike = join_by_weight(kinds.select("fp", F.col("id").alias("b")), first, ["fp"], "many", total, F.xxhash64("b")).filter("a <> b").select("a", "b")
    near = links(first.select("fp"), radius).toDF("x", "y").join(first.select(F.col("fp").alias("x"), F.col("a").alias("i")), "x").join(first.select(F.col("fp").alias("y"), F.col("a").alias("j")), "y")
    joined = verified(written(alike.union(near.select(F.least("i", "j"), F.greatest("i", "j"))).distinct()))
    refuted = None

    # by signatures: those of two documents or more
    own = shared_signatures(rows)
    # one row of each kind: a document of its own set's name
    members = written(own.join(kinds.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("sig", F.col("doc_id").alias("id"), "n"))
    named = written(rows.select("doc_id", "same"))
    sketches = written(rows.join(kinds.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "sketch"))
    forget(rows, shuffles=True)
    names = components(joined)
    labels = written(kinds.select("id").join(names.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("label")))
    partners, met = 0, None
    while True:
        if met is None:
            labelled = written(members.select("sig", "id", "n").join(labels, "id"))
            open_ = written(labelled.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.struct("id", "label", "n")).alias("least"), F.count("*").alias("size")).filter("lo <> hi").drop("lo", "hi"))
            met = written(join_by_weight(labelled, open_, ["sig"], "size", total, F.xxhash64("id")).filter("size IS NOT NULL"))
            # groups of one label stay so: later rounds read the others alone
            forget(labelled, members)
            members = met
        if partners == 0:
            # of the least rows of its groups, the one it is with most often
            often = met.filter("label <> least.label AND id <> least.id").groupBy(F.col("id").alias("own"), F.col("least.id").alias("other"), "n", F.col("least.n").alias("m")).agg(F.count("*").alias("together"))
            often = often.withColumn("nth", F.row_number().over(Window.partitionBy("own").orderBy(F.desc("together"), "other"))).filter("nth = 1")
            found = written(_possible(often, sketches, similarity).withColumn("nth", F.lit(1)))
            more = True
        else:
            found = written(_compared(met, sketches, similarity, partners, most))
            more = (partners == 1 and not open_.filter(F.col("size") > most).isEmpty()) or not found.filter(F.col("own").isNull() | (F.col("nth") > partners)).isEmpty()
        pairs = found.filter(F.col("own").isNotNull() & (F.col("nth") <= max(1, partners))).select(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).distinct()
        pairs = written(pairs.join(refuted, ["a", "b"], "left_anti") if refuted is not None else pairs)
        forget(found)
        grow = 64
        if not pairs.isEmpty():
            held = verified(pairs)
            similar = held.count()
            # where most pairs of a round were not similar, the next one takes fewer more
            grow = 64 if 2 * similar >= checked[-1] else 8
            wrong = pairs.join(held, ["a", "b"], "left_anti")
            refuted = written(refuted.union(wrong) if refuted is not None else wrong)
            if similar:
                # only components that new links join get new names; where none do, the same rows meet again
                labels = _relabelled(labels, held, total)
                forget(open_, shuffles=True)
                met = None
        if not more:
            break
        partners = max(1, partners * grow)
    forget(members, sketches)
    of = kinds.join(labels, "id").select("same", F.col("label").alias("component_id"), "rows")
    out = join_by_weight(named, written(of), ["same"], "rows", total, F.xxhash64("doc_id"))
    return out.select("doc_id", "component_id"), checked


def _relabelled(labels: DataFrame, held: DataFrame, total: int) -> DataFrame:
    """``labels`` (id, label), where components that the edges ``held`` (a, b) join take the smallest of their labels."""
    half = written(join_counted(held, labels.toDF("a", "i"), ["a"], F.col("b")))
    edges = join_counted(half, labels.toDF("b", "j"), ["b"], F.col("a")).select(F.col("i").alias("a"), F.col("j").alias("b"))
    names = written(components(edges).withColumnRenamed("node", "label"))
    if names.count() <= SMALL:
        out = labels.join(F.broadcast(names), "label", "left")
    else:
        weighed = names.join(labels.groupBy("label").agg(F.count("*").alias("rows")), "label")
        out = join_by_weight(labels, written(weighed), ["label"], "rows", total, F.xxhash64("id"))
    out = written(out.select("id", F.coalesce("component", "label").alias("label")))
    forget(labels, half, names)
    return out


def _possible(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (own, other) of sets of n and m elements, those that sizes and sketches don't rule out."""
    pairs = pairs.join(sketches.withColumnRenamed("id", "own"), "own")
    pairs = join_counted(written(pairs.select("own", "other", "n", "m", "sketch")), sketches.select(F.col("id").alias("other"), F.col("sketch").alias("its")), ["other"], F.col("own"))
    return pairs.select("own", "other", "n", "m", "sketch", "its").mapInArrow(_Possible(similarity), "own long, other long")


def _compared(met: DataFrame, sketches: DataFrame, similarity: float, partners: int, most: int) -> DataFrame:
    """Pairs (own, other) of the rows (sig, id, n, label, size) of each ``sig`` that sizes and sketches don't rule out, numbered for each ``own``; a row with nulls where pairs were left."""
    few = met.filter(F.col("size") <= FEW).groupBy("sig").agg(F.array_sort(F.collect_list(F.struct("id", "n", "label"))).alias("x"))
    pairs = few.select(F.explode("x").alias("p"), "x").select("p", F.explode("x").alias("q")).filter(f"p.id > q.id AND p.label <> q.label AND least(p.n, q.n) >= {similarity} * greatest(p.n, q.n) - 1e-6")
    pairs = pairs.select(F.col("p.id").alias("own"), F.col("q.id").alias("other"), F.col("p.n").alias("n"), F.col("q.n").alias("m")).distinct()
    pairs = _possible(pairs, sketches, similarity)
    # a crowded group is cut into parts: at first each part meets itself alone, later every two meet
    many = met.filter(F.col("size") > FEW).withColumn("parts", F.ceil(F.col("size") / most).cast("int")).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    others = F.sequence(F.lit(0), F.col("parts") - 1) if partners > 1 else F.array("part")
    many = many.withColumn("at", F.explode(others)).withColumns({"i": F.least("part", "at"), "j": F.greatest("part", "at")})
    many = many.select("sig", "i", "j", "id", "label", "n").join(sketches, "id")
    keys = ["sig", "i", "j"]
    tiles = many.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_Candidates(keys, similarity, partners), "own long, other long")
    # a row meets others in many groups, but takes no more partners for that
    return pairs.union(tiles).distinct().withColumn("nth", F.row_number().over(Window.partitionBy("own").orderBy("other")))


def _repeats_ids(docs: DataFrame) -> bool:
    """Whether a doc_id is on several rows; ids that are on one, as in most tables, need no grouping of texts."""
    return bool(docs.groupBy("doc_id").count().filter("count > 1").limit(1).count())


def without_near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row, that of the smallest doc_id, of each component of near copies; all columns as they are.

    Rows without a doc_id stay; of rows that repeat a doc_id one stays.
    """
    gone = near_copies(docs, width, similarity).filter("doc_id <> component_id").select(F.col("doc_id").alias("_id"))
    rows = packed(docs, _id=F.col("doc_id"))
    stay = rows.filter("_id IS NOT NULL").join(gone, "_id", "left_anti").dropDuplicates(["_id"])
    return unpacked(stay).unionByName(unpacked(rows.filter("_id IS NULL")))
