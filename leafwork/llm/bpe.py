"""Byte-level BPE: encoding by corpus-level merge replay, and decoding.

Rows arrive in blocks. The distinct pieces of a block that were not seen before form one corpus: an inverted index
leads from each rank (each pair of neighbouring tokens whose concatenation has that rank) to the positions where the
pair stands, and the merges are replayed in rank order over all pieces at once; a merge touches only its two
neighbours' entries. A piece in which a merge makes a pair of lower rank than the one being replayed leaves the common
order, and is merged by itself in its own order. No rows move: the work is one pass over the input.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import text_of

#: The pattern's white space, Unicode's White_Space property.
WHITE = "\t-\r \x85\xa0  -     　"


#: In place of a rank: the pair never merges.
NONE = 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


class Codec:
    """Encodes and decodes by a rank table. ``most_pieces`` bounds the pieces remembered between blocks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_pieces: int = 700_000):
        self.ranks, self.most_pieces = ranks, most_pieces
        inside = f"[{WHITE}]"
        self.find = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", inside)).findall
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.known: dict[str, bytes] = {}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        halves = sorted(((ranks[t[:i]] << 32) | ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        self.pairs, self.pair_ranks = np.array(halves, np.int64).reshape(-1, 2).T.copy()

    def alone(self, piece: bytes) -> list[int]:
        """One piece in its own order: always the lowest rank, the leftmost first."""
        n = len(piece)
        parts = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # a pair stands in the heap with its length, by which one that has changed since is told
        pair = lambda i: parts[i] + parts[after[i]]
        heap = [(self.ranks[p], i, len(p)) for i in range(n - 1) if (p := pair(i)) in self.ranks]
        heapify(heap)
        while heap:
            rank, i, size = heappop(heap)
            j = after[i]
            if not parts[i] or j >= n or len(parts[i]) + len(parts[j]) != size or self.ranks.get(pair(i)) != rank:
                continue
            parts[i], parts[j], after[i] = pair(i), b"", after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (p := pair(k)) in self.ranks:
                    heappush(heap, (self.ranks[p], k, len(p)))
        return [self.ranks[p] for p in parts if p]

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of neighbouring tokens, NONE where the pair never merges or one side is no token."""
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.pairs[at] == key), self.pair_ranks[at], NONE)

    def replay(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece, all merges replayed in rank order over all pieces."""
        whole = [self.ranks.get(p, -1) for p in pieces]
        rest = [k for k, rank in enumerate(whole) if rank < 0]
        if not rest:
            return [np.array([rank], "<u4") for rank in whole]
        long = np.fromiter((len(pieces[k]) for k in rest), np.int64, len(rest))
        # the tokens of all pieces in a row, each piece between two places without a token
        first = np.cumsum(long + 1) - long
        n = int(long.sum()) + len(rest) + 1
        owner = np.zeros(n, np.int64)
        owner[1:] = np.repeat(np.arange(len(rest)), long + 1)
        inside = np.ones(n, bool)
        inside[np.append(0, first + long)] = False
        token = np.full(n, -1, np.int64)
        token[inside] = self.of_byte[np.frombuffer(b"".join(pieces[k] for k in rest), np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        pair = np.append(self.rank_of(token[:-1], token[1:]), NONE)  # the rank of each place's token with the next
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(ranks: np.ndarray, places: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, at in zip(ranks[np.append(0, cuts)].tolist(), np.split(places, cuts), strict=True):
                if rank not in index:
                    index[rank] = []
                    heappush(heap, rank)
                index[rank].append(at)

        if len(places := np.flatnonzero(pair != NONE)):
            enter(pair[places], places)
        astray = np.zeros(len(rest) + 1, bool)
        while heap:
            now = heappop(heap)
            at = np.unique(np.concatenate(index.pop(now)))
            at = at[pair[at] == now]
            if not len(at):
                continue
            # of pairs that share a token the left one merges, then the next but one, and so on
            run = np.flatnonzero(np.append(True, after[at[:-1]] != at[1:]))
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            gone = after[at]
            token[at], token[gone], pair[gone] = now, -1, NONE
            after[at] = after[gone]
            before[after[at]] = at
            left = before[at]
            pair[at], pair[left] = self.rank_of(token[at], token[after[at]]), self.rank_of(token[left], token[at])
            touched = np.unique(np.append(at, left))
            ranks = pair[touched]
            new, touched = ranks[ranks != NONE], touched[ranks != NONE]
            if len(new):
                astray[owner[touched[new < now]]] = True
                enter(new, touched)
        stands = np.flatnonzero(token >= 0)
        ids, ends = token[stands].astype("<u4"), np.searchsorted(stands, first + long)
        out = [np.array([rank], "<u4") if rank >= 0 else None for rank in whole]
        for i, (k, a, b) in enumerate(zip(rest, np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)):
            out[k] = np.array(self.alone(pieces[k]), "<u4") if astray[i] else ids[a:b]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text of a block."""
        pieces = [self.find(t) for t in texts]
        new = list({p for of in pieces for p in of}.difference(self.known))
        if len(self.known) + len(new) > self.most_pieces:
            self.known = {}
            new = list({p for of in pieces for p in of})
        known = self.known
        known.update(zip(new, (ids.tobytes() for ids in self.replay([p.encode() for p in new])), strict=True))
        return [np.frombuffer(b"".join(map(known.__getitem__, of)), "<u4") for of in pieces]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_codecs: dict[str, Codec] = {}


def encode(docs: DataFrame, ranks_path: str, pattern: str, block_mb: float = 16) -> DataFrame:
    """doc_id, token_ids array<int> for each row; a null text counts as empty and gives no ids, repeated rows stay.

    Blocks hold ``block_mb`` MB of text, or one longer text.
    """
    return text_of(docs).mapInArrow(_Blocks(ranks_path, pattern, block_mb, False), "doc_id long, token_ids array<int>")


def encode_digest(docs: DataFrame, ranks_path: str, pattern: str, block_mb: float = 16) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and decoded_sha256 (the bytes that the ids decode to).

    One row per input row, in either engine's order: null and empty texts have no tokens, very long texts are one block
    of their own, repeated rows and null ids stay, other columns are never read, no rows give no rows.
    """
    return text_of(docs).mapInArrow(_Blocks(ranks_path, pattern, block_mb, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


class _Blocks:
    def __init__(self, ranks_path: str, pattern: str, block_mb: float, digest: bool):
        self.ranks, self.pattern, self.most, self.digest = read_ranks(ranks_path), pattern, block_mb * 1e6, digest
        self.key = hashlib.sha256(repr((pattern, sorted(self.ranks.items()))).encode()).hexdigest()

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # workers are used again: the pieces known to one task serve the next
        if self.key not in _codecs:
            _codecs[self.key] = Codec(self.ranks, self.pattern)
        codec = _codecs[self.key]
        for batch in batches:
            ids, texts, size, first = batch.column(0), [], 0, 0
            for text in batch.column(1):
                texts.append(text.as_py())
                size += len(texts[-1])
                if size > self.most:
                    yield self.out(codec, ids.slice(first, len(texts)), texts)
                    first, texts, size = first + len(texts), [], 0
            if texts:
                yield self.out(codec, ids.slice(first, len(texts)), texts)

    def out(self, codec: Codec, doc_ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        tokens = codec.encode(texts)
        if not self.digest:
            return pa.RecordBatch.from_arrays([doc_ids, pa.array([t.astype("i4") for t in tokens], pa.list_(pa.int32()))], ["doc_id", "token_ids"])
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return pa.RecordBatch.from_arrays(
            [doc_ids, pa.array([len(t) for t in tokens], pa.int64()), pa.array([sha(t.tobytes()) for t in tokens]), pa.array([sha(codec.decode(t)) for t in tokens])],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )
