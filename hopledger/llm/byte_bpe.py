"""Byte-level BPE: pieces of equal length class are merged together as padded matrices.

Every row of a matrix is one distinct piece. A round finds the lowest pair rank of each row at its leftmost place, merges it and
closes the gap, so the matrix loses one column a round; rows without a mergeable pair leave. Pair ranks come from an open hash table
held in two arrays, and only the two pairs beside a merge are looked up again.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from hopledger.llm.common import map_slices, texts_of

NO_PAIR = np.int32(2**31 - 1)
# Pieces known to a task; beyond this many characters the memory of pieces is emptied.
CACHE_CHARS = 10_000_000
# Longer pieces are merged with a heap: one merge a round would take time with the square of the length.
MATRIX_BYTES = 512


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PairTable:
    """(left id, right id) -> rank of their concatenation, as linear probing over arrays."""

    def __init__(self, ranks: dict[bytes, int], made: Iterable[str] | None = None):
        """Pairs that make any of ``ranks``, or only the texts of ``made``."""
        pairs = [
            (ranks[token[:cut]] << 20 | ranks[token[cut:]], rank)
            for token, rank in (ranks.items() if made is None else ((t.encode(), ranks[t.encode()]) for t in made))
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        bits = max(4, (2 * len(pairs)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NO_PAIR, np.int32)
        keys = np.array([k for k, _ in pairs], np.int64)
        values = np.array([v for _, v in pairs], np.int32)
        slot = self._slot(keys)
        while keys.size:
            free = self.keys[slot] == -1
            _, first = np.unique(slot, return_index=True)
            first = first[free[first]]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
            left = np.ones(keys.size, bool)
            left[first] = False
            keys, values, slot = keys[left], values[left], slot[left] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; a negative id stands for no neighbour."""
        shape = left.shape
        keys = ((left.astype(np.int64) << 20) | right.astype(np.int64)).ravel()
        out = np.full(keys.size, NO_PAIR, np.int32)
        at = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        keys = keys[at]
        slot = self._slot(keys)
        while at.size:
            found = self.keys[slot]
            hit = found == keys
            out[at[hit]] = self.values[slot[hit]]
            go = ~hit & (found != -1)
            at, keys, slot = at[go], keys[go], slot[go] + 1 & self.mask
        return out.reshape(shape)


class BytePairs:
    """Encodes pieces and texts by a rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pattern = regex.compile(pattern)
        self.known: dict[str, tuple[int, str, bytes]] = {}
        self.known_chars = 0

    def merge_matrix(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece; pieces may differ in length, shorter rows are padded with -1."""
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max(initial=1))
        padded = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        ids = np.where(np.arange(width) < lengths[:, None], self.byte_ids[padded], np.int32(-1))
        rank = self.pairs.look_up(ids[:, :-1], ids[:, 1:])
        rows = np.arange(len(pieces))
        out: list[list[int]] = [[] for _ in pieces]

        def leave(which: np.ndarray) -> None:
            for row, values in zip(rows[which].tolist(), ids[which].tolist(), strict=True):
                out[row] = [v for v in values if v >= 0]

        while rows.size:
            if not rank.shape[1]:
                leave(np.ones(rows.size, bool))
                break
            at = rank.argmin(axis=1)
            best = rank[np.arange(rows.size), at]
            go = best != NO_PAIR
            if not go.all():
                leave(~go)
                rows, ids, rank, at, best = rows[go], ids[go], rank[go], at[go], best[go]
                if not rows.size:
                    break
            every, width = np.arange(rows.size), ids.shape[1]
            take = np.arange(width - 1)
            ids[every, at] = best
            ids = np.take_along_axis(ids, take + (take > at[:, None]), axis=1)
            rank = np.take_along_axis(rank, take[:-1] + (take[:-1] >= at[:, None]), axis=1)
            if rank.shape[1]:
                before, after = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
                rank[before, at[before] - 1] = self.pairs.look_up(ids[before, at[before] - 1], best[before])
                rank[after, at[after]] = self.pairs.look_up(best[after], ids[after, at[after] + 1])
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        """The same merges for one long piece: lowest rank first, leftmost among equals."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        one = lambda a, b: self.ranks.get(self.token[a] + self.token[b])
        heap = [(r, i) for i in range(len(ids) - 1) if (r := one(ids[i], ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= len(ids) or one(ids[i], ids[j]) != rank:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
                if (r := one(rank, ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := one(ids[before[i]], rank)) is not None:
                heapq.heappush(heap, (r, before[i]))
        return [i for i in ids if i >= 0]

    def learn(self, pieces: set[str]) -> None:
        """Adds the encodings of unseen pieces, each length class as one matrix."""
        classes: dict[int, list[str]] = {}
        for piece in pieces:
            data = piece.encode()
            if (whole := self.ranks.get(data)) is not None:
                self.known[piece] = (1, str(whole), data)
            else:
                classes.setdefault((len(data) - 1).bit_length(), []).append(piece)
            self.known_chars += len(piece) + 100
        for length, members in classes.items():
            data = [m.encode() for m in members]
            if 1 << length > MATRIX_BYTES:
                encoded = map(self.merge_long, data)
            else:
                step = max(1, (1 << 20) >> length)
                encoded = (ids for k in range(0, len(data), step) for ids in self.merge_matrix(data[k:k + step]))
            for piece, ids in zip(members, encoded, strict=True):
                self.known[piece] = (len(ids), ",".join(map(str, ids)), b"".join(self.token[i] for i in ids))

    def encode(self, texts: list[str]) -> list[list[tuple[int, str, bytes]]]:
        """Per text the pieces as (number of ids, decimal ids, decoded bytes)."""
        split = [self.pattern.findall(text) for text in texts]
        if self.known_chars > CACHE_CHARS:
            self.known, self.known_chars = {}, 0
        unseen = set().union(*split).difference(self.known)
        if unseen:
            self.learn(unseen)
        known = self.known
        return [[known[piece] for piece in pieces] for pieces in split]


@lru_cache(maxsize=1)
def _encoder(path_or_key: str, pattern: str, shipped) -> BytePairs:
    return BytePairs(shipped.value, pattern)


def encode_texts(df: DataFrame, vocabulary: str, pattern: str, keep: str = "doc_id long", text: str = "text",
                 with_ids: bool = False) -> DataFrame:
    """Rows of ``df`` as (keep, n_tokens, ids_sha256, decoded_sha256[, ids]).

    ``vocabulary`` is the path of a rank file, read on the driver and sent to the tasks (its size is fixed, about a megabyte). Null and
    empty texts have no ids and the digests of nothing; other columns do not matter; repeated rows stay.
    """
    name = keep.split()[0]
    shipped = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    schema = f"{keep}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    def make():
        encoder = _encoder(vocabulary, pattern, shipped)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, digests, decoded, ids = [], [], [], []
            for pieces in encoder.encode(texts_of(batch, text)):
                counts.append(sum([p[0] for p in pieces]))
                joined = ",".join([p[1] for p in pieces])
                digests.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join([p[2] for p in pieces])).hexdigest())
                if with_ids:
                    ids.append(np.fromstring(joined, np.int32, sep=",") if joined else np.empty(0, np.int32))
            columns = [batch.column(name), pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded)]
            names = [name, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names)

        return work

    return map_slices(df.select(name, text), text, schema, make)
