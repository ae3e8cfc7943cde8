"""Exact top-k by columnar branch and bound over integer vectors.

A shard is laid out by dimension. For each query, partial inner products grow by one block of dimensions at a time, over the surviving
candidates only; what the remaining dimensions can add is at most the product of the remaining norms (Cauchy-Schwarz), and candidates whose
bound stays below the k-th best score known are compacted away. Blocks with much of the query's mass come first.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from hopledger.llm.vectors import best_of_shards, leading, usable

SHARD_ROWS, DIMENSION_BLOCK = 4096, 8
# Up to this size products and sums of components are exact in double precision.
EXACT = float(1 << 22)


class Columns:
    """Candidates by dimension with the mass that remains after each block of dimensions."""

    def __init__(self, c: np.ndarray):
        self.by_dimension = np.ascontiguousarray(c.T)
        self.starts = list(range(0, c.shape[1], DIMENSION_BLOCK))
        self.mass = np.stack([(self.by_dimension[a:a + DIMENSION_BLOCK] ** 2).sum(axis=0) for a in self.starts])
        self.total = self.mass.sum(axis=0)

    def search(self, q: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, scores) of the ``k`` highest inner products, without rows of the query's own id."""
        alive = np.flatnonzero(ids != own)
        if not alive.size:
            return alive, np.empty(0)
        weight = np.array([(q[a:a + DIMENSION_BLOCK] ** 2).sum() for a in self.starts])
        order = np.argsort(-weight, kind="stable")
        # The k best of a few rows give a first score to beat.
        seed = alive[:: max(1, alive.size // (8 * k))]
        known = q @ self.by_dimension[:, seed]
        floor = np.partition(known, known.size - k)[known.size - k] if known.size >= k else -np.inf
        partial, rest, left = np.zeros(alive.size), self.total[alive].copy(), weight.sum()
        for at, block in enumerate(order):
            rows = slice(self.starts[block], self.starts[block] + DIMENSION_BLOCK)
            columns = self.by_dimension[rows] if alive.size == ids.size else self.by_dimension[rows][:, alive]
            partial = partial + q[rows] @ columns
            if at == order.size - 1:
                break
            rest, left = rest - self.mass[block][alive], left - weight[block]
            bound = partial + np.sqrt(np.maximum(rest, 0) * max(left, 0)) * (1 + 1e-9) + 1e-6
            keep = bound >= floor
            if not keep.all():
                alive, partial, rest = alive[keep], partial[keep], rest[keep]
        best = leading(partial, ids[alive], k)
        return alive[best], partial[best]


def _search(k: int):
    def search(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray):
        q, c = np.floor(256 * q), np.floor(256 * c)
        if max(np.abs(q).max(), np.abs(c).max()) * np.sqrt(q.shape[1] / 64) >= EXACT:
            return _large(q_ids, q, c_ids, c, k)
        columns = Columns(c)
        found = [columns.search(row, c_ids, own, k) for own, row in zip(q_ids.tolist(), q, strict=True)]
        at = np.repeat(np.arange(len(found)), [p.size for p, _ in found])
        return at, np.concatenate([p for p, _ in found]), np.concatenate([s for _, s in found]).astype(np.int64)

    return search


def _large(q_ids, q, c_ids, c, k):
    """The same for components beyond double precision: whole numbers without limit; scores are held within a long."""
    top = 2**63 - 1
    qs, cs = ([[int(x) for x in row] for row in m.tolist()] for m in (q, c))
    at, places, scores = [], [], []
    for i, row in enumerate(qs):
        ranked = sorted((-sum(map(int.__mul__, row, other)), int(c_ids[j]), j) for j, other in enumerate(cs) if c_ids[j] != q_ids[i])
        for score, _, j in ranked[:k]:
            at.append(i)
            places.append(j)
            scores.append(max(-top - 1, min(top, -score)))
    return np.array(at, np.int64), np.array(places, np.int64), np.array(scores, np.int64)


def exact_top_k(embeddings: DataFrame, every: int = 50, k: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) by the inner product of floor(256 * x), exact.

    Queries are the rows with vec_id divisible by ``every``. Vectors that are null, empty or hold null or non-finite components take no
    part; vectors of another length than the query's are not its candidates. A repeated row is a candidate as often as it occurs;
    a repeated query id is one query. Extra columns do not matter; no usable vectors give no rows.
    """
    return best_of_shards(usable(embeddings), every, k, shard_rows, "long", _search(k))
