"""Approximate nearest neighbours by stable projections and a kd-tree with a chi-square stopping test.

Inner products are turned into distances by one more component that gives all vectors the same norm. Normal (2-stable) projections take
vectors to ``PROJECTIONS`` dimensions; for a point at distance d the squared projected distance is d^2 times a chi-square variable. A
shard's projections are indexed by a kd-tree. A query takes leaves in the order of their projected distance r and verifies their points on
the original vectors; it stops when a point as near as its k-th best so far (distance d) would have been projected within r with probability
``SURE``: r^2 >= d^2 * quantile. Every row is indexed.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopledger.llm.vectors import NO_ID, best_of_shards, usable

SHARD_ROWS, LEAF_ROWS, PROJECTIONS, SURE = 8192, 256, 8, 0.95
# Squared distances and scores within this share of the squared norm may be equal in exact arithmetic.
NEAR = 1e-12


def chi_square_quantile(p: float, m: int) -> float:
    """The value that a chi-square variable with an even number ``m`` of degrees stays below with probability ``p``."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(m // 2))
    low, high = 0.0, 1000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def kd_leaves(points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> list[np.ndarray]:
    """Positions per leaf: halves at the median of the widest dimension until a leaf is small enough."""
    leaves, open_ = [], [np.arange(len(points))]
    while open_:
        rows = open_.pop()
        spread = np.ptp(points[rows], axis=0)
        if rows.size <= leaf_rows:
            leaves.append(rows)
            continue
        half = rows.size // 2
        order = rows[np.argpartition(points[rows, spread.argmax()], half)]
        open_ += [order[:half], order[half:]]
    return leaves


class Projected:
    """The index of one shard."""

    def __init__(self, c: np.ndarray, norm: float, seed: int = 5):
        self.c, self.norm = c, norm
        last = np.sqrt(np.maximum(norm * norm - (c * c).sum(axis=1), 0))
        self.axes = np.random.default_rng(seed).standard_normal((c.shape[1] + 1, PROJECTIONS))
        points = np.column_stack([c, last]) @ self.axes
        self.leaves = kd_leaves(points)
        self.low = np.array([points[rows].min(axis=0) for rows in self.leaves])
        self.high = np.array([points[rows].max(axis=0) for rows in self.leaves])

    def search(self, q: np.ndarray, q_ids: np.ndarray, c_ids: np.ndarray, k: int, sure: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best found per query; all queries of the block go through the leaves together, each in its own order."""
        quantile = chi_square_quantile(sure, PROJECTIONS)
        norms = (q * q).sum(axis=1)
        at = q @ self.axes[:-1]
        out = np.maximum(np.maximum(self.low[None] - at[:, None], at[:, None] - self.high[None]), 0)
        reach = (out * out).sum(axis=2)
        order = np.argsort(reach, axis=1, kind="stable")
        top = np.full((len(q), k), -np.inf)
        where = np.full((len(q), k), -1, np.int64)
        active, step, width = np.arange(len(q)), 0, 1
        while active.size and step < len(self.leaves):
            turn = order[active, step:step + width]
            # The test comes before each leaf: distance^2 of the k-th best is norm^2 + |q|^2 - 2 * score.
            far = self.norm**2 + norms[active] - 2 * top[active, -1]
            # Points that look equally far are still to come: they may have smaller ids.
            wanted = np.take_along_axis(reach[active], turn, axis=1) <= quantile * (far[:, None] + NEAR * self.norm**2)
            active, turn, wanted = (x[wanted.any(axis=1)] for x in (active, turn, wanted))
            pairs = np.argwhere(wanted)
            leaf_of = turn[wanted]
            for leaf in np.unique(leaf_of):
                who = active[pairs[leaf_of == leaf, 0]]
                self._merge(q, q_ids, c_ids, who, self.leaves[leaf], top, where)
            step += width
            width = min(8, width * 2)
        real = top > -np.inf
        return np.nonzero(real)[0], where[real], top[real]


    def _merge(self, q, q_ids, c_ids, who: np.ndarray, rows: np.ndarray, top: np.ndarray, where: np.ndarray) -> None:
        """Takes a leaf's points into the best of the queries ``who``: by exact score, ties to the smaller position (that is, id)."""
        k = top.shape[1]
        scores = q[who] @ self.c[rows].T
        scores[q_ids[who][:, None] == c_ids[rows][None]] = -np.inf
        # The fast product only proposes: what may belong to the best is measured again, always in the order of the components.
        both = np.concatenate([top[who], scores], axis=1)
        cut = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k]
        at, column = np.nonzero(scores >= (cut - NEAR * self.norm**2)[:, None])
        at, column = at[scores[at, column] > -np.inf], column[scores[at, column] > -np.inf]
        old, slot = np.nonzero(where[who] >= 0)
        row = np.r_[old, at]
        place = np.r_[where[who][old, slot], rows[column]]
        score = np.r_[top[who][old, slot], exact_products(q, who[at], self.c, rows[column])]
        order = np.lexsort((place, -score, row))
        row, place, score = row[order], place[order], score[order]
        rank = np.arange(row.size) - np.searchsorted(row, row)
        keep = rank < k
        top[who[row[keep]], rank[keep]], where[who[row[keep]], rank[keep]] = score[keep], place[keep]


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20, shard_rows: int = SHARD_ROWS, sure: float = SURE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the nearest found by inner product in double precision, nearest first, ties to smaller vec_id.

    Queries are the rows with vec_id divisible by ``every``. Vectors that are null, empty, zero or hold null or non-finite components
    take no part; vectors of another length than the query's are not its candidates. With at most ``k`` candidates all are returned. A
    repeated row is a candidate as often as it occurs; a repeated query id is one query. No usable vectors give no rows.
    """
    vectors = usable(embeddings, nonzero=True)
    most = vectors.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0] or 1.0

    def search(q_ids, q, c_ids, c):
        # By id, rows without one last: equal scores then go by position.
        order = np.argsort(np.where(c_ids == NO_ID, np.iinfo(np.int64).max, c_ids), kind="stable")
        at, where, score = Projected(c[order], most).search(q, q_ids, c_ids[order], k, sure)
        return at, order[where], score

    return best_of_shards(vectors, every, k, shard_rows, "double", search)


def exact_products(q: np.ndarray, at: np.ndarray, c: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Inner products summed in component order, so that a pair's score does not depend on the block it was found in."""
    total = np.zeros(at.size)
    for k in range(q.shape[1]):
        total += q[at, k] * c[where, k]
    return total
