"""Hard-negative mining by tiles of anchors and candidates.

Anchors are dealt to blocks and rows to shards; a task meets one block with one shard and multiplies them tile by tile. Products are
recursive Strassen products of whole numbers modulo 2^64: padding with zeros makes every dimension even, and additions, subtractions and
products there are exact for every score that fits a long. Two passes share the dealt rows: the first keeps a heap of the best rows of the
anchor's label, the second a heap for each positive, of the rows inside the window that the positive's score opens. Heaps are arrays of
fixed width that merge: tiles within a task, then tasks by rank in Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopledger.llm.vectors import NO_ID, usable

BLOCK_ROWS, SHARD_ROWS, TILE_ROWS = 1024, 8192, 2048
# Below this size of any dimension the plain product is taken.
LEAF = 32
LONG = 2**63 - 1
# Windows of positives compared with a tile at once.
PLACES = 1024


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` over whole numbers: seven products of quarters in place of eight; odd dimensions get a row or column of zeros."""
    m, d, n = *a.shape, b.shape[1]
    if min(m, d, n) <= LEAF:
        return a @ b
    if (m | d | n) & 1:
        a = np.pad(a, ((0, m & 1), (0, d & 1)))
        b = np.pad(b, ((0, d & 1), (0, n & 1)))
    i, j, k = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :k], b[:j, k:], b[j:, :k], b[j:, k:]
    p1, p2 = strassen(a11 + a22, b11 + b22), strassen(a21 + a22, b11)
    p3, p4 = strassen(a11, b12 - b22), strassen(a22, b21 - b11)
    p5, p6, p7 = strassen(a11 + a12, b22), strassen(a21 - a11, b11 + b12), strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * i, 2 * k), p1.dtype)
    out[:i, :k], out[:i, k:] = p1 + p4 - p5 + p7, p3 + p5
    out[i:, :k], out[i:, k:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b``, held within a long where they do not fit one."""
    top = [max(-int(x.min(initial=0)), int(x.max(initial=0))) for x in (a, b)]
    if max(1, a.shape[1]) * top[0] * top[1] <= LONG:
        return strassen(a, np.ascontiguousarray(b.T))
    exact = strassen(a.astype(object), b.T.astype(object))
    return np.array([[max(-LONG - 1, min(LONG, v)) for v in row] for row in exact.tolist()], np.int64).reshape(exact.shape)


class Heaps:
    """The ``k`` best (score, id) of every row: higher scores first, ties to the smaller id, rows without id last."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.row, self.score, self.id = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.floor = np.full(rows, -LONG - 1)

    def merge(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Takes in the entries of another heap, or a tile's cells, given as three arrays."""
        row, score, ids = np.r_[self.row, row], np.r_[self.score, score], np.r_[self.id, ids]
        # The complement falls as scores rise and, unlike the negative, exists for every long.
        order = np.lexsort((np.where(ids == NO_ID, LONG, ids), ~score, row))
        row, score, ids = row[order], score[order], ids[order]
        first = np.searchsorted(row, row)
        keep = np.arange(row.size) - first < self.k
        self.row, self.score, self.id = row[keep], score[keep], ids[keep]
        last = np.flatnonzero(np.bincount(self.row, minlength=self.floor.size) == self.k)
        self.floor[last] = self.score[np.searchsorted(self.row, last, side="right") - 1]

    def take(self, scores: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """Takes in the fitting cells of a tile: only those that reach the row's worst kept score and the k-th best of the tile."""
        fits = fits & (scores >= self.floor[:, None])
        if scores.shape[1] > 4 * self.k:
            masked = np.where(fits, scores, -LONG - 1)
            cut = np.partition(masked, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            fits &= scores >= cut[:, None]
        row, at = np.nonzero(fits)
        self.merge(row, scores[row, at], ids[at])


def _matrix(rows: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows of each length with their vectors as one matrix."""
    sizes = np.array([], np.int64) if not rows.num_rows else np.diff(_lists(rows).offsets.to_numpy())
    for size in np.unique(sizes):
        part = rows.filter(pa.array(sizes == size))
        yield part, _lists(part).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, size)


def _lists(rows: pa.Table) -> pa.ListArray:
    lists = rows.column("x").combine_chunks()
    return lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists


def _numbers(rows: pa.Table, column: str) -> np.ndarray:
    return rows.column(column).fill_null(NO_ID).to_numpy().astype(np.int64)


def _tiles(left: pa.Table, right: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchors, anchor matrix, candidate ids, labels, matrix) of equal length, at most ``TILE_ROWS`` candidates at once."""
    for anchors, a in _matrix(left):
        for candidates, c in _matrix(right):
            if a.shape[1] == c.shape[1]:
                ids, labels = _numbers(candidates, "vec_id"), _numbers(candidates, "label")
                # By label, so that a tile of the first pass meets few labels.
                order = np.argsort(labels, kind="stable")
                for begin in range(0, order.size, TILE_ROWS):
                    part = order[begin:begin + TILE_ROWS]
                    yield anchors, a, ids[part], labels[part], c[part]


def _best_positives(k: int):
    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        heaps: dict[int, tuple[np.ndarray, Heaps]] = {}
        for anchors, a, ids, labels, c in _tiles(left, right):
            own, kind = _numbers(anchors, "vec_id"), _numbers(anchors, "label")
            _, heap = heaps.setdefault(a.shape[1], (own, Heaps(own.size, k)))
            for label in np.intersect1d(kind, labels):
                rows, columns = np.flatnonzero(kind == label), np.flatnonzero(labels == label)
                scores, part = products(a[rows], c[columns]), Heaps(rows.size, k)
                part.floor = heap.floor[rows]
                part.take(scores, ids[columns], own[rows][:, None] != ids[columns])
                heap.merge(rows[part.row], part.score, part.id)
        return _found([(own[h.row], h.id, h.score) for own, h in heaps.values()], ("anchor_id", "positive_id", "positive_score"))

    return task


def _best_negatives(k: int, low: tuple[int, int], high: tuple[int, int]):
    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        heaps: dict[int, tuple[np.ndarray, ...]] = {}
        for anchors, a, ids, labels, c in _tiles(left, right):
            own, kind = _numbers(anchors, "vec_id"), _numbers(anchors, "label")
            found = heaps.get(a.shape[1])
            if found is None:
                positives = anchors.column("positives").to_pylist()
                at = np.repeat(np.arange(own.size), [len(p) for p in positives])
                flat = [p for row in positives for p in row]
                who = np.array([NO_ID if p["positive_id"] is None else p["positive_id"] for p in flat], np.int64)
                score, place_of = (np.array([p[name] for p in flat], np.int64) for name in ("positive_score", "place"))
                # low * p <= 100 * s <= high * p over whole numbers: the ends of the window, rounded inwards.
                ends = [(-((-low[0] * s) // low[1]), high[0] * s // high[1]) for s in score.tolist()]
                found = heaps[a.shape[1]] = at, own, place_of, who, score, np.array(ends, np.int64).reshape(-1, 2), Heaps(at.size, k)
            at, *_, ends, heap = found
            scores = products(a, c)
            other = kind[:, None] != labels
            for place in np.split(np.arange(at.size), np.arange(PLACES, at.size, PLACES)):
                part, s = Heaps(place.size, k), scores[at[place]]
                part.floor = heap.floor[place]
                part.take(s, ids, other[at[place]] & (s >= ends[place, :1]) & (s <= ends[place, 1:]))
                heap.merge(place[part.row], part.score, part.id)
        return _found([(own[at[h.row]], place[h.row], who[h.row], score[h.row], h.id, h.score) for at, own, place, who, score, _, h in heaps.values()],
                      ("anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"))

    return task


def _found(parts: list[tuple[np.ndarray, ...]], names: tuple[str, ...]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * len(names)
    return pa.table({n: pa.array(c, pa.int64(), mask=(c == NO_ID) if n.endswith("_id") else None) for n, c in zip(names, columns, strict=True)})


def mine(
    embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    block_rows: int = BLOCK_ROWS, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), the hard negatives of each anchor and positive.

    Scores are inner products of floor(256 * x). Anchors are the rows with vec_id divisible by ``every``; an id that comes more than once is
    one anchor, with its least label and vector. An anchor's positives are its best ``positives`` rows of the same label, negatives the best
    ``negatives`` rows of another label with ``low`` to ``high`` percent of the positive's score; a positive without any gives no row. Rows of
    the anchor's own id are no candidates for it, nor are vectors of another length; rows without an id are candidates, last among ties;
    repeated rows are candidates, and positives with rows of their own, as often as they occur. Rows with a null label, a null or empty vector, or null or non-finite components
    take no part. Scores beyond a long are held at its ends. Extra columns do not matter; an empty table gives no rows.
    """
    whole = F.transform("v", lambda c: F.floor(256 * c)).alias("x")
    rows = usable(embeddings.filter("label IS NOT NULL"), keep=("label",)).select("vec_id", F.col("label").cast("long").alias("label"), whole)
    anchors = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("least")).select("vec_id", "least.*")
    n = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("vec_id") % every == 0).alias("asked")).first()
    shards, blocks = max(1, math.ceil(n.rows / shard_rows)), max(1, math.ceil(n.asked / block_rows))
    parts = min(shards * blocks, 1 << 14)
    spread = lambda top: F.explode(F.sequence(F.lit(0), F.lit(top - 1)))
    dealt = rows.select(
        "*", F.pmod(F.xxhash64("vec_id", "x"), F.lit(shards)).cast("int").alias("shard"), spread(blocks).alias("block")
    ).repartition(parts, "block", "shard").groupBy("block", "shard")

    def meet(asked: DataFrame, task, schema: str) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
        # Aliases: both sides come from the same rows.
        sent = asked.select(*(F.col(c).alias(c) for c in asked.columns), block, spread(shards).alias("shard")).repartition(parts, "block", "shard")
        return sent.groupBy("block", "shard").cogroup(dealt).applyInArrow(task, schema)

    def first(df: DataFrame, keys: tuple[str, ...], score: str, who: str, k: int) -> DataFrame:
        order = W.partitionBy(*keys).orderBy(F.desc(score), F.asc_nulls_last(who))
        return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    near = meet(anchors, _best_positives(positives), "anchor_id long, positive_id long, positive_score long")
    near = first(near, ("anchor_id",), "positive_score", "positive_id", positives)
    # At most ``positives`` per anchor are gathered.
    gathered = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.collect_list(F.struct(F.col("rank").alias("place"), "positive_id", "positive_score")).alias("positives"))
    found = meet(
        anchors.join(gathered, "vec_id"), _best_negatives(negatives, (low, 100), (high, 100)),
        "anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    ranked = first(found, ("anchor_id", "place"), "negative_score", "negative_id", negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
