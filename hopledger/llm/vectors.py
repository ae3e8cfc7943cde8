"""Query blocks meet candidate shards: the part that both vector searches share.

Vectors are dealt to shards of about ``shard_rows`` and queries to blocks of about ``block_rows``; a task sees one shard and one block, so its
memory is bounded by the two and not by the table. Each task returns the best of its shard, and a window ranks them per query.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
_FOUND = "query_id long, vec_id long, score {kind}"


def usable(embeddings: DataFrame, nonzero: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(vec_id, v, *keep) of vectors without null or non-finite components; null and empty vectors and, if asked, zero vectors are left out."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), *keep)
    rows = rows.filter(v.isNotNull() & (F.size(v) > 0) & finite)
    return rows.filter(F.exists(v, lambda x: x != 0)) if nonzero else rows


def best_of_shards(
    vectors: DataFrame, every: int, k: int, shard_rows: int, kind: str,
    search: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]],
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest scores of each query, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``; an id that comes more than once is one query, with its least vector.
    Candidates are all rows with another vec_id (null ids included) and a vector of the query's length. ``search`` gets
    (query ids, queries, candidate ids, candidates) and returns (query position, candidate position, score) of each query's best of the shard.
    """
    queries = vectors.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n = vectors.agg(F.count("*").alias("rows")).first().rows
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(n / every / BLOCK_ROWS))
    each = lambda top: F.explode(F.sequence(F.lit(0), F.lit(top - 1)))
    parts = shards * blocks
    dealt = vectors.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), each(blocks).alias("block"))
    asked = queries.select("vec_id", "v", each(shards).alias("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    dealt, asked = (d.repartition(parts, "block", "shard") for d in (dealt, asked))
    arrow_kind = pa.float64() if kind == "double" else pa.int64()

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        for q_ids, q in _by_length(left):
            for c_ids, c in _by_length(right):
                if q.shape[1] == c.shape[1]:
                    qi, ci, score = search(q_ids, q, c_ids, c)
                    for into, values in zip(found, (q_ids[qi], ci, score), strict=True):
                        into.append(values)
                    # Candidates may have no id: positions become ids, null where there is none.
                    found[1][-1] = np.where(c_ids[ci] == NO_ID, NO_ID, c_ids[ci])
        ids = np.concatenate(found[1])
        score = np.concatenate([f for f in found[2] if f.size] or [np.empty(0)])
        return pa.table({"query_id": pa.array(np.concatenate(found[0]), pa.int64()), "vec_id": pa.array(ids, pa.int64(), mask=ids == NO_ID),
                         "score": pa.array(score.tolist() if kind == "long" else score, arrow_kind)})

    met = asked.groupBy("block", "shard").cogroup(dealt.groupBy("block", "shard")).applyInArrow(task, _FOUND.format(kind=kind))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


NO_ID = np.iinfo(np.int64).min


def _by_length(rows: pa.Table):
    """(ids, matrix) of the vectors of each length."""
    if not rows.num_rows:
        return
    lists = rows.column("v").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    ids = rows.column("vec_id").fill_null(NO_ID).to_numpy()
    sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
    begin = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        which = np.flatnonzero(sizes == size)
        yield ids[which], flat[begin[which][:, None] + np.arange(size)]


def leading(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to the smaller id (rows without id last)."""
    last = np.where(ids == NO_ID, np.iinfo(np.int64).max, ids)
    if scores.size > 4 * k:
        cut = np.partition(scores, scores.size - k)[scores.size - k]
        near = np.flatnonzero(scores >= cut)
        return near[np.lexsort((last[near], -scores[near]))[:k]]
    return np.lexsort((last, -scores))[:k]
