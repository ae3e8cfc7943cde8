import numpy as np
import pytest
from pyspark.sql import functions as F

from hopledger.llm.exact_search import exact_top_k
from hopledger.llm.projected_search import chi_square_quantile, kd_leaves, nearest

ROWS = "vec_id long, embedding array<float>, label int"


def made(spark, n=3000, d=24, seed=1):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, d))
    m = (centres[draw.integers(0, 12, n)] + 0.7 * draw.normal(size=(n, d))).astype(np.float32)
    m[n // 2:n // 2 + 200] = m[0]  # a large group of equal vectors
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(m)], ROWS)
    return m.astype(float), df.select("*", F.lit(1).alias("v"), F.lit("x").alias("score"), F.lit(2).alias("shard"))


def test_exact_matches_brute_force(spark):
    m, df = made(spark)
    q = np.floor(256 * m).astype(np.int64)
    found = {}
    for r in exact_top_k(df, shard_rows=700).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for i in range(0, len(q), 50):
        s = q @ q[i]
        top = sorted((-s[j], j) for j in range(len(q)) if j != i)[:5]
        assert sorted(found[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(top)]


def test_exact_with_large_components(spark):
    rows = [(0, [1e30, 1.0]), (50, [3.0, -2.5e7]), (7, [2e7, 3e7]), (8, [-1e9, 4.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], ROWS)
    whole = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in rows}
    for r in exact_top_k(df).collect():
        true = sum(a * b for a, b in zip(whole[r.query_id], whole[r.vec_id], strict=True))
        assert r.score == max(-2**63, min(2**63 - 1, true))




def test_recall_by_id(spark):
    m, df = made(spark, 9000)
    found = {}
    for r in nearest(df, shard_rows=3000).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for i in range(0, len(m), 20):
        s = np.zeros(len(m))
        for d in range(m.shape[1]):
            s += m[i, d] * m[:, d]
        s[i] = -np.inf
        rows = sorted(found[i])
        assert [k for k, _, _ in rows] == list(range(1, 21))
        assert all(score == s[j] for _, j, score in rows)
        assert [(-score, j) for _, j, score in rows] == sorted((-score, j) for _, j, score in rows)
        hits += len(set(np.lexsort((np.arange(len(m)), -s))[:20].tolist()) & {j for _, j, _ in rows})
    assert hits / (20 * len(found)) >= 0.9


def test_ties_go_to_smaller_ids(spark):
    """300 equal best vectors over several shards and leaves: the 20 smallest ids, for a query among them too."""
    draw = np.random.default_rng(3)
    m = draw.normal(size=(4000, 16))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m = m.astype(np.float32)
    m[501:801] = m[0]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(m)], ROWS).repartition(5)
    for rows in (8192, 900):
        found = {}
        for r in nearest(df, shard_rows=rows).collect():
            found.setdefault(r.query_id, {})[r.rank] = r.vec_id
        assert [found[0][k] for k in range(1, 21)] == list(range(501, 521))
        assert [found[520][k] for k in range(1, 21)] == [0, *range(501, 520)]
        assert [found[780][k] for k in range(1, 21)] == [0, *range(501, 520)]


@pytest.mark.parametrize(("search", "every", "k"), [(exact_top_k, 50, 5), (nearest, 20, 20)])
def test_odd_rows(spark, search, every, k):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (every, [0.5, 0.5]), (every, [0.5, 0.5]), (1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]),
            (6, [1.0, 2.0, 3.0]), (None, [9.0, 9.0]), (8, [1.0, 1.0]), (9, [1.0, 1.0]), (9, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], ROWS)
    found = [(r.query_id, r.rank, r.vec_id) for r in search(df).collect()]
    assert sorted(r for r in found if r[0] == 0) == [(0, 1, None), (0, 2, 8), (0, 3, 9), (0, 4, 9), (0, 5, every), *([(0, 6, every)] if k > 5 else [])]
    assert {r[0] for r in found} == {0, every}
    assert search(df.limit(0)).count() == 0


def test_quantile_and_leaves():
    assert abs(chi_square_quantile(0.95, 8) - 15.507) < 1e-3 and abs(chi_square_quantile(0.5, 2) - 1.3863) < 1e-3
    points = np.random.default_rng(0).normal(size=(1000, 3))
    leaves = kd_leaves(points, 64)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(1000)) and max(map(len, leaves)) <= 64
    assert sorted(np.concatenate(kd_leaves(np.zeros((500, 3)), 64)).tolist()) == list(range(500))
