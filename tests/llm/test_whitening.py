import numpy as np
import pytest
from pyspark.sql import functions as F

from hopledger.llm.whitening import leading_eigenpairs, whiten

ROWS = "vec_id long, embedding array<float>, label int"


def table(spark, vectors):
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors], ROWS).repartition(4)
    return df.select("*", F.lit(1).alias("x"), F.lit(2).alias("v"), F.lit("s").alias("size"), F.lit(0).alias("n"))


def brute(vectors, k=4):
    """Everything by definition, with the library's eigensolver; component -> sign free values by id."""
    x = np.array([[int(np.floor(256 * float(np.float32(c)))) for c in v] for _, v in vectors], object)
    distinct = sorted(set(map(tuple, x.tolist())))
    n, s = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    y = np.array([[(n * a - b) / n for a, b in zip(row, s, strict=True)] for row in distinct], float)
    values, vecs = np.linalg.eigh(y.T @ y / n)
    values, vecs = values[::-1][:k], vecs[:, ::-1][:, :k]
    all_y = np.array([[(n * a - b) / n for a, b in zip(row, s, strict=True)] for row in x.tolist()], float)
    deviation = [sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x.tolist()]
    return n, deviation, all_y @ vecs / np.sqrt(values), values / np.trace(y.T @ y / n)


@pytest.mark.parametrize("offset", [0.0, 30000.0, 3e9])
def test_matches_definition(spark, offset):
    draw = np.random.default_rng(5)
    m = draw.normal(size=(900, 12)) * np.linspace(3, 1, 12) * max(1.0, offset / 1000) + offset
    m[300:420] = m[0]  # copies count once in the fit
    vectors = [(i, v.tolist()) for i, v in enumerate(m)]
    n, deviation, expected, explained = brute(vectors)
    found = {}
    for r in whiten(table(spark, vectors)).collect():
        found.setdefault(r.component, {})[r.vec_id] = r
        assert r.n == n and r.identity_error <= 1e-9
        assert r.deviation == min(2**63 - 1, deviation[r.vec_id])
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
    assert sorted(found) == [1, 2, 3, 4]
    for c, rows in found.items():
        got = np.array([rows[i].whitened for i in range(900)])
        sign = np.sign(got[0] * expected[0, c - 1])
        assert np.abs(got * sign - expected[:, c - 1]).max() < 1e-7


def test_eigenpairs_of_many_shapes():
    draw = np.random.default_rng(2)
    q = np.linalg.qr(draw.normal(size=(40, 40)))[0]
    shapes = [np.r_[np.full(3, 5.0), np.linspace(4, 1, 37)], np.r_[9.0, 9.0 - 1e-9, 9.0 - 2e-9, np.ones(37)], np.ones(40),
              np.r_[1e12, 1.0, np.zeros(38)], np.linspace(1e-30, 1e-28, 40)]
    matrices = [q @ np.diag(s) @ q.T for s in shapes] + [np.diag([3.0, 1.0, 3.0, 2.0]), np.array([[2.0]]), np.zeros((3, 3)), np.diag([0.0, 7.0, 7.0])]
    matrices.append(np.kron(np.eye(2), matrices[0][:5, :5]))  # equal blocks: every eigenvalue comes twice
    for a in matrices:
        a = (a + a.T) / 2
        values, vectors = leading_eigenpairs(a, 4)
        size = max(np.abs(a).max(), 1e-300)
        k = min(4, len(a))
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1][:k]).max() <= 1e-13 * size * len(a)
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
        assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * size * len(a)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (2, [2.0, 1.0]), (None, [0.0, 5.0]), (3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]),
            (8, [1.0, 2.0, 3.0]), (9, [-0.0, 0.0, -0.001]), (10, [1e30, 1.0, 2.0, 3.0]), (11, [0.0, 1.0, 2.0, -1e30])]
    found = [(r.vec_id, r.component, r.n) for r in whiten(table(spark, rows)).collect()]
    assert sorted(found, key=str) == sorted(
        [(i, c, 3) for i in (1, 2, 2, None) for c in (1, 2)] + [(i, 1, 2) for i in (8, 9, 10, 11)], key=str)
    assert whiten(table(spark, rows).limit(0)).count() == 0
    same = [(i, [1.0, 2.0]) for i in range(5)]
    assert whiten(table(spark, same)).count() == 0
