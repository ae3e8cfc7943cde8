import numpy as np
import pytest
from pyspark.sql import functions as F

from hopledger.llm.hard_negatives import Heaps, mine, products, strassen

ROWS = "vec_id long, embedding array<double>, label int"


def table(spark, rows):
    df = spark.createDataFrame(rows, ROWS).repartition(4)
    return df.select("*", *(F.lit(c).alias(c) for c in ("x", "v", "block", "shard", "rank", "positives", "least", "positive_id")))


def brute(rows, every=100, positives=5, negatives=10):
    """(anchor, positive, rank, negative, scores) by definition, over rows with unique ids."""
    whole = {i: ([int(np.floor(256 * x)) for x in v], label) for i, v, label in rows}
    score = lambda a, b: max(-2**63, min(2**63 - 1, sum(map(int.__mul__, whole[a][0], whole[b][0]))))
    out = set()
    for a in (i for i in whole if i % every == 0):
        scored = sorted((-score(a, b), b) for b in whole if b != a and len(whole[a][0]) == len(whole[b][0]))
        for p, who in [x for x in scored if whole[x[1]][1] == whole[a][1]][:positives]:
            fits = [x for x in scored if whole[x[1]][1] != whole[a][1] and 30 * -p <= 100 * -x[0] <= 90 * -p][:negatives]
            out |= {(a, who, k + 1, b, -p, -s) for k, (s, b) in enumerate(fits)}
    return out


def rows_of(df):
    return [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect()]


@pytest.mark.parametrize("shape", [(70, 64, 300), (33, 33, 33), (129, 7, 65), (1, 100, 100), (0, 40, 50), (97, 130, 101)])
def test_strassen_is_exact(shape):
    draw = np.random.default_rng(3)
    for top in (5, 2**31, 2**62):  # beyond a long both wrap alike
        a, b = draw.integers(-top, top, shape[:2]), draw.integers(-top, top, shape[1:])
        assert (strassen(a, b) == a @ b).all()


def test_products_are_held_within_a_long():
    a, b = np.array([[2**62, 2**62], [-2**62, 1]]), np.array([[3, 1], [2**62, 0]])
    assert products(a, b).tolist() == [[2**63 - 1, 2**63 - 1], [1 - 3 * 2**62 if 3 * 2**62 < 2**63 else -2**63, -2**63]]


def test_heaps_merge_in_any_order():
    draw = np.random.default_rng(8)
    scores, ids = draw.integers(-3, 3, (6, 400)), draw.permutation(400)
    expected = [sorted((-s, i) for s, i in zip(row.tolist(), ids.tolist(), strict=True) if s != 2)[:7] for row in scores]
    for cuts in ([0, 400], [0, 3, 10, 200, 400], range(0, 401, 40)):
        whole, tiles = Heaps(6, 7), list(zip(cuts, list(cuts)[1:], strict=False))
        for a, b in draw.permutation(tiles).tolist():
            part = Heaps(6, 7)
            part.take(scores[:, a:b], ids[a:b], scores[:, a:b] != 2)
            whole.merge(part.row, part.score, part.id)
        found = [[(-s, i) for s, i in zip(whole.score[whole.row == r].tolist(), whole.id[whole.row == r].tolist(), strict=True)] for r in range(6)]
        assert found == expected


def test_matches_brute_force(spark):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(6, 20))
    label = np.where(draw.random(2500) < 0.35, 0, draw.integers(0, 6, 2500))
    m = centres[label] + 1.2 * draw.normal(size=(2500, 20))
    m[1000:1300] = m[0]  # equal vectors, so ties by id, over several labels
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(m, label, strict=True))]
    found = rows_of(mine(table(spark, rows), block_rows=10, shard_rows=600))
    assert len(found) == len(set(found)) and set(found) == brute(rows) and len(found) > 500


def test_large_components_and_lengths(spark):
    rows = [(0, [3e7, 2e7], 1), (1, [2e7, 3e7], 1), (2, [1e7, 1e7], 2), (3, [1e7, 2e6], 3), (4, [9.0], 1), (100, [5.0, 5.0], 1), (200, [-1.0, 0.5], 2)]
    assert set(rows_of(mine(table(spark, rows)))) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (1, [2.0, 2.0], 1), (1, [2.0, 2.0], 1), (2, [1.0, 1.0], 2), (2, [1.0, 1.0], 2), (None, [1.0, 1.0], 3),
            (3, None, 1), (4, [], 1), (5, [nan, 1.0], 2), (6, [inf, 1.0], 2), (7, [1.0, None], 2), (8, [1.0, 1.0], None), (9, [1.0, 1.0, 1.0], 2)]
    one, two = 256 * 256 * 2, 256 * 512 * 2
    ranked = [(1, 2), (2, 2), (3, None)]
    assert sorted(rows_of(mine(table(spark, rows))), key=str) == sorted([(0, 1, k, n, two, one) for k, n in ranked for _ in range(2)], key=str)
    assert mine(table(spark, rows).limit(0)).count() == 0
    # No window where the best positive scores below zero, and none without another label.
    assert rows_of(mine(table(spark, [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.5], 2)]))) == []
    assert rows_of(mine(table(spark, [(0, [1.0], 1), (1, [1.0], 1)]))) == []
