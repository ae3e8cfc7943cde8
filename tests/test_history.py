import random

import pytest
from pyspark.sql import functions as F

from hopledger.operators import history as h
from hopledger.operators.scan import KeyedScan
from hopledger.schemas import HISTORY_EVENT


def sequential(events):
    """The loader's way, one event after the other."""
    out = {}
    for app, kind, at, _ in events:
        rows = out.setdefault(app, [])
        prev = max((b if b is not None else a for a, b in rows), default=None)
        if kind == "reload":
            eff = at if prev is None or at > prev else prev + 1
        elif rows and rows[-1][1] is None:
            eff = at if at > rows[-1][0] else rows[-1][0] + 1
        else:
            continue
        if rows and rows[-1][1] is None:
            rows[-1] = (rows[-1][0], eff)
        if kind == "reload":
            rows.append((eff, None))
    return {app: rows for app, rows in out.items() if rows}


def intervals(df):
    out = {}
    for r in df.orderBy("app_key", "valid_from").collect():
        out.setdefault(r.app_key, []).append((r.valid_from, r.valid_to))
    return out


@pytest.mark.parametrize("events, want", [
    ([("reload", 50), ("reload", 50)], [(50, 51), (51, None)]),
    ([("reload", 1700001000), ("close", 1700000500)], [(1700001000, 1700001001)]),
    ([("reload", 1700001000), ("close", 1700002000), ("reload", 1700000000)], [(1700001000, 1700002000), (1700002001, None)]),
    ([("close", 5), ("reload", 7), ("close", 9), ("close", 99), ("reload", 8)], [(7, 9), (10, None)]),
])
def test_stated_cases(spark, events, want):
    rows = [("a", kind, at, n) for n, (kind, at) in enumerate(events)]
    assert intervals(h.revisions(spark.createDataFrame(rows, HISTORY_EVENT))) == {"a": want}


@pytest.mark.parametrize("block_rows", [4_000_000, 40])
def test_against_sequential_model(spark, block_rows):
    rng = random.Random(11)
    # one app holds a third of the events
    apps = ["hot"] * 50 + [f"app{k}" for k in range(100)]
    rows = [(rng.choice(apps), rng.choice(["reload", "reload", "close"]), rng.randrange(1, 400), n) for n in range(3000)]
    frame = spark.createDataFrame(rows, HISTORY_EVENT).repartition(5)
    scan = h.effective_events(frame, block_rows)
    assert scan.cut == (block_rows == 40)
    got = intervals(h.revisions(frame, block_rows))
    assert got == sequential(rows)
    for revisions in got.values():
        assert all(a < (b or a + 1) for a, b in revisions)
        assert sum(b is None for _, b in revisions) <= 1
        assert all(x[1] <= y[0] for x, y in zip(revisions, revisions[1:]))


def test_blocks_are_bounded_and_equal_to_plain_windows(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(30)}", n, rng.randrange(1000)) for n in range(8000)]
    frame = spark.createDataFrame(rows, "k string, ord bigint, v bigint")

    def run(block_rows):
        scan = KeyedScan(frame, ["k"], "ord", block_rows).row_number("rn").running("s", F.col("v"), "sum")
        return scan.running("m", F.col("v") - F.col("rn"), "max").previous("p", F.col("v")).following("f", F.col("v"))

    plain, cut = run(10**9), run(500)
    assert cut.cut and not plain.cut
    assert cut._frame.groupBy("k", "_block").count().agg(F.max("count")).first()[0] <= 600
    assert plain.df.exceptAll(cut.df).count() == 0 and cut.df.count() == 8000


def test_unchanged_reloads_can_be_dropped(spark):
    rows = [("a", "reload", 1, 1, "x"), ("a", "reload", 2, 2, "x"), ("a", "reload", 3, 3, "y"), ("a", "close", 4, 4, None),
            ("a", "reload", 5, 5, "y"), ("a", "reload", 6, 6, "y"), ("b", "reload", 1, 7, "x")]
    frame = spark.createDataFrame(rows, "app_key string, kind string, at_s bigint, ord bigint, digest string")
    assert sorted(r.ord for r in h.drop_unchanged(frame, "digest").collect()) == [1, 3, 4, 5, 7]


def test_reconcile_closes_only_missing_apps(spark):
    edges = spark.createDataFrame(
        [("payments", 100, None, "declared"), ("ledger", 100, None, "declared"), ("ledger", 50, 100, "declared"),
         ("late", 900, None, "declared"), ("seen", 1, None, "observed")],
        "app_phash string, valid_from bigint, valid_to bigint, provenance string")
    assert {r[0] for r in h.open_declared_apps(edges).collect()} == {"payments", "ledger", "late"}
    closes = h.retractions(edges, spark.createDataFrame([("payments",)], "app_phash string"), 500)
    got = {(r.app_phash, r.valid_from): r.valid_to for r in h.close_validity(edges, closes).collect()}
    assert got == {("payments", 100): None, ("ledger", 100): 500, ("ledger", 50): 100, ("late", 900): 901, ("seen", 1): None}


def test_reconcile_gate():
    assert h.should_reconcile(False, False, 1, False) and h.should_reconcile(False, False, 0, True)
    assert not h.should_reconcile(True, False, 1, True)
    assert not h.should_reconcile(False, True, 1, True)
    assert not h.should_reconcile(False, False, 0, False)


def test_keyed_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(map(tuple, h.keyed_upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
