"""Absence and age per key against their definitions, over many blocks."""

import random

import pytest
from pyspark.sql import functions as F

from hopledger.operators.alerting import Alerting
from hopledger.operators.series import MICROS, Grid, absent_series, age_of_newest

STEP, LOOK = 60, 150
GRID = Grid(step=STEP, range=120, lookback=LOOK, start=600, end=12_000, blocks=3)
TICKS = [t for t in range(600, 12_001, STEP)]


def feed(spark, points):
    rows = [(m, n, float(at), 1.0) for (m, n), ats in points.items() for at in ats]
    return spark.createDataFrame(rows, "metric string, instance string, at double, value double").select(
        "metric", "instance", (F.timestamp_micros((F.col("at") * 1_000_000).cast("bigint"))).alias("ts"), "value")


@pytest.fixture(scope="module")
def points():
    draw = random.Random(9)
    return {
        ("in", "a"): [draw.uniform(0, 13_000) for _ in range(60)],
        ("in", "b"): [x / 2 for x in range(1200, 26_000)],  # never silent
        ("in", "c"): [30.0],  # before the grid, and then no more
        ("out", "a"): [5400.0, 5400.0, 11_999.5, 12_001.0],
        ("out", "d"): [600.0, 600.0 + LOOK + STEP, 13_000.0],
    }


def test_absent_series(spark, points):
    want = {(*k, t) for k, ats in points.items() for t in TICKS if not any(t - LOOK < at <= t for at in ats)}
    rows = absent_series(feed(spark, points), ["metric", "instance"], GRID).collect()
    assert len(rows) == len(want) and {(r.metric, r.instance, r.t // MICROS) for r in rows} == want
    assert not [r for r in rows if r.instance == "b"]


def test_expected_keys_without_samples(spark, points):
    expected = spark.createDataFrame([("a",), ("z",), ("z",)], "instance string")
    rows = absent_series(feed(spark, points), ["instance"], GRID, expected).collect()
    ats = points["in", "a"] + points["out", "a"]
    want = {("z", t) for t in TICKS} | {("a", t) for t in TICKS if not any(t - LOOK < at <= t for at in ats)}
    assert len(rows) == len(want) and {(r.instance, r.t // MICROS) for r in rows} == want


def test_whole_feed(spark, points):
    some = {k: v for k, v in points.items() if k[1] in "acd"}
    ats = [x for v in some.values() for x in v]
    want = [t for t in TICKS if not any(t - LOOK < at <= t for at in ats)]
    assert sorted(r.t // MICROS for r in absent_series(feed(spark, some), [], GRID).collect()) == want
    none = feed(spark, points).limit(0)
    assert sorted(r.t // MICROS for r in absent_series(none, [], GRID).collect()) == TICKS
    assert absent_series(none, ["instance"], GRID).count() == 0 == age_of_newest(none, ["instance"], GRID).count()


def test_age(spark, points):
    for keys in (["metric", "instance"], []):
        groups = points if keys else {(): [x for v in points.values() for x in v]}
        want = {(*k, t): t - max(a for a in ats if a <= t) for k, ats in groups.items() for t in TICKS if min(ats) <= t}
        got = {(*[r[c] for c in keys], r.t // MICROS): r.value for r in age_of_newest(feed(spark, points), keys, GRID).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_both_ends_are_needed(spark, points):
    for make in (absent_series, age_of_newest):
        with pytest.raises(ValueError, match="both ends"):
            make(feed(spark, points), ["instance"], Grid(step=60))


def test_alerts_per_device(spark, points):
    rows = feed(spark, points).withColumns({"metric": F.lit("ifHCInOctets"), "if_index": F.lit(1), "if_name": F.lit("Te1"), "iface": F.col("instance")})
    alerting = Alerting(rows, spark.range(0).select(), GRID, per=["instance"], mapping_samples=rows)
    absent = alerting.alerts("counters_absent", 120)
    assert {r.instance for r in absent.filter("state = 'firing'").collect()} >= {"c", "d"}
    assert alerting.alerts("counters_stale").filter("value <= 300").count() == 0
    assert alerting.alerts("mapping_absent", 120).count() == absent.count()


def test_a_busy_key_is_spread_over_blocks(spark, points):
    """Samples are shuffled on (key, block) only, and what is shuffled by key alone are runs."""
    plan = absent_series(feed(spark, points), ["instance"], GRID)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(instance" in plan and "blk" in plan
    keyed = [line for line in plan.splitlines() if "Exchange hashpartitioning(instance" in line and "blk" not in line]
    assert keyed and all("REPARTITION" not in line for line in keyed)
