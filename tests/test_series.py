import random

import pytest
from pyspark.sql import functions as F

from hopledger.operators import series as s
from hopledger.operators.alerting import Alerting, alerts_as_samples, hold
from hopledger.operators.health import BY_IFACE, PathHealth, interface_ticks
from hopledger.schemas import MAPPING

AT = 300
GRID = s.Grid(step=60, range=300, lookback=300, start=AT, end=AT)
COLUMNS = "metric string, sec double, value double, instance string, if_index bigint, if_name string, iface string, alertname string, alertstate string"


def samples(spark, *rows):
    """(metric, interface number, [(second, value)], alert name)."""
    full = [(m, float(sec), float(v), "10.0.0.1", i, f"Te{i}", f"10.0.0.1:{i}", alert, "firing" if alert else "")
            for m, i, points, alert in rows for sec, v in points]
    return spark.createDataFrame(full, COLUMNS).withColumn("ts", F.timestamp_micros((F.col("sec") * 1e6).cast("bigint"))).drop("sec")


def ramp(start, step, n=6):
    return [(60 * k, start + step * k) for k in range(n + 1)]


def mapping(spark, *rows):
    """(app, interface number, direction)."""
    return spark.createDataFrame([(a, f"{a}-api", "rtr", f"Te{i}", "10.0.0.1", i, f"10.0.0.1:{i}", d) for a, i, d in rows], MAPPING)


def values(df):
    return sorted(round(r.value, 4) for r in df.filter(F.col("t") == AT * s.MICROS).collect())


def health(spark, points, maps, keys=None):
    return PathHealth(samples(spark, *points), mapping(spark, *maps), GRID, keys)


def octets(metric, number, rate):
    return (metric, number, ramp(0, rate * 60), "")


@pytest.mark.parametrize("keys", [None, BY_IFACE])
def test_egress_rate_fans_out(spark, keys):
    out = ("ifHCOutOctets", 1, ramp(0, 1000), "")
    assert values(health(spark, [out], [("a", 1, "egress")], keys).series("if_egress_octets_rate")) == [16.6667]
    assert values(health(spark, [out], [("a", 2, "egress"), ("a", 1, "ingress")], keys).series("if_egress_octets_rate")) == []
    row = health(spark, [out], [("a", 1, "egress"), ("b", 1, "egress")], keys).series("if_egress_octets_rate").collect()
    assert sorted(r.app for r in row) == ["a", "b"] and row[0].direction == "egress"


def test_capacity_per_direction_and_util(spark):
    speed = ("ifHighSpeed", 1, [(300, 10000)], "")
    both = [("a", 1, "egress"), ("a", 1, "ingress")]
    assert values(health(spark, [speed], both).series("if_capacity_bps")) == [1e10, 1e10]
    assert values(health(spark, [("ifHighSpeed", 1, [(300, 0)], "")], both).series("if_capacity_bps")) == []
    assert values(health(spark, [octets("ifHCOutOctets", 1, 1000)], both).series("if_util")) == []
    busy = [octets("ifHCOutOctets", 1, 1000), octets("ifHCInOctets", 1, 2000), ("ifHighSpeed", 1, [(300, 0.016)], "")]
    h = health(spark, busy, both)
    assert values(h.series("if_util")) == [0.5, 1.0] and values(h.series("path_util_max")) == [1.0]
    assert values(h.path_rollups().withColumnRenamed("path_util_max", "value")) == [1.0]
    # the rules as written: both series fanned out, then divided on all labels
    labels = ["app", "service", "device", "if_name", "instance", "if_index", "iface", "direction"]
    rate = s.scaled(h.series("if_egress_octets_rate"), 8)
    assert values(s.ratio(rate, h.series("if_capacity_bps"), labels)) == [0.5]


def test_hops_down_are_explicit(spark):
    maps = [("a", 1, "egress"), ("a", 1, "ingress"), ("a", 2, "egress")]
    down = health(spark, [("ifOperStatus", 1, [(300, 2)], ""), ("ifOperStatus", 2, [(300, 1)], "")], maps)
    assert values(down.series("if_oper_up")) == [0.0, 1.0]
    assert values(down.series("path_hops_down")) == [1.0] and values(down.series("path_oper_up_min")) == [0.0]
    healthy = health(spark, [("ifOperStatus", 1, [(300, 1)], ""), ("ifOperStatus", 2, [(300, 1)], "")], maps)
    assert values(healthy.series("path_hops_down")) == [0.0]


def test_errors_count_once_and_one_sided(spark):
    maps = [("payments", 1, "egress"), ("payments", 1, "ingress"), ("ledger", 2, "egress")]
    points = [octets("ifInErrors", 1, 1), octets("ifOutErrors", 1, 2), octets("ifInErrors", 2, 5)]
    h = health(spark, points, maps)
    assert values(h.series("if_in_errors_rate")) == [1.0, 5.0]
    assert {r.app: round(r.value, 4) for r in h.series("path_errors_rate").collect()} == {"payments": 3.0, "ledger": 5.0}
    two_sided = h.sum_of_sides("if_in_errors_rate", "if_out_errors_rate")
    assert {r.app: round(r.value, 4) for r in two_sided.collect()} == {"payments": 3.0, "ledger": 5.0}


def test_alerts_are_counted_before_the_fan_out(spark):
    firing = [("ALERTS", 1, [(300, 1)], "A"), ("ALERTS", 1, [(300, 1)], "B")]
    h = health(spark, firing, [("a", 1, "egress"), ("a", 1, "ingress"), ("b", 1, "egress")])
    assert values(h.series("if_alerts_firing")) == [2.0, 2.0] and values(h.series("path_alerts_firing")) == [2.0, 2.0]


def test_copies_and_conflicts(spark):
    rows = samples(spark, octets("ifHCInOctets", 1, 10), octets("ifHCInOctets", 2, 10))
    copied = rows.unionAll(rows.filter("if_index = 1"))
    keys = ["instance", "if_index", "if_name", "iface"]
    assert values(s.counter_rate(copied, keys, GRID)) == [10.0, 10.0]
    # two series under one join key: neither value may be used
    same_name = rows.withColumn("if_name", F.lit("Te1"))
    one = s.counter_rate(same_name, keys, GRID)
    assert s.fan_out(one, mapping(spark, ("a", 1, "egress")), ["instance", "if_name"]).count() == 0
    assert [r.copies for r in s.fan_out_conflicts(one, ["instance", "if_name"]).collect()] == [2]
    assert interface_ticks(same_name, ["in_octets"], ["instance", "if_name"], GRID).filter("in_octets is not null").count() == 0


def reference_rate(points, t, span):
    """The rate formula on the samples of (t - span, t]."""
    inside = [(a, v) for a, v in points if t - span < a <= t]
    if len(inside) < 2:
        return None
    increase = inside[-1][1] - inside[0][1] + sum(a[1] for a, b in zip(inside, inside[1:]) if b[1] < a[1])
    interval = inside[-1][0] - inside[0][0]
    gap = interval / (len(inside) - 1)
    start, end = inside[0][0] - (t - span), t - inside[-1][0]
    if start >= 1.1 * gap:
        start = gap / 2
    if increase > 0 and inside[0][1] >= 0:
        start = min(start, interval * inside[0][1] / increase)
    if end >= 1.1 * gap:
        end = gap / 2
    return increase * (interval + start + end) / interval / span


@pytest.mark.parametrize("blocks", [1, 3])
def test_rates_and_instants_against_brute_force(spark, blocks):
    rng = random.Random(7)
    history = {}
    for i in range(4):
        at, value, points = rng.randrange(50), 0, []
        while at < 4000:
            value = 0 if rng.random() < 0.1 else value + rng.randrange(100)
            points.append((at, value))
            at += rng.choice([5, 15, 30, 30, 30, 400])
        history[i] = points
    frame = samples(spark, *[("c", i, p, "") for i, p in history.items()])
    grid = s.Grid(step=20, range=110, lookback=70, start=100, end=3900, blocks=blocks)
    keys = ["if_index"]
    got = {(r.if_index, r.t // s.MICROS): r.value for r in s.counter_rate(frame, keys, grid).collect()}
    ticks = range(100, 3901, 20)
    want = {(i, t): v for i, p in history.items() for t in ticks if (v := reference_rate(p, t, 110)) is not None}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    last = {(r.if_index, r.t // s.MICROS): (r.sample_us // s.MICROS, r.value) for r in s.instant_vector(frame, keys, grid).collect()}
    assert last == {(i, t): max(q) for i, p in history.items() for t in ticks if (q := [x for x in p if t - 70 < x[0] <= t])}
    spans = {(r.if_index, r.t // s.MICROS): [x.value for x in r.points] for r in s.range_vector(frame, keys, grid).collect()}
    assert spans == {(i, t): [float(x[1]) for x in q] for i, p in history.items() for t in ticks if (q := [x for x in p if t - 110 < x[0] <= t])}


def test_one_shuffle_of_samples(spark):
    frame = samples(spark, octets("ifHCOutOctets", 1, 1), octets("ifHCInOctets", 1, 1), ("ifHighSpeed", 1, [(300, 1)], ""))
    plan = interface_ticks(frame, ["out_octets", "in_octets", "speed"], ["instance", "if_name"], GRID)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange ") == 1


def alerting(spark, points, maps, start=0, end=600, **more):
    grid = s.Grid(step=60, range=300, lookback=300, start=start, end=end)
    return Alerting(samples(spark, *points), mapping(spark, *maps), grid, **more)


def ticks_of(df):
    return [r.t // (60 * s.MICROS) for r in df.orderBy("t").collect()]


def test_absence_stale_and_drift(spark):
    maps = [("a", 1, "egress"), ("a", 2, "egress")]
    here = alerting(spark, [("ifHCInOctets", 1, [(0, 1), (60, 2)], "")], maps)
    assert ticks_of(here.counters_absent()) == [6, 7, 8, 9, 10]
    assert ticks_of(here.counters_stale()) == [7, 8, 9, 10]
    assert {r.value for r in here.mapping_drift().filter("t <= 300000000").collect()} == {1.0}
    assert {r.value for r in here.mapping_drift().filter("t > 300000000").collect()} == {2.0}
    aligned = alerting(spark, [("ifHCInOctets", 1, [(600, 1)], ""), ("ifHCInOctets", 2, [(600, 1)], "")], maps, start=600)
    assert aligned.mapping_drift().count() == 0 and aligned.counters_absent().count() == 0
    assert aligned.mapping_absent().count() == 0 and alerting(spark, [("x", 1, [(0, 1)], "")], []).mapping_absent().count() == 11
    nothing = alerting(spark, [("ifOperStatus", 1, [(0, 1)], "")], maps)
    assert len(ticks_of(nothing.counters_absent())) == 11 and nothing.counters_stale().count() == 0


def test_hold(spark):
    active = spark.createDataFrame([("x", t * 60 * s.MICROS, 1.0) for t in (0, 1, 2, 4, 5, 6, 7)] + [("y", 60 * s.MICROS, 1.0)],
                                   "l string, t bigint, value double")
    got = {(r.l, r.t // (60 * s.MICROS)): r.state for r in hold(active, ["l"], 60, 120).collect()}
    assert got == {("x", 0): "pending", ("x", 1): "pending", ("x", 2): "firing", ("x", 4): "pending", ("x", 5): "pending",
                   ("x", 6): "firing", ("x", 7): "firing", ("y", 1): "pending"}


def test_interface_down_feeds_the_alert_series(spark):
    maps = [("a", 1, "egress")]
    down = alerting(spark, [("ifOperStatus", 1, [(60 * k, 2) for k in range(11)], "")], maps)
    rows = down.alerts("interface_down")
    first = rows.orderBy("t").first()
    assert (first.alertname, first.severity, first.state, first.summary) == ("InterfaceDown", "page", "pending", "10.0.0.1 Te1 is down")
    fed = PathHealth(alerts_as_samples(rows), mapping(spark, *maps), GRID)
    assert values(fed.series("path_alerts_firing")) == [1.0]


def test_utilization_alert_renders_a_percentage(spark):
    points = [octets("ifHCOutOctets", 1, 1900), ("ifHighSpeed", 1, [(60 * k, 0.016) for k in range(11)], "")]
    row = alerting(spark, points, [("a", 1, "egress")], start=300, end=300).alerts("path_utilization_high").first()
    assert row.summary == "a has a hop that is 95% full"


def test_feed_down(spark):
    feeds = spark.createDataFrame([("up", "mapping", "x", 0.0), ("up", "other", "y", 0.0), ("up", "mapping", "z", 1.0)],
                                  "metric string, job string, instance string, value double").withColumn("ts", F.timestamp_seconds(F.lit(300)))
    rows = alerting(spark, [("x", 1, [(0, 1)], "")], [], start=300, end=300, feeds=feeds).alerts("mapping_feed_down").collect()
    assert [(r.instance, r.summary) for r in rows] == [("x", "the mapping feed mapping is down")]


def test_scans_are_pruned(spark, tmp_path):
    path = str(tmp_path / "samples")
    samples(spark, octets("ifHCOutOctets", 1, 1), octets("ifOperStatus", 1, 1)).write.partitionBy("metric").parquet(path)
    h = PathHealth(spark.read.parquet(path), mapping(spark, ("a", 1, "egress")), GRID)
    text = h.series("if_egress_octets_rate")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(metric" in text and "GreaterThan(ts" in text
