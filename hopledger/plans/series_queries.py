"""Series algebra, path health and alert rules over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hopledger.operators import series as s
from hopledger.operators.alerting import RULES, Alerting, alerts_as_samples, hold, stamp
from hopledger.operators.health import BY_IF_NAME, BY_IFACE, SERIES_NAMES, PathHealth, alert_ticks, interface_ticks
from hopledger.operators.mapping import without_direction
from hopledger.plans import domain as d
from hopledger.plans.domain_sql import LABELS, LOOKBACK_US, RANGE_US
from hopledger.plans.registry import query

KEYS = ["instance", "if_index", "if_name", "iface"]
KEYS_SQL = "instance, if_index, if_name, iface"


def _metric(spark, sf_dir, name):
    return d.samples(spark, sf_dir).filter(F.col("metric") == name)


@query("instant_vector", "V1 V2", f"""
SELECT {KEYS_SQL}, t_s, sample_us, value FROM instants WHERE metric = 'ifHCInOctets'
""", "instants")
def _(spark, sf_dir):
    rows = s.select_labels(d.samples(spark, sf_dir), metric="ifHCInOctets")
    return d.in_seconds(s.instant_vector(rows, KEYS, d.grid(spark, sf_dir)))


@query("range_vector", "V3", f"""
SELECT x.instance, x.if_index, x.if_name, x.iface, t.t_s, count(*) AS n, sum(CAST(x.value AS BIGINT))::BIGINT AS total,
       CAST(arg_min(x.value, x.us) AS DOUBLE) AS first_value
FROM ticks t JOIN samples x ON x.us <= t.t AND x.us > t.t - {RANGE_US} WHERE x.metric = 'ifHCInOctets' GROUP BY ALL
""", "ticks samples")
def _(spark, sf_dir):
    points = s.range_vector(_metric(spark, sf_dir, "ifHCInOctets"), KEYS, d.grid(spark, sf_dir))
    total = F.aggregate("points", F.lit(0).cast("bigint"), lambda a, p: a + p["value"].cast("bigint"))
    return points.select(*KEYS, F.expr("t div 1000000").alias("t_s"), F.size("points").cast("bigint").alias("n"),
                         total.alias("total"), F.col("points")[0]["value"].alias("first_value"))


@query("counter_rate", "V4", f"""
SELECT metric, {KEYS_SQL}, t_s, round(value * TIE, 6) AS value FROM rates
""", "rates")
def _(spark, sf_dir):
    counters = d.samples(spark, sf_dir).filter(~F.col("metric").isin("ALERTS", "ifHighSpeed", "ifOperStatus"))
    return d.seconds(s.counter_rate(counters, ["metric", *KEYS], d.grid(spark, sf_dir)))


@query("comparisons", "V5 V6 V7", f"""
SELECT {KEYS_SQL}, t_s, value * 1e6 AS value, 'speed' AS kind FROM instants WHERE metric = 'ifHighSpeed' AND value > 0
UNION ALL SELECT {KEYS_SQL}, t_s, CASE WHEN value = 1 THEN 1.0 ELSE 0.0 END, 'up' FROM instants WHERE metric = 'ifOperStatus'
UNION ALL SELECT {KEYS_SQL}, t_s, value, 'down' FROM instants WHERE metric = 'ifOperStatus' AND value <> 1
""", "instants")
def _(spark, sf_dir):
    speed = s.instant_vector(_metric(spark, sf_dir, "ifHighSpeed"), KEYS, d.grid(spark, sf_dir))
    status = s.instant_vector(_metric(spark, sf_dir, "ifOperStatus"), KEYS, d.grid(spark, sf_dir))
    parts = [s.scaled(s.compare(speed, ">", 0), 1e6).withColumn("kind", F.lit("speed")),
             s.equals_flag(status, 1).withColumn("kind", F.lit("up")),
             s.compare(status, "!=", 1).withColumn("kind", F.lit("down"))]
    return d.in_seconds(parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("sample_us"))


@query("fan_out", "V8 V8k", f"""
SELECT {LABELS}, m.direction, x.t_s, x.value FROM instants x
JOIN mapping m ON m.iface = x.iface WHERE x.metric = 'ifHCInOctets'
""", "instants mapping")
def _(spark, sf_dir):
    """On the composite key."""
    one = s.instant_vector(_metric(spark, sf_dir, "ifHCInOctets"), KEYS, d.grid(spark, sf_dir))
    return d.in_seconds(s.fan_out(one, d.mapping(spark, sf_dir), BY_IFACE))


@query("fan_out_conflicts", "V8", """
SELECT instance, if_name, t_s, count(*) AS copies FROM instants
WHERE metric IN ('ifOutErrors', 'ifOutDiscards') GROUP BY ALL HAVING count(*) > 1
""", "instants")
def _(spark, sf_dir):
    """Two metrics taken for one: an interface that has both is no unique side."""
    rows = d.samples(spark, sf_dir).filter(F.col("metric").isin("ifOutErrors", "ifOutDiscards"))
    both = s.instant_vector(rows, ["metric", *KEYS], d.grid(spark, sf_dir))
    out = s.fan_out_conflicts(both, BY_IF_NAME)
    return out.select(*BY_IF_NAME, F.expr("t div 1000000").alias("t_s"), "copies")


MAP_LABELS = "app, service, device, if_name, instance, if_index, iface, direction"


@query("ratio", "V9", f"""
SELECT {MAP_LABELS}, t_s, round(e.value / c.value * TIE, 9) AS value FROM if_egress_octets_rate e
JOIN if_capacity_bps c USING ({MAP_LABELS}, t_s) WHERE c.value <> 0
""", "if_egress_octets_rate if_capacity_bps")
def _(spark, sf_dir):
    health = d.health(spark, sf_dir)
    rates, capacity = health.series("if_egress_octets_rate"), health.series("if_capacity_bps")
    return d.seconds(s.ratio(rates, capacity, MAP_LABELS.split(", ")), 9)


@query("rollup_by_app", "V10a", """
SELECT app, t_s, round(sum(value) * TIE, 6) AS value FROM if_in_errors_rate GROUP BY ALL
""", "if_in_errors_rate")
def _(spark, sf_dir):
    return d.seconds(s.rollup_by_app(d.health(spark, sf_dir).series("if_in_errors_rate")))


@query("aggregate_by", "V10", """
SELECT instance, t_s, 'max' AS how, max(value) AS value FROM instants WHERE metric = 'ifHCInOctets' GROUP BY ALL
UNION ALL SELECT instance, t_s, 'min', min(value) FROM instants WHERE metric = 'ifHCInOctets' GROUP BY ALL
UNION ALL SELECT instance, t_s, 'sum', sum(value) FROM instants WHERE metric = 'ifHCInOctets' GROUP BY ALL
""", "instants")
def _(spark, sf_dir):
    rows = s.instant_vector(_metric(spark, sf_dir, "ifHCInOctets"), KEYS, d.grid(spark, sf_dir))
    out = None
    for how in ("max", "min", "sum"):
        part = s.aggregate_by(rows, how, ["instance"]).withColumn("how", F.lit(how))
        out = part if out is None else out.unionByName(part)
    return d.in_seconds(out)


@query("count_by", "V10c", "SELECT instance, if_name, t_s, CAST(value AS DOUBLE) AS value FROM firing", "firing")
def _(spark, sf_dir):
    return d.seconds(alert_ticks(d.samples(spark, sf_dir), BY_IF_NAME, d.grid(spark, sf_dir)))


@query("sum_or_either", "V12", "SELECT app, service, t_s, round(value * TIE, 6) AS value FROM path_errors_rate", "path_errors_rate")
def _(spark, sf_dir):
    return d.seconds(d.health(spark, sf_dir).sum_of_sides("if_in_errors_rate", "if_out_errors_rate"))


@query("unless", "V13", f"""
SELECT {MAP_LABELS} FROM mapping m WHERE NOT EXISTS (
  SELECT 1 FROM scrape x WHERE x.instance = m.instance AND x.if_name = m.if_name)
""", "mapping scrape")
def _(spark, sf_dir):
    return s.unless(d.mapping(spark, sf_dir), _metric(spark, sf_dir, "ifHCInOctets"), BY_IF_NAME)


@query("absent", "V14", """
SELECT k.metric, k.instance, t.t_s, 1.0::DOUBLE AS value FROM (SELECT DISTINCT metric, instance FROM samples) k, ticks t
WHERE NOT EXISTS (SELECT 1 FROM instants x WHERE x.metric = k.metric AND x.instance = k.instance AND x.t_s = t.t_s)
""", "samples ticks instants")
def _(spark, sf_dir):
    """Every metric of every device that ever sent it."""
    return d.seconds(s.absent_series(d.samples(spark, sf_dir), ["metric", "instance"], d.grid(spark, sf_dir)))


@query("absent_feed", "V14", f"""
SELECT t_s, 1.0::DOUBLE AS value FROM ticks t WHERE t.t NOT IN (
  SELECT t.t FROM ticks t JOIN samples x ON x.us <= t.t AND x.us > t.t - {LOOKBACK_US} WHERE metric = 'ifHCInOctets')
""", "ticks samples")
def _(spark, sf_dir):
    """The whole feed: a row only where no device at all has sent."""
    return d.seconds(s.absent_series(_metric(spark, sf_dir, "ifHCInOctets"), [], d.grid(spark, sf_dir)))


@query("age_of_newest", "V15", """
SELECT metric, instance, t_s, round((t.t - max(x.us)) / 1000000.0 * TIE, 6)::DOUBLE AS value
FROM ticks t JOIN samples x ON x.us <= t.t GROUP BY metric, instance, t.t, t_s
""", "ticks samples")
def _(spark, sf_dir):
    return d.seconds(s.age_of_newest(d.samples(spark, sf_dir), ["metric", "instance"], d.grid(spark, sf_dir)))


# Path health: each derived series against the rule spelled out in SQL.

COVERS = {
    "if_egress_octets_rate": "H1", "if_ingress_octets_rate": "H2", "if_capacity_bps": "H3", "if_oper_up": "H4",
    "if_in_errors_rate": "H5", "if_out_errors_rate": "H6", "if_in_discards_rate": "H7", "if_out_discards_rate": "H8",
    "if_alerts_firing": "H9", "if_util": "H10 H11", "path_util_max": "H12", "path_oper_up_min": "H13",
    "path_hops_down": "H14", "path_errors_rate": "H15", "path_discards_rate": "H16", "path_alerts_firing": "H17",
}


def _series_query(name: str, covers: str) -> None:
    @query(name, covers, f"SELECT * REPLACE (round(CAST(value AS DOUBLE) * TIE, 6) AS value) FROM {name}", name)
    def _(spark, sf_dir):
        return d.seconds(d.health(spark, sf_dir).series(name))


for _name in SERIES_NAMES:
    _series_query(_name, COVERS[_name])


@query("path_rollups", "H12 H13 H14 H15 H16", """
SELECT app, service, t_s, round(u.value * TIE, 6) AS path_util_max, CAST(o.value AS DOUBLE) AS path_oper_up_min,
       CAST(n.value AS DOUBLE) AS path_hops_down, round(e.value * TIE, 6) AS path_errors_rate,
       round(x.value * TIE, 6) AS path_discards_rate
FROM path_util_max u FULL JOIN path_oper_up_min o USING (app, service, t_s) FULL JOIN path_hops_down n USING (app, service, t_s)
FULL JOIN path_errors_rate e USING (app, service, t_s) FULL JOIN path_discards_rate x USING (app, service, t_s)
""", "path_util_max path_oper_up_min path_hops_down path_errors_rate path_discards_rate")
def _(spark, sf_dir):
    """All path rollups in one pass."""
    rolled = d.health(spark, sf_dir).path_rollups().withColumn("t_s", F.expr("t div 1000000")).drop("t")
    for c in ("path_util_max", "path_errors_rate", "path_discards_rate"):
        rolled = rolled.withColumn(c, d.rounded(F.col(c)))
    return rolled


@query("interface_ticks", "V1 V4", f"""
SELECT instance, if_name, t_s, round(max(CASE WHEN metric = 'ifHCOutOctets' THEN value END) * TIE, 6) AS out_octets,
       round(max(CASE WHEN metric = 'ifOutErrors' THEN value END) * TIE, 6) AS out_errors,
       max(CASE WHEN metric = 'ifOperStatus' THEN value END) AS status
FROM (SELECT metric, {KEYS_SQL}, t_s, value FROM rates WHERE metric IN ('ifHCOutOctets', 'ifOutErrors')
      UNION ALL SELECT metric, {KEYS_SQL}, t_s, value FROM instants WHERE metric = 'ifOperStatus') GROUP BY ALL
""", "rates instants")
def _(spark, sf_dir):
    ticks = interface_ticks(d.samples(spark, sf_dir), ["out_octets", "out_errors", "status"], BY_IF_NAME, d.grid(spark, sf_dir))
    return ticks.select(*BY_IF_NAME, F.expr("t div 1000000").alias("t_s"), d.rounded(F.col("out_octets")).alias("out_octets"),
                        d.rounded(F.col("out_errors")).alias("out_errors"), "status")


@query("series_conflicts", "V8", """
SELECT instance, t_s, 'status' AS "column", count(*) AS series FROM instants WHERE metric = 'ifOperStatus' GROUP BY ALL HAVING count(*) > 1
""", "instants")
def _(spark, sf_dir):
    """Joined on the instance alone, its interfaces are in each other's way: all such ticks are listed."""
    found = d.health(spark, sf_dir, ["instance"]).conflicts("status")
    return found.select("instance", F.expr("t div 1000000").alias("t_s"), "column", "series")


# Alert rules. Days stand in for minutes: holds are scaled to the step of the grid.

HOLD_S = 2 * d.DAY


def held(labels: str, source: str, hold_s: int = HOLD_S) -> str:
    part = f"PARTITION BY {labels}" if labels else ""
    comma = f"{labels}, " if labels else ""
    return f"""
SELECT {comma}t_s, value, active_since_s, CASE WHEN t_s - active_since_s >= {hold_s} THEN 'firing' ELSE 'pending' END AS state
FROM (SELECT *, min(t_s) OVER (PARTITION BY {comma}island) AS active_since_s
      FROM (SELECT *, t_s - {d.DAY} * row_number() OVER ({part} ORDER BY t_s) AS island FROM ({source})))
"""


def _state(df, labels):
    return df.select(*labels, F.expr("t div 1000000").alias("t_s"), d.rounded(F.col("value")).alias("value"),
                     F.expr("active_since div 1000000").alias("active_since_s"), "state")


def _alerting(spark, sf_dir, **changes):
    values = {"samples": d.samples(spark, sf_dir), "mapping": d.mapping(spark, sf_dir), "grid": d.grid(spark, sf_dir)}
    return Alerting(**{**values, **changes})


STALE = """
SELECT instance, t_s, round((t.t - max(x.us)) / 1000000.0 * TIE, 6)::DOUBLE AS value FROM ticks t JOIN samples x ON x.us <= t.t
WHERE metric = 'ifHCInOctets' GROUP BY instance, t.t, t_s
"""
SILENT = """
SELECT k.instance, t.t_s, 1.0::DOUBLE AS value FROM (SELECT DISTINCT instance FROM {rows}) k, ticks t WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT DISTINCT instance, t_s FROM ticks JOIN {rows} y ON y.us <= ticks.t AND y.us > ticks.t - {look}) x
  WHERE x.instance = k.instance AND x.t_s = t.t_s)
"""
VIEWS = "(SELECT epoch_us(ts) AS us, 'api-' || user_id AS instance FROM events WHERE event_type = 'view')"
INBOUND = "(SELECT us, instance FROM samples WHERE metric = 'ifHCInOctets')"


@query("hold", "A0", held("app, service", "SELECT app, service, t_s, round(value * TIE, 6) AS value FROM path_hops_down WHERE value > 1"),
       "path_hops_down")
def _(spark, sf_dir):
    active = s.compare(d.health(spark, sf_dir).path_hops_down(), ">", 1)
    return _state(hold(active, ["app", "service"], d.DAY, HOLD_S), ["app", "service"])


@query("alert_mapping_absent", "A1", held("instance", SILENT.format(rows=VIEWS, look=LOOKBACK_US)), "ticks")
def _(spark, sf_dir):
    """Views as scrapes of one mapping feed per user."""
    views = d.table(spark, sf_dir, "events").filter("event_type = 'view'").select(
        F.concat(F.lit("api-"), F.col("user_id").cast("string")).alias("instance"), F.col("ts").cast("timestamp").alias("ts"), F.lit(1.0).alias("value"))
    return _state(_alerting(spark, sf_dir, mapping_samples=views, per=["instance"]).alerts("mapping_absent", HOLD_S), ["instance"])


@query("alert_mapping_feed_down", "A2", held("instance", f"""
SELECT 'api-' || (user_id % 50) AS instance, t.t_s, 0.0::DOUBLE AS value
FROM ticks t JOIN events ON epoch_us(ts) <= t.t AND epoch_us(ts) > t.t - {LOOKBACK_US}
GROUP BY ALL HAVING arg_max(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, epoch_us(ts)) = 0
"""), "ticks")
def _(spark, sf_dir):
    """Events as scrapes of fifty mapping feeds, down on an error."""
    feeds = d.table(spark, sf_dir, "events").select(
        F.lit("up").alias("metric"), F.lit("mapping").alias("job"),
        F.concat(F.lit("api-"), (F.col("user_id") % 50).cast("string")).alias("instance"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "error", 0.0).otherwise(1.0).alias("value"))
    return _state(_alerting(spark, sf_dir, feeds=feeds).alerts("mapping_feed_down", HOLD_S), ["instance"])


@query("alert_counters_absent", "A3", held("instance", SILENT.format(rows=INBOUND, look=LOOKBACK_US)), "ticks samples")
def _(spark, sf_dir):
    return _state(_alerting(spark, sf_dir, per=["instance"]).alerts("counters_absent", HOLD_S), ["instance"])


@query("alert_counters_stale", "A4", held("instance", f"SELECT * FROM ({STALE}) WHERE value > 300"), "ticks samples")
def _(spark, sf_dir):
    return _state(_alerting(spark, sf_dir, per=["instance"]).alerts("counters_stale", HOLD_S), ["instance"])


@query("alert_mapping_drift", "A5", held("", """
SELECT t.t_s, CAST(count(*) AS DOUBLE) AS value FROM ticks t, mapping m
WHERE NOT EXISTS (SELECT 1 FROM instants x WHERE x.metric = 'ifHCInOctets' AND x.t_s = t.t_s
                  AND x.instance = m.instance AND x.if_name = m.if_name) GROUP BY t.t_s
"""), "ticks mapping instants")
def _(spark, sf_dir):
    return _state(_alerting(spark, sf_dir).alerts("mapping_drift", HOLD_S), [])


def _path_alert(name: str, covers: str, source: str, bound: str) -> None:
    text = f"SELECT app, service, t_s, round(value * TIE, 6) AS value FROM {source} WHERE value > {bound}"

    @query(f"alert_{name}", covers, held("app, service", text), source)
    def _(spark, sf_dir):
        return _state(_alerting(spark, sf_dir).alerts(name, HOLD_S), ["app", "service"])


_path_alert("path_hop_down", "A6", "path_hops_down", "0")
_path_alert("path_utilization_high", "A7", "path_util_max", "0.9")
_path_alert("path_errors", "A8", "path_errors_rate", "0")
_path_alert("path_discards", "A9", "path_discards_rate", "0")


DOWN = f"SELECT {KEYS_SQL}, t_s, value FROM instants WHERE metric = 'ifOperStatus' AND value <> 1"


@query("alert_interface_down", "A10", held(KEYS_SQL, DOWN, d.DAY), "instants")
def _(spark, sf_dir):
    return _state(_alerting(spark, sf_dir).alerts("interface_down", d.DAY), KEYS)


@query("alert_annotations", "A11 F16", f"""
SELECT app, service, t_s, 'PathHopDown' AS alertname, 'warning' AS severity,
       CAST(value AS BIGINT) || ' interface(s) on a path of ' || app || ' are down' AS summary,
       'an interface on the declared path of ' || app || '/' || service || ' is down' AS description
FROM path_hops_down WHERE value > 0
UNION ALL
SELECT app, service, t_s, 'PathUtilizationHigh', 'warning',
       app || ' has a hop that is ' || printf('%.4g', round(value * TIE, 6) * 100) || '% full',
       'the busiest hop on the declared path of ' || app || '/' || service || ' is above 90%'
FROM path_util_max WHERE value > 0.9
""", "path_hops_down path_util_max")
def _(spark, sf_dir):
    alerting = _alerting(spark, sf_dir)
    rounded = alerting.alerts("path_utilization_high", HOLD_S).withColumn("value", d.rounded(F.col("value")))
    full = stamp(rounded, RULES["path_utilization_high"], ["app", "service"])
    rows = alerting.alerts("path_hop_down", HOLD_S).unionByName(full)
    return rows.select("app", "service", F.expr("t div 1000000").alias("t_s"), "alertname", "severity", "summary", "description")


@query("alerts_as_samples", "A10 H9", f"""
SELECT instance, if_name, count(*) AS n, count(*) FILTER (WHERE state = 'firing') AS firing
FROM ({held(KEYS_SQL, DOWN, d.DAY)}) GROUP BY ALL
""", "instants")
def _(spark, sf_dir):
    """Interface alerts fed back as samples, counted per interface."""
    fed = alerts_as_samples(_alerting(spark, sf_dir).alerts("interface_down", d.DAY))
    return fed.groupBy("instance", "if_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("alertstate") == "firing").alias("firing"))
