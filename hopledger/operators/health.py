"""Path-health series.

All rules of one interface are computed in one pass: its counters and gauges are shuffled together
once, reduced to one row per tick, and only then fanned out over the mapping. Each series below is a
projection or a rollup of that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopledger.operators.mapping import without_direction
from hopledger.operators.series import (
    SERIES, aggregate_by, count_by, counter_rate, fan_out, Grid, instant_vector, range_facts, sum_or_either, with_rate,
)

BY_IF_NAME = ["instance", "if_name"]
BY_IFACE = ["iface"]
APP_SERVICE = ["app", "service"]

# The raw metrics and how each is read.
RATES = {
    "out_octets": "ifHCOutOctets",
    "in_octets": "ifHCInOctets",
    "in_errors": "ifInErrors",
    "out_errors": "ifOutErrors",
    "in_discards": "ifInDiscards",
    "out_discards": "ifOutDiscards",
}
GAUGES = {"speed": "ifHighSpeed", "status": "ifOperStatus"}
INPUT_METRICS = [*RATES.values(), *GAUGES.values(), "ALERTS"]

# Names of the derived series.
SERIES_NAMES = {
    "if_egress_octets_rate": "app:if_egress_octets:rate5m",
    "if_ingress_octets_rate": "app:if_ingress_octets:rate5m",
    "if_capacity_bps": "app:if_capacity_bps",
    "if_oper_up": "app:if_oper_up:state",
    "if_in_errors_rate": "app:if_in_errors:rate5m",
    "if_out_errors_rate": "app:if_out_errors:rate5m",
    "if_in_discards_rate": "app:if_in_discards:rate5m",
    "if_out_discards_rate": "app:if_out_discards:rate5m",
    "if_alerts_firing": "app:if_alerts_firing:count",
    "if_util": "app:if_util:ratio",
    "path_util_max": "app:path_util_max:ratio",
    "path_oper_up_min": "app:path_oper_up_min:state",
    "path_hops_down": "app:path_hops_down:count",
    "path_errors_rate": "app:path_errors:rate5m",
    "path_discards_rate": "app:path_discards:rate5m",
    "path_alerts_firing": "app:path_alerts_firing:count",
}


def interface_ticks(samples: DataFrame, columns: list[str], keys: list[str], grid: Grid) -> DataFrame:
    """One row per (join keys, tick) with a column per raw metric asked for.

    Rates need two samples in the range, gauges the last one in the look-back. A metric with more
    than one series under the join key is null there, as its value would be ambiguous.
    """
    wanted = {c: (RATES | GAUGES)[c] for c in columns}
    gauges = [m for c, m in wanted.items() if c in GAUGES]
    span: Column = F.lit(grid.range)
    if gauges and grid.lookback != grid.range:
        span = F.when(F.col("metric").isin(*gauges), grid.lookback).otherwise(grid.range)
    rows = samples.filter(F.col("metric").isin(*wanted.values()))
    gauge = F.col("metric").isin(*gauges)
    # a rate of one sample is dropped by its count: asking for a null rate would repeat the formula
    facts = range_facts(rows, ["metric", *SERIES], keys, grid, span).filter((F.col("n") >= 2) | gauge)
    valued = with_rate(facts, grid.range).withColumn(
        "value", F.when(gauge, F.col("last_value")).otherwise(F.col("rate"))
    )
    # the facts are still in the tasks of their block: this second grouping needs no shuffle
    one = lambda m: F.when(
        F.count_if(F.col("metric") == m) == 1, F.max(F.when(F.col("metric") == m, F.col("value")))
    )
    return valued.groupBy(*keys, "blk", "t").agg(*[one(m).alias(c) for c, m in wanted.items()]).drop("blk")


def tick_conflicts(samples: DataFrame, columns: list[str], keys: list[str], grid: Grid) -> DataFrame:
    """What ``interface_ticks`` leaves null: (keys, t, column, series) with more than one series of a metric under the join key."""
    out = None
    for column in columns:
        rows = samples.filter(F.col("metric") == (RATES | GAUGES)[column])
        series = (counter_rate if column in RATES else instant_vector)(rows, SERIES, grid)
        part = series.groupBy(*keys, "t").agg(F.count(F.lit(1)).alias("series")).filter("series > 1").withColumn("column", F.lit(column))
        out = part if out is None else out.unionByName(part)
    return out


def alert_ticks(samples: DataFrame, keys: list[str], grid: Grid) -> DataFrame:
    """Firing alerts per (join keys, tick), counted before any fan-out."""
    firing = samples.filter((F.col("metric") == "ALERTS") & (F.col("alertstate") == "firing"))
    labels = [c for c in ("alertname", *SERIES) if c in firing.columns]
    return count_by(instant_vector(firing, labels, grid), keys)


@dataclass
class PathHealth:
    """The derived series over ``samples`` and ``mapping``; each method is a DataFrame.

    ``keys`` are the columns samples and mapping share: instance and if_name, or the composite iface.
    """

    samples: DataFrame
    mapping: DataFrame
    grid: Grid
    keys: list[str] | None = None

    def __post_init__(self) -> None:
        self.keys = self.keys or BY_IF_NAME

    def conflicts(self, *columns: str) -> DataFrame:
        """Interfaces and ticks that the series leave out, as two series share their join key."""
        return tick_conflicts(self.samples, list(columns or RATES | GAUGES), self.keys, self.grid)

    def _ticks(self, *columns: str) -> DataFrame:
        return interface_ticks(self.samples, list(columns), self.keys, self.grid)

    def _spread(self, column: str, value: Column, mapping: DataFrame, ticks: DataFrame | None = None) -> DataFrame:
        ticks = self._ticks(column) if ticks is None else ticks
        one = ticks.withColumn("value", value).filter("value is not null")
        return fan_out(one, mapping, self.keys, checked=True)

    def _directed(self, direction: str) -> DataFrame:
        return self.mapping.filter(F.col("direction") == direction)

    def if_egress_octets_rate(self) -> DataFrame:
        return self._spread("out_octets", F.col("out_octets"), self._directed("egress"))

    def if_ingress_octets_rate(self) -> DataFrame:
        return self._spread("in_octets", F.col("in_octets"), self._directed("ingress"))

    def if_capacity_bps(self) -> DataFrame:
        return self._spread("speed", F.when(F.col("speed") > 0, F.col("speed") * 1e6), self.mapping)

    def _up(self) -> Column:
        return (F.col("status") == 1).cast("double")

    def if_oper_up(self) -> DataFrame:
        return self._spread("status", self._up(), without_direction(self.mapping))

    def _plain(self, column: str) -> DataFrame:
        return self._spread(column, F.col(column), without_direction(self.mapping))

    def if_in_errors_rate(self) -> DataFrame:
        return self._plain("in_errors")

    def if_out_errors_rate(self) -> DataFrame:
        return self._plain("out_errors")

    def if_in_discards_rate(self) -> DataFrame:
        return self._plain("in_discards")

    def if_out_discards_rate(self) -> DataFrame:
        return self._plain("out_discards")

    def if_alerts_firing(self) -> DataFrame:
        ticks = alert_ticks(self.samples, self.keys, self.grid)
        return fan_out(ticks, without_direction(self.mapping), self.keys, checked=True)

    def if_util(self) -> DataFrame:
        """Octets over capacity, divided per interface before the fan-out.

        Rate and capacity of an interface land on the same mapping rows, so dividing first gives
        the same quotients with one fan-out and no join of fanned-out series.
        """
        capacity = F.when(F.col("speed") > 0, F.col("speed") * 1e6)
        of = lambda c: F.col(c) * 8 / capacity
        ticks = self._ticks("out_octets", "in_octets", "speed").select(
            *self.keys, "t", of("out_octets").alias("egress"), of("in_octets").alias("ingress")
        ).filter("egress is not null or ingress is not null")
        spread = ticks.join(self.mapping.filter(F.col("direction").isin("egress", "ingress")), self.keys)
        value = F.when(F.col("direction") == "egress", F.col("egress")).otherwise(F.col("ingress"))
        return spread.withColumn("value", value).drop("egress", "ingress").filter("value is not null")

    def path_util_max(self) -> DataFrame:
        return aggregate_by(self.if_util(), "max", APP_SERVICE)

    def path_oper_up_min(self) -> DataFrame:
        return aggregate_by(self.if_oper_up(), "min", APP_SERVICE)

    def path_hops_down(self) -> DataFrame:
        down = self.if_oper_up().withColumn("value", 1 - F.col("value"))
        return aggregate_by(down, "sum", APP_SERVICE)

    def _either(self, left: str, right: str) -> DataFrame:
        """In plus out per app and service; a missing side counts as nothing, not as a gap."""
        ticks = self._ticks(left, right)
        both = F.coalesce(F.col(left), F.lit(0.0)) + F.coalesce(F.col(right), F.lit(0.0))
        present = F.col(left).isNotNull() | F.col(right).isNotNull()
        spread = self._spread("", F.when(present, both), without_direction(self.mapping), ticks)
        return aggregate_by(spread, "sum", APP_SERVICE)

    def path_errors_rate(self) -> DataFrame:
        return self._either("in_errors", "out_errors")

    def path_discards_rate(self) -> DataFrame:
        return self._either("in_discards", "out_discards")

    def path_alerts_firing(self) -> DataFrame:
        return aggregate_by(self.if_alerts_firing(), "sum", APP_SERVICE)

    def series(self, name: str) -> DataFrame:
        """A derived series by its short name, in label order, with ``t`` and ``value``."""
        if name not in SERIES_NAMES:
            raise KeyError(name)
        df = getattr(self, name)()
        labels = [c for c in (*self.mapping.columns,) if c in df.columns]
        return df.select(*labels, "t", "value")

    def sum_of_sides(self, left: str, right: str) -> DataFrame:
        """H15, H16 in their two-sided form, from series already fanned out."""
        return sum_or_either(
            aggregate_by(self.series(left), "sum", APP_SERVICE),
            aggregate_by(self.series(right), "sum", APP_SERVICE), APP_SERVICE,
        )

    def path_rollups(self) -> DataFrame:
        """Every per-path series but the alert count in one pass, one column each.

        One shuffle of samples, one fan-out, one aggregation: the form to run for all of them.
        """
        ticks = self._ticks(*RATES, *GAUGES)
        capacity = F.when(F.col("speed") > 0, F.col("speed") * 1e6)
        up = self._up()
        total = lambda a, b: F.when(
            F.col(a).isNotNull() | F.col(b).isNotNull(),
            F.coalesce(F.col(a), F.lit(0.0)) + F.coalesce(F.col(b), F.lit(0.0)),
        )
        facts = ticks.select(
            *self.keys, "t", up.alias("up"), (1 - up).alias("down"),
            (F.col("out_octets") * 8 / capacity).alias("egress"),
            (F.col("in_octets") * 8 / capacity).alias("ingress"),
            total("in_errors", "out_errors").alias("errors"),
            total("in_discards", "out_discards").alias("discards"),
        )
        # one row per interface of an app: its directions become two flags, so nothing counts twice
        sides = self.mapping.groupBy(*[c for c in self.mapping.columns if c != "direction"]).agg(
            F.bool_or(F.col("direction") == "egress").alias("has_egress"),
            F.bool_or(F.col("direction") == "ingress").alias("has_ingress"),
        )
        util = F.greatest(F.when(F.col("has_egress"), F.col("egress")), F.when(F.col("has_ingress"), F.col("ingress")))
        return facts.join(sides, self.keys).groupBy(*APP_SERVICE, "t").agg(
            F.max(util).alias("path_util_max"), F.min("up").alias("path_oper_up_min"),
            F.sum("down").alias("path_hops_down"), F.sum("errors").alias("path_errors_rate"),
            F.sum("discards").alias("path_discards_rate"),
        ).filter(
            "coalesce(path_util_max, path_oper_up_min, path_hops_down, path_errors_rate, path_discards_rate)"
            " is not null"
        )
