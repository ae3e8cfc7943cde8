"""Alert conditions with hold durations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopledger.functions.text import humanize_percentage, number_text
from hopledger.operators.health import APP_SERVICE, PathHealth
from hopledger.operators.series import MICROS, SERIES, Grid, absent_series, age_of_newest, compare, instant_vector

INBOUND = "ifHCInOctets"


@dataclass(frozen=True)
class Rule:
    """What an alert is called, how long it must hold and what is stamped on it."""

    name: str
    hold_s: int
    severity: str
    summary: str
    description: str = ""
    labels: list[str] = field(default_factory=list)


# Hold durations, severities and thresholds of the rules.
RULES = {
    "mapping_absent": Rule(
        "MappingAbsent", 300, "critical", "no mapping rows: every path-health series has stopped"),
    "mapping_feed_down": Rule(
        "MappingFeedDown", 300, "critical", "the mapping feed {job} is down"),
    "counters_absent": Rule(
        "CountersAbsent", 300, "critical", "no raw counters have arrived"),
    "counters_stale": Rule(
        "CountersStale", 300, "critical", "the newest raw counter is {value} s old"),
    "mapping_drift": Rule(
        "MappingDrift", 1800, "warning", "{value} mapping rows match no counter"),
    "path_hop_down": Rule(
        "PathHopDown", 300, "warning", "{value} interface(s) on a path of {app} are down",
        "an interface on the declared path of {app}/{service} is down", APP_SERVICE),
    "path_utilization_high": Rule(
        "PathUtilizationHigh", 900, "warning", "{app} has a hop that is {percent} full",
        "the busiest hop on the declared path of {app}/{service} is above 90%", APP_SERVICE),
    "path_errors": Rule(
        "PathErrors", 900, "warning", "hops of {app} report errors",
        "in and out errors over the hops of {app}/{service}: {value}/s", APP_SERVICE),
    "path_discards": Rule(
        "PathDiscards", 900, "warning", "hops of {app} discard packets",
        "in and out discards over the hops of {app}/{service}: {value}/s", APP_SERVICE),
    "interface_down": Rule(
        "InterfaceDown", 30, "page", "{instance} {if_name} is down", "", SERIES),
}
STALE_AFTER_S = 300
UTILIZATION_LIMIT = 0.9


def hold(active: DataFrame, labels: list[str], step_s: int, hold_s: int) -> DataFrame:
    """A0: each active tick with ``active_since`` and ``state`` pending or firing.

    A run is broken by one missing tick. There is one row per label set and tick, so a window holds
    no more rows than the grid has ticks.
    """
    step = step_s * MICROS
    keys = labels or [F.lit(0)]
    by_time = Window.partitionBy(*keys).orderBy("t")
    begins = F.when(F.col("t") - F.coalesce(F.lag("t").over(by_time), F.lit(-step)) != step, F.col("t"))
    begins = F.when(F.lag("t").over(by_time).isNull(), F.col("t")).otherwise(begins)
    since = F.max("_begins").over(by_time.rowsBetween(Window.unboundedPreceding, 0))
    held = (F.col("t") - F.col("active_since")) >= hold_s * MICROS
    return (
        active.withColumn("_begins", begins).withColumn("active_since", since).drop("_begins")
        .withColumn("state", F.when(held, "firing").otherwise("pending"))
    )


def fill(template: str, labels: list[str]) -> Column:
    """A bounded template of label names, {value} and {percent}."""
    pieces: list[Column] = []
    for i, part in enumerate(template.replace("}", "{").split("{")):
        if i % 2 == 0:
            pieces.append(F.lit(part))
        elif part == "value":
            pieces.append(number_text(F.col("value")))
        elif part == "percent":
            pieces.append(humanize_percentage(F.col("value")))
        elif part in labels:
            pieces.append(F.col(part))
        else:
            raise ValueError(f"template names {part!r}, which is no label of the alert")
    return F.concat(*pieces)


def stamp(held: DataFrame, rule: Rule, labels: list[str]) -> DataFrame:
    """Alert name, severity and annotations as columns."""
    return held.withColumns({
        "alertname": F.lit(rule.name),
        "severity": F.lit(rule.severity),
        "summary": fill(rule.summary, labels),
        "description": fill(rule.description, labels),
    })


@dataclass
class Alerting:
    """The alert rules over one evaluation grid, which needs both ends.

    Absence and age (A1, A3, A4) are judged for the whole feed, or, with ``per``, for each value of those labels among all that ever sent.
    """

    samples: DataFrame
    mapping: DataFrame
    grid: Grid
    keys: list[str] | None = None
    mapping_samples: DataFrame | None = None
    feeds: DataFrame | None = None
    per: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.health = PathHealth(self.samples, self.mapping, self.grid, self.keys)

    def _ticks(self) -> DataFrame:
        return self.grid.ticks(self.samples.sparkSession)

    def _inbound(self) -> DataFrame:
        return self.samples.filter(F.col("metric") == INBOUND)

    def mapping_absent(self) -> DataFrame:
        """A1. ``mapping_samples`` are scrapes of the mapping; without them it is there when it has rows."""
        if self.mapping_samples is not None:
            return absent_series(self.mapping_samples, self.per, self.grid)
        rows = self.mapping.agg(F.count(F.lit(1)).alias("n")).scalar()
        return self._ticks().filter(rows == 0).withColumn("value", F.lit(1.0))

    def mapping_feed_down(self) -> DataFrame:
        """A2 on ``feeds``: samples of ``up`` with a ``job`` label."""
        up = self.feeds.filter((F.col("metric") == "up") & (F.col("job") == "mapping"))
        return compare(instant_vector(up, ["job", "instance"], self.grid), "==", 0).drop("sample_us")

    def counters_absent(self) -> DataFrame:
        """A3."""
        return absent_series(self._inbound(), self.per, self.grid)

    def counters_stale(self) -> DataFrame:
        """A4, over the whole history: the look-back would hide the very samples it asks about."""
        return compare(age_of_newest(self._inbound(), self.per, self.grid), ">", STALE_AFTER_S)

    def mapping_drift(self) -> DataFrame:
        """A5: mapping rows less the rows whose interface has a counter at the tick.

        Counting the matched rows and subtracting avoids pairing every mapping row with every tick.
        """
        keys = self.health.keys
        per_key = self.mapping.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        seen = instant_vector(self._inbound(), SERIES, self.grid).select(*keys, "t").distinct()
        matched = seen.join(per_key, keys).groupBy("t").agg(F.sum("_rows").alias("_matched"))
        total = self.mapping.agg(F.count(F.lit(1)).alias("n")).scalar()
        value = (total - F.coalesce("_matched", F.lit(0))).cast("double")
        return compare(
            self._ticks().join(matched, "t", "left").withColumn("value", value).drop("_matched"), ">", 0
        )

    def path_hop_down(self) -> DataFrame:
        return compare(self.health.path_hops_down(), ">", 0)

    def path_utilization_high(self) -> DataFrame:
        return compare(self.health.path_util_max(), ">", UTILIZATION_LIMIT)

    def path_errors(self) -> DataFrame:
        return compare(self.health.path_errors_rate(), ">", 0)

    def path_discards(self) -> DataFrame:
        return compare(self.health.path_discards_rate(), ">", 0)

    def interface_down(self) -> DataFrame:
        """A10."""
        status = self.samples.filter(F.col("metric") == "ifOperStatus")
        return compare(instant_vector(status, SERIES, self.grid), "!=", 1).drop("sample_us")

    def alerts(self, name: str, hold_s: int | None = None) -> DataFrame:
        """The rule ``name`` held and stamped."""
        rule = RULES[name]
        own = {"mapping_feed_down": ["job", "instance"], "counters_absent": self.per, "counters_stale": self.per,
               "mapping_absent": [] if self.mapping_samples is None else self.per}
        labels = list(own.get(name, rule.labels))
        held = hold(getattr(self, name)(), labels, self.grid.step, rule.hold_s if hold_s is None else hold_s)
        return stamp(held, rule, labels)


def alerts_as_samples(alerts: DataFrame) -> DataFrame:
    """Alert state as samples, the input of the firing-alert series."""
    return alerts.select(
        F.lit("ALERTS").alias("metric"), F.timestamp_micros("t").alias("ts"), F.lit(1.0).alias("value"),
        "alertname", F.col("state").alias("alertstate"),
        *[c for c in SERIES if c in alerts.columns],
    )
