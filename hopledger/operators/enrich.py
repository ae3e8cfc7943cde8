"""Alert enrichment with blast radius."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopledger.functions.identity import strict_int
from hopledger.functions.text import criticality_rank, overlay, plural
from hopledger.functions.times import is_resolved, rfc3339
from hopledger.operators.topology import IMPACT_COLUMNS, Topology, impact_asof, resolve_targets


@dataclass(frozen=True)
class EnrichConfig:
    device_label: str = "instance"
    if_index_label: str = "ifIndex"
    if_name_label: str = "ifName"
    prefix: str = ""
    enrich_labels: bool = True
    enrich_resolved: bool = False


def correlate(alerts: DataFrame, config: EnrichConfig = EnrichConfig()) -> DataFrame:
    """``mode`` exact, name or null and the key columns of a lookup."""
    label = lambda name: F.coalesce(F.try_element_at("labels", F.lit(name)), F.lit(""))
    device, index = label(config.device_label), strict_int(label(config.if_index_label))
    name = label(config.if_name_label)
    mode = F.when(device == "", None).when(index.isNotNull(), "exact").when(name != "", "name")
    return alerts.withColumns({
        "mode": mode, "instance": device, "if_index": index, "device": device, "ref": name,
    })


def render_labels(impact: DataFrame, keys: list[str]) -> DataFrame:
    """max_criticality, app_count and customer_impact per key.

    Rows are first brought to one per (key, app), then to one per key, each combined before its
    shuffle. The spelling kept is that of the first row in (app, customer) order with the top rank.
    """
    ranked = impact.withColumn("_rank", criticality_rank(F.col("criticality")))
    place = F.struct((-F.col("_rank")).alias("r"), "app", "customer", "criticality")
    per_app = ranked.groupBy(*keys, "app").agg(
        F.min(F.when(F.col("_rank") > 0, place)).alias("_top"),
        F.bool_or(F.col("customer") != "").alias("_customers"),
    )
    return per_app.groupBy(*keys).agg(
        F.coalesce(F.min("_top")["criticality"], F.lit("unknown")).alias("max_criticality"),
        F.count(F.lit(1)).alias("app_count"),
        F.bool_or("_customers").alias("customer_impact"),
    )


def impact_line() -> Column:
    part = lambda lead, c, tail="": F.when(
        F.col(c) != "", F.concat(F.lit(lead), F.col(c), F.lit(tail))
    ).otherwise("")
    return F.concat(
        F.lit("- "), "app", F.lit(" ("), "service", F.lit(") owner "), F.coalesce("owner", F.lit("")),
        part(" customer ", "customer"), part(" [", "criticality", "]"),
    )


def impact_lines(impact: DataFrame, keys: list[str]) -> DataFrame:
    """E3 as rows: one line per impact row, for reports over any number of them."""
    return impact.select(*keys, "app", "customer", impact_line().alias("line"))


def _notes(apps: Column, customers: Column, lines: Column) -> list[Column]:
    return [
        F.concat(F.lit("apps affected ("), apps.cast("string"), F.lit("):\n"), lines).alias("impact"),
        F.concat(plural(apps, "app"), F.lit(", "), plural(customers, "customer")).alias("blast_radius"),
    ]


def render_annotations(impact: DataFrame, keys: list[str]) -> DataFrame:
    """The two annotation texts per key.

    The text of an alert holds a line per impact row, so building it gathers exactly what it prints;
    counts come from plain aggregations.
    """
    counts = impact.groupBy(*keys).agg(
        F.count_distinct("app").alias("_apps"),
        F.count_distinct(F.nullif(F.col("customer"), F.lit(""))).alias("_customers"),
    )
    rows = F.array_sort(F.collect_list(F.struct("app", "customer", "line")))
    texts = impact_lines(impact, keys).groupBy(*keys).agg(
        F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("_lines")
    )
    return counts.join(texts, keys).select(*keys, *_notes(F.col("_apps"), F.col("_customers"), F.col("_lines")))


def render_alerts_at_once(impact: DataFrame, keys: list[str]) -> DataFrame:
    """E2 and E3 together, from one grouping: the rows that the text prints are gathered anyway, and labels and counts follow from them."""
    ranked = impact.select(*keys, "app", "customer", impact_line().alias("line"), (-criticality_rank(F.col("criticality"))).alias("r"), "criticality")
    gathered = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("app", "customer", "line", "r", "criticality"))).alias("_rows"))
    rows = F.col("_rows")
    customers = F.array_distinct(F.filter(F.transform(rows, lambda x: x["customer"]), lambda c: c != ""))
    place = lambda x: F.struct(x["r"].alias("r"), x["app"].alias("app"), x["customer"].alias("customer"), x["criticality"].alias("criticality"))
    told = gathered.withColumns({
        "_apps": F.size(F.array_distinct(F.transform(rows, lambda x: x["app"]))), "_customers": F.size(customers),
        "_top": F.array_min(F.transform(F.filter(rows, lambda x: x["r"] < 0), place)),
        "_lines": F.array_join(F.transform(rows, lambda x: x["line"]), "\n"),
    })
    return told.select(
        *keys, *_notes(F.col("_apps"), F.col("_customers"), F.col("_lines")),
        F.coalesce(F.col("_top.criticality"), F.lit("unknown")).alias("max_criticality"),
        F.col("_apps").cast("long").alias("app_count"), (F.col("_customers") > 0).alias("customer_impact"))


def lookup_alerts(topology: Topology, alerts: DataFrame, now: Column, config: EnrichConfig) -> DataFrame:
    """Alerts with the interface they are about and the second to look at (start, else now)."""
    keyed = correlate(alerts, config).withColumn(
        "at_s", F.unix_seconds(F.coalesce(rfc3339(F.col("starts_at")), now))
    )
    targets = resolve_targets(
        topology.catalog, keyed.select("mode", "instance", "if_index", "device", "ref").distinct()
    ).filter("target_status = 'ok'")
    exact = targets.filter("mode = 'exact'").select("mode", "instance", "if_index", "iface_phash").distinct()
    name = targets.filter("mode = 'name'").select("mode", "device", "ref", "iface_phash").distinct()
    return (
        keyed.join(exact.withColumnRenamed("iface_phash", "_exact"), ["mode", "instance", "if_index"], "left")
        .join(name.withColumnRenamed("iface_phash", "_name"), ["mode", "device", "ref"], "left")
        .withColumn("iface_phash", F.coalesce("_exact", "_name"))
        .drop("_exact", "_name")
    )


def enrich_alerts(
    topology: Topology, alerts: DataFrame, now: Column | None = None, config: EnrichConfig = EnrichConfig(),
    exposed: DataFrame | None = None,
) -> DataFrame:
    """Alerts with impact labels and annotations laid over their own, and ``enrich_status``.

    Alerts without a key or without impact pass through unchanged. Labels go on firing and resolved
    alerts alike, so both keep one identity; annotations go on resolved ones only when asked for.
    Impact is computed once per distinct (interface, second), not per alert.
    """
    now = F.current_timestamp() if now is None else now
    looked = lookup_alerts(topology, alerts, now, config)
    keys = ["iface_phash", "at_s"]
    impact = impact_asof(topology, looked.filter("iface_phash is not null"), exposed)
    rendered = render_alerts_at_once(impact, keys) if config.enrich_labels else render_annotations(impact, keys)
    out = looked.join(rendered, keys, "left")
    hit = F.col("blast_radius").isNotNull()
    key = lambda name: F.lit(config.prefix + name)
    if config.enrich_labels:
        added = F.create_map(
            key("max_criticality"), F.col("max_criticality"),
            key("app_count"), F.col("app_count").cast("string"),
            key("customer_impact"), F.col("customer_impact").cast("string"),
        )
        out = out.withColumn("labels", F.when(hit, overlay(F.col("labels"), added)).otherwise(F.col("labels")))
    annotate = hit if config.enrich_resolved else hit & ~is_resolved(F.col("ends_at"), now)
    notes = F.create_map(key("impact"), F.col("impact"), key("blast_radius"), F.col("blast_radius"))
    own = F.coalesce(F.col("annotations"), F.expr("map()").cast("map<string,string>"))
    out = out.withColumn("annotations", F.when(annotate, overlay(own, notes)).otherwise(F.col("annotations")))
    status = (
        F.when(F.col("labels").isNull(), "error").when(F.col("mode").isNull(), "no_key")
        .when(hit, "enriched").otherwise("no_match")
    )
    return out.withColumn("enrich_status", status).select(*alerts.columns, "enrich_status")


def outcome_counts(enriched: DataFrame) -> DataFrame:
    """E5."""
    return enriched.groupBy("enrich_status").agg(F.count(F.lit(1)).alias("alerts"))


__all__ = [
    "EnrichConfig", "correlate", "render_labels", "render_annotations", "impact_lines", "lookup_alerts",
    "enrich_alerts", "outcome_counts", "IMPACT_COLUMNS",
]
