"""Alert enrichment over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hopledger.operators import enrich as e
from hopledger.operators.topology import impact_asof
from hopledger.plans import domain as d
from hopledger.plans.registry import query


@query("correlate", "E1", "SELECT alert_id, mode, device, if_index, ref FROM keyed", "keyed")
def _(spark, sf_dir):
    return e.correlate(d.alerts(spark, sf_dir)).select(
        "alert_id", "mode", "device",
        F.when(F.col("mode") == "exact", F.col("if_index")).alias("if_index"), "ref")


@query("lookup_alerts", "E6 F14", "SELECT alert_id, mode, at_s, iface_phash FROM looked", "looked")
def _(spark, sf_dir):
    return d.looked(spark, sf_dir).select("alert_id", "mode", "at_s", "iface_phash")


def _impact(spark, sf_dir):
    looked = d.looked(spark, sf_dir).filter("iface_phash is not null")
    rows = impact_asof(d.topology(spark, sf_dir, *d.IMPACT), looked, d.exposed(spark, sf_dir))
    return looked.select("alert_id", "iface_phash", "at_s").join(rows, ["iface_phash", "at_s"])


@query("render_labels", "E2", """
SELECT alert_id, max_criticality, app_count, customers > 0 AS customer_impact FROM rendered
""", "rendered")
def _(spark, sf_dir):
    return e.render_labels(_impact(spark, sf_dir), ["alert_id"])


@query("render_annotations", "E3 F12", """
SELECT alert_id, 'apps affected (' || app_count || '):' || chr(10) || lines AS impact,
       app_count || CASE WHEN app_count = 1 THEN ' app, ' ELSE ' apps, ' END || customers
       || CASE WHEN customers = 1 THEN ' customer' ELSE ' customers' END AS blast_radius FROM rendered
""", "rendered")
def _(spark, sf_dir):
    return e.render_annotations(_impact(spark, sf_dir), ["alert_id"])


@query("impact_lines", "E3", """
SELECT alert_id, app, customer, '- ' || app || ' (' || service || ') owner ' || owner
       || CASE WHEN customer <> '' THEN ' customer ' || customer ELSE '' END
       || CASE WHEN criticality <> '' THEN ' [' || criticality || ']' ELSE '' END AS line FROM alert_impact
""", "alert_impact")
def _(spark, sf_dir):
    return e.impact_lines(_impact(spark, sf_dir), ["alert_id"])


ENRICHED_SQL = """
SELECT k.alert_id, CASE WHEN k.mode IS NULL THEN 'no_key' WHEN r.alert_id IS NULL THEN 'no_match' ELSE 'enriched' END AS enrich_status,
       r.max_criticality, CAST(r.app_count AS VARCHAR) AS app_count,
       CASE WHEN r.customers > 0 THEN 'true' WHEN r.customers = 0 THEN 'false' END AS customer_impact,
       CASE WHEN NOT k.resolved THEN 'apps affected (' || r.app_count || '):' || chr(10) || r.lines END AS impact,
       'event ' || k.alert_id AS summary
FROM keyed k LEFT JOIN rendered r ON r.alert_id = k.alert_id
"""


def enriched_columns(rows):
    label = lambda k: F.try_element_at("labels", F.lit(k)).alias(k)
    note = lambda k: F.try_element_at("annotations", F.lit(k)).alias(k)
    return rows.select("alert_id", "enrich_status", label("max_criticality"), label("app_count"),
                       label("customer_impact"), note("impact"), note("summary"))


def enriched(spark, sf_dir):
    now = F.timestamp_seconds(F.lit(d.NOW_S + 86400))
    alerts = d.alerts(spark, sf_dir)
    # a start that cannot be read is looked up at the reporting time of the checks
    start = F.when(F.col("starts_at") == "not-a-time", "2001-08-02T00:00:00Z").otherwise(F.col("starts_at"))
    rows = alerts.withColumn("starts_at", start)
    return e.enrich_alerts(d.topology(spark, sf_dir, *d.IMPACT), rows, now, exposed=d.exposed(spark, sf_dir))


@query("enrich_alerts", "E4 F13 F15", ENRICHED_SQL, "keyed rendered")
def _(spark, sf_dir):
    return enriched_columns(enriched(spark, sf_dir))


@query("outcome_counts", "E5", f"SELECT enrich_status, count(*) AS alerts FROM ({ENRICHED_SQL}) GROUP BY 1", "keyed rendered")
def _(spark, sf_dir):
    return e.outcome_counts(enriched(spark, sf_dir))
