"""Sources, sinks and column functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hopledger.functions.identity import (
    KINDS, canonical_if_name, entity_hash, host_part, iface_label, interface_hash, key_safe, normalize_token, strict_int,
)
from hopledger.functions.text import criticality_rank, curated_list, escape_label_value, overlay, plural
from hopledger.functions.times import as_of_seconds, is_resolved, rfc3339
from hopledger.operators.catalog import harvest_interfaces
from hopledger.operators.series import keep_metrics, keep_scoped
from hopledger.plans import domain as d
from hopledger.plans.domain_sql import address, canonical, entity, host, rank, token
from hopledger.plans.registry import query
from hopledger.schemas import DECL_READ
from hopledger.sources.alerts import parse_alerts, rejected_bodies, render_alerts
from hopledger.sources.declarations import parse_texts, declarations_from_json
from hopledger.sources.samples import address_inventory, app_seed, attach_targets
from hopledger.sources.sinks import exposition_lines, stamp_tenant

PATTERN = "ifHC(In|Out)Octets|ALERTS"
SAMPLE_OUT = ["metric", "instance", "if_index", "if_name", "iface", "value", "unix_micros(ts) AS us"]
SAMPLE_SQL = "metric, instance, if_index, if_name, iface, value, us"


@query("keep_metrics", "S1", f"SELECT {SAMPLE_SQL} FROM samples WHERE regexp_full_match(metric, '{PATTERN}')", "samples")
def _(spark, sf_dir):
    return keep_metrics(d.samples(spark, sf_dir), PATTERN).selectExpr(*SAMPLE_OUT)


@query("keep_scoped", "S2", """
SELECT metric, instance, if_index, if_name, iface, value, us
FROM (SELECT * REPLACE (CASE WHEN alertname = 'HighErrors' THEN '' ELSE if_name END AS if_name) FROM samples)
WHERE metric IN ('ifHCInOctets', 'ifOperStatus') OR (metric = 'ALERTS' AND if_name <> '')
""", "samples")
def _(spark, sf_dir):
    unnamed = F.when(F.col("alertname") == "HighErrors", "").otherwise(F.col("if_name"))
    rows = d.samples(spark, sf_dir).withColumn("if_name", unnamed)
    return keep_scoped(rows, ["ifHCInOctets", "ifOperStatus"]).selectExpr(*SAMPLE_OUT)


@query("attach_targets", "S3", f"""
SELECT event_id, s_name AS device, {address('s_suppkey')} AS instance, value
FROM events JOIN supplier ON s_suppkey = user_id
""")
def _(spark, sf_dir):
    targets = d.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("target"), F.col("s_name").alias("hostname"), d.address(F.col("s_suppkey")).alias("ip")
    )
    rows = d.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("target"), "value")
    return attach_targets(rows, targets).select("event_id", "device", "instance", "value")


@query("harvest_interfaces", "S4 S5 V16", """
SELECT DISTINCT instance, device, if_name, if_descr, if_alias, if_index FROM parsed
""", "parsed")
def _(spark, sf_dir):
    raw = d.observed_rows(spark, sf_dir).withColumnRenamed("device", "hostname").withColumn("metric", F.lit("ifHCInOctets"))
    return harvest_interfaces(raw, "hostname")


@query("address_inventory", "S7", "SELECT ip, device FROM inventory", "inventory")
def _(spark, sf_dir):
    return address_inventory(d.device_extract(spark, sf_dir))


@query("app_seed", "S8", f"""
SELECT app_phash, name, 'SYS' || custkey AS sys_id, svc_phash FROM app_svc
""", "app_svc")
def _(spark, sf_dir):
    key = F.col("c_custkey")
    extract = d.table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), d.service_name(key).alias("service"),
        F.concat(F.lit("SYS"), key.cast("string")).alias("sys_id"),
    )
    seed = app_seed(extract)
    return seed["app"].join(seed["runs_as"], "app_phash")


@query("parse_declarations", "S6", """
SELECT 'c-' || c_custkey AS file, CASE WHEN c_custkey % 8 <> 0 THEN c_name END AS app,
       CASE WHEN c_custkey % 8 <> 0 THEN c_mktsegment END AS owner,
       CASE WHEN c_custkey % 8 <> 0 THEN 'Te0/0/' || c_nationkey END AS second_hop,
       c_custkey % 8 <> 0 AS parsed FROM customer
""")
def _(spark, sf_dir):
    """A YAML file per customer; one in eight has a misspelt key, is empty or is no mapping."""
    key = F.col("c_custkey")
    good = F.format_string(
        "app: '%s'\nruns_as: svc-%d  # comment\nowner: %s\nconsumed_by_customers: [acme, globex]\ndepends_on:\n"
        "  - to: ledger\n    path:\n      hops:\n        - {device: r-%d, if: uplink, direction: egress}\n"
        "        - {device: r-%d, if: 'Te0/0/%d', direction: ingress}\n",
        "c_name", "c_custkey", "c_mktsegment", "c_nationkey", "c_nationkey", "c_nationkey")
    bad = F.when(key % 24 == 0, F.concat(good, F.lit("runz_as: x\n"))).when(key % 24 == 8, "# nothing\n").otherwise("- a\n")
    texts = d.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c-"), key.cast("string")).alias("file"), F.when(key % 8 == 0, bad).otherwise(good).alias("value"))
    read = parse_texts(texts.repartition("file"))
    second = F.col("depends_on")[0]["path"]["hops"][1]["if"]
    return read.select("file", "app", "owner", second.alias("second_hop"), F.col("parse_error").isNull().alias("parsed"))


FAULTS = """
CASE WHEN part % 5 = 0 THEN 'declaration: unknown key ''runz_as'''
     WHEN part % 7 = 1 AND dep_count > 0 THEN array_to_string(
       ['declaration.depends_on[' || i || ']: unknown key ''too''' FOR i IN range(dep_count)], '; ')
     WHEN part % 11 = 2 AND dep_count > 0 THEN
       CASE WHEN part % 37 <> 0 THEN 'declaration.depends_on[0].path.hops: expected a list; ' ELSE '' END
       || 'declaration.depends_on[1].paths[0].hops: expected a list; declaration.depends_on[1].paths[1].hops: expected a list'
     WHEN part % 13 = 3 THEN 'declaration.owner: expected text' END
"""


@query("declarations_from_json", "S6", f"""
SELECT file, CASE WHEN parse_error IS NULL THEN app END AS app, CASE WHEN parse_error IS NULL THEN dep_count ELSE 0 END AS dep_count,
       parse_error FROM (SELECT *, {FAULTS} AS parse_error FROM doc)
""", "doc")
def _(spark, sf_dir):
    """Each declaration as JSON text, some with faults at one level or another."""
    fields = [f for f in DECL_READ.names if f not in ("file", "parse_error")]
    part, value = F.split_part("file", F.lit("-"), F.lit(4)).cast("bigint"), F.col("value")
    typo = F.when(part % 5 == 0, F.lit("x")).alias("runz_as")
    rows = d.declarations(spark, sf_dir).select("file", F.to_json(F.struct(*fields, typo)).alias("value"))
    spoilt = (
        F.when(part % 5 == 0, value)
        .when((part % 7 == 1) & value.contains('"to":'), F.replace(value, F.lit('"to":'), F.lit('"too":')))
        .when((part % 11 == 2) & value.contains('"to":'), F.regexp_replace(value, '"hops":\\[[^\\]]*\\]', '"hops":3'))
        .when(part % 13 == 3, F.regexp_replace(value, '"owner":("[^"]*")', '"owner":[$1]')).otherwise(value)
    )
    return declarations_from_json(rows.withColumn("value", spoilt)).select(
        "file", "app", F.size(F.coalesce("depends_on", F.array())).cast("bigint").alias("dep_count"), "parse_error")


def _bodies(spark, sf_dir):
    """Each alert as a posted JSON array."""
    alert = F.struct("labels", "annotations", F.col("starts_at").alias("startsAt"), F.col("ends_at").alias("endsAt"),
                     F.col("alert_id").alias("id"))
    return d.alerts(spark, sf_dir).select(F.concat(F.lit("["), F.to_json(alert), F.lit("]")).alias("value"))


@query("parse_alerts", "S9", f"""
SELECT alert_id, CASE kind WHEN 0 THEN device WHEN 1 THEN device WHEN 3 THEN device END AS instance,
       CASE kind WHEN 0 THEN CAST(if_index AS VARCHAR) WHEN 3 THEN 'x7' END AS if_index,
       'event ' || alert_id AS summary, resolved FROM keyed
""", "keyed")
def _(spark, sf_dir):
    label = lambda m, k: F.try_element_at(m, F.lit(k))
    return parse_alerts(_bodies(spark, sf_dir)).select(
        F.get_json_object("raw", "$.id").cast("bigint").alias("alert_id"), label("labels", "instance").alias("instance"),
        label("labels", "ifIndex").alias("if_index"), label("annotations", "summary").alias("summary"),
        (F.col("ends_at") < "2010").alias("resolved"),
    )


@query("alert_rejects", "S9", """
SELECT alert_id, CASE alert_id % 4 WHEN 1 THEN 'not an array of alerts' WHEN 2 THEN 'malformed' ELSE 'empty' END AS reason
FROM keyed WHERE alert_id % 4 <> 0
""", "keyed")
def _(spark, sf_dir):
    """Each alert posted as an array, as a bare object, cut off, or not at all; the first alone can be read."""
    alert = F.to_json(F.struct("labels", "annotations", F.col("alert_id").alias("id")))
    how = F.col("alert_id") % 4
    body = F.when(how == 0, F.concat(F.lit("["), alert, F.lit("]"))).when(how == 1, alert).when(how == 2, F.concat(F.lit("["), alert))
    bodies = d.alerts(spark, sf_dir).select("alert_id", body.alias("value"))
    return rejected_bodies(bodies).select("alert_id", "reason")


@query("render_alerts", "K3", """
SELECT alert_id, 'event ' || alert_id AS summary, resolved,
       CASE WHEN no_start THEN 'not-a-time' ELSE strftime(to_timestamp(at_s) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') END AS starts_at
FROM keyed
""", "keyed")
def _(spark, sf_dir):
    out = render_alerts(parse_alerts(_bodies(spark, sf_dir)))
    read = lambda path: F.get_json_object("value", path)
    return out.select(read("$.id").cast("bigint").alias("alert_id"), read("$.annotations.summary").alias("summary"),
                      (read("$.endsAt") < "2010").alias("resolved"), read("$.startsAt").alias("starts_at"))


@query("tenant_series", "K1", """
SELECT app, service, t_s, round(value * TIE, 6) AS value, 'tenant-a' AS tenant FROM path_hops_down
""", "path_hops_down")
def _(spark, sf_dir):
    series = d.health(spark, sf_dir).series("path_hops_down")
    return stamp_tenant(d.seconds(series), "tenant-a")


@query("exposition_lines", "K2 M2 F10", """
SELECT 'interface_app{app="' || app || '",service="' || service || '",device="' || device || '",ifName="' || if_name
       || '",instance="' || instance || '",ifIndex="' || if_index || '",iface="' || iface
       || '",direction="' || direction || '"} 1' AS value FROM mapping
""", "mapping")
def _(spark, sf_dir):
    return exposition_lines(d.mapping(spark, sf_dir))


@query("name_functions", "F3 F4 F5 F6 F7 F8 F9 P0", f"""
SELECT ord, {host('instance')} AS host, {token('if_descr')} AS token, {canonical('if_name')} AS canonical,
       NOT contains(if_name, ':') AS safe, {entity('interface', token('device'), canonical('if_name'))} AS phash,
       CASE WHEN regexp_matches(if_index_raw, '^[+-]?[0-9]+$') THEN CAST(if_index_raw AS BIGINT) END AS if_index,
       instance || ':' || if_index_raw AS iface FROM observed
""", "observed")
def _(spark, sf_dir):
    c = F.col
    return d.observed_rows(spark, sf_dir).select(
        "ord", host_part(c("instance")).alias("host"), normalize_token(c("if_descr")).alias("token"),
        canonical_if_name(c("if_name")).alias("canonical"), key_safe(c("if_name")).alias("safe"),
        normalize_token(c("device")).alias("_device"), strict_int(c("if_index_raw")).alias("if_index"),
        iface_label(c("instance"), c("if_index_raw")).alias("iface"),
    ).withColumn("phash", interface_hash(c("_device"), c("canonical"))).drop("_device")


@query("entity_hashes", "F1 F2", " UNION ALL ".join(
    f"SELECT c_custkey AS custkey, '{kind}' AS kind, {entity(kind, 'c_name', 'c_mktsegment')} AS phash FROM customer"
    for kind in KINDS
))
def _(spark, sf_dir):
    name, segment = F.concat(F.lit(" "), F.upper("c_name")), F.col("c_mktsegment")
    hashes = F.array(*[
        F.struct(F.lit(kind).alias("kind"), entity_hash(kind, name, segment).alias("phash")) for kind in KINDS
    ])
    return d.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.explode(hashes).alias("_h")).select(
        "custkey", "_h.kind", "_h.phash"
    )


@query("escape_texts", "F10", """
SELECT doc_id, md5(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n')) AS digest
FROM documents
""")
def _(spark, sf_dir):
    return d.table(spark, sf_dir, "documents").select("doc_id", F.md5(escape_label_value(F.col("text"))).alias("digest"))


@query("text_functions", "F11 F12 F18", f"""
SELECT custkey, {rank('criticality')} AS rank,
       CASE WHEN nationkey = 1 THEN '1 app' ELSE nationkey || ' apps' END AS counted,
       name || '|' || owner || CASE WHEN owner = service THEN '' ELSE '|' || service END AS curated FROM apps
""", "apps")
def _(spark, sf_dir):
    key = F.col("c_custkey")
    text = F.concat_ws(",", F.concat(F.lit(" "), "c_name"), F.lit(" "), "c_mktsegment", F.concat("c_name", F.lit("\t")),
                       F.lit(""), d.service_name(key))
    rows = d.table(spark, sf_dir, "customer")
    criticality = F.when(key % 7 == 0, "Critical").when(key % 9 == 0, "").otherwise(
        F.concat(F.lit("TIER-"), (key % 5 + 1).cast("string")))
    return rows.select(
        key.alias("custkey"), criticality_rank(criticality).alias("rank"),
        plural(F.col("c_nationkey"), "app").alias("counted"), F.array_join(curated_list(text), "|").alias("curated"),
    )


@query("time_functions", "F14 F15 P02", f"""
SELECT o_orderkey AS orderkey,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(epoch(o_orderdate) AS BIGINT) - 7200 END AS instant,
       CASE WHEN o_orderkey % 10 = 0 THEN false ELSE CAST(epoch(o_orderdate) AS BIGINT) - 7200 < {d.THEN_S} END AS resolved,
       CASE o_orderkey % 4 WHEN 0 THEN CAST(epoch(o_orderdate) AS BIGINT) WHEN 1 THEN {d.NOW_S} END AS at_s
FROM orders
""")
def _(spark, sf_dir):
    key, at_s = F.col("o_orderkey"), F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    text = F.when(key % 10 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
    at = F.when(key % 4 == 0, at_s.cast("string")).when(key % 4 == 1, "").when(key % 4 == 2, "4102444801").otherwise("soon")
    rows = d.table(spark, sf_dir, "orders")
    return rows.select(
        key.alias("orderkey"), F.unix_seconds(rfc3339(text)).alias("instant"),
        is_resolved(text, F.timestamp_seconds(F.lit(d.THEN_S))).alias("resolved"),
        as_of_seconds(at, F.lit(d.NOW_S).cast("bigint")).alias("at_s"),
    )


@query("map_overlay", "F13", """
SELECT c_custkey AS custkey, c_mktsegment AS kept,
       CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS shared,
       CASE WHEN c_custkey % 2 = 0 THEN c_name END AS added FROM customer
""")
def _(spark, sf_dir):
    base = F.create_map(F.lit("kept"), F.col("c_mktsegment"), F.lit("shared"), F.lit("old"))
    empty = F.expr("map()").cast("map<string,string>")
    top = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("shared"), F.lit("new"), F.lit("added"), F.col("c_name")))
    merged = overlay(base, top.otherwise(empty))
    get = lambda k: F.try_element_at("_m", F.lit(k)).alias(k)
    return d.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), merged.alias("_m")).select(
        "custkey", get("kept"), get("shared"), get("added")
    )
