"""Catalog and declarations over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hopledger.operators import catalog as c
from hopledger.operators import declare as dc
from hopledger.operators.load import DECLARED, graph_of, load_batch
from hopledger.operators.topology import impact_at
from hopledger.plans import domain as d
from hopledger.plans.domain_sql import (
    MATCHES, declared_device, declared_ref, entity, resolution, short_name,
)
from hopledger.plans.registry import fragment, query

OUT = "phash, device, if_name, metric_if_name, if_descr, if_alias, instance, vendor, if_index, observed_at"


@query("build_catalog", "C1 P00", f"SELECT {OUT}, ord FROM good", "good")
def _(spark, sf_dir):
    return d.built(spark, sf_dir)[0]


@query("catalog_rejects", "C1", "SELECT ord, instance, device, if_name, reason FROM judged WHERE reason IS NOT NULL", "judged")
def _(spark, sf_dir):
    return d.built(spark, sf_dir)[1].select("ord", "instance", "device", "if_name", "reason")


@query("identity_collisions", "C2", """
SELECT g.phash, g.device, g.if_name, f.instance AS first_instance, g.instance AS other_instance
FROM (SELECT DISTINCT phash, device, if_name, instance FROM good) g
JOIN (SELECT phash, arg_min(instance, ord) AS instance FROM good GROUP BY phash) f ON f.phash = g.phash
WHERE f.instance <> g.instance
""", "good")
def _(spark, sf_dir):
    return c.identity_collisions(d.built(spark, sf_dir)[0])


@query("latest_per_identity", "C3", f"SELECT {OUT} FROM catalog", "catalog")
def _(spark, sf_dir):
    return c.latest_per_identity(d.built(spark, sf_dir)[0])


@query("refresh_catalog", "C4 T1", f"""
SELECT phash, device, if_name, metric_if_name, if_descr, if_alias, instance,
       CASE WHEN if_index % 2 = 0 THEN 'renewed' ELSE vendor END AS vendor,
       CASE WHEN if_index % 2 = 0 THEN if_index + 100 ELSE if_index END AS if_index, observed_at
FROM catalog
UNION ALL
SELECT {entity('interface', "'standby-' || device", 'if_name')}, 'standby-' || device, if_name, metric_if_name, if_descr, if_alias, instance,
       'renewed', if_index + 100, observed_at
FROM catalog WHERE if_index % 2 <> 0
""", "catalog")
def _(spark, sf_dir):
    """A second harvest of the whole catalog: half of the interfaces are known and get a new index, half stand on devices not seen before."""
    known = d.catalog(spark, sf_dir)
    device = F.when(F.col("if_index") % 2 == 0, F.col("device")).otherwise(F.concat(F.lit("standby-"), F.col("device")))
    new = known.withColumns({"vendor": F.lit("renewed"), "device": device}).withColumns({
        "phash": c.interface_hash(F.col("device"), F.col("if_name")), "if_index": F.col("if_index") + 100})
    return c.refresh_catalog(known, new)


@query("oldest_observation", "C5", "SELECT min(observed_at) AS oldest_observed_at FROM catalog WHERE observed_at <> 0", "catalog")
def _(spark, sf_dir):
    return c.oldest_observation(d.catalog(spark, sf_dir))


@query("interfaces_by_hash", "C6", f"""
SELECT {OUT} FROM catalog WHERE phash IN (
  SELECT {entity('interface', "lower(printf('Supplier#%09d', s_suppkey))", "'tengige0/0/1'")} FROM supplier)
""", "catalog")
def _(spark, sf_dir):
    name = F.lower(d.device_name(F.col("s_suppkey")))
    wanted = d.table(spark, sf_dir, "supplier").select(c.interface_hash(name, F.lit("tengige0/0/1")).alias("phash"))
    return c.interfaces_by_hash(d.catalog(spark, sf_dir), wanted)


@query("catalog_table", "C7 K4", f"SELECT {OUT} FROM catalog", "catalog")
def _(spark, sf_dir):
    return d.catalog(spark, sf_dir)


@query("resolve_refs", "C8", "SELECT device, ref, status, phash FROM resolved", "resolved")
def _(spark, sf_dir):
    return c.resolve_refs(d.lineitem_hops(spark, sf_dir), d.catalog(spark, sf_dir))


@query("suggestions", "C9", """
SELECT device, rank, metric_if_name FROM (
  SELECT device, metric_if_name, CAST(row_number() OVER (PARTITION BY device ORDER BY metric_if_name, phash) AS INTEGER) AS rank
  FROM catalog) WHERE rank <= 8
""", "catalog")
def _(spark, sf_dir):
    return c.suggestions(d.catalog(spark, sf_dir))


@query("suggestion_lists", "C9", """
SELECT device, string_agg(metric_if_name, ',' ORDER BY metric_if_name) AS suggestions FROM (
  SELECT device, metric_if_name, row_number() OVER (PARTITION BY device ORDER BY metric_if_name, phash) AS rank
  FROM catalog) WHERE rank <= 8 GROUP BY device
""", "catalog")
def _(spark, sf_dir):
    return c.suggestion_lists(d.catalog(spark, sf_dir)).select("device", F.array_join("suggestions", ",").alias("suggestions"))


@query("ambiguous_matches", "C10", f"""
SELECT r.device, r.ref, c.phash, c.metric_if_name FROM resolved_refs r JOIN spelled c ON {MATCHES}
JOIN resolved s ON s.device = r.device AND s.ref = r.ref AND s.status = 'ambiguous'
""", "resolved_refs spelled resolved")
def _(spark, sf_dir):
    return c.ambiguous_matches(d.lineitem_hops(spark, sf_dir), d.catalog(spark, sf_dir))


# Declarations: one document per lineitem, two dependencies each.

fragment("doc", f"""
SELECT 'decl-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS file,
       CASE WHEN l_partkey % 59 = 0 THEN ' '
            ELSE (CASE WHEN l_linenumber % 2 = 0 THEN 'App-' ELSE 'app-' END) || l_orderkey END AS app,
       CASE WHEN l_partkey % 47 = 0 THEN '' ELSE 'run-' || (l_orderkey % 1000) END AS runs_as,
       'team-' || (l_suppkey % 9) AS owner, 'tier-' || (l_partkey % 5 + 1) AS criticality,
       CASE WHEN l_partkey % 67 = 0 THEN 0 ELSE 2 END AS dep_count,
       CASE WHEN l_partkey % 53 = 0 THEN 1 WHEN l_partkey % 3 = 0 THEN 2 ELSE 0 END AS customer_count,
       l_partkey AS part, l_suppkey AS n, CAST(l_linenumber AS BIGINT) AS ln,
       CASE WHEN l_partkey % 43 = 0 AND l_linenumber = 6 THEN 'sideways'
            ELSE CASE l_returnflag WHEN 'A' THEN 'ingress' WHEN 'N' THEN 'transit' ELSE 'egress' END END AS side
FROM lineitem
""")
fragment("doc_dep", """
SELECT *, 0 AS dep_ix, CASE WHEN part % 61 = 0 THEN ' ' ELSE 'dep-' || (part % 50) END AS target FROM doc WHERE dep_count = 2
UNION ALL SELECT *, 1, 'far-' || (part % 7) FROM doc WHERE dep_count = 2
""", "doc")
fragment("doc_path", """
SELECT *, 0 AS path_ix, CASE WHEN part % 41 = 0 THEN 0 ELSE 2 END AS hop_count FROM doc_dep WHERE dep_ix = 0 AND part % 37 <> 0
UNION ALL SELECT *, 0, 1 FROM doc_dep WHERE dep_ix = 1
UNION ALL SELECT *, 1, 2 FROM doc_dep WHERE dep_ix = 1
""", "doc_dep")
fragment("doc_hop", f"""
SELECT *, {declared_device('n')} AS device,
       CASE WHEN seq = CASE WHEN dep_ix = 0 THEN 1 WHEN path_ix = 1 THEN 2 ELSE 0 END
            THEN {declared_ref('n', 'ln', 'part')} ELSE {short_name('n', 'ln')} END AS ref
FROM (SELECT *, 1 AS seq FROM doc_path WHERE hop_count >= 1 UNION ALL SELECT *, 2 FROM doc_path WHERE hop_count = 2)
""", "doc_path")
resolution("doc_resolved", "doc_hop")

fragment("doc_errors", """
SELECT file, app, NULL AS dep, NULL AS path_ix, 'empty_app' AS code, '' AS detail FROM doc WHERE trim(app) = ''
UNION ALL SELECT file, app, NULL, NULL, 'empty_runs_as', '' FROM doc WHERE trim(runs_as) = ''
UNION ALL SELECT file, app, NULL, NULL, 'unsafe_customer', 'cust:bad' FROM doc WHERE part % 53 = 0
UNION ALL SELECT file, app, target, NULL, 'empty_dep', '' FROM doc_dep WHERE trim(target) = ''
UNION ALL SELECT file, app, target, NULL, 'no_path', '' FROM doc_dep WHERE dep_ix = 0 AND part % 37 = 0
UNION ALL SELECT file, app, target, path_ix, 'empty_hops', '' FROM doc_path WHERE hop_count = 0
UNION ALL SELECT file, app, target, path_ix, 'bad_direction', side FROM doc_hop WHERE side = 'sideways'
UNION ALL SELECT h.file, h.app, h.target, h.path_ix,
                 CASE r.status WHEN 'no_match' THEN 'unresolved_hop' ELSE 'ambiguous_hop' END, h.device || '/' || h.ref
          FROM doc_hop h JOIN doc_resolved r ON r.device = h.device AND r.ref = h.ref WHERE r.status <> 'ok'
""", "doc", "doc_dep", "doc_path", "doc_hop", "doc_resolved")
fragment("doc_claims", f"""
SELECT file, app, {entity('application', 'app')} AS app_phash FROM doc
WHERE file NOT IN (SELECT file FROM doc_errors)
""", "doc", "doc_errors")
fragment("doc_all_errors", """
SELECT file, app, dep, path_ix, code, detail FROM doc_errors
UNION ALL SELECT c.file, c.app, NULL, NULL, 'duplicate_app', f.file FROM doc_claims c
JOIN (SELECT app_phash, min(file) AS file FROM doc_claims GROUP BY 1) f ON f.app_phash = c.app_phash AND f.file < c.file
""", "doc_errors", "doc_claims")


@query("explode_declarations", "D1 F17", """
SELECT file, app, runs_as, dep_ix, target AS "to", path_ix, seq, device, ref, side AS direction FROM doc_hop
""", "doc_hop")
def _(spark, sf_dir):
    return dc.explode_declarations(d.declarations(spark, sf_dir))


@query("validate_declarations", "D2", "SELECT file, app, dep, path_ix, code, detail FROM doc_errors", "doc_errors")
def _(spark, sf_dir):
    return dc.validate_declarations(d.declarations(spark, sf_dir), d.catalog(spark, sf_dir))


@query("duplicate_apps", "D3", f"""
SELECT x.file, x.app, NULL::VARCHAR AS dep, NULL::INTEGER AS path_ix, 'duplicate_app' AS code, y.file AS detail
FROM (SELECT file, app, {entity('application', 'app')} AS h FROM doc) x
JOIN (SELECT {entity('application', 'app')} AS h, min(file) AS file FROM doc GROUP BY 1) y ON x.h = y.h AND x.file > y.file
""", "doc")
def _(spark, sf_dir):
    return dc.duplicate_apps(d.declarations(spark, sf_dir))


@query("shared_names", "D2", f"""
SELECT x.file, x.app, NULL::VARCHAR AS dep, NULL::INTEGER AS path_ix, 'shared_service' AS code, x.runs_as AS detail
FROM doc x JOIN (SELECT lower(trim(runs_as)) AS s FROM doc GROUP BY 1
                 HAVING count(DISTINCT lower(trim(app))) > 1) y ON y.s = lower(trim(x.runs_as))
""", "doc")
def _(spark, sf_dir):
    return dc.shared_names(d.declarations(spark, sf_dir))


def _errors(spark, sf_dir):
    return d.stored(spark, sf_dir, "declaration_errors", lambda: dc.batch_errors(
        d.declarations(spark, sf_dir), d.catalog(spark, sf_dir)))


@query("batch_errors", "D3 D4", "SELECT file, app, dep, path_ix, code, detail FROM doc_all_errors", "doc_all_errors")
def _(spark, sf_dir):
    return dc.batch_errors(d.declarations(spark, sf_dir), d.catalog(spark, sf_dir))


@query("batch_status", "D4", """
SELECT (SELECT count(DISTINCT file) FROM doc) AS files, count(*) AS errors, count(DISTINCT file) AS bad_files,
       count(*) > 0 AS failed FROM doc_all_errors
""", "doc doc_all_errors")
def _(spark, sf_dir):
    return dc.batch_status(d.declarations(spark, sf_dir), _errors(spark, sf_dir))


@query("loadable_declarations", "D4 D5", """
SELECT file, app, runs_as, 899251200 AS at_s FROM doc WHERE file NOT IN (SELECT file FROM doc_all_errors)
""", "doc doc_all_errors")
def _(spark, sf_dir):
    good = dc.loadable(d.declarations(spark, sf_dir), _errors(spark, sf_dir))
    return dc.stamp_batch(good, d.THEN_S).select("file", "app", "runs_as", "at_s")


fragment("good_doc", f"""
SELECT *, {entity('appservice', 'runs_as')} AS svc_phash FROM doc WHERE file NOT IN (SELECT file FROM doc_all_errors)
""", "doc", "doc_all_errors")
fragment("good_conn", f"""
SELECT p.*, {entity('application', 'p.app')} AS app_phash,
       {entity('connection', 'p.svc_phash', 'p.to_svc_phash', "'batch'", '899251200')} AS conn_phash
FROM (SELECT g.svc_phash, x.*, {entity('appservice', 'x.target')} AS to_svc_phash
      FROM doc_path x JOIN good_doc g ON g.file = x.file) p
""", "good_doc", "doc_path")


def _revised(spark, sf_dir, hops=True):
    good = dc.loadable(d.declarations(spark, sf_dir), _errors(spark, sf_dir), hops=hops)
    return good.withColumns({
        "source": F.lit("batch"), "valid_from": F.lit(d.THEN_S).cast("bigint"), "valid_to": F.lit(None).cast("bigint"),
    })


@query("declared_takes", "D6 D8", f"""
SELECT DISTINCT app_phash, svc_phash, to_svc_phash, conn_phash, {entity('path', 'conn_phash', 'path_ix')} AS path_phash,
       899251200 AS valid_from, 'declared' AS provenance, CAST(1 AS DOUBLE) AS confidence FROM good_conn
""", "good_conn")
def _(spark, sf_dir):
    edges = dc.dependency_edges(_revised(spark, sf_dir, hops=False), d.catalog(spark, sf_dir))
    return edges["takes"].select("app_phash", "svc_phash", "to_svc_phash", "conn_phash", "path_phash", "valid_from",
                                 "provenance", "confidence")


@query("declared_hops", "D8", f"""
SELECT DISTINCT {entity('path', 'c.conn_phash', 'c.path_ix')} AS path_phash, h.seq, h.side AS direction,
       r.phash AS iface_phash
FROM good_conn c JOIN doc_hop h ON h.file = c.file AND h.dep_ix = c.dep_ix AND h.path_ix = c.path_ix
JOIN doc_resolved r ON r.device = h.device AND r.ref = h.ref AND r.status = 'ok'
""", "good_conn doc_hop doc_resolved")
def _(spark, sf_dir):
    # The references of all files need no search for the good ones, which is the dear part.
    refs = dc.explode_declarations(d.declarations(spark, sf_dir))
    return dc.dependency_edges(_revised(spark, sf_dir), d.catalog(spark, sf_dir), refs)["hop"]


@query("declared_customers", "D7 D8", f"""
SELECT DISTINCT {entity('customer', 'customer')} AS cust_phash, customer,
       {entity('businessservice', 'customer', 'app')} AS bs_phash, svc_phash
FROM (SELECT *, 'acme' AS customer FROM good_doc WHERE customer_count = 2
      UNION ALL SELECT *, 'cust-' || (part % 10) FROM good_doc WHERE customer_count = 2)
""", "good_doc")
def _(spark, sf_dir):
    return dc.app_edges(_revised(spark, sf_dir))["consumes"]


# Two batches: all declarations first; then those of orders with 1 or 2 as rest of three, the former without dependencies.

fragment("batch_doc", f"""
SELECT g.*, CAST(split_part(file, '-', 2) AS BIGINT) % 3 AS turn, {entity('application', 'app')} AS app_phash FROM good_doc g
""", "good_doc")
fragment("batch_conn", f"""
SELECT p.*, {entity('connection', 'p.svc_phash', 'p.to_svc_phash', 'p.source', 'p.valid_from')} AS conn_phash
FROM (SELECT x.*, g.svc_phash, g.app_phash, {entity('appservice', 'x.target')} AS to_svc_phash, v.*
      FROM doc_path x JOIN batch_doc g ON g.file = x.file
      JOIN (SELECT 'first' AS source, {d.THEN_S} AS valid_from, {d.NOW_S} AS valid_to
            UNION ALL SELECT 'second', {d.NOW_S}, NULL) v ON v.source = 'first' OR g.turn = 2) p
""", "batch_doc", "doc_path")
fragment("batch_hop", f"""
SELECT DISTINCT {entity('path', 'c.conn_phash', 'c.path_ix')} AS path_phash, h.seq, h.side AS direction, r.phash AS iface_phash,
       c.svc_phash, c.valid_from, c.valid_to
FROM batch_conn c JOIN doc_hop h ON h.file = c.file AND h.dep_ix = c.dep_ix AND h.path_ix = c.path_ix
JOIN doc_resolved r ON r.device = h.device AND r.ref = h.ref AND r.status = 'ok'
""", "batch_conn", "doc_hop", "doc_resolved")


def _second(spark, sf_dir):
    """The second batch: only files that loaded before, so it has no errors of its own. A table, since loading reads it many times."""
    return d.stored(spark, sf_dir, "batch_decl_2", lambda: _second_declarations(spark, sf_dir))


def _second_declarations(spark, sf_dir):
    good = _first_log(spark, sf_dir).select(*DECLARED)
    turn = F.split_part("file", F.lit("-"), F.lit(2)).cast("bigint") % 3
    emptied = F.when(turn == 1, F.slice("depends_on", 1, 0)).otherwise(F.col("depends_on"))
    return good.filter(turn > 0).withColumn("depends_on", emptied)


def _first_log(spark, sf_dir):
    return d.stored(spark, sf_dir, "batch_log_1", lambda: load_batch(
        d.declarations(spark, sf_dir), d.catalog(spark, sf_dir), None, d.THEN_S, "first", _errors(spark, sf_dir)).log)


def _loaded(spark, sf_dir):
    first = _first_log(spark, sf_dir)
    second = d.stored(spark, sf_dir, "batch_events_2", lambda: load_batch(
        _second(spark, sf_dir), d.catalog(spark, sf_dir), first, d.NOW_S, "second").events)
    return graph_of(first.unionByName(second), d.catalog(spark, sf_dir))


@query("load_batch_takes", "D8 T2 T3 T7", f"""
SELECT DISTINCT app_phash, svc_phash, to_svc_phash, conn_phash, {entity('path', 'conn_phash', 'path_ix')} AS path_phash, source,
       valid_from, valid_to FROM batch_conn
""", "batch_conn")
def _(spark, sf_dir):
    return _loaded(spark, sf_dir)[0].takes.select(
        "app_phash", "svc_phash", "to_svc_phash", "conn_phash", "path_phash", "source", "valid_from", "valid_to")


@query("load_batch_hops", "D8", "SELECT DISTINCT path_phash, seq, direction, iface_phash FROM batch_hop", "batch_hop")
def _(spark, sf_dir):
    return _loaded(spark, sf_dir)[0].hop.select("path_phash", "seq", "direction", "iface_phash")


@query("load_batch_impact", "Q2 D8", f"""
SELECT DISTINCT h.iface_phash, g.app, g.runs_as AS service, g.owner, coalesce(k.customer, '') AS customer, g.criticality
FROM batch_hop h JOIN batch_doc g ON g.svc_phash = h.svc_phash AND g.dep_count > 0
LEFT JOIN (SELECT svc_phash, 'acme' AS customer FROM batch_doc WHERE customer_count = 2 AND dep_count > 0
           UNION SELECT svc_phash, 'cust-' || (part % 10) FROM batch_doc WHERE customer_count = 2 AND dep_count > 0) k
  ON k.svc_phash = g.svc_phash
WHERE {d.NOW_S} - 1 >= h.valid_from AND (h.valid_to IS NULL OR {d.NOW_S} - 1 < h.valid_to)
""", "batch_hop batch_doc")
def _(spark, sf_dir):
    return impact_at(_loaded(spark, sf_dir)[0], d.NOW_S - 1)


@query("load_batch_retractions", "T5 T6", f"""
SELECT app_phash, {d.NOW_S} AS close_at, 'open' AS gate FROM batch_doc WHERE dep_count > 0 AND turn = 0
""", "batch_doc")
def _(spark, sf_dir):
    """The second batch retracts what it leaves out; the same batch with its faulty files retracts nothing."""
    log, whole = _first_log(spark, sf_dir), d.declarations(spark, sf_dir)
    turn = F.split_part("file", F.lit("-"), F.lit(2)).cast("bigint") % 3
    loads = load_batch(_second(spark, sf_dir), d.catalog(spark, sf_dir), log, d.NOW_S, "second")
    fails = load_batch(whole.filter(turn > 0), d.catalog(spark, sf_dir), log, d.NOW_S, "second", _errors(spark, sf_dir))
    gate = lambda rows, name: rows.select("app_phash", "close_at", F.lit(name).alias("gate"))
    return gate(loads.retracted, "open").unionByName(gate(fails.retracted, "closed"))
