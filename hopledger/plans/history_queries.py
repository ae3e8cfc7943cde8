"""History and topology over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hopledger.functions.identity import entity_hash
from hopledger.operators import history as h
from hopledger.operators.declare import batch_status
from hopledger.operators.dims import Dimensions, impact_dims_asof
from hopledger.operators import topology as tp
from hopledger.operators.increments import History, advance, begin
from hopledger.operators.mapping import curated_apps, in_mapping_order, live_mapping, mapping_series, without_direction
from hopledger.plans import domain as d
from hopledger.plans.domain_sql import (
    address, declared_device, declared_ref, resolution, valid,
)
from hopledger.plans.registry import fragment, query
from hopledger.session import checkpoint_folder
from hopledger.sources.sinks import read_version, write_version


@query("revisions", "T2 T3 T7", "SELECT app_key, orderkey, at_s, valid_from, valid_to FROM revision", "revision")
def _(spark, sf_dir):
    return h.revisions(d.history_events(spark, sf_dir)).select("app_key", "orderkey", "at_s", "valid_from", "valid_to")


@query("revisions_by_batch", "T2 T3", "SELECT app_key, orderkey, at_s, valid_from, valid_to FROM revision", "revision")
def _(spark, sf_dir):
    """The same history from four batches: three in time and one of late events, which are played again from their place."""
    events = d.history_events(spark, sf_dir)
    at, late = F.col("at_s"), F.col("orderkey") % 10 == 3
    number = F.when(late, 3).when(at < 788918400, 0).when(at < 852076800, 1).otherwise(2)
    folder = f"{checkpoint_folder(spark)}/history-{uuid.uuid4().hex}"
    known = begin(events)
    for batch in range(4):
        known = advance(known, events.filter(number == batch))
        parts = {name: getattr(known, name) for name in ("events", "state", "revisions")}
        for name, part in parts.items():
            write_version(part, f"{folder}/{name}")
        known = History(*(read_version(spark, f"{folder}/{name}") for name in parts))
    return known.revisions.select("app_key", "orderkey", "at_s", "valid_from", "valid_to")


@query("effective_closes", "T3", """
SELECT app_key, orderkey, at_s, CAST(eff AS BIGINT) AS eff FROM effective WHERE kind = 'close'
""", "effective")
def _(spark, sf_dir):
    rows = h.effective_events(d.history_events(spark, sf_dir)).df
    return rows.filter("kind = 'close'").select("app_key", "orderkey", "at_s", "eff")


@query("drop_unchanged", "T2", """
SELECT app_key, orderkey FROM (
  SELECT h.*, kind || ':' || o_orderpriority AS state,
         lag(kind || ':' || o_orderpriority) OVER (PARTITION BY custkey ORDER BY pos) AS before
  FROM history h JOIN orders ON o_orderkey = orderkey)
WHERE kind <> 'reload' OR before IS NULL OR before <> state
""", "history")
def _(spark, sf_dir):
    digests = d.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), "o_orderpriority")
    events = d.history_events(spark, sf_dir).join(digests, "orderkey")
    return h.drop_unchanged(events, "o_orderpriority").select("app_key", "orderkey")


EDGE = "app_phash, svc_phash, to_svc_phash, valid_from, valid_to, source"


@query("close_validity", "T3", f"""
SELECT c.app_phash, svc_phash, to_svc_phash, valid_from, source,
       CASE WHEN valid_to IS NULL AND a.custkey % 3 = 0
            THEN CASE WHEN {d.THEN_S} > valid_from THEN {d.THEN_S} ELSE valid_from + 1 END ELSE valid_to END AS valid_to
FROM connection c JOIN apps a ON a.app_phash = c.app_phash
""", "connection apps")
def _(spark, sf_dir):
    closes = d.table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(
        entity_hash("application", F.col("c_name")).alias("app_phash"), F.lit(d.THEN_S).cast("bigint").alias("close_at"))
    edges = h.close_validity(d.depends_on(spark, sf_dir), closes)
    return edges.select(*EDGE.split(", "))


@query("open_declared_apps", "T4", "SELECT DISTINCT app_phash FROM connection WHERE valid_to IS NULL", "connection")
def _(spark, sf_dir):
    return h.open_declared_apps(d.depends_on(spark, sf_dir))


def _present(spark, sf_dir):
    """Apps ordered for since the middle of the history."""
    recent = d.table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz"))
    return recent.select(d.app_hash(d.app_name(F.col("o_custkey"))).alias("app_phash")).distinct()


@query("retractions", "T5", f"""
SELECT DISTINCT app_phash, {d.NOW_S} AS close_at FROM connection WHERE valid_to IS NULL AND custkey NOT IN (
  SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '2001-01-01')
""", "connection")
def _(spark, sf_dir):
    return h.retractions(d.depends_on(spark, sf_dir), _present(spark, sf_dir), d.NOW_S)


# One batch is whole, the other holds a faulty file, so its gate stays closed.
BATCH = "SELECT count(*) AS files, count(*) FILTER ({bad}) > 0 AS failed FROM orders"


@query("batch_retractions", "T6", f"""
SELECT batch, app_phash, {d.NOW_S} AS close_at FROM (SELECT DISTINCT app_phash FROM connection WHERE valid_to IS NULL AND custkey NOT IN (
  SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '2001-01-01')) JOIN (
  SELECT 'whole' AS batch, * FROM ({BATCH.format(bad="WHERE o_orderstatus = 'X'")})
  UNION ALL SELECT 'faulty', * FROM ({BATCH.format(bad="WHERE o_orderstatus = 'P'")})) ON files > 0 AND NOT failed
""", "connection")
def _(spark, sf_dir):
    """The same history behind the gates of two batches of an order each a file, one of them with errors."""
    orders = d.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), "o_orderstatus")
    out = None
    for batch, bad in (("whole", "X"), ("faulty", "P")):
        status = batch_status(orders, orders.filter(F.col("o_orderstatus") == bad))
        gone = h.gated_retractions(d.depends_on(spark, sf_dir), _present(spark, sf_dir), d.NOW_S, status)
        part = gone.select(F.lit(batch).alias("batch"), "app_phash", "close_at")
        out = part if out is None else out.unionByName(part)
    return out


@query("keyed_upsert", "T1", """
SELECT app_phash, name, CASE WHEN custkey % 2 = 0 THEN 'new owner' ELSE owner END AS owner FROM apps
""", "apps")
def _(spark, sf_dir):
    old = d.apps(spark, sf_dir).select("app_phash", "name", "owner")
    even = d.table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0")
    new = even.select(entity_hash("application", F.col("c_name")).alias("app_phash"), F.col("c_name").alias("name"),
                      F.lit("new owner").alias("owner"))
    return h.keyed_upsert(old, new, ["app_phash"])


# Topology

PATH_SQL = """
SELECT DISTINCT {lead}, c.device, c.if_name, c.metric_if_name, c.instance, c.if_index, h.seq, h.direction,
       'declared' AS provenance, CAST(1 AS DOUBLE) AS confidence
FROM app_svc a JOIN takes t ON t.svc_phash = a.svc_phash JOIN hop h ON h.path_phash = t.path_phash
JOIN catalog c ON c.phash = h.iface_phash WHERE {when}
"""


@query("app_paths", "Q1 P01", PATH_SQL.format(lead="a.app_phash", when=valid(str(d.THEN_S))), "app_svc takes hop catalog")
def _(spark, sf_dir):
    return tp.in_path_order(tp.app_paths(d.topology(spark, sf_dir, *d.PATHS), d.THEN_S))


AT_SQL = "(800000000 + a.custkey % 1000 * 150000)"


@query("app_paths_asof", "Q1 P01", PATH_SQL.format(lead=f"a.app_phash, {AT_SQL} AS at_s", when=valid(AT_SQL)),
       "app_svc takes hop catalog")
def _(spark, sf_dir):
    key = F.col("c_custkey")
    wanted = d.table(spark, sf_dir, "customer").select(
        entity_hash("application", F.col("c_name")).alias("app_phash"),
        (F.lit(800000000) + key % 1000 * 150000).alias("at_s"))
    return tp.app_paths_asof(d.topology(spark, sf_dir, *d.PATHS), wanted)


@query("impact", "Q2", f"""
SELECT DISTINCT t.iface_phash, a.app, a.service, a.owner, a.customer, a.criticality
FROM exposed t JOIN affected a ON a.svc_phash = t.svc_phash WHERE {valid(str(d.THEN_S))}
""", "exposed affected")
def _(spark, sf_dir):
    return tp.impact_at(d.topology(spark, sf_dir), d.THEN_S)


IMPACT = "app, service, owner, customer, criticality"

fragment("event_at", f"""
SELECT event_id AS qid, user_id AS n, event_id % 7 + 1 AS ln, event_id,
       (CAST(floor(epoch(ts)) AS BIGINT) - {d.EVENTS_FROM}) * 80 + 788918400 AS at_s FROM events
""")


def _event_at():
    return (F.unix_seconds(F.col("ts").cast("timestamp")) - d.EVENTS_FROM) * 80 + 788918400


@query("impact_by_index", "Q3", f"""
SELECT q.qid, {IMPACT} FROM event_at q
JOIN indexed x ON x.instance = {address('q.n')} || ':9116' AND x.if_index = q.ln AND x.phash IS NOT NULL
JOIN (SELECT * FROM exposed) t ON t.iface_phash = x.phash AND {valid('q.at_s')}
JOIN affected a ON a.svc_phash = t.svc_phash GROUP BY ALL
""", "event_at indexed exposed affected")
def _(spark, sf_dir):
    queries = d.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("qid"), F.concat(d.address(F.col("user_id")), F.lit(":9116")).alias("instance"),
        (F.col("event_id") % 7 + 1).alias("if_index"), _event_at().alias("at_s"))
    return tp.impact_by_index(d.topology(spark, sf_dir, *d.IMPACT), queries, d.exposed(spark, sf_dir))


fragment("event_refs", f"""
SELECT qid, at_s, {declared_device('n')} AS device, {declared_ref('n', 'ln', 'event_id')} AS ref FROM event_at
""", "event_at")
resolution("event_resolved", "event_refs")


@query("impact_by_name", "Q4", f"""
SELECT q.qid, {IMPACT} FROM event_refs q
JOIN event_resolved r ON r.device = q.device AND r.ref = q.ref AND r.status = 'ok'
JOIN exposed t ON t.iface_phash = r.phash AND {valid('q.at_s')}
JOIN affected a ON a.svc_phash = t.svc_phash GROUP BY ALL
""", "event_refs event_resolved exposed affected")
def _(spark, sf_dir):
    n, ln = F.col("user_id"), F.col("event_id") % 7 + 1
    queries = d.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("qid"), d.declared_device(n).alias("device"),
        d.declared_ref(n, ln, F.col("event_id")).alias("ref"), _event_at().alias("at_s"))
    return tp.impact_by_name(d.topology(spark, sf_dir, *d.IMPACT), queries, d.exposed(spark, sf_dir))


fragment("request", f"""
SELECT o_orderkey AS qid, CAST(epoch(o_orderdate) AS BIGINT) AS at_s, o_orderkey % 5 AS kind, s.*
FROM orders JOIN (SELECT s_suppkey AS n, count(*) OVER () AS suppliers FROM supplier) s ON s.n = o_orderkey % s.suppliers
""")
fragment("request_refs", f"""
SELECT qid, {declared_device('n')} AS device, {declared_ref('n', '(qid % 7 + 1)', 'qid')} AS ref FROM request
WHERE kind IN (1, 4)
""", "request")
resolution("request_resolved", "request_refs")
fragment("request_target", f"""
SELECT q.qid, q.at_s, 'exact' AS mode, x.phash, CASE WHEN x.matches > 1 THEN 'ambiguous' WHEN x.matches = 1 THEN 'ok' ELSE 'none' END AS status
FROM request q LEFT JOIN indexed x ON x.instance = {address('q.n')} || ':9116' AND x.if_index = q.qid % 7 + 1 WHERE q.kind IN (0, 3)
UNION ALL
SELECT q.qid, q.at_s, 'name', r.phash, r.status FROM request q JOIN request_refs f ON f.qid = q.qid
JOIN request_resolved r ON r.device = f.device AND r.ref = f.ref WHERE q.kind = 1 OR (q.kind = 4 AND trim(f.ref) <> '')
""", "request", "indexed", "request_refs", "request_resolved")


@query("answer_requests", "Q5 Q6 P02 Q3 Q4", f"""
SELECT g.qid, g.mode,
       CASE WHEN g.status = 'no_match' THEN 'no interface matches' WHEN g.status = 'ambiguous' THEN 'ambiguous interface reference'
            WHEN a.app IS NULL THEN 'no path known' END AS note,
       a.app, a.service, a.owner, a.customer, a.criticality
FROM (SELECT * FROM request_target WHERE mode = 'exact' OR qid NOT IN (SELECT qid FROM request_refs WHERE trim(ref) = '')) g
LEFT JOIN (SELECT iface_phash, svc_phash, valid_from, valid_to FROM exposed) t ON t.iface_phash = g.phash AND {valid('g.at_s')}
LEFT JOIN affected a ON a.svc_phash = t.svc_phash GROUP BY ALL
UNION ALL
SELECT qid, CASE WHEN kind = 2 THEN CASE WHEN qid % 2 = 0 THEN 'invalid at' ELSE 'invalid ifIndex' END ELSE 'invalid' END AS mode,
       CASE WHEN kind = 2 THEN CASE WHEN qid % 2 = 0 THEN 'invalid at' ELSE 'invalid ifIndex' END ELSE 'invalid' END,
       NULL, NULL, NULL, NULL, NULL
FROM request WHERE kind = 2 OR qid IN (SELECT qid FROM request_refs WHERE trim(ref) = '')
""", "request request_refs request_target exposed affected")
def _(spark, sf_dir):
    asked = d.stored(spark, sf_dir, "requests", lambda: _requests(spark, sf_dir))
    now_s = F.lit(d.NOW_S).cast("bigint")
    return tp.answer_requests(d.topology(spark, sf_dir, *d.IMPACT), asked, now_s, d.exposed(spark, sf_dir))


def _requests(spark, sf_dir):
    """A request per order: by index (with a name beside it), by name, with a bad index or a bad time."""
    suppliers = d.table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("c")).scalar()
    key = F.col("o_orderkey")
    rows = d.table(spark, sf_dir, "orders").withColumn("n", key % suppliers)
    n, ln, kind = F.col("n"), key % 7 + 1, key % 5
    exact, bad = kind.isin(0, 3), kind == 2
    at_s = F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("string")
    return rows.select(
        key.alias("qid"),
        F.when(exact | bad, F.concat(F.lit(" "), d.address(n), F.lit(":9116"))).alias("instance"),
        F.when(exact, ln.cast("string")).when(bad, "7x").alias("if_index_raw"),
        F.when(kind != 2, d.declared_device(n)).alias("device"),
        F.when(kind != 2, d.declared_ref(n, ln, key)).alias("ref"),
        F.when(bad & (key % 2 == 0), "-1").otherwise(at_s).alias("at_raw"),
    )


@query("impact_asof", "Q7", f"""
SELECT DISTINCT l.iface_phash, l.at_s, a.app, a.service, a.owner, a.customer, a.criticality
FROM (SELECT DISTINCT iface_phash, at_s FROM looked WHERE iface_phash IS NOT NULL) l
JOIN exposed t ON t.iface_phash = l.iface_phash AND {valid('l.at_s')} JOIN affected a ON a.svc_phash = t.svc_phash
""", "looked exposed affected")
def _(spark, sf_dir):
    topology = d.topology(spark, sf_dir, *d.IMPACT)
    return tp.impact_asof(topology, d.looked(spark, sf_dir).filter("iface_phash is not null"), d.exposed(spark, sf_dir))


OWNED, MOVED, LEFT, VIP_FROM = 820454400, 852076800, 883612800, 788918400

fragment("app_then", f"""
SELECT custkey, name, 'former-' || owner AS owner, criticality, 0 AS valid_from, {OWNED} + (custkey % 700) * {d.DAY} AS valid_to FROM app_svc WHERE custkey % 3 = 0
UNION ALL SELECT custkey, name, owner, criticality, CASE WHEN custkey % 3 = 0 THEN {OWNED} + (custkey % 700) * {d.DAY} ELSE 0 END, NULL FROM app_svc
""", "app_svc")
fragment("runs_then", f"""
SELECT custkey, svc_phash, service, CASE WHEN custkey % 11 = 5 THEN {MOVED} + (custkey % 300) * {d.DAY} ELSE 0 END AS valid_from, NULL::BIGINT AS valid_to FROM app_svc
""", "app_svc")
fragment("consumes_then", f"""
SELECT svc_phash, n_name AS customer, 0 AS valid_from, CASE WHEN custkey % 5 = 2 THEN {LEFT} + (custkey % 200) * {d.DAY} END AS valid_to
FROM app_svc JOIN nation ON n_nationkey = nationkey WHERE custkey % 4 <> 0
UNION ALL SELECT svc_phash, 'vip-' || nationkey, {VIP_FROM}, NULL FROM app_svc WHERE custkey % 4 <> 0 AND custkey % 6 = 1
""", "app_svc")


def _dimensions(spark, sf_dir):
    """Apps that change owner, apps that move to another service, customers that leave and others that come."""
    key, later = F.col("c_custkey"), lambda base, spread: F.lit(base) + key % spread * d.DAY
    open_end = F.lit(None).cast("long")
    rows = d.table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", F.col("c_name").alias("app"), F.col("c_mktsegment").alias("owner"), d.service_name(key).alias("service"),
        F.concat(F.lit("key-"), key.cast("string")).alias("app_phash"))
    rows = rows.join(d.apps(spark, sf_dir).select(F.col("name").alias("app"), "criticality"), "app")
    changes, moves = key % 3 == 0, key % 11 == 5
    app = ["app_phash", "app", "owner", "criticality"]
    then = rows.filter(changes).select("app_phash", "app", F.concat(F.lit("former-"), "owner").alias("owner"), "criticality",
                                       F.lit(0).cast("long").alias("valid_from"), later(OWNED, 700).alias("valid_to"))
    now = rows.select(*app, F.when(changes, later(OWNED, 700)).otherwise(0).alias("valid_from"), open_end.alias("valid_to"))
    svc = d.service_hash(F.col("service")).alias("svc_phash")
    home = rows.select("app_phash", svc, "service", F.when(moves, later(MOVED, 300)).otherwise(0).alias("valid_from"), open_end.alias("valid_to"))
    old = F.concat(F.lit("svc-old-"), key.cast("string"))
    before = rows.filter(moves).select("app_phash", d.service_hash(old).alias("svc_phash"), old.alias("service"),
                                       F.lit(0).cast("long").alias("valid_from"), later(MOVED, 300).alias("valid_to"))
    served = rows.filter(key % 4 != 0)
    nation = d.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("customer"))
    plain = served.join(nation, "c_nationkey").select(
        svc, "customer", F.lit(0).cast("long").alias("valid_from"), F.when(key % 5 == 2, later(LEFT, 200)).alias("valid_to"))
    vip = served.filter(key % 6 == 1).select(
        svc, F.concat(F.lit("vip-"), F.col("c_nationkey").cast("string")).alias("customer"), F.lit(VIP_FROM).cast("long").alias("valid_from"), open_end.alias("valid_to"))
    return Dimensions(then.unionByName(now), home.unionByName(before), plain.unionByName(vip))


@query("impact_dims_asof", "Q2 Q7", f"""
SELECT DISTINCT l.iface_phash, l.at_s, a.name AS app, r.service, a.owner, coalesce(c.customer, '') AS customer, coalesce(a.criticality, '') AS criticality
FROM (SELECT DISTINCT iface_phash, at_s FROM looked WHERE iface_phash IS NOT NULL) l
JOIN exposed t ON t.iface_phash = l.iface_phash AND {valid('l.at_s')}
JOIN runs_then r ON r.svc_phash = t.svc_phash AND {valid('l.at_s', 'r')}
JOIN app_then a ON a.custkey = r.custkey AND {valid('l.at_s', 'a')}
LEFT JOIN consumes_then c ON c.svc_phash = t.svc_phash AND {valid('l.at_s', 'c')}
""", "looked exposed app_then runs_then consumes_then")
def _(spark, sf_dir):
    """Impact with the owner, the service and the customers of the instant looked at."""
    people = d.stored(spark, sf_dir, "people_history", lambda: _dimensions(spark, sf_dir).people())
    return impact_dims_asof(d.exposed(spark, sf_dir), people, d.looked(spark, sf_dir).filter("iface_phash is not null"))


@query("list_apps", "Q8", "SELECT c_name AS name FROM customer")
def _(spark, sf_dir):
    return tp.list_apps(d.topology(spark, sf_dir, "app"))


@query("app_services", "Q9", """
SELECT app_phash, name AS app, CASE WHEN custkey % 13 = 0 THEN name ELSE service END AS service FROM apps
""", "apps")
def _(spark, sf_dir):
    whole = d.topology(spark, sf_dir, "app", "service", "runs_as")
    homeless = d.table(spark, sf_dir, "customer").filter("c_custkey % 13 = 0").select(
        entity_hash("application", F.col("c_name")).alias("app_phash"))
    whole.runs_as = whole.runs_as.join(homeless, "app_phash", "left_anti")
    return tp.app_services(whole)


@query("interface_selectors", "Q10", """
SELECT DISTINCT app_phash, instance, if_index, instance || ':' || if_index AS selector FROM path_now
""", "path_now")
def _(spark, sf_dir):
    return tp.interface_selectors(tp.app_paths(d.topology(spark, sf_dir, *d.PATHS), d.NOW_S))


@query("selector_lists", "Q10", """
SELECT app_phash, string_agg(instance || ':' || if_index, ',' ORDER BY instance, if_index) AS selectors
FROM (SELECT DISTINCT app_phash, instance, if_index FROM path_now) GROUP BY app_phash
""", "path_now")
def _(spark, sf_dir):
    lists = tp.selector_lists(tp.app_paths(d.topology(spark, sf_dir, *d.PATHS), d.NOW_S))
    return lists.select("app_phash", F.array_join("selectors", ",").alias("selectors"))


@query("scope_samples", "Q11", """
SELECT metric, iface, us, value FROM samples
WHERE metric = 'ifHCOutOctets' AND iface IN (SELECT instance || ':' || if_index FROM path_now)
""", "samples path_now")
def _(spark, sf_dir):
    selectors = tp.interface_selectors(tp.app_paths(d.topology(spark, sf_dir, *d.PATHS), d.NOW_S))
    octets = d.samples(spark, sf_dir).filter("metric = 'ifHCOutOctets'")
    return tp.scope_samples(octets, selectors).select("metric", "iface", F.unix_micros("ts").alias("us"), "value")


def _curated(spark, sf_dir):
    key = F.col("c_custkey")
    spec = F.concat_ws(" , ", F.col("c_name"), F.when(key % 4 == 0, F.lit("")), F.upper("c_name"))
    return d.table(spark, sf_dir, "customer").select(F.when(key % 3 != 0, spec).otherwise("").alias("apps"))


@query("curated_paths", "Q12", """
SELECT a.app_phash, count(DISTINCT p.instance || ':' || p.if_index) AS interfaces
FROM apps a LEFT JOIN path_now p ON p.app_phash = a.app_phash WHERE a.custkey % 3 <> 0 GROUP BY a.app_phash
""", "apps path_now")
def _(spark, sf_dir):
    """Interfaces per curated app; the apps without a path, the warning list, count none."""
    paths, pathless = tp.curated_paths(d.topology(spark, sf_dir, *d.PATHS), curated_apps(_curated(spark, sf_dir)), d.NOW_S)
    counts = tp.interface_selectors(paths).groupBy("app_phash").agg(F.count(F.lit(1)).alias("interfaces"))
    return counts.unionByName(pathless.withColumn("interfaces", F.lit(0).cast("bigint")))


MAP = "app, service, device, if_name, instance, if_index, iface, direction"


@query("mapping_series", "M1 M2", f"SELECT {MAP} FROM mapping", "mapping")
def _(spark, sf_dir):
    topology = d.topology(spark, sf_dir)
    hops = tp.app_paths(topology, d.NOW_S).join(tp.app_services(topology), "app_phash")
    return in_mapping_order(mapping_series(hops))


@query("live_mapping", "M3 F18 Q12", f"""
SELECT {MAP} FROM mapping WHERE app IN (SELECT name FROM apps WHERE custkey % 3 <> 0)
""", "mapping apps")
def _(spark, sf_dir):
    return live_mapping(d.topology(spark, sf_dir), d.NOW_S, curated_apps(_curated(spark, sf_dir)))


@query("mapping_without_direction", "V11", "SELECT * FROM undirected", "undirected")
def _(spark, sf_dir):
    return without_direction(d.mapping(spark, sf_dir))
