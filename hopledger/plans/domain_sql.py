"""The domain of ``domain`` as SQL fragments for the checking engine, written from the definitions."""

from __future__ import annotations

from hopledger.plans.domain import DAY, EVENTS_FROM, HARVESTED, NOW_S, WEEK
from hopledger.plans.registry import fragment

RANGE_S = 7 * DAY
RANGE_US, LOOKBACK_US = 7 * DAY * 1000000, 2 * DAY * 1000000


# Fixed values, written out here too so that the check does not read the code it checks.
LONG_NAMES = {
    "te": "tengige", "gi": "gigabitethernet", "eth": "ethernet", "et": "ethernet", "fa": "fastethernet", "hu": "hundredgige",
}
RANKED = {4: "critical tier-1 p1 sev1", 3: "high tier-2 p2 sev2", 2: "medium tier-3 p3 sev3", 1: "low tier-4 p4 sev4"}


def token(x: str) -> str:
    return f"lower(regexp_replace({x}, '\\s+', '', 'g'))"


def canonical(x: str) -> str:
    s = token(x)
    head = f"regexp_extract({s}, '^[a-z]+')"
    cases = " ".join(f"WHEN '{short}' THEN '{long}'" for short, long in LONG_NAMES.items())
    return (
        f"CASE WHEN contains({s}, '-') THEN {s} "
        f"ELSE (CASE {head} {cases} ELSE {head} END) || regexp_replace({s}, '^[a-z]+', '') END"
    )


def entity(kind: str, *parts: str) -> str:
    joined = " || chr(31) || ".join(f"lower(trim(CAST({p} AS VARCHAR)))" for p in parts)
    return f"'{kind}:' || substr(sha256('{kind}' || chr(31) || {joined}), 1, 16)"


def host(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches({x}, '^\\[[^\\]]*\\]:[^:]*$') THEN regexp_extract({x}, '^\\[([^\\]]*)\\]', 1) "
        f"WHEN regexp_matches({x}, '^[^:\\[\\]]*:[^:]*$') THEN split_part({x}, ':', 1) ELSE {x} END"
    )


def rank(x: str) -> str:
    cases = " ".join(f"WHEN '{word}' THEN {value}" for value, words in RANKED.items() for word in words.split())
    return f"CASE lower({x}) {cases} ELSE 0 END"


def address(n: str) -> str:
    return f"'10.0.' || ({n} // 256) || '.' || ({n} % 256)"


def short_name(n: str, ln: str) -> str:
    return f"(CASE {n} % 3 WHEN 0 THEN 'Te0/0/' WHEN 1 THEN 'Gi0/0/' ELSE 'ge-0/0/' END || {ln})"


def long_name(n: str, ln: str) -> str:
    return f"(CASE {n} % 3 WHEN 0 THEN 'TenGigE0/0/' WHEN 1 THEN 'GigabitEthernet0/0/' ELSE 'ge-0/0/' END || {ln})"


def alias_name(n: str, ln: str) -> str:
    return f"(CASE WHEN {n} % 23 = 0 AND {ln} IN (5, 6) THEN 'shared-' || {n} ELSE 'uplink-' || {n} || '-' || {ln} END)"


def declared_device(n: str) -> str:
    return f"(CASE WHEN {n} % 5 = 1 THEN {address(n)} ELSE printf('SUPPLIER#%09d', {n}) END)"


def declared_ref(n: str, ln: str, pick: str) -> str:
    return (
        f"(CASE WHEN {pick} % 50 = 0 THEN 'Te9/9/9' WHEN {pick} % 51 = 0 THEN ' ' "
        f"WHEN {pick} % 4 = 0 THEN {short_name(n, ln)} WHEN {pick} % 4 = 1 THEN upper({alias_name(n, ln)}) "
        f"WHEN {pick} % 4 = 2 THEN {long_name(n, ln)} ELSE ' ' || {short_name(n, ln)} || ' ' END)"
    )


def valid(at: str, alias: str = "t") -> str:
    return f"({at} >= {alias}.valid_from AND ({alias}.valid_to IS NULL OR {at} < {alias}.valid_to))"


# Catalog

fragment("pairs", "SELECT DISTINCT l_suppkey AS n, CAST(l_linenumber AS BIGINT) AS ln FROM lineitem")

fragment("observed", f"""
SELECT {address('n')} || CASE WHEN dup = 1 THEN ':9117' ELSE ':9116' END AS instance,
       CASE WHEN n % 5 IN (0, 1) THEN '' ELSE printf('Supplier#%09d', n) END AS device,
       CASE WHEN ln = 7 OR (n % 17 = 0 AND ln = 1) THEN ''
            WHEN n % 19 = 0 AND ln = 5 THEN 'Te:5' ELSE {short_name('n', 'ln')} END AS if_name,
       CASE WHEN n % 17 = 0 AND ln = 1 THEN '' ELSE {long_name('n', 'ln')} END AS if_descr,
       {alias_name('n', 'ln')} AS if_alias,
       CASE WHEN n % 11 = 0 AND ln = 3 THEN 'abc' WHEN n % 13 = 0 AND ln = 2 THEN ''
            WHEN n % 31 = 0 AND ln = 6 THEN '5' ELSE CAST(ln AS VARCHAR) END AS if_index_raw,
       n * 1000 + ln * 10 + dup AS ord
FROM (SELECT n, ln, 0 AS dup FROM pairs UNION ALL SELECT n, ln, 1 FROM pairs WHERE n % 10 = 3 AND ln = 4)
""", "pairs")

fragment("parsed", """
SELECT * EXCLUDE (if_index_raw),
       CASE WHEN if_index_raw = '' THEN 0 ELSE CAST(if_index_raw AS BIGINT) END AS if_index
FROM observed WHERE if_index_raw = '' OR regexp_matches(if_index_raw, '^[+-]?[0-9]+$')
""", "observed")

fragment("devices", f"""
SELECT s_name AS name, CASE WHEN s_suppkey % 5 = 1 THEN '' ELSE {address('s_suppkey')} || '/24' END AS primary_ip
FROM supplier
""")

fragment("inventory", """
SELECT split_part(primary_ip, '/', 1) AS ip, max(name) AS device FROM devices WHERE primary_ip <> '' GROUP BY 1
""", "devices")

fragment("judged", f"""
SELECT *, CASE WHEN if_name = '' THEN 'empty canonical name' WHEN device = '' THEN 'empty_device'
               WHEN contains(device, ':') THEN 'unsafe device' WHEN contains(if_name, ':') THEN 'unsafe ifName' END AS reason,
       {entity('interface', 'device', 'if_name')} AS phash
FROM (SELECT p.instance, p.if_name AS metric_if_name, p.if_descr, p.if_alias, p.if_index, p.ord,
             {token("coalesce(nullif(p.device, ''), i.device, j.device, " + host('p.instance') + ")")} AS device,
             CASE WHEN {canonical('p.if_name')} <> '' THEN {canonical('p.if_name')}
                  ELSE {canonical('p.if_descr')} END AS if_name
      FROM parsed p LEFT JOIN inventory i ON i.ip = p.instance LEFT JOIN inventory j ON j.ip = {host('p.instance')})
""", "parsed", "inventory")

fragment("good", f"""
SELECT phash, device, if_name, metric_if_name, if_descr, if_alias, instance, 'generic' AS vendor, if_index,
       CAST(CASE WHEN ord % 29 = 0 THEN 0 ELSE {HARVESTED} + ord % 97 END AS BIGINT) AS observed_at, ord
FROM judged WHERE reason IS NULL
""", "judged")

fragment("catalog", """
SELECT * EXCLUDE (ord, rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY phash ORDER BY observed_at DESC, ord DESC) AS rn FROM good) WHERE rn = 1
""", "good")

# References

fragment("lines", f"""
SELECT l_orderkey AS orderkey, l_partkey % 2 AS path_ix, CAST(l_linenumber AS BIGINT) AS seq,
       {declared_device('l_suppkey')} AS device, {declared_ref('l_suppkey', 'l_linenumber', 'l_partkey')} AS ref,
       CASE l_returnflag WHEN 'A' THEN 'ingress' WHEN 'N' THEN 'transit' ELSE 'egress' END AS direction
FROM lineitem
""")

fragment("spelled", f"""
SELECT device, if_name, {canonical('if_descr')} AS descr_name, lower(if_alias) AS alias_name,
       lower(metric_if_name) AS metric_name, phash, metric_if_name FROM catalog
""", "catalog")

MATCHES = """
trim(r.ref) <> '' AND c.device = r.device_token AND (
  (r.want <> '' AND (c.if_name = r.want OR c.descr_name = r.want))
  OR c.alias_name = lower(trim(r.ref)) OR c.metric_name = lower(trim(r.ref)))
"""


def resolution(name: str, source: str) -> None:
    """Fragments matching the distinct (device, ref) of ``source`` against the catalog."""
    fragment(f"{name}_refs", f"""
SELECT device, ref, {token('device')} AS device_token, {canonical('ref')} AS want
FROM (SELECT DISTINCT device, ref FROM {source})
""", source)
    fragment(name, f"""
SELECT r.device, r.ref, count(c.phash) AS matches,
       CASE count(c.phash) WHEN 0 THEN 'no_match' WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS status,
       CASE WHEN count(c.phash) = 1 THEN min(c.phash) END AS phash
FROM {name}_refs r LEFT JOIN spelled c ON {MATCHES} GROUP BY r.device, r.ref
""", f"{name}_refs", "spelled")


resolution("resolved", "lines")

# Apps and services

fragment("apps", f"""
SELECT {entity('application', 'c_name')} AS app_phash, c_name AS name, c_mktsegment AS owner,
       CASE WHEN c_custkey % 7 = 0 THEN 'Critical' WHEN c_custkey % 9 = 0 THEN ''
            ELSE 'tier-' || (c_custkey % 5 + 1) END AS criticality,
       'svc-' || (CASE WHEN c_custkey % 50 = 49 THEN c_custkey - 1 ELSE c_custkey END) AS service,
       c_custkey AS custkey, c_nationkey AS nationkey
FROM customer
""")

fragment("app_svc", f"SELECT *, {entity('appservice', 'service')} AS svc_phash FROM apps", "apps")

fragment("people", """
SELECT svc_phash, n_name AS customer, name AS app FROM app_svc JOIN nation ON n_nationkey = nationkey
WHERE custkey % 4 <> 0
UNION ALL
SELECT svc_phash, 'vip-' || nationkey, name FROM app_svc WHERE custkey % 4 <> 0 AND custkey % 6 = 1
""", "app_svc")

# History

fragment("history", f"""
SELECT o_orderkey AS orderkey, o_custkey AS custkey, printf('Customer#%09d', o_custkey) AS app_key,
       CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 = 0 THEN 'close' ELSE 'reload' END AS kind,
       CAST(epoch(o_orderdate) AS BIGINT) AS at_s,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos
FROM orders
""")

fragment("effective", """
SELECT h.*, rn + max(at_s - rn) OVER (PARTITION BY custkey ORDER BY rn) AS eff FROM (
  SELECT *, row_number() OVER (PARTITION BY custkey ORDER BY pos) AS rn FROM (
    SELECT *, lag(kind) OVER (PARTITION BY custkey ORDER BY pos) AS before FROM history)
  WHERE kind = 'reload' OR before = 'reload') h
""", "history")

fragment("revision", """
SELECT * FROM (
  SELECT orderkey, custkey, app_key, kind, at_s, eff AS valid_from,
         lead(eff) OVER (PARTITION BY custkey ORDER BY rn) AS valid_to FROM effective) WHERE kind = 'reload'
""", "effective")

fragment("connection", f"""
SELECT x.*, {entity('connection', 'svc_phash', 'to_svc_phash', 'source', 'valid_from')} AS conn_phash FROM (
  SELECT r.orderkey, r.custkey, r.valid_from, r.valid_to, a.app_phash, a.svc_phash,
         {entity('appservice', "('dep-' || (r.orderkey % 50))")} AS to_svc_phash,
         'git-' || (r.orderkey % 3) AS source
  FROM revision r JOIN app_svc a ON a.name = r.app_key) x
""", "revision", "app_svc")

fragment("takes", f"""
SELECT c.*, {entity('path', 'conn_phash', 'path_ix')} AS path_phash
FROM connection c, (VALUES (0), (1)) AS v(path_ix)
""", "connection")

fragment("hop", f"""
SELECT DISTINCT {entity('path', 'c.conn_phash', 'l.path_ix')} AS path_phash, l.seq, l.direction, r.phash AS iface_phash
FROM lines l JOIN connection c ON c.orderkey = l.orderkey
JOIN resolved r ON r.device = l.device AND r.ref = l.ref AND r.status = 'ok'
""", "lines", "connection", "resolved")

fragment("exposed", """
SELECT DISTINCT h.iface_phash, t.svc_phash, t.valid_from, t.valid_to FROM takes t JOIN hop h ON h.path_phash = t.path_phash
""", "takes", "hop")

fragment("affected", """
SELECT DISTINCT a.svc_phash, a.name AS app, a.service, a.owner, coalesce(p.customer, '') AS customer, a.criticality
FROM app_svc a LEFT JOIN people p ON p.svc_phash = a.svc_phash
""", "app_svc", "people")

fragment("path_now", f"""
SELECT DISTINCT a.app_phash, a.name AS app, a.service, c.device, c.if_name, c.metric_if_name, c.instance, c.if_index,
       h.seq, h.direction
FROM app_svc a JOIN takes t ON t.svc_phash = a.svc_phash JOIN hop h ON h.path_phash = t.path_phash
JOIN catalog c ON c.phash = h.iface_phash WHERE {valid(str(NOW_S))}
""", "app_svc", "takes", "hop", "catalog")

fragment("mapping", """
SELECT app, service, device, metric_if_name AS if_name, instance, if_index,
       instance || ':' || if_index AS iface, side AS direction FROM (
  SELECT *, row_number() OVER (PARTITION BY instance, if_index, app, side
                               ORDER BY seq, device, if_name, metric_if_name, service) AS rn
  FROM (SELECT *, direction AS side FROM path_now WHERE direction <> 'transit'
        UNION ALL SELECT *, 'ingress' FROM path_now WHERE direction = 'transit'
        UNION ALL SELECT *, 'egress' FROM path_now WHERE direction = 'transit')) WHERE rn = 1
""", "path_now")

fragment("undirected", "SELECT DISTINCT * EXCLUDE (direction) FROM mapping", "mapping")

# Samples

fragment("scrape", f"""
SELECT epoch_us(ts) AS us, user_id AS n, event_id, event_type, value AS v,
       {address('user_id')} || ':9116' AS instance, event_id % 3 + 1 AS if_index,
       {short_name('user_id', '(event_id % 3 + 1)')} AS if_name,
       {address('user_id')} || ':9116:' || (event_id % 3 + 1) AS iface,
       ((CAST(floor(epoch(ts)) AS BIGINT) - {EVENTS_FROM}) % {WEEK} + {WEEK}) % {WEEK} AS w
FROM events
""")

fragment("samples", """
SELECT 'ifHCOutOctets' AS metric, us, instance, if_index, if_name, iface, '' AS alertname, '' AS alertstate,
       CAST(w * (1 + n % 13) * 10000 + floor(v * 100) AS DOUBLE) AS value FROM scrape
UNION ALL SELECT 'ifHCInOctets', us, instance, if_index, if_name, iface, '', '',
       CAST(w * (1 + n % 5) * 10000 + floor(v * 50) AS DOUBLE) FROM scrape
UNION ALL SELECT 'ifHighSpeed', us, instance, if_index, if_name, iface, '', '',
       CAST(CASE WHEN n % 10 = 9 THEN 0 ELSE 1 + n % 2 END AS DOUBLE) FROM scrape
UNION ALL SELECT 'ifOperStatus', us, instance, if_index, if_name, iface, '', '',
       CAST(CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS DOUBLE) FROM scrape
UNION ALL SELECT 'ifInErrors', us, instance, if_index, if_name, iface, '', '',
       CAST((w // 3600) * (n % 3) AS DOUBLE) FROM scrape
UNION ALL SELECT 'ifOutErrors', us, instance, if_index, if_name, iface, '', '',
       CAST(w // 7200 AS DOUBLE) FROM scrape WHERE n % 2 = 0
UNION ALL SELECT 'ifInDiscards', us, instance, if_index, if_name, iface, '', '',
       CAST(w // 1000 AS DOUBLE) FROM scrape WHERE n % 4 = 1
UNION ALL SELECT 'ifOutDiscards', us, instance, if_index, if_name, iface, '', '',
       CAST((w // 900) * (n % 2) AS DOUBLE) FROM scrape WHERE n % 3 = 0
UNION ALL SELECT 'ALERTS', us, instance, if_index, if_name, iface,
       CASE WHEN event_id % 2 = 0 THEN 'InterfaceDown' ELSE 'HighErrors' END,
       CASE WHEN event_id % 5 = 0 THEN 'pending' ELSE 'firing' END, 1.0 FROM scrape WHERE event_type = 'error'
""", "scrape")

fragment("ticks", f"""
SELECT t_s, t_s * 1000000 AS t FROM (
  SELECT unnest(range(CAST(epoch(date_trunc('day', min(ts))) AS BIGINT), CAST(epoch(max(ts)) AS BIGINT) + {2 * DAY}, {DAY})) AS t_s FROM events)
WHERE t_s < (SELECT epoch_us(max(ts)) FROM events) / 1000000.0 + {DAY}
""")

fragment("instants", f"""
SELECT s.metric, s.instance, s.if_index, s.if_name, s.iface, s.alertname, s.alertstate, t.t, t.t_s,
       arg_max(s.value, s.us) AS value, max(s.us) AS sample_us
FROM ticks t JOIN samples s ON s.us <= t.t AND s.us > t.t - {LOOKBACK_US}
GROUP BY ALL
""", "ticks", "samples")

fragment("rates", f"""
SELECT metric, instance, if_index, if_name, iface, t, t_s,
       inc * (i + least(CASE WHEN s0 >= 1.1 * gap THEN gap / 2 ELSE s0 END,
                        CASE WHEN inc > 0 AND v1 >= 0 THEN i * v1 / inc END)
                + CASE WHEN e0 >= 1.1 * gap THEN gap / 2 ELSE e0 END) / i / {RANGE_S} AS value
FROM (SELECT *, (last_us - first_us) / 1000000.0 AS i, (last_us - first_us) / 1000000.0 / (n - 1) AS gap,
             (first_us - (t - {RANGE_US})) / 1000000.0 AS s0, (t - last_us) / 1000000.0 AS e0,
             v2 - v1 + drops AS inc
      FROM (SELECT metric, instance, if_index, if_name, iface, t, t_s, count(*) AS n,
                   min(us) AS first_us, max(us) AS last_us, arg_min(value, us) AS v1, arg_max(value, us) AS v2,
                   coalesce(sum(CASE WHEN value < prev THEN prev END), 0) AS drops
            FROM (SELECT s.*, t.t, t.t_s,
                         lag(s.value) OVER (PARTITION BY s.metric, s.iface, s.if_name, t.t ORDER BY s.us) AS prev
                  FROM ticks t JOIN samples s ON s.us <= t.t AND s.us > t.t - {RANGE_US}
                  WHERE s.metric NOT IN ('ALERTS', 'ifHighSpeed', 'ifOperStatus'))
            GROUP BY ALL) WHERE n >= 2)
""", "ticks", "samples")

LABELS = "m.app, m.service, m.device, m.if_name, m.instance, m.if_index, m.iface"


def spread(name: str, source: str, where: str, value: str, directed: str | None) -> None:
    """A fragment fanning ``source`` out over the mapping, directed or not."""
    table = "undirected" if directed is None else "mapping"
    labels = LABELS if directed is None else LABELS + ", m.direction"
    on = "" if directed in (None, "both") else f" AND m.direction = '{directed}'"
    fragment(name, f"""
SELECT {labels}, s.t_s, CAST({value} AS DOUBLE) AS value FROM {source} s
JOIN {table} m ON m.instance = s.instance AND m.if_name = s.if_name{on} WHERE {where}
""", source, table)


spread("if_egress_octets_rate", "rates", "s.metric = 'ifHCOutOctets'", "s.value", "egress")
spread("if_ingress_octets_rate", "rates", "s.metric = 'ifHCInOctets'", "s.value", "ingress")
spread("if_capacity_bps", "instants", "s.metric = 'ifHighSpeed' AND s.value > 0", "s.value * 1e6", "both")
spread("if_oper_up", "instants", "s.metric = 'ifOperStatus'", "CASE WHEN s.value = 1 THEN 1 ELSE 0 END", None)
spread("if_in_errors_rate", "rates", "s.metric = 'ifInErrors'", "s.value", None)
spread("if_out_errors_rate", "rates", "s.metric = 'ifOutErrors'", "s.value", None)
spread("if_in_discards_rate", "rates", "s.metric = 'ifInDiscards'", "s.value", None)
spread("if_out_discards_rate", "rates", "s.metric = 'ifOutDiscards'", "s.value", None)

fragment("firing", """
SELECT instance, if_name, t_s, count(*) AS value FROM instants
WHERE metric = 'ALERTS' AND alertstate = 'firing' GROUP BY ALL
""", "instants")
spread("if_alerts_firing", "firing", "true", "s.value", None)

for _side in ("egress", "ingress"):
    fragment(f"if_{_side}_util", f"""
SELECT r.* EXCLUDE (value), r.value * 8 / c.value AS value FROM if_{_side}_octets_rate r JOIN if_capacity_bps c
USING (app, service, device, if_name, instance, if_index, iface, direction, t_s)
""", f"if_{_side}_octets_rate", "if_capacity_bps")
fragment("if_util", "SELECT * FROM if_egress_util UNION ALL SELECT * FROM if_ingress_util",
         "if_egress_util", "if_ingress_util")

fragment("path_util_max", "SELECT app, service, t_s, max(value) AS value FROM if_util GROUP BY ALL", "if_util")
fragment("path_oper_up_min", "SELECT app, service, t_s, min(value) AS value FROM if_oper_up GROUP BY ALL", "if_oper_up")
fragment("path_hops_down", "SELECT app, service, t_s, sum(1 - value) AS value FROM if_oper_up GROUP BY ALL", "if_oper_up")
fragment("path_alerts_firing", "SELECT app, service, t_s, sum(value) AS value FROM if_alerts_firing GROUP BY ALL",
         "if_alerts_firing")
for _kind in ("errors", "discards"):
    fragment(f"path_{_kind}_rate", f"""
SELECT app, service, t_s,
       CASE WHEN i.value IS NULL THEN o.value WHEN o.value IS NULL THEN i.value ELSE i.value + o.value END AS value
FROM (SELECT app, service, t_s, sum(value) AS value FROM if_in_{_kind}_rate GROUP BY ALL) i
FULL JOIN (SELECT app, service, t_s, sum(value) AS value FROM if_out_{_kind}_rate GROUP BY ALL) o
USING (app, service, t_s)
""", f"if_in_{_kind}_rate", f"if_out_{_kind}_rate")

# Alerts

fragment("alerts", f"""
SELECT event_id AS alert_id, event_id % 4 AS kind, event_id % 9 = 0 AS no_start, event_id % 2 = 1 AS resolved,
       user_id AS n, event_id % 7 + 1 AS ln,
       CASE WHEN event_id % 9 = 0 THEN {NOW_S}
            ELSE (CAST(floor(epoch(ts)) AS BIGINT) - {EVENTS_FROM}) * 80 + 788918400 END AS at_s
FROM events WHERE event_type = 'error'
""")

fragment("keyed", f"""
SELECT *, CASE kind WHEN 0 THEN 'exact' WHEN 2 THEN NULL ELSE 'name' END AS mode,
       CASE kind WHEN 0 THEN {address('n')} || ':9116' WHEN 1 THEN {declared_device('n')}
                 WHEN 3 THEN printf('Supplier#%09d', n) ELSE '' END AS device,
       CASE WHEN kind = 0 THEN ln END AS if_index,
       CASE kind WHEN 1 THEN {declared_ref('n', 'ln', 'alert_id')} WHEN 3 THEN {alias_name('n', 'ln')} ELSE '' END AS ref
FROM alerts
""", "alerts")

fragment("alert_names", "SELECT device, ref FROM keyed WHERE mode = 'name'", "keyed")
resolution("alert_resolved", "alert_names")

fragment("indexed", """
SELECT instance, if_index, CASE WHEN count(*) = 1 THEN min(phash) END AS phash, count(*) AS matches
FROM catalog GROUP BY ALL
""", "catalog")

fragment("looked", """
SELECT k.*, coalesce(x.phash, r.phash) AS iface_phash
FROM keyed k LEFT JOIN indexed x ON k.mode = 'exact' AND x.instance = k.device AND x.if_index = k.if_index
LEFT JOIN alert_resolved r ON k.mode = 'name' AND r.device = k.device AND r.ref = k.ref
""", "keyed", "indexed", "alert_resolved")

fragment("alert_impact", f"""
SELECT DISTINCT l.alert_id, l.at_s, l.iface_phash, a.app, a.service, a.owner, a.customer, a.criticality
FROM looked l JOIN exposed t ON t.iface_phash = l.iface_phash AND {valid('l.at_s')}
JOIN affected a ON a.svc_phash = t.svc_phash
""", "looked", "exposed", "affected")

fragment("rendered", f"""
SELECT alert_id, count(DISTINCT app) AS app_count, count(DISTINCT nullif(customer, '')) AS customers,
       coalesce(arg_min(criticality, sort_key) FILTER (WHERE rank > 0), 'unknown') AS max_criticality,
       string_agg('- ' || app || ' (' || service || ') owner ' || owner
                  || CASE WHEN customer <> '' THEN ' customer ' || customer ELSE '' END
                  || CASE WHEN criticality <> '' THEN ' [' || criticality || ']' ELSE '' END,
                  chr(10) ORDER BY app, customer, service, owner) AS lines
FROM (SELECT *, {rank('criticality')} AS rank,
             (9 - {rank('criticality')}) || app || chr(1) || customer AS sort_key FROM alert_impact)
GROUP BY alert_id
""", "alert_impact")
