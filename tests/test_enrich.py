import pytest
from pyspark.sql import functions as F

from hopledger.operators import enrich as e
from hopledger.sources.alerts import parse_alerts, render_alerts
from tests.test_topology import topology  # noqa: F401

IMPACT = "id int, app string, service string, owner string, customer string, criticality string"
KNOWN = [("payments", "payments-api", "team-payments", "acme", "critical"), ("ledger", "ledger-api", "team-ledger", "", "")]


def impact(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], IMPACT)


def test_render(spark):
    rows = impact(spark, *KNOWN)
    assert tuple(e.render_labels(rows, ["id"]).first())[1:] == ("critical", 2, True)
    note = e.render_annotations(rows, ["id"]).first()
    assert note.impact == ("apps affected (2):\n- ledger (ledger-api) owner team-ledger\n"
                           "- payments (payments-api) owner team-payments customer acme [critical]")
    assert note.blast_radius == "2 apps, 1 customer"


def test_render_nothing_known(spark):
    rows = impact(spark, ("ledger", "ledger-api", "t", "", "gold"))
    assert tuple(e.render_labels(rows, ["id"]).first())[1:] == ("unknown", 1, False)
    assert e.render_annotations(rows, ["id"]).first().blast_radius == "1 app, 0 customers"


@pytest.mark.parametrize("given, want", [
    (["Tier-1"], "Tier-1"), (["P3", "P1"], "P1"), (["sev4", "sev2"], "sev2"), (["tier-2", "tier-1"], "tier-1"),
    (["critical", "P1"], "critical"), (["low", "gold"], "low"),
])
def test_rank(spark, given, want):
    rows = impact(spark, *[(f"app{k}", "s", "o", "", c) for k, c in enumerate(given)])
    assert e.render_labels(rows, ["id"]).first().max_criticality == want


def alerts(spark, *rows):
    """(id, labels, starts_at, ends_at)."""
    return spark.createDataFrame([(k, labels, {"summary": "s"}, a, b) for k, labels, a, b in rows],
                                 "id int, labels map<string,string>, annotations map<string,string>, starts_at string, ends_at string")


def test_correlate(spark):
    rows = alerts(
        spark, (1, {"instance": "h", "ifIndex": "42", "ifName": "x"}, "", ""), (2, {"instance": "h", "ifIndex": "4x", "ifName": "x"}, "", ""),
        (3, {"instance": "h"}, "", ""), (4, {"ifIndex": "42"}, "", ""), (5, {"instance": "h", "ifIndex": "9"}, "", ""))
    assert {r.id: r.mode for r in e.correlate(rows).collect()} == {1: "exact", 2: "name", 3: None, 4: None, 5: "exact"}
    custom = e.EnrichConfig(device_label="dev", if_index_label="idx")
    assert e.correlate(alerts(spark, (1, {"dev": "h", "idx": "1"}, "", "")), custom).first().mode == "exact"


OLD, NEVER = "1970-01-01T00:00:01Z", "2100-01-01T00:00:00Z"
AT = {t: f"1970-01-01T00:0{t // 60}:{t % 60:02}Z" for t in (50, 160, 250)}


def test_enrich(spark, topology):  # noqa: F811
    exact = {"instance": "10.0.0.1", "ifIndex": "42", "severity": "page"}
    rows = alerts(
        spark, (1, exact, AT[160], NEVER), (2, {"instance": "rtr-a", "ifName": "Ethernet1"}, AT[160], NEVER), (3, {"alertname": "x"}, AT[160], NEVER),
        (4, exact, AT[50], NEVER), (5, exact, AT[160], OLD), (6, exact, "bad", NEVER), (7, {"instance": "10.0.0.3", "ifIndex": "7"}, AT[160], NEVER),
        (8, None, AT[160], NEVER), (9, {"instance": "10.0.0.1", "ifIndex": "1", "ifName": "ethernet1"}, AT[160], NEVER))
    now = F.timestamp_seconds(F.lit(250))
    got = {r.id: r for r in e.enrich_alerts(topology, rows, now).collect()}
    assert {k: r.enrich_status for k, r in got.items()} == {
        1: "enriched", 2: "enriched", 3: "no_key", 4: "no_match", 5: "enriched", 6: "enriched", 7: "no_match", 8: "error", 9: "no_match"}
    assert got[1].labels == {**exact, "max_criticality": "critical", "app_count": "2", "customer_impact": "true"}
    assert got[1].annotations["blast_radius"] == "2 apps, 2 customers" and got[1].annotations["summary"] == "s"
    # resolved: same labels, no annotations; unreadable start: as of now
    assert got[5].labels == got[1].labels and got[5].annotations == {"summary": "s"}
    assert got[6].labels["app_count"] == "1"
    for k in (3, 4, 7, 8, 9):
        assert got[k].labels == rows.filter(F.col("id") == k).first().labels and got[k].annotations == {"summary": "s"}
    both = e.EnrichConfig(prefix="x_", enrich_labels=False, enrich_resolved=True)
    five = e.enrich_alerts(topology, rows.filter("id = 5"), now, both).first()
    assert five.labels == exact and set(five.annotations) == {"summary", "x_impact", "x_blast_radius"}
    counts = {r.enrich_status: r.alerts for r in e.outcome_counts(e.enrich_alerts(topology, rows, now)).collect()}
    assert counts == {"enriched": 4, "no_match": 3, "no_key": 1, "error": 1}


def test_json_round_trip(spark):
    body = ('[{"labels":{"alertname":"IfDown"},"startsAt":"2026-06-03T10:00:00Z","generatorURL":"http://p/?q=\\"a\\"","n":12,'
            '"nested":{"b": [1, 2.0]},"nothing":null},{"labels":{"a":["list"]},"annotations":{"k":"v"}}]')
    rows = parse_alerts(spark.createDataFrame([(body,)], "value string"))
    first, second = rows.collect()
    assert first.labels == {"alertname": "IfDown"} and first.annotations == {} and first.starts_at == "2026-06-03T10:00:00Z"
    assert second.annotations == {"k": "v"} and second.starts_at is None
    out = render_alerts(rows.limit(1).withColumn("annotations", F.create_map(F.lit("x"), F.lit("y")))).first().value
    assert out == ('{"annotations":{"x":"y"},"generatorURL":"http://p/?q=\\"a\\"","labels":{"alertname":"IfDown"},"n":12,'
                   '"nested":{"b":[1,2.0]},"nothing":null,"startsAt":"2026-06-03T10:00:00Z"}')


def test_both_at_once_equals_one_by_one(spark):
    rows = [("k", "a", "s", "o", "", "tier-2"), ("k", "a", "s", "o", "acme", "tier-2"), ("k", "b", "s2", "o", "acme", "Critical"), ("k", "c", "s2", None, "", "sev1"),
            ("m", "x", "s", "o", "", "odd"), ("n", "y", "s", "o", "zz", ""), ("n", "y", "s", "p", "zz", "low")]
    found = spark.createDataFrame(rows, "key string, app string, service string, owner string, customer string, criticality string")
    apart = e.render_annotations(found, ["key"]).join(e.render_labels(found, ["key"]), "key")
    together = e.render_alerts_at_once(found, ["key"]).select(apart.columns)
    assert sorted(map(tuple, together.collect())) == sorted(map(tuple, apart.collect()))
