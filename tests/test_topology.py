import pytest
from pyspark.sql import functions as F

from hopledger.operators import topology as tp
from hopledger.operators.mapping import curated_apps, in_mapping_order, live_mapping, mapping_series, without_direction
from hopledger.schemas import CATALOG
from hopledger.sources.sinks import append_series, exposition_lines, write_exposition


def catalog(spark, rows):
    """(phash, device, if_name, instance, if_index)."""
    full = [(p, d, n, n.title(), n, f"alias {p}", inst, "", ix, 1) for p, d, n, inst, ix in rows]
    return spark.createDataFrame(full, CATALOG)


@pytest.fixture(scope="module")
def topology(spark):
    frame = spark.createDataFrame
    takes = [("s1", "pathA", 100, 200), ("s1", "pathB", 100, 200), ("s1", "pathC", 200, None), ("s2", "pathD", 150, None)]
    return tp.Topology(
        catalog=catalog(spark, [("i1", "rtr-a", "ethernet1", "10.0.0.1", 42), ("i2", "rtr-b", "ethernet2", "10.0.0.2", 43),
                                ("i3", "rtr-c", "ethernet3", "10.0.0.3", 7), ("i4", "rtr-c", "ethernet4", "10.0.0.3", 7)]),
        app=frame([("a1", "payments", "team-payments", "critical"), ("a2", "ledger", "team-ledger", None), ("a3", "idle", "t", "low")],
                  "app_phash string, name string, owner string, criticality string"),
        service=frame([("s1", "payments-api"), ("s2", "ledger-api")], "svc_phash string, name string"),
        runs_as=frame([("a1", "s1"), ("a2", "s2")], "app_phash string, svc_phash string"),
        consumes=frame([("c1", "acme", "b1", "s1"), ("c2", "globex", "b2", "s1")],
                       "cust_phash string, customer string, bs_phash string, svc_phash string"),
        takes=frame([(None, s, p, a, b, "" if p == "pathB" else "declared", 1.0) for s, p, a, b in takes],
                    "app_phash string, svc_phash string, path_phash string, valid_from bigint, valid_to bigint, provenance string, confidence double"),
        hop=frame([("pathA", 1, "egress", "i1"), ("pathA", 2, "transit", "i2"), ("pathB", 1, "egress", "i1"), ("pathC", 1, "ingress", "i2"),
                   ("pathD", 1, "egress", "i1"), ("pathD", 2, "egress", "i3")],
                  "path_phash string, seq bigint, direction string, iface_phash string"))


def test_path_is_ordered_distinct_and_as_of(topology):
    paths = tp.in_path_order(tp.app_paths(topology, 100)).collect()
    # both candidate paths share the first interface; a blank provenance counts as declared
    assert [(r.app_phash, r.seq, r.device, r.provenance) for r in paths] == [("a1", 1, "rtr-a", "declared"), ("a1", 2, "rtr-b", "declared")]
    assert [(r.seq, r.device) for r in tp.app_paths(topology, 200).filter("app_phash = 'a1'").collect()] == [(1, "rtr-b")]
    assert tp.app_paths(topology, 99).count() == 0


def test_bulk_path_equals_single(spark, topology):
    queries = spark.createDataFrame([("a1", 99), ("a1", 100), ("a1", 199), ("a1", 200), ("a2", 200), ("a3", 200)], "app_phash string, at_s bigint")
    got = {tuple(r) for r in tp.app_paths_asof(topology, queries).select("at_s", "app_phash", "seq", "device").collect()}
    want = {(at, r.app_phash, r.seq, r.device) for app, at in map(tuple, queries.collect())
            for r in tp.app_paths(topology, at).filter(F.col("app_phash") == app).collect()}
    assert got == want and len(got) == 7


def test_impact_keeps_apps_without_customers(topology):
    rows = {tuple(r) for r in tp.impact_at(topology, 160).filter("iface_phash = 'i1'").collect()}
    assert rows == {("i1", "payments", "payments-api", "team-payments", "acme", "critical"),
                    ("i1", "payments", "payments-api", "team-payments", "globex", "critical"),
                    ("i1", "ledger", "ledger-api", "team-ledger", "", "")}


def test_bulk_impact_equals_single(spark, topology):
    lookups = spark.createDataFrame([(i, t) for i in ("i1", "i2", "i3", "zz") for t in (99, 100, 150, 199, 200, 999)], "iface_phash string, at_s bigint")
    got = {tuple(r) for r in tp.impact_asof(topology, lookups.unionAll(lookups)).collect()}
    want = {(r.iface_phash, at, *list(r)[1:]) for at in (99, 100, 150, 199, 200, 999) for r in tp.impact_at(topology, at).collect()}
    assert got == want


def test_history_of_interfaces_nobody_asks_about_is_sifted_out(spark, topology):
    lookups = spark.createDataFrame([("i2", 250), ("i9", 250)], "iface_phash string, at_s bigint")
    rows = tp.impact_asof(topology, lookups, tp.exposure(topology, whole=False))
    assert sorted((r.iface_phash, r.app, r.customer) for r in rows.collect()) == [("i2", "payments", "acme"), ("i2", "payments", "globex")]
    assert "bit_or" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_exposure_by_path_has_the_same_rows(topology):
    twice = tp.Topology(**{**topology.__dict__, "hop": topology.hop.unionByName(topology.hop)})
    whole, dealt = (tp.exposure(twice, whole=w).collect() for w in (True, False))
    # pathA and pathB meet i1 at the same time: a row each, and no more
    assert set(whole) == set(dealt) and len(whole) == 5 and len(dealt) == 6


def test_by_index_none_one_many(spark, topology):
    queries = spark.createDataFrame([(1, "10.0.0.1", 42, 160), (2, "10.0.0.3", 7, 160), (3, "10.9.9.9", 1, 160)],
                                    "qid int, instance string, if_index bigint, at_s bigint")
    status = {r.instance: r.status for r in tp.find_by_index(topology.catalog, queries).collect()}
    assert status == {"10.0.0.1": "ok", "10.0.0.3": "ambiguous", "10.9.9.9": "none"}
    assert {r.qid for r in tp.impact_by_index(topology, queries).collect()} == {1}


def test_requests_are_all_answered(spark, topology):
    rows = [(1, "10.0.0.1", "42", "", "", "160"), (2, " ", "42", "RTR-A", "alias i1", "160"), (3, "10.0.0.3", "7", "rtr-a", "ethernet1", "160"),
            (4, "10.0.0.1", "x", "rtr-a", "ethernet1", "160"), (5, "", "", "rtr-a", "nope", "160"), (6, "", "", "rtr-a", "", "160"),
            (7, "10.0.0.1", "42", "", "", "5"), (8, "10.0.0.1", "42", "", "", "-5"), (9, None, None, "rtr-a", "ethernet1", None),
            (10, "10.9.9.9", "1", "rtr-a", "ethernet1", "160")]
    requests = spark.createDataFrame(rows, "qid int, instance string, if_index_raw string, device string, ref string, at_raw string")
    got = {}
    for r in tp.answer_requests(topology, requests, F.lit(160).cast("bigint")).collect():
        got.setdefault(r.qid, (r.mode, r.note, set()))[2].add(r.app)
    hit = {"payments", "ledger"}
    assert got == {1: ("exact", None, hit), 2: ("name", None, hit), 3: ("exact", "ambiguous interface reference", {None}),
                   4: ("invalid ifIndex", "invalid ifIndex", {None}), 5: ("name", "no interface matches", {None}), 6: ("invalid", "invalid", {None}),
                   7: ("exact", "no path known", {None}), 8: ("invalid at", "invalid at", {None}), 9: ("name", None, hit),
                   10: ("exact", "no path known", {None})}


def hops(spark, *rows):
    """(app, seq, instance, if_index, direction)."""
    full = [(a, f"{a}-api", s, "rtr", "e", "Te1", inst, ix, d) for a, s, inst, ix, d in rows]
    return spark.createDataFrame(full, "app string, service string, seq bigint, device string, if_name string, metric_if_name string, instance string, if_index bigint, direction string")


def test_mapping_expands_transit_and_removes_repeats(spark):
    one = mapping_series(hops(spark, ("a", 1, "10.0.0.1", 1, "transit"), ("a", 2, "10.0.0.1", 1, "transit")))
    assert sorted(r.direction for r in one.collect()) == ["egress", "ingress"]
    two = mapping_series(hops(spark, ("a", 1, "10.0.0.1", 1, "transit"), ("b", 1, "10.0.0.1", 1, "transit"), ("b", 2, "10.0.0.1", 1, "egress")))
    assert two.count() == 4 and without_direction(two).count() == 2
    assert {r.iface for r in two.collect()} == {"10.0.0.1:1"}


def test_exposition_is_ordered_and_escaped(spark, tmp_path):
    mapping = mapping_series(hops(spark, ('q"x', 1, "b", 100, "egress"), ("a", 1, "b", 9, "egress"), ("a", 1, "b", 42, "ingress")))
    lines = [r.value for r in exposition_lines(mapping, "m").collect()]
    assert lines[0] == 'm{app="a",service="a-api",device="rtr",ifName="Te1",instance="b",ifIndex="9",iface="b:9",direction="egress"} 1'
    assert lines[1].startswith('m{app="q\\"x"') and 'direction="ingress"' in lines[2]
    write_exposition(mapping, str(tmp_path / "text"))
    assert [r.if_index for r in in_mapping_order(mapping).collect()] == [9, 100, 42]


def test_live_mapping_of_curated_apps(spark, topology):
    named = curated_apps(spark.createDataFrame([(" Payments, ,payments ",), ("idle",)], "apps string"))
    assert named.select("app").count() == 3 and named.select("app_phash").distinct().count() == 2
    curated = spark.createDataFrame([("a1",), ("a3",), ("a1",)], "app_phash string")
    rows = live_mapping(topology, 160, curated)
    assert {(r.app, r.service) for r in rows.collect()} == {("payments", "payments-api")}
    assert rows.count() == 3
    paths, pathless = tp.curated_paths(topology, curated, 160)
    assert paths.count() == 2 and [r.app_phash for r in pathless.collect()] == ["a3"]


def test_selectors_are_real_pairs_in_numeric_order(spark):
    paths = spark.createDataFrame([("a", "10.0.0.1", i) for i in (100, 9, 42, 9)] + [("b", "10.0.0.1", 42), ("b", "10.0.0.2", 43)],
                                  "app_phash string, instance string, if_index bigint")
    got = {r.app_phash: r.selectors for r in tp.selector_lists(paths).collect()}
    assert got == {"a": ["10.0.0.1:9", "10.0.0.1:42", "10.0.0.1:100"], "b": ["10.0.0.1:42", "10.0.0.2:43"]}
    samples = spark.createDataFrame([("10.0.0.1:42", 1.0), ("10.0.0.1:43", 2.0)], "iface string, value double")
    assert [r.value for r in tp.scope_samples(samples, tp.interface_selectors(paths)).collect()] == [1.0]


def test_tenant_append(spark, tmp_path):
    path = str(tmp_path / "series")
    for batch, value in ((0, 1.0), (1, 2.0), (1, 2.0)):  # the last batch is run again
        append_series(spark.createDataFrame([(value,)], "value double"), "t1", path, batch)
    assert spark.read.parquet(path).count() == 2
    assert spark.read.parquet(path).count() == 2
    assert {(r.value, r.tenant) for r in spark.read.parquet(path).collect()} == {(1.0, "t1"), (2.0, "t1")}


def test_impact_of_services_with_one_name_is_given_once(spark):
    frame = spark.createDataFrame
    graph = tp.Topology(
        app=frame([("p1", "A", "o", "")], "app_phash string, name string, owner string, criticality string"),
        runs_as=frame([("p1", "s1"), ("p1", "s2")], "app_phash string, svc_phash string"),
        service=frame([("s1", "S"), ("s2", "S")], "svc_phash string, name string"),
        consumes=frame([], "svc_phash string, customer string"))
    exposed = frame([("i", "s1", 0, None), ("i", "s2", 0, None), ("i", "s1", 1, 9)], "iface_phash string, svc_phash string, valid_from long, valid_to long")
    asked = frame([("i", 5)], "iface_phash string, at_s long")
    assert [tuple(r) for r in tp.impact_asof(graph, asked, exposed).collect()] == [("i", 5, "A", "S", "o", "", "")]
    # where names tell services apart, the wide rows are not shuffled to find repeats
    graph.service = frame([("s1", "S"), ("s2", "T")], "svc_phash string, name string")
    rows = tp.impact_asof(graph, asked, exposed)
    assert rows.count() == 2 and not rows._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")
