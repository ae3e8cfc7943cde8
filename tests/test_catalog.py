import itertools
import random

from pyspark.sql import Observation
from pyspark.sql import functions as F

from hopledger.operators import catalog as c
from hopledger.schemas import CATALOG, IFACE_OBS
from hopledger.sources.samples import address_inventory, app_seed, attach_targets
from hopledger.sources.sinks import read_version, write_version


def observed(spark, *rows):
    """(instance, device, if_name, if_descr, if_alias, raw index)."""
    return c.parse_index(spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], IFACE_OBS))


def row(instance, device="", if_name="Te0/0/1", descr="", alias="", index="1"):
    return (instance, device, if_name, descr, alias, index)


def test_harvest_counts_bad_indexes(spark):
    raw = spark.createDataFrame(
        [("ifHCInOctets", "10.0.0.1", "Te0/1/2", "TenGigE0/1/2", "uplink", "42", "r1"),
         ("ifHCInOctets", "10.0.0.1", "Te0/1/2", "TenGigE0/1/2", "uplink", "42", "r1"),
         ("ifHCInOctets", "10.0.0.1", "Te0/1/3", "", None, "abc", "r1"),
         ("ifHCInOctets", "10.0.0.1", "loopback0", "", "", None, None),
         ("ifSpeed", "10.0.0.1", "x", "", "", "1", "r1")],
        "metric string, instance string, if_name string, if_descr string, if_alias string, if_index_raw string, hostname string")
    seen = Observation("harvest")
    rows = {(r.if_name, r.if_index, r.device) for r in c.harvest_interfaces(raw, "hostname", seen).collect()}
    assert rows == {("Te0/1/2", 42, "r1"), ("loopback0", 0, "")}
    assert seen.get["skipped"] == 1


def test_device_precedence(spark):
    rows = observed(spark, row("10.0.0.1:9116", "rtr-labeled"), row("10.0.0.2:9116"), row("10.0.0.3:9116"),
                    row("rtr-bare"), row("10.0.0.4:9116"))
    inventory = spark.createDataFrame([("10.0.0.2:9116", "rtr-inv"), ("10.0.0.4", "rtr-host")], "ip string, device string")
    ok, rejects = c.build_catalog(rows, 5, inventory)
    names = {r.instance: r.device for r in ok.collect()}
    assert names == {"10.0.0.1:9116": "rtr-labeled", "10.0.0.2:9116": "rtr-inv", "10.0.0.3:9116": "10.0.0.3",
                     "rtr-bare": "rtr-bare", "10.0.0.4:9116": "rtr-host"}
    assert rejects.count() == 0


def test_rejects_have_reasons(spark):
    rows = observed(
        spark, row("h1", if_name="", descr=" "), row("a:b:c"), row("h2", if_name="x:y"), row(":9116"), row("h3", if_name="", descr="Eth1"))
    ok, rejects = c.build_catalog(rows, 5)
    assert {r.instance: r.reason for r in rejects.collect()} == {
        "h1": "empty canonical name", "a:b:c": "unsafe device", "h2": "unsafe ifName", ":9116": "empty_device"}
    assert [(r.device, r.if_name, r.metric_if_name) for r in ok.collect()] == [("h3", "ethernet1", "")]


def test_collision_and_last_wins(spark):
    rows = observed(spark, row("10.0.0.1:9116", "rtr-dup"), row("10.0.0.9:9116", "RTR-dup", "TenGigE0/0/1"))
    ok, rejects = c.build_catalog(rows, 5)
    assert ok.count() == 2 and rejects.count() == 0
    hit = c.identity_collisions(ok).collect()
    assert [(r.first_instance, r.other_instance) for r in hit] == [("10.0.0.1:9116", "10.0.0.9:9116")]
    assert [r.instance for r in c.latest_per_identity(ok).collect()] == ["10.0.0.9:9116"]


def entries(spark, *rows):
    """(phash, device, if_name, metric name, descr, alias)."""
    full = [(p, d, n, m, de, a, "10.0.0.1", "", 1, 9) for p, d, n, m, de, a in rows]
    return spark.createDataFrame(full, CATALOG)


CORE = [("p1", "rtr-core-1", "tengige0/1/2", "Te0/1/2", "TenGigE0/1/2", "uplink-ledger-dc"),
        ("p2", "rtr-core-1", "tengige0/1/3", "Te0/1/3", "TenGigE0/1/3", "uplink-auth-dc"),
        ("p3", "rtr-x", "ethernet1", "Eth1", "", ""), ("p4", "rtr-x", "ethernet2", "Eth2", "Ethernet1", " Odd ")]


def test_resolution_cases(spark):
    wanted = {
        ("rtr-core-1", "Te0/1/2"): ("ok", "p1"), ("RTR-core-1 ", "uplink-LEDGER-dc"): ("ok", "p1"),
        ("rtr-core-1", " Uplink-auth-dc "): ("ok", "p2"), ("rtr-core-1", "Te9/9/9"): ("no_match", None),
        ("rtr-core-1", " "): ("no_match", None), ("nowhere", "Te0/1/2"): ("no_match", None),
        ("rtr-x", "Ethernet1"): ("ambiguous", None), ("rtr-x", "odd"): ("no_match", None),
        ("rtr-x", "eth2"): ("ok", "p4"),
    }
    refs = spark.createDataFrame(list(wanted), "device string, ref string")
    refs = refs.unionAll(refs)
    got = {(r.device, r.ref): (r.status, r.phash) for r in c.resolve_refs(refs, entries(spark, *CORE)).collect()}
    assert got == wanted
    matches = c.ambiguous_matches(refs, entries(spark, *CORE)).collect()
    assert {(r.ref, r.metric_if_name) for r in matches} == {("Ethernet1", "Eth1"), ("Ethernet1", "Eth2")}


def test_resolution_against_brute_force(spark):
    rng = random.Random(5)
    words = ["Te0", "TenGigE0", "te0", "Gi1", "", "up", "Up ", "ge-1", "x"]
    canon = {"": "", "te0": "tengige0", "gi1": "gigabitethernet1"}
    fold = lambda s: canon.get(s.strip().lower(), s.strip().lower())
    rows = []
    for k in range(60):
        name, descr, alias = (rng.choice(words) for _ in range(3))
        rows.append((f"p{k:02}", f"d{rng.randrange(12)}", fold(name) or "n", name, descr, alias))
    refs = list(itertools.product([f"d{k}" for k in range(13)], words))
    want = {}
    for device, ref in refs:
        hits = [p for p, d, n, m, de, a in rows if d == device and ref.strip() and (
            n == fold(ref) or fold(de) == fold(ref) or a.lower() == ref.strip().lower() or m.lower() == ref.strip().lower())]
        want[device, ref] = ("no_match", None) if not hits else ("ok", hits[0]) if len(hits) == 1 else ("ambiguous", None)
    got = c.resolve_refs(spark.createDataFrame(refs, "device string, ref string"), entries(spark, *rows))
    assert {(r.device, r.ref): (r.status, r.phash) for r in got.collect()} == want


def test_suggestions_are_the_first_eight(spark):
    rows = [(f"p{k}", "d", f"n{k}", f"m{9 - k}", "", "") for k in range(10)]
    got = c.suggestion_lists(entries(spark, *rows)).first()
    assert got.suggestions == [f"m{k}" for k in range(8)]


def test_refresh_and_age(spark):
    old = entries(spark, *CORE)
    new = entries(spark, CORE[0]).withColumns({"if_index": F.lit(77).cast("bigint"), "observed_at": F.lit(0).cast("bigint")})
    out = {r.phash: r.if_index for r in c.refresh_catalog(old, new).collect()}
    assert out == {"p1": 77, "p2": 1, "p3": 1, "p4": 1}
    assert c.oldest_observation(c.refresh_catalog(old, new)).first()[0] == 9
    assert c.oldest_observation(new).first()[0] == 0
    assert c.recent_only(old, 100).count() == 4 and c.recent_only(old, 100, 50).count() == 0


def test_inventory_targets_and_seed(spark):
    devices = spark.createDataFrame(
        [("a", "10.0.0.1/24"), ("b", "10.0.0.1/32"), ("c", ""), ("d", None)], "name string, primary_ip string")
    assert [tuple(r) for r in address_inventory(devices).collect()] == [("10.0.0.1", "b")]
    targets = spark.createDataFrame([("t1", "rtr-1", "10.0.0.1")], "target string, hostname string, ip string")
    samples = spark.createDataFrame([("t1", 1.0), ("t2", 2.0)], "target string, value double")
    assert [(r.device, r.instance) for r in attach_targets(samples, targets).collect()] == [("rtr-1", "10.0.0.1")]
    seed = app_seed(spark.createDataFrame(
        [("Pay", "pay-api", "S1"), ("pay ", "pay-web", "S2")], "name string, service string, sys_id string"))
    assert seed["app"].count() == 1 and seed["runs_as"].count() == 2


def test_table_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert read_version(spark, path) is None
    assert write_version(spark.range(3), path) == 1
    assert write_version(read_version(spark, path).filter("id > 0"), path) == 2
    (tmp_path / "t" / "v=3").mkdir()
    assert read_version(spark, path).count() == 2 and read_version(spark, path, 1).count() == 3
