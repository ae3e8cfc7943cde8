import pytest
from pyspark.sql import functions as F

from hopledger.operators import declare as dc
from hopledger.operators.sieve import marked
from hopledger.schemas import DECL
from hopledger.sources.declarations import declarations_from_json, parse_declaration, read_declarations, usable
from tests.test_catalog import CORE, entries

PAYMENTS = """
app: payments
runs_as: payments-api
owner: team-payments
criticality: tier-1
consumed_by_customers: [acme, globex]
depends_on:
  - to: ledger-api
    path:
      hops:
        - {device: rtr-core-1, if: Te0/1/2, direction: egress}
        - {device: RTR-core-1, if: uplink-auth-dc, direction: transit}
"""


def hop(ref="Te0/1/2", device="rtr-core-1", direction="egress"):
    return {"device": device, "if": ref, "direction": direction}


def dep(to="ledger-api", path=None, paths=None):
    return {"to": to, "path": None if path is None else {"hops": path},
            "paths": None if paths is None else [{"hops": p} for p in paths]}


def decl(spark, *rows):
    """(file, app, runs_as, customers, deps)."""
    full = [(f, a, r, "team", "tier-1", c, d) for f, a, r, c, d in rows]
    return spark.createDataFrame(full, DECL)


def codes(df):
    return sorted((r.file, r.code) for r in df.collect())


def test_parse_and_strictness():
    parsed = parse_declaration(PAYMENTS)
    assert parsed["app"] == "payments" and parsed["consumed_by_customers"] == ["acme", "globex"]
    assert [h["direction"] for h in parsed["depends_on"][0]["path"]["hops"]] == ["egress", "transit"]
    for bad in ("", "# only a comment\n", "runz_as: x\n", "app: a\ndepends_on:\n - to: b\n   paht: {}\n", "app: a\napp: b\n", "[1]\n", "app: [x]\n"):
        with pytest.raises(ValueError):
            parse_declaration(bad)


def test_scalars_keep_their_text():
    assert parse_declaration("app: 007\nowner: ~\n")["app"] == "007"
    assert parse_declaration("app: 007\nowner: ~\n")["owner"] is None


def test_read_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_declarations(spark, str(tmp_path))
    assert read_declarations(spark, str(tmp_path), allow_empty=True).count() == 0
    (tmp_path / "a.yaml").write_text(PAYMENTS)
    (tmp_path / "b.yaml").write_text("app: x\nnope: 1\n")
    (tmp_path / "c.txt").write_text("ignored")
    read = read_declarations(spark, str(tmp_path))
    rows = {r.file.rsplit("/", 1)[1]: r for r in read.collect()}
    assert set(rows) == {"a.yaml", "b.yaml"}
    assert rows["a.yaml"].parse_error is None and "nope" in rows["b.yaml"].parse_error
    assert usable(read).count() == 1
    errors = dc.batch_errors(read, entries(spark, *CORE))
    assert [r.code for r in errors.collect()] == ["parse"]
    assert dc.explode_declarations(dc.loadable(usable(read), errors)).count() == 2


def test_json_declarations(spark):
    rows = spark.createDataFrame([("f1", '{"app":"a","depends_on":[{"to":"b","paths":[{"hops":[]}]}]}'), ("f2", '{"ap":"a"}'), ("f3", "[]")],
                                 "file string, value string")
    got = {r.file: (r.app, r.parse_error) for r in declarations_from_json(rows).collect()}
    assert got == {"f1": ("a", None), "f2": (None, "declaration: unknown key 'ap'"), "f3": (None, "declaration: expected a mapping")}


def test_json_is_strict_at_every_level(spark):
    dep = '{"app":"a","depends_on":[{"to":"b","path":null},%s]}'
    cases = {
        dep % '{"to":"b","paht":{"hops":[]}}': "declaration.depends_on[1]: unknown key 'paht'",
        dep % '{"to":"b","path":{"hops":3}}': "declaration.depends_on[1].path.hops: expected a list",
        dep % '{"to":"b","paths":[{"hops":[{"device":"r","iff":"x"}]}]}': "declaration.depends_on[1].paths[0].hops[0]: unknown key 'iff'",
        dep % '{"to":["b"],"path":[],"x":1,"A":2}':
            "declaration.depends_on[1]: unknown key 'A'; declaration.depends_on[1]: unknown key 'x'; "
            "declaration.depends_on[1].to: expected text; declaration.depends_on[1].path: expected a mapping",
        dep % '"b"': "declaration.depends_on[1]: expected a mapping",
        '{"app":"a","consumed_by_customers":"acme"}': "declaration.consumed_by_customers: expected a list",
        '{"app":"a","app":"b"}': "declaration: no JSON, or a key is given twice", "{": "declaration: no JSON, or a key is given twice",
        "": "declaration: empty", "null": "declaration: empty", '{"app":7,"owner":true}': None, "{}": None,
    }
    rows = spark.createDataFrame([(str(k), v) for k, v in enumerate([*cases, None])], "file string, value string")
    got = {int(r.file): (r.parse_error, r.app) for r in declarations_from_json(rows).collect()}
    assert [got[k][0] for k in range(len(cases) + 1)] == [*cases.values(), "declaration: empty"]
    assert got[10] == (None, "7")


def test_sugar_path_comes_first(spark):
    d = decl(spark, ("f", "billing", "b", [], [dep("x", [hop("first")], [[hop("second")], [hop("third"), hop("fourth")]])]))
    got = [(r.path_ix, r.seq, r.ref) for r in dc.explode_declarations(d).orderBy("path_ix", "seq").collect()]
    assert got == [(0, 1, "first"), (1, 1, "second"), (2, 1, "third"), (2, 2, "fourth")]


def test_validation_codes(spark):
    good = [dep(path=[hop(), hop("uplink-auth-dc", direction="transit")])]
    d = decl(
        spark, ("ok", "payments", "payments-api", ["acme"], good), ("names", " ", "", ["a:b", "c\n"], good),
        ("unsafe", "a:b", "c:d", [], good), ("nopath", "n", "n", [], [dep(), dep(path=[])]),
        ("dep", "m", "m", [], [dep(" ", [hop()]), dep("x:y", [hop()])]),
        ("hop", "h", "h", [], [dep(paths=[[hop("Te9/9/9")], [hop(direction="up")], [hop("Ethernet1", "rtr-x")]])]),
        ("nodeps", "z", "z", [], []))
    assert codes(dc.validate_declarations(d, entries(spark, *CORE))) == sorted([
        ("names", "empty_app"), ("names", "empty_runs_as"), ("names", "unsafe_customer"), ("names", "unsafe_customer"),
        ("unsafe", "unsafe_app"), ("unsafe", "unsafe_runs_as"), ("nopath", "no_path"), ("nopath", "empty_hops"),
        ("dep", "empty_dep"), ("dep", "unsafe_dep"), ("hop", "unresolved_hop"), ("hop", "bad_direction"), ("hop", "ambiguous_hop")])


def test_duplicates_and_gate(spark):
    good = [dep(path=[hop()])]
    d = decl(spark, ("a", "pay", "s", [], [dep()]), ("b", "Pay ", "s", [], good), ("c", "pay", "s", [], good), ("d", "other", "t", [], good))
    errors = dc.batch_errors(d, entries(spark, *CORE))
    # the broken file does not claim the app; the first good one does
    assert codes(errors) == [("a", "no_path"), ("c", "duplicate_app")]
    assert sorted(r.file for r in dc.loadable(d, errors).collect()) == ["b", "d"]
    assert dc.loadable(d, errors, validate_only=True).count() == 0
    assert tuple(dc.batch_status(d, errors).first()) == (4, 2, 2, True)
    assert sorted(r.code for r in dc.shared_names(d).collect()) == []


def test_edges(spark):
    deps = [dep("ledger-api", [hop(), hop("Te9/9/9")], [[hop("uplink-auth-dc")]])]
    d = decl(spark, ("a", "payments", "payments-api", ["acme", "globex"], deps), ("b", "alone", "alone-api", [], deps)).withColumns({
        "source": F.lit("git"), "valid_from": F.lit(100).cast("bigint"), "valid_to": F.lit(None).cast("bigint")})
    edges = dc.dependency_edges(d, entries(spark, *CORE)) | dc.app_edges(d)
    assert edges["consumes"].count() == 2
    assert edges["depends_on"].count() == 2 and edges["takes"].count() == 4
    # the hop without an interface is left out; an app without customers keeps its paths
    assert edges["hop"].count() == 4
    assert edges["takes"].filter("confidence = 1.0 and valid_to is null").count() == 4
    assert edges["service"].count() == 3


def test_batch_time(spark):
    d = decl(spark, ("a", "x", "y", [], []))
    assert dc.stamp_batch(d, 123).first().at_s == 123
    assert dc.stamp_batch(d).first().at_s > 1_700_000_000


def test_marks_miss_no_key_and_let_few_others_through(spark):
    rows = spark.range(20000).selectExpr("concat('rtr-', id % 100) as device", "concat('Te', id) as ref", "id")
    wanted = rows.filter("id % 20 = 3").select("device", "ref")
    seen = marked(rows, wanted, ["device", "ref"], "may").groupBy((F.col("id") % 20 == 3).alias("in"), "may").count().collect()
    count = {(r["in"], r["may"]): r["count"] for r in seen}
    assert count[True, True] == 1000 and (True, False) not in count and count.get((False, True), 0) < 100
    assert marked(rows, wanted.limit(0), ["device", "ref"], "may").filter("may").count() == 0


def test_only_suspect_hops_are_shuffled_again(spark):
    good = decl(spark, *[(f"f{i}", f"a{i}", "svc", [], [dep(path=[hop(), hop("Te9/9/9" if i == 7 else "Te0/1/2")])]) for i in range(200)])
    catalog = entries(spark, *CORE)
    errors = dc.validate_declarations(good, catalog)
    assert codes(errors) == [("f7", "unresolved_hop")]
    # hops that are in order end before the last join: its plan sifts them by bits
    assert "bit_or" in errors._jdf.queryExecution().optimizedPlan().toString()


def test_takes_need_no_hops(spark):
    rows = decl(spark, ("f1", "a", "svc", [], [dep(path=[hop(), hop("x")], paths=[[hop()], []]), dep("none"), dep("other", paths=[[hop()]])]),
                ("f2", "b", "svc", [], None), ("f3", "c", "svc", [], [dep(path=[])]))
    errors = rows.filter("file = 'f3'").select("file")
    edges = {}
    for hops in (True, False):
        good = dc.loadable(rows, errors, hops=hops).withColumns({
            "source": F.lit("s"), "valid_from": F.lit(1).cast("bigint"), "valid_to": F.lit(None).cast("bigint")})
        found = dc.dependency_edges(good, entries(spark, *CORE))
        edges[hops] = [sorted(map(tuple, found[name].collect()), key=str) for name in ("takes", "depends_on")]
    assert edges[True] == edges[False] and [len(e) for e in edges[True]] == [4, 3]
