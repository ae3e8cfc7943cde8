import pytest
from pyspark.sql import functions as F

from hopledger.functions import identity as i
from hopledger.functions import text as t
from hopledger.functions import times as tm
from hopledger.operators.catalog import check_label_name


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column).collect()]


def test_hash_literals(spark):
    lit = F.lit
    row = spark.range(1).select(
        i.entity_hash("interface", lit("rtr-core-1"), lit("tengige0/1/2")), i.entity_hash("application", lit(" Payments ")),
        i.entity_hash("appservice", lit("payments-api")), i.entity_hash("customer", lit("acme")),
        i.entity_hash("businessservice", lit("acme"), lit("payments")), i.entity_hash("application", lit(" payments　")),
    ).first()
    assert list(row) == [
        "interface:ba127692247d2f31", "application:d5d2a647fc8c15c0", "appservice:2aef70d6c4d49957",
        "customer:9958f12614b8cd15", "businessservice:cae07398e9470814", "application:d5d2a647fc8c15c0",
    ]
    with pytest.raises(ValueError):
        i.entity_hash("planet", lit("x"))


def test_hash_keeps_inner_spaces_and_kinds_apart(spark):
    row = spark.range(1).select(
        i.entity_hash("application", F.lit("my app")), i.entity_hash("application", F.lit("myapp")),
        i.entity_hash("customer", F.lit("a")), i.entity_hash("device", F.lit("a")),
    ).first()
    assert len({x.split(":")[1] for x in row}) == 4


CANON = {
    "Gi0/3": "gigabitethernet0/3", "GigabitEthernet0/3": "gigabitethernet0/3", "Te0/1/2": "tengige0/1/2",
    "TenGigE0/1/2": "tengige0/1/2", "ge-0/0/3": "ge-0/0/3", "Et1": "ethernet1", "Eth1": "ethernet1",
    "Ethernet1": "ethernet1", "Fa0/1": "fastethernet0/1", "Hu1/1": "hundredgige1/1", "  Te0/1/2 ": "tengige0/1/2",
    "Te 0/1": "tengige0/1", "Ｔｅ０/1": "tengige0/1", "": "", " ": "", "0/1": "0/1",
    "Teth0": "teth0", "TE-1": "te-1",
}


def test_canonical_names(spark):
    assert values(spark, CANON, i.canonical_if_name(F.col("x"))) == list(CANON.values())


def test_lower_is_per_code_point(spark):
    assert values(spark, ["İΣ"], i.plain_lower(F.col("x"))) == ["iσ"]


def test_key_safety(spark):
    rows = ["valid-name", "a:b", "a\x01b", "a\nb", ""]
    assert values(spark, rows, i.key_safe(F.col("x"))) == [True, False, False, False, True]


def test_host_part(spark):
    cases = {"h:1": "h", "[::1]:9100": "::1", "a:b:c": "a:b:c", "h": "h", ":9116": "", "[::1]": "[::1]", "x[y]:1": "x[y]:1"}
    assert values(spark, cases, i.host_part(F.col("x"))) == list(cases.values())


def test_strict_int(spark):
    cases = {"5": 5, "+5": 5, "-5": -5, " 5": None, "5 ": None, "abc": None, "": None, "99999999999999999999": None}
    assert values(spark, cases, i.strict_int(F.col("x"))) == list(cases.values())


def test_escape_order(spark):
    assert values(spark, ['a\\"b\nc'], t.escape_label_value(F.col("x"))) == ['a\\\\\\"b\\nc']


def test_criticality_rank(spark):
    cases = {"Critical": 4, "tier-1": 4, "P3": 2, "sev4": 1, "tier-5": 0, "": 0, "gold": 0}
    assert values(spark, cases, t.criticality_rank(F.col("x"))) == list(cases.values())


def test_plural(spark):
    assert values(spark, [0, 1, 2], t.plural(F.col("x"), "app"), "x int") == ["0 apps", "1 app", "2 apps"]


def test_overlay(spark):
    m = spark.range(1).select(t.overlay(
        F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"), F.lit("c"), F.lit("4")),
    )).first()[0]
    assert m == {"a": "1", "b": "3", "c": "4"}


def test_humanize_percentage(spark):
    cases = {0.9123456: "91.23%", 0.001: "0.1%", 1.0: "100%", 123.456: "1.235e+04%", 0.0: "0%", 1e-9: "1e-07%", -0.5: "-50%"}
    assert values(spark, cases, t.humanize_percentage(F.col("x")), "x double") == list(cases.values())


def test_curated_list(spark):
    assert values(spark, [" a, b ,,a,", ""], t.curated_list(F.col("x"))) == [["a", "b"], []]


def test_instants(spark):
    cases = {
        "2026-06-03T10:00:00Z": 1780480800, "2026-06-03T10:00:00.123456789+02:00": 1780473600,
        "2026-06-03 10:00:00": None, "2026-13-03T10:00:00Z": None, "": None,
    }
    assert values(spark, cases, F.unix_seconds(tm.rfc3339(F.col("x")))) == list(cases.values())


def test_resolved_is_strictly_before_now(spark):
    now = tm.rfc3339(F.lit("2026-06-03T10:00:00Z"))
    rows = ["2026-06-03T09:59:59Z", "2026-06-03T10:00:00Z", "bad", None]
    assert values(spark, rows, tm.is_resolved(F.col("x"), now)) == [True, False, False, False]


def test_as_of_bounds(spark):
    cases = {"": 7, "0": 0, "4102444800": 4102444800, "4102444801": None, "-1": None, "1.5": None, "x": None}
    assert values(spark, cases, tm.as_of_seconds(F.col("x"), F.lit(7).cast("bigint"))) == list(cases.values())


def test_label_name_grammar():
    assert check_label_name("hostname") == "hostname"
    for bad in ("", "1a", "a-b", "a) or (b", "a\n"):
        with pytest.raises(ValueError):
            check_label_name(bad)


def test_number_text(spark):
    from hopledger.functions.text import number_text

    cases = {1.0: "1", 0.0: "0", -2.5: "-2.5", 1e-5: "1e-05", 0.00012: "0.00012", 0.05: "0.05", 123456.789: "123456.789", 1e6: "1e+06",
             1234567.5: "1.2345675e+06", 1e8: "1e+08", 1.5e-7: "1.5e-07", 1e120: "1e+120", float("inf"): "+Inf", 100.0: "100", 999999.0: "999999"}
    rows = spark.createDataFrame([(v,) for v in cases], "v double").select("v", number_text(F.col("v")).alias("t")).collect()
    assert {r.v: r.t for r in rows} == cases


def test_nan_is_no_match_and_no_maximum(spark):
    from hopledger.operators.series import aggregate_by, compare

    nan = float("nan")
    rows = spark.createDataFrame([("a", 1, nan), ("a", 1, 2.0), ("b", 1, nan)], "app string, t long, value double")
    assert [r.value for r in compare(rows, ">", 1).collect()] == [2.0]
    top = {r.app: r.value for r in aggregate_by(rows, "max", ["app"]).collect()}
    assert top["a"] == 2.0 and top["b"] != top["b"]


def test_rejected_bodies(spark):
    from hopledger.sources.alerts import parse_alerts, rejected_bodies

    bodies = spark.createDataFrame([('[{"labels":{}}]',), ("[]",), ('{"labels":{}}',), ('[{"labels":',), (None,), ("[1]",)], "value string")
    assert sorted(r.reason for r in rejected_bodies(bodies).collect()) == ["empty", "malformed", *["not an array of alerts"] * 2]
    assert parse_alerts(bodies).count() == 1


def test_percentages_round_the_binary_value(spark):
    """Against the interpreter's own rounding of every fourth digit from small to large, exact halves among them."""
    ratios = [k / 100000 for k in range(90000, 180000, 7)] + [0.90125, 0.90375, 0.90035, 1e-6, 1.00005e-6, 9.9995e-3, 0.099995, 0.99995, 9.9995, 99.995, 99.99499999]
    ratios += [k * 10.0**e for e in range(-19, 14) for k in (1.0, 1.23445, 1.23455, 9.9995, 9.99949999, 5.0005, 7.77777)] + [-x for x in (0.5, 0.90035, 123456.5)]
    want = ["%.4g" % (x * 100) + "%" for x in ratios]
    df = spark.createDataFrame([(float(x), w) for x, w in zip(ratios, want)], "x double, want string")
    bad = df.withColumn("got", t.humanize_percentage(F.col("x"))).filter("got <> want or got is null").collect()
    assert not bad
    odd = values(spark, [float("nan"), float("inf"), float("-inf"), 0.0, None], t.humanize_percentage(F.col("x")), "x double")
    assert odd == ["NaN%", "+Inf%", "-Inf%", "0%", None]
