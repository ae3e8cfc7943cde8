"""What a query stores of the graph is what it reads."""

import os

import pytest
from pyspark.sql import functions as F

from hopledger.operators.mapping import live_mapping
from hopledger.operators.topology import exposure
from hopledger.plans import all_queries
from hopledger.plans import domain as d

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


@pytest.fixture
def stored(monkeypatch):
    names, real = set(), d.stored

    def noted(spark, sf_dir, name, build):
        names.add(name)
        return real(spark, sf_dir, name, build)

    monkeypatch.setattr(d, "stored", noted)
    return names


def build(spark, name):
    return all_queries()[name].build(spark, SF_DIR)


def test_services_need_no_history(spark, stored):
    build(spark, "app_services").count()
    assert stored == {"app", "service", "runs_as"}


def test_series_need_no_hop_table(spark, stored):
    d.mapping_at(spark, SF_DIR, d.THEN_S).count()
    assert not stored & {"takes", "hop", "consumes", "exposure"}


def test_impact_needs_the_exposure_alone(spark, stored):
    build(spark, "impact_by_index").limit(1).count()
    assert "exposure" in stored and not stored & {"takes", "hop"}


def same(left, right):
    assert sorted(map(tuple, left.select(*right.columns).distinct().collect())) == sorted(map(tuple, right.distinct().collect()))


def test_mapping_and_exposure_equal_those_of_the_whole_graph(spark):
    whole = d.topology(spark, SF_DIR)
    same(d.mapping_at(spark, SF_DIR, d.THEN_S), live_mapping(whole, d.THEN_S))
    same(d.exposed(spark, SF_DIR), exposure(whole))


def test_a_plain_pick_spells_the_same_reference(spark):
    n, ln, pick = F.lit(7), F.lit(3), F.col("id")
    rows = spark.range(10_500).filter(d.declared_ref(n, ln, pick) != d.declared_ref(n, ln, d.plain_pick(pick)))
    assert rows.count() == 0


def test_orders_of_one_connection_share_path_and_validity(spark, tmp_path):
    """Two apps that share a service reload in the same second with the same target and source; one of them ends earlier."""
    day = lambda n: f"TIMESTAMP_NTZ '2000-01-{n:02d}'"
    customers = [f"({k}, 'Customer#{k:09d}', 0, 'x')" for k in (48, 49)]
    orders = [f"({key}, {who}, 'O', {day(at)})" for key, who, at in ((150, 48, 1), (300, 49, 1), (301, 48, 9))]
    lines = [f"({key}, 6, {n}, 2, 'A')" for key, n in ((150, 7), (300, 9), (301, 12))]
    tables = {
        "customer": ("c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string", customers),
        "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz", orders),
        "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_returnflag string", lines),
        "supplier": ("s_suppkey bigint, s_name string", [f"({n}, 'Supplier#{n:09d}')" for n in (7, 9, 12)]),
        "nation": ("n_nationkey int, n_name string", ["(0, 'A')"]),
    }
    for name, (fields, given) in tables.items():
        schema = spark.createDataFrame([], fields).schema
        rows = spark.sql(f"VALUES {', '.join(given)}").toDF(*schema.names)
        rows.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.parquet(f"{tmp_path}/{name}.parquet")
    whole, later = d.topology(spark, str(tmp_path)), 947376000
    rows = lambda found, columns: sorted((tuple(r) for r in found.select(*columns).distinct().collect()), key=str)
    ends = ["svc_phash", "iface_phash", "valid_from", "valid_to"]
    assert len(rows(exposure(whole), ends)) == 5
    assert rows(d.exposed(spark, str(tmp_path)), ends) == rows(exposure(whole), ends)
    mapped = live_mapping(whole, later)
    assert mapped.count() > 0 and rows(d.mapping_at(spark, str(tmp_path), later), mapped.columns) == rows(mapped, mapped.columns)
