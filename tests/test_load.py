"""What is read in several places while a batch loads is computed once."""

from pyspark.sql import functions as F

from hopledger.operators import declare as dc
from hopledger.operators.load import graph_of, load_batch
from hopledger.operators.sieve import PER_ROW, WORDS, bits
from hopledger.plans import domain as d
from hopledger.sources.sinks import settled
from tests.test_catalog import CORE, entries
from tests.test_declare import codes, decl, dep, hop


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def batch(spark):
    good = [dep(path=[hop()], paths=[[hop(), hop("uplink-auth-dc")]])]
    return decl(spark, ("a", "pay", "s", ["acme"], good), ("b", "Pay", "s", [], good), ("c", "bad", "t", [], [dep(path=[hop("Te9/9/9")])]))


def test_errors_and_history_are_computed_once(spark):
    catalog = entries(spark, *CORE)
    loaded = load_batch(batch(spark), catalog, None, 100, "first")
    assert codes(loaded.errors) == [("b", "duplicate_app"), ("c", "unresolved_hop")]
    # neither holds the checks again: no declaration is exploded for the status, no history is played for an edge
    assert "Generate" not in plan(loaded.errors) and "Generate" not in plan(loaded.status)
    graph, depends_on = graph_of(loaded.log, catalog)
    assert "Window" not in plan(graph.takes) + plan(graph.hop) + plan(depends_on)
    assert graph.takes.count() == 2 and graph.hop.count() == 3


def test_duplicates_do_not_repeat_the_validation(spark):
    catalog = entries(spark, *CORE)
    errors = dc.batch_errors(batch(spark), catalog)
    assert "Generate" not in plan(errors) and codes(errors) == [("b", "duplicate_app"), ("c", "unresolved_hop")]


def test_declarations_of_one_row_group_are_dealt_to_all_cores(spark, tmp_path):
    # a row for each of 64 orders in one file, one row group
    lines = spark.range(64).select(
        F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.col("id").alias("l_partkey"), F.col("id").alias("l_suppkey"), F.lit("A").alias("l_returnflag"))
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    documents = d.documents(spark, str(tmp_path))
    assert documents.count() == 64 and "RepartitionByExpression" in plan(documents)


def test_packed_files_do_not_pass_for_small_tables(spark):
    # a million rows in a few MB of file: as large as its file it would be broadcast
    written = settled(spark.range(1_000_000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v")))
    size = int(written._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert size > 16_000_000


def test_the_table_of_bits_has_few_rows(spark):
    table = bits(spark.range(400_000), ["id"])
    assert table.count() <= WORDS // PER_ROW == 65_536 and len(table.columns) == PER_ROW + 1


def test_hops_take_references_from_elsewhere(spark):
    catalog, decls = entries(spark, *CORE), batch(spark)
    stamped = decls.filter("file = 'a'").withColumns({"source": F.lit("x"), "valid_from": F.lit(1), "valid_to": F.lit(None).cast("long")})
    own, given = (dc.dependency_edges(stamped, catalog, refs)["hop"] for refs in (None, dc.explode_declarations(decls)))
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, given.collect())) != []
