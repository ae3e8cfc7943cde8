import random

from pyspark.sql import functions as F

from hopledger.operators.intervals import join_valid
from hopledger.session import checkpoint_folder


def test_matches_a_plain_join(spark):
    draw = random.Random(4)
    history = [(draw.choice("abc"), k, f := draw.randrange(-10**6, 10**9), draw.choice([None, f, f + 1, f + draw.randrange(1, 10**draw.randrange(1, 11))]))
               for k in range(400)]
    lookups = [(draw.choice("abcd"), draw.randrange(-10**6, 10**9)) for _ in range(300)] + [("a", f) for k, _, f, _ in history[:40] if k == "a"]
    left = spark.createDataFrame(lookups, "key string, at_s long")
    right = spark.createDataFrame(history, "key string, n long, valid_from long, valid_to long")
    want = sorted((k, at, n) for k, at in lookups for key, n, f, t in history if k == key and f <= at and (t is None or at < t))
    assert sorted((r.key, r.at_s, r.n) for r in join_valid(left, right, ["key"]).collect()) == want
    assert join_valid(left.limit(0), right, ["key"]).count() == 0


def test_joined_rows_grow_with_the_matches(spark):
    """One interface with 50,000 intervals and as many lookups: a plain join would make 2.5e9 rows."""
    n = 50_000
    right = spark.range(n).select(F.lit("trunk").alias("key"), (F.col("id") * 1000).alias("valid_from"), (F.col("id") * 1000 + 1000).alias("valid_to"))
    left = spark.range(n).select(F.lit("trunk").alias("key"), (F.col("id") * 1000 + 7).alias("at_s"))
    assert join_valid(left, right, ["key"]).agg(F.count("*"), F.sum(F.col("at_s") - F.col("valid_from"))).first()[:] == (n, 7 * n)


def test_a_shared_folder_is_demanded_beyond_one_machine():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    try:
        checkpoint_folder(Session())
    except ValueError as error:
        assert "spark.checkpoint.dir" in str(error)
    else:
        raise AssertionError("a local folder was used on a cluster")


def test_repeats_go_where_the_bucket_is(spark):
    lookups = spark.createDataFrame([("a", 5), ("a", 7)], "k string, at_s long")
    history = spark.createDataFrame([("a", "x", 0, 9), ("a", "x", 1, None), ("a", "y", 6, None)], "k string, v string, valid_from long, valid_to long")
    found = join_valid(lookups, history, ["k"], ["at_s", "v"])
    assert sorted(map(tuple, found.collect())) == [(5, "x"), (7, "x"), (7, "y")]
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges(join_valid(lookups, history, ["k"], ["at_s", "v"])) == exchanges(join_valid(lookups, history, ["k"]))
