"""Batches in any order against all events at once."""

import random
import re

import pytest
from pyspark.sql import functions as F

from hopledger.operators import increments
from hopledger.operators.history import revisions
from hopledger.operators.increments import advance, begin
from hopledger.sources.sinks import read_version, write_version

EVENTS = "app_key string, kind string, at_s long, ord long, note string"


def made(seed, n=240):
    draw = random.Random(seed)
    at, rows = {}, []
    for k in range(n):
        app = draw.choice("abcde")
        at[app] = at.get(app, 1000) + draw.choice([-5, 0, 0, 1, 1, 30])  # clocks run backwards at times
        rows.append((app, draw.choice(["reload", "reload", "close"]), at[app], k, f"n{k}"))
    return rows


def stored(spark, history, folder):
    for name in ("events", "state", "revisions"):
        write_version(getattr(history, name), f"{folder}/{name}")
    return type(history)(*(read_version(spark, f"{folder}/{name}") for name in ("events", "state", "revisions")))


@pytest.mark.parametrize("order", ["in time", "mixed"])
def test_batches_equal_the_whole(spark, tmp_path, order):
    rows = made(4)
    sent = rows if order == "in time" else random.Random(7).sample(rows, len(rows))
    history = begin(spark.createDataFrame(rows, EVENTS))
    for k in range(0, len(sent), 60):
        history = stored(spark, advance(history, spark.createDataFrame(sent[k:k + 60], EVENTS)), tmp_path)
        upto = spark.createDataFrame(sent[:k + 60], EVENTS)
        want = sorted((r.app_key, r.note, r.valid_from, r.valid_to) for r in revisions(upto).collect())
        assert sorted((r.app_key, r.note, r.valid_from, r.valid_to) for r in history.revisions.collect()) == want
        assert history.state.count() == len({r[0] for r in sent[:k + 60]})
    before = sorted(map(str, history.revisions.collect()))
    assert sorted(map(str, advance(history, spark.createDataFrame([], EVENTS)).revisions.collect())) == before


def test_large_batches_are_dealt_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(increments, "TASK_ROWS", 10)
    rows = spark.range(300).select(
        F.format_string("app-%s", F.col("id") % 40).alias("app_key"), F.when(F.col("id") % 5 == 0, "close").otherwise("reload").alias("kind"),
        (F.col("id") * 7 % 100).alias("at_s"), F.col("id").alias("ord"))
    known = increments.advance(increments.advance(increments.begin(rows), rows.filter("ord % 3 > 0")), rows.filter("ord % 3 = 0"))
    sizes = [int(n) for n in re.findall(r"hashpartitioning\(app_key#\d+, (\d+)\), REPARTITION_BY_NUM", known.revisions._jdf.queryExecution().executedPlan().toString())]
    assert sizes and min(sizes) >= 20
    columns = ["app_key", "ord", "valid_from", "valid_to"]
    found = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert found(known.revisions) == found(revisions(rows))
