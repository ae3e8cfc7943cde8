import json
import time

import pytest
from pyspark.sql import functions as F

from hopledger.operators.alerting import hold
from hopledger.operators.series import MICROS, Grid, counter_rate
from hopledger.sources.sinks import claim_version, newest_version, read_version, write_version
from hopledger.streaming.series import attribute, parquet_batches, pinned_table, stream_rates
from hopledger.streaming.state import stream_absence, stream_hold, stream_stable_labels
from hopledger.streaming.upkeep import catalog_upkeep, enrichment
from tests.test_enrich import AT, NEVER
from tests.test_topology import topology  # noqa: F401


class Feed:
    """A folder of JSON files read as a stream, one file per micro-batch."""

    def __init__(self, spark, folder, schema):
        self.folder, self.count = folder, 0
        folder.mkdir()
        self.stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))

    def send(self, *rows):
        self.count += 1
        path = self.folder / f"{self.count:04}.json"
        path.with_suffix(".tmp").write_text("\n".join(json.dumps(r) for r in rows))
        path.with_suffix(".tmp").rename(path)


def drain(stream, folder, name, each=None):
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", str(folder / f"{name}-state")).trigger(availableNow=True)
    writer = writer.foreachBatch(each) if each else writer.format("parquet").option("path", str(folder / name))
    running = writer.start()
    try:
        assert running.awaitTermination(120), "the stream did not catch up"
    finally:
        running.stop()


def test_rates_equal_batch_and_late_samples_change_nothing(spark, tmp_path):
    grid = Grid(step=60, range=300, lookback=300)
    feed = Feed(spark, tmp_path / "in", "k string, sec bigint, value double")
    points = [{"k": k, "sec": 30 * n, "value": float(n % 37 * m)} for n in range(1, 100) for k, m in (("a", 5), ("b", 7))]
    for n in range(0, len(points), 50):
        feed.send(*points[n:n + 50])
    stream = feed.stream.withColumn("ts", F.timestamp_seconds("sec"))
    drain(stream_rates(stream, ["k"], grid, "1 minute"), tmp_path, "out")
    final = (30 * 99 - 60) * MICROS
    batch = counter_rate(spark.createDataFrame(points).withColumn("ts", F.timestamp_seconds("sec")), ["k"], grid)
    want = {(r.k, r.t): r.value for r in batch.collect() if r.t < final}
    got = {(r.k, r.t): r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    # a sample for ticks that are final is dropped: nothing is emitted twice
    feed.send({"k": "a", "sec": 45, "value": 1e9}, {"k": "a", "sec": 6000, "value": 1.0})
    drain(stream_rates(stream, ["k"], grid, "1 minute"), tmp_path, "out")
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len({(r.k, r.t) for r in rows}) == len(rows) and max(r.value for r in rows) < 1e6


def test_attribution_uses_the_mapping_of_the_moment(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "iface string, t bigint, value double")
    current = {"app": "old"}
    read = lambda batch, batch_id: spark.createDataFrame([("i1", current["app"])], "iface string, app string")
    each = attribute(read, ["iface"], parquet_batches(str(tmp_path / "out")))
    for app, t in (("old", 1), ("new", 2)):
        current["app"] = app
        feed.send({"iface": "i1", "t": t, "value": 1.0}, {"iface": "i2", "t": t, "value": 1.0})
        drain(feed.stream, tmp_path, "attribution", each)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.t, r.app) for r in rows} == {(1, "old"), (2, "new")}


def test_a_batch_that_runs_again_keeps_its_mapping(spark, tmp_path):
    versions, out = str(tmp_path / "mapping"), str(tmp_path / "out")
    each = attribute(pinned_table(versions, str(tmp_path / "pins")), ["iface"], parquet_batches(out))
    ticks = spark.createDataFrame([("i1", 1, 1.0)], "iface string, t bigint, value double")
    with pytest.raises(ValueError, match="no whole version"):
        each(ticks, 0)
    publish = lambda app: write_version(spark.createDataFrame([("i1", app)], "iface string, app string"), versions)
    assert publish("old") == 1
    each(ticks, 0)
    assert publish("new") == 2
    each(ticks, 1)
    each(ticks, 0)  # after a failure the batch is run again
    assert sorted((r.batch, r.app) for r in spark.read.parquet(out).collect()) == [(0, "old"), (1, "new")]


def test_two_writers_take_two_versions(spark, tmp_path):
    path = str(tmp_path / "table")
    first, second = claim_version(spark, path), claim_version(spark, path)
    assert (first, second) == (1, 2) and newest_version(spark, path) is None
    assert write_version(spark.range(3), path) == 3 and newest_version(spark, path) == 3


def test_hold_across_batches_equals_batch(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "l string, sec bigint")
    ticks = {"x": [60, 120, 180, 240, 360, 420, 480, 540], "y": [180, 300]}
    for first in (60, 240, 420):
        feed.send(*[{"l": k, "sec": t} for k, v in ticks.items() for t in v if first <= t < first + 180])
    feed.send({"l": "z", "sec": 2000})
    active = feed.stream.withColumn("at", F.timestamp_seconds("sec")).withWatermark("at", "60 seconds").select(
        "l", "at", (F.col("sec") * MICROS).alias("t"), F.lit(1.0).alias("value"))
    drain(stream_hold(active, ["l"], 60, 120), tmp_path, "out")
    rows = spark.read.parquet(str(tmp_path / "out")).filter("l <> 'z'").collect()
    whole = spark.createDataFrame([(k, t * MICROS, 1.0) for k, v in ticks.items() for t in v], "l string, t bigint, value double")
    want = {(r.l, r.t, r.active_since, r.state) for r in hold(whole, ["l"], 60, 120).collect()}
    assert {(r.l, r.t, r.active_since, r.state) for r in rows if r.state != "resolved"} == want
    resolved = {(r.l, r.t // MICROS) for r in rows if r.state == "resolved"}
    assert ("x", 600) in resolved and ("y", 360) in resolved


def test_hold_judges_ticks_in_order_whatever_batch_brings_them(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "l string, sec bigint")
    for batch in ([120, 180], [60, 240], [300, 480], [420]):
        feed.send(*[{"l": "x", "sec": t} for t in batch])
    feed.send({"l": "z", "sec": 5000})
    active = feed.stream.withColumn("at", F.timestamp_seconds("sec")).withWatermark("at", "600 seconds").select(
        "l", "at", (F.col("sec") * MICROS).alias("t"), F.lit(1.0).alias("value"))
    drain(stream_hold(active, ["l"], 60, 120), tmp_path, "out")
    rows = spark.read.parquet(str(tmp_path / "out")).filter("l = 'x'").collect()
    whole = spark.createDataFrame([("x", t * MICROS, 1.0) for t in (60, 120, 180, 240, 300, 420, 480)], "l string, t bigint, value double")
    want = {(r.t, r.active_since, r.state) for r in hold(whole, ["l"], 60, 120).collect()}
    assert {(r.t, r.active_since, r.state) for r in rows if r.state != "resolved"} == want
    assert sorted(r.t // MICROS for r in rows if r.state == "resolved") == [360, 540]


def test_rates_take_the_highest_of_samples_at_one_instant(spark, tmp_path):
    grid = Grid(step=60, range=120, lookback=120)
    feed = Feed(spark, tmp_path / "in", "k string, sec bigint, value double")
    points = [{"k": "a", "sec": 30 * n, "value": float(v)} for n in range(1, 30) for v in (10 * n, 10 * n - (n % 3) * 7)]
    feed.send(*points)
    feed.send({"k": "z", "sec": 9000, "value": 1.0})
    drain(stream_rates(feed.stream.withColumn("ts", F.timestamp_seconds("sec")), ["k"], grid, "1 minute"), tmp_path, "out")
    batch = counter_rate(spark.createDataFrame(points).withColumn("ts", F.timestamp_seconds("sec")), ["k"], grid)
    want = {r.t: round(r.value, 9) for r in batch.collect()}
    assert {r.t: round(r.value, 9) for r in spark.read.parquet(str(tmp_path / "out")).filter("k = 'a'").collect()} == want


def test_absence_of_a_feed_that_never_sent(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "feed string")
    expected = spark.createDataFrame([("quiet",), ("busy",)], "feed string")
    feed.send({"feed": "busy"})
    running = stream_absence(feed.stream, expected, 2, 2).writeStream.outputMode("append").format("memory").queryName("absence").option(
        "checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
    seen, until = {}, time.time() + 90
    try:
        while time.time() < until and "firing" not in seen.get("quiet", []):
            time.sleep(1)
            seen = {}
            for r in spark.table("absence").orderBy("at_ms").collect():
                seen.setdefault(r.feed, []).append(r.state)
        feed.send({"feed": "quiet"})
        while time.time() < until and "resolved" not in seen.get("quiet", []):
            time.sleep(1)
            seen = {"quiet": [r.state for r in spark.table("absence").filter("feed = 'quiet'").orderBy("at_ms").collect()]}
    finally:
        running.stop()
    assert seen["quiet"][:3] == ["pending", "firing", "resolved"]


def test_labels_stay_the_same_when_a_lookup_fails(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "alert_key string, starts_at string, alert_id bigint, impact_labels string")
    row = lambda key, at, n, labels: {"alert_key": key, "starts_at": at, "alert_id": n, "impact_labels": labels}
    feed.send(row("k", "t1", 1, "L1"), row("q", "t1", 2, None))
    feed.send(row("k", "t1", 3, None), row("k", "t2", 4, None))
    feed.send(row("k", "t1", 5, "L9"))
    # a clock keeps this stream running even when it is caught up
    running = stream_stable_labels(feed.stream).writeStream.outputMode("append").format("memory").queryName("labels").option(
        "checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
    got, until = {}, time.time() + 60
    try:
        while time.time() < until and len(got) < 5:
            time.sleep(1)
            got = {r.alert_id: r.impact_labels for r in spark.table("labels").collect()}
    finally:
        running.stop()
    assert got == {1: "L1", 2: None, 3: "L1", 4: None, 5: "L1"}


def test_enrichment_in_flight(spark, tmp_path, topology):  # noqa: F811
    feed = Feed(spark, tmp_path / "in", "id int, labels map<string,string>, annotations map<string,string>, starts_at string, ends_at string")
    exact = {"instance": "10.0.0.1", "ifIndex": "42"}
    feed.send({"id": 1, "labels": exact, "annotations": {}, "starts_at": AT[160], "ends_at": NEVER})
    feed.send({"id": 2, "labels": exact, "annotations": {}, "starts_at": AT[160], "ends_at": "1970-01-01T00:00:02Z"})
    drain(feed.stream, tmp_path, "enrich", enrichment(lambda: topology, parquet_batches(str(tmp_path / "out"))))
    rows = {r.id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows[1].labels == rows[2].labels and rows[1].labels["app_count"] == "2"
    assert rows[1].annotations and not rows[2].annotations


def test_catalog_upkeep(spark, tmp_path):
    schema = "metric string, instance string, hostname string, if_name string, if_descr string, if_alias string, if_index_raw string"
    feed = Feed(spark, tmp_path / "in", schema)
    row = lambda name, index: {"metric": "ifHCInOctets", "instance": "h:1", "hostname": "r1", "if_name": name, "if_descr": "",
                               "if_alias": "", "if_index_raw": index}
    feed.send(row("Te1", "1"), row("Te1", "1"), row("Te2", "2"))
    feed.send(row("Te1", "9"), row("Te3", "bad"))
    drain(feed.stream, tmp_path, "upkeep", catalog_upkeep(str(tmp_path / "catalog"), lambda batch: 100 + batch, "hostname"))
    rows = {r.if_name: (r.if_index, r.observed_at) for r in read_version(spark, str(tmp_path / "catalog")).collect()}
    assert rows == {"tengige1": (9, 101), "tengige2": (2, 100)}
