"""Per-batch jobs: alerts enriched in flight, their labels kept in a table and the catalog kept current."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopledger.operators.catalog import build_catalog, harvest_interfaces, latest_per_identity, refresh_catalog
from hopledger.operators.enrich import EnrichConfig, enrich_alerts
from hopledger.operators.topology import Topology
from hopledger.sources.sinks import pinned_version, read_version, write_version
from hopledger.streaming.series import Writer


def enrichment(
    read_topology: Callable[[], Topology], write: Writer, config: EnrichConfig = EnrichConfig(),
    now: Column | None = None, read_exposure: Callable[[], DataFrame] | None = None,
) -> Writer:
    """W7, for ``foreachBatch``: the batch of alerts against the history as it is then."""

    def each(batch: DataFrame, batch_id: int) -> None:
        exposed = read_exposure() if read_exposure else None
        write(enrich_alerts(read_topology(), batch, now, config, exposed), batch_id)

    return each


LABEL_TTL_S = 6 * 3600


def kept_labels(path: str, pins: str, write: Writer, clock: Callable[[int], int], ttl_s: int = LABEL_TTL_S) -> Writer:
    """W8 on a table, for ``foreachBatch``: the labels an alert got first, kept for ``ttl_s`` from then on, whatever becomes of the stream.

    The batch is ``alerts(alert_key, starts_at, alert_id, impact_labels, seq)``; labels are null where the lookup failed, and of several
    notices in a batch the first by ``seq`` that has some counts. Labels live in versions of the table at ``path``: a stream that starts anew
    is seeded from the newest, a batch that runs again goes by the version it met first (``pins``). ``clock`` gives the second of a batch.
    """
    keys = ["alert_key", "starts_at"]

    def each(batch: DataFrame, batch_id: int) -> None:
        spark, now = batch.sparkSession, F.lit(clock(batch_id))
        version = pinned_version(spark, path, pins, batch_id)
        kept_at = "alert_key string, starts_at string, labels string, kept_at long"
        old = spark.createDataFrame([], kept_at) if version is None else read_version(spark, path, version)
        alive = old.filter(F.col("kept_at") > now - ttl_s)
        fresh = batch.filter("impact_labels IS NOT NULL").groupBy(*keys).agg(F.min_by("impact_labels", F.struct("seq", "impact_labels")).alias("labels"))
        new = fresh.join(alive, keys, "left_anti").select(*keys, "labels", now.cast("long").alias("kept_at"))
        known = alive.select("alert_key", "starts_at", "labels", "kept_at").unionByName(new)
        write(batch.select(*keys, "alert_id", "seq").join(known.drop("kept_at"), keys, "left").withColumnRenamed("labels", "impact_labels"), batch_id)
        write_version(known, path)

    return each


def catalog_upkeep(
    path: str, observed_at: Callable[[int], int], device_label: str | None = None,
    read_inventory: Callable[[], DataFrame] | None = None, vendor: str = "", order: tuple[str, ...] = (),
) -> Writer:
    """W9, for ``foreachBatch``: harvest, build and refresh into a new version of the catalog table.

    Of several observations of an interface in a batch the last by ``order`` counts, ties by a hash of the row. A batch that runs again
    overwrites its own rows with the same values.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = harvest_interfaces(batch, device_label)
        ordered = rows.withColumn("ord", F.struct(*order, F.xxhash64(*rows.columns).alias("_hash")))
        ok, _ = build_catalog(ordered, observed_at(batch_id), read_inventory() if read_inventory else None, vendor)
        new = latest_per_identity(ok)
        old = read_version(batch.sparkSession, path)
        write_version(new if old is None else refresh_catalog(old, new), path)

    return each
