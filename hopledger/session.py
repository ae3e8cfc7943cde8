"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(app_name: str = "hopledger", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive planning on. Cluster submissions leave ``master`` unset."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


# Rows of packed files are up to about so many times as large in memory.
UNPACKED = 20


def sized(spark: SparkSession) -> SparkSession:
    """Spark takes a table for as large as its files; packed ones of millions of rows then pass for small and are broadcast through the driver.

    Adaptive planning still broadcasts what turns out to be small.
    """
    spark.conf.set("spark.sql.sources.fileCompressionFactor", str(UNPACKED))
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a local one only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder
