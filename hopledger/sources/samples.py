"""Samples, targets and inventory extracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopledger.functions.identity import trim_spaces
from hopledger.operators.declare import app_hash, service_hash


def attach_targets(samples: DataFrame, targets: DataFrame) -> DataFrame:
    """S3: ``targets(target, hostname, ip)`` give a sample its device and management address."""
    return samples.join(targets, "target").withColumns({
        "device": F.coalesce("hostname", F.lit("")), "instance": F.col("ip"),
    }).drop("target", "hostname", "ip")


def address_inventory(devices: DataFrame) -> DataFrame:
    """``devices(name, primary_ip)`` to one device per bare address; devices without one drop.

    Of several devices on one address the last name in order is kept.
    """
    bare = F.split_part(F.coalesce("primary_ip", F.lit("")), F.lit("/"), F.lit(1))
    return devices.select(bare.alias("ip"), "name").filter("ip <> ''").groupBy("ip").agg(
        F.max("name").alias("device")
    )


def app_seed(extract: DataFrame) -> dict[str, DataFrame]:
    """``extract(name, service, sys_id)`` to app, service and runs_as rows, unique per key."""
    rows = extract.filter(trim_spaces(F.col("name")) != "").select(
        app_hash(F.col("name")).alias("app_phash"), "name",
        service_hash(F.col("service")).alias("svc_phash"), "service", "sys_id",
    )
    pick = F.struct("name", "sys_id")
    return {
        "app": rows.groupBy("app_phash").agg(F.max(pick).alias("_p")).select("app_phash", "_p.name", "_p.sys_id"),
        "service": rows.groupBy("svc_phash").agg(F.max("service").alias("name")),
        "runs_as": rows.select("app_phash", "svc_phash").distinct(),
    }
