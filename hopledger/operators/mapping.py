"""The interface-to-app mapping dimension (M1-M3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopledger.functions.identity import entity_hash, iface_label
from hopledger.functions.text import curated_list
from hopledger.operators.topology import Topology, app_paths, app_services

MAPPING_COLUMNS = ["app", "service", "device", "if_name", "instance", "if_index", "iface", "direction"]
ORDER = ["direction", "instance", "if_index", "app", "service"]


def mapping_series(hops: DataFrame) -> DataFrame:
    """M1: ``hops`` with app and service to mapping rows.

    A transit hop carries both directions. One row per (instance, if_index, app, direction): the
    first in hop order.
    """
    both = F.array(F.lit("ingress"), F.lit("egress"))
    sides = F.when(F.col("direction") == "transit", both).otherwise(F.array("direction"))
    rows = hops.withColumn("direction", F.explode(sides))
    first = Window.partitionBy("instance", "if_index", "app", "direction").orderBy(
        "seq", "device", "if_name", "metric_if_name", "service"
    )
    # filtering on rank one also runs before the shuffle, so repeats of a point never travel
    return (
        rows.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1")
        .select("app", "service", "device", F.col("metric_if_name").alias("if_name"), "instance", "if_index",
                iface_label(F.col("instance"), F.col("if_index")).alias("iface"), "direction")
    )


def in_mapping_order(mapping: DataFrame) -> DataFrame:
    """M2."""
    return mapping.orderBy(*ORDER)


def curated_apps(spec: DataFrame) -> DataFrame:
    """F18 on ``spec(apps)``: one row per curated app."""
    return spec.select(F.explode(curated_list(F.col("apps"))).alias("app")).distinct().withColumn(
        "app_phash", entity_hash("application", F.col("app"))
    )


def live_mapping(topology: Topology, at_s: int, curated: DataFrame | None = None) -> DataFrame:
    """M3: mapping of the curated apps (all apps when None) from their paths at ``at_s``, in one job."""
    paths = app_paths(topology, at_s)
    services = app_services(topology)
    if curated is not None:
        services = services.join(curated.select("app_phash").distinct(), "app_phash", "left_semi")
    return mapping_series(paths.join(services, "app_phash"))


def without_direction(mapping: DataFrame) -> DataFrame:
    """V11."""
    return mapping.drop("direction").distinct()
