"""Writers (K1, K2, K4)."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopledger.functions.text import escape_label_value
from hopledger.operators.mapping import in_mapping_order
from hopledger.session import checkpoint_folder, sized

# Label names of the exposition text, in order.
EXPOSITION_LABELS = {
    "app": "app", "service": "service", "device": "device", "ifName": "if_name",
    "instance": "instance", "ifIndex": "if_index", "iface": "iface", "direction": "direction",
}


def stamp_tenant(series: DataFrame, tenant: str) -> DataFrame:
    """K1."""
    return series.withColumn("tenant", F.lit(tenant))


def append_series(series: DataFrame, tenant: str, path: str, batch: int) -> None:
    """K1: derived series under their tenant, one folder per batch: a batch written again replaces its own rows."""
    rows = stamp_tenant(series, tenant).withColumn("batch", F.lit(batch))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant", "batch").parquet(path)


def exposition_lines(mapping: DataFrame, metric: str = "interface_app") -> DataFrame:
    """K2: one text line per mapping row in mapping order, as ``value``."""
    pieces = []
    for i, (label, column) in enumerate(EXPOSITION_LABELS.items()):
        opening = f'{metric}{{{label}="' if i == 0 else f'",{label}="'
        pieces += [F.lit(opening), escape_label_value(F.col(column).cast("string"))]
    return in_mapping_order(mapping).select(F.concat(*pieces, F.lit('"} 1')).alias("value"))


def write_exposition(mapping: DataFrame, path: str, metric: str = "interface_app") -> None:
    exposition_lines(mapping, metric).write.mode("overwrite").text(path)


def _folder(spark: SparkSession, path: str):
    """(file system, path) as Spark sees them."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), root


def _versions(spark: SparkSession, path: str, mark: str = "v=") -> list[int]:
    """Versions of a table that were written to the end, or with another ``mark`` those that were claimed."""
    fs, root = _folder(spark, path)
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith(mark) and (mark != "v=" or fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))):
            found.append(int(name[len(mark):]))
    return sorted(found)


CLAIM, PACKED = "_claim-", "zstd"


def claim_version(spark: SparkSession, path: str) -> int:
    """The next free version number, claimed by a file that only one writer can create."""
    fs, _ = _folder(spark, path)
    number = max(_versions(spark, path) + _versions(spark, path, CLAIM), default=0)
    while True:
        number += 1
        try:
            fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{CLAIM}{number}"), False).close()
            return number
        except Py4JJavaError:
            if number not in _versions(spark, path, CLAIM):
                raise


def write_version(df: DataFrame, path: str) -> int:
    """K4: write a table anew beside its last version; readers move over once it is whole.

    A writer that dies leaves a folder no reader looks at, two writers have two numbers, and a version may be computed from the
    one before it.
    """
    version = claim_version(df.sparkSession, path)
    df.write.mode("overwrite").parquet(f"{path}/v={version}", compression=PACKED)
    return version


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read from there.

    For a table that several branches of a plan read: each would compute it anew, and the plan would hold it as often.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/hopledger-settled/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=PACKED)
    return sized(df.sparkSession).read.schema(df.schema).parquet(path)


def newest_version(spark: SparkSession, path: str) -> int | None:
    """The number of the newest whole version."""
    return max(_versions(spark, path), default=None)


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The given or newest whole version of a table; None when there is none."""
    version = version or newest_version(spark, path)
    return None if version is None else sized(spark).read.parquet(f"{path}/v={version}")


def pinned_version(spark: SparkSession, path: str, pins: str, batch: int) -> int | None:
    """The version of a table that a batch goes by: the newest when it is first asked for, and the same whenever the batch runs again.

    The number is noted under ``pins`` before it is given out, by a rename that leaves a note that is there already as it is.
    """
    fs, note = _folder(spark, f"{pins}/batch={batch}")
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    if not fs.exists(note):
        version = newest_version(spark, path)
        if version is None:
            return None
        fs.mkdirs(note.getParent())
        fs.mkdirs(path_of(f"{pins}/_new-{batch}/{version}"))
        fs.rename(path_of(f"{pins}/_new-{batch}"), note)
    names = [status.getPath().getName() for status in fs.listStatus(note)]
    return min(int(name) for name in names if name.isdigit())
