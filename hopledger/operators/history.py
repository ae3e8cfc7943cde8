"""Valid-time history of declarations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopledger.operators.scan import BLOCK_ROWS, KeyedScan


def keyed_upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Set the new row where there is one, keep the old row elsewhere. ``new`` has unique keys."""
    columns = old.columns
    kept = old.join(new.select(*keys), keys, "left_anti")
    return kept.select(*columns).unionByName(new.select(*columns))


def effective_events(events: DataFrame, block_rows: int = BLOCK_ROWS) -> KeyedScan:
    """Every event that takes effect, with the second it takes effect at (``eff``).

    Within an app an event takes effect at its own time, or one second after the event before it if
    that is later. Closes that find nothing open (first, or after a close) do nothing. Taking the row
    number off turns the recurrence into a running maximum, so it needs no loop.
    """
    scan = KeyedScan(events, ["app_key"], "ord", block_rows).previous("_before", F.col("kind"))
    scan.keep((F.col("kind") == "reload") | (F.col("_before") == "reload"))
    scan.row_number("_nth").running("_slack", F.col("at_s") - F.col("_nth"), "max")
    return scan.add("eff", F.col("_nth") + F.col("_slack"))


def revisions(events: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Reload events as revisions ``[valid_from, valid_to)``; an open one has a null end."""
    scan = effective_events(events, block_rows).following("valid_to", F.col("eff"))
    return (
        scan.df.filter("kind = 'reload'")
        .withColumnRenamed("eff", "valid_from")
        .drop("kind", "_before", "_nth", "_slack")
    )


def drop_unchanged(events: DataFrame, digest: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Optional: leave out a reload whose ``digest`` equals the one of the reload right before it."""
    state = F.concat_ws(":", "kind", F.coalesce(F.col(digest), F.lit("")))
    scan = KeyedScan(events, ["app_key"], "ord", block_rows).previous("_same", state)
    scan.keep((F.col("kind") != "reload") | F.col("_same").isNull() | (F.col("_same") != state))
    return scan.df.drop("_same")


def close_validity(edges: DataFrame, closes: DataFrame) -> DataFrame:
    """T3 on tables: end the open edges of the apps in ``closes(app_phash, close_at)``.

    An end at or before the start is moved to one second after it.
    """
    ended = F.greatest(F.col("close_at"), F.col("valid_from") + 1)
    stop = F.when(F.col("valid_to").isNull() & F.col("close_at").isNotNull(), ended).otherwise(F.col("valid_to"))
    return edges.join(closes, "app_phash", "left").withColumn("valid_to", stop).select(*edges.columns)


def open_declared_apps(depends_on: DataFrame) -> DataFrame:
    """T4: apps with at least one open declared dependency."""
    return depends_on.filter("valid_to is null and provenance = 'declared'").select("app_phash").distinct()


def retractions(depends_on: DataFrame, present: DataFrame, at_s: int) -> DataFrame:
    """T5: closes for the open apps missing from ``present(app_phash)``."""
    gone = open_declared_apps(depends_on).join(present, "app_phash", "left_anti")
    return gone.withColumn("close_at", F.lit(at_s).cast("bigint"))


def should_reconcile(validate_only: bool, failed: bool, files: int, allow_empty: bool) -> bool:
    """T6."""
    return not validate_only and not failed and (files > 0 or allow_empty)


def gated_retractions(
    depends_on: DataFrame, present: DataFrame, at_s: int, status: DataFrame, validate_only: bool = False, allow_empty: bool = False,
) -> DataFrame:
    """T5 behind T6: retractions only if the batch of ``status(files, failed)`` may reconcile; ``status`` has one row."""
    may = (~F.col("failed")) & ((F.col("files") > 0) | F.lit(allow_empty)) & F.lit(not validate_only)
    return retractions(depends_on, present, at_s).filter(status.select(may.alias("may")).scalar())
