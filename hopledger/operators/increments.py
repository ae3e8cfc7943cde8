"""History batch by batch (T2, T3): what is known of an app is carried on, only apps of the batch are worked on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopledger.operators.history import effective_events

# Events that one task works on, on average: tables that grow get more tasks, not larger ones.
TASK_ROWS = 250_000
STATE = "app_key string, last_ord long, last_kind string, nth long, slack long"


@dataclass
class History:
    """All events so far, one state row per app and the revisions.

    The state is what the recurrence of ``effective_events`` needs to go on: the last event, how many have taken effect (``nth``) and the
    running maximum of time less number (``slack``).
    """

    events: DataFrame
    state: DataFrame
    revisions: DataFrame


def begin(events: DataFrame) -> History:
    """An empty history for events of this schema."""
    none = events.limit(0)
    spark = events.sparkSession
    revisions = none.drop("kind").withColumns({"valid_from": F.lit(None).cast("long"), "valid_to": F.lit(None).cast("long")})
    return History(none, spark.createDataFrame([], STATE), revisions)


def _state(events: DataFrame, effects: DataFrame) -> DataFrame:
    """State after ``events`` whose effects are (app_key, _nth, _slack)."""
    last = events.groupBy("app_key").agg(F.max("ord").alias("last_ord"), F.max_by("kind", "ord").alias("last_kind"))
    reached = effects.groupBy("app_key").agg(F.max("_nth").alias("nth"), F.max("_slack").alias("slack"))
    return last.join(reached, "app_key", "left").select("app_key", "last_ord", "last_kind", F.coalesce("nth", F.lit(0).cast("long")).alias("nth"), "slack")


def _continued(batch: DataFrame, state: DataFrame) -> DataFrame:
    """Effective events of apps whose batch comes after all that is known of them, with ``eff``, ``_nth`` and ``_slack``."""
    seeds = state.join(batch.select("app_key").distinct(), "app_key", "left_semi").select(
        "app_key", F.col("last_ord").alias("ord"), F.col("last_kind").alias("kind"), F.col("nth").alias("_nth0"), F.col("slack").alias("_slack0"), F.lit(True).alias("_seed"))
    rows = batch.withColumn("_seed", F.lit(False)).unionByName(seeds, allowMissingColumns=True)
    by_order = Window.partitionBy("app_key").orderBy("ord", F.desc("_seed"))
    so_far = by_order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_before", F.lag("kind").over(by_order))
    rows = rows.filter(F.col("_seed") | (F.col("kind") == "reload") | (F.col("_before") == "reload"))
    rows = rows.withColumn("_nth", F.coalesce(F.max("_nth0").over(so_far), F.lit(0)) + F.count_if(~F.col("_seed")).over(so_far))
    slack = F.when(F.col("_seed"), F.col("_slack0")).otherwise(F.col("at_s") - F.col("_nth"))
    return rows.withColumn("_slack", F.max(slack).over(so_far)).withColumn("eff", F.col("_nth") + F.col("_slack"))


def _revisions(effective: DataFrame, columns: list[str]) -> DataFrame:
    """Reloads among effective events as revisions, each up to the next effective event."""
    following = F.lead("eff").over(Window.partitionBy("app_key").orderBy("ord"))
    rows = effective.withColumn("valid_to", following).filter("kind = 'reload'").withColumn("valid_from", F.col("eff"))
    return rows.select(*columns)


def _dealt(history: History, batch: DataFrame) -> tuple[History, DataFrame]:
    """Events and revisions dealt by app, to as many tasks as they need.

    Rows that compress well are merged into few large tasks otherwise, and every window and join of a stage sorts them in memory.
    """
    rows = history.events.count() + batch.count()
    if rows <= TASK_ROWS:
        return history, batch
    parts = max(batch.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    deal = lambda df: df.repartition(parts, "app_key")
    return History(deal(history.events), history.state, deal(history.revisions)), deal(batch)


def advance(history: History, batch: DataFrame) -> History:
    """The history with a batch of events (app_key, kind, at_s, ord, ...), ``ord`` unique within an app.

    Apps whose events all come later than what is known go on from their state. Apps with an event that is late are played again from
    their own events, as a late one moves those after it. Apps that are not in the batch are neither read in windows nor changed. The
    result equals the revisions of all events at once. An empty batch changes nothing; the new tables are to be written by the caller.
    """
    history, batch = _dealt(history, batch)
    columns = history.revisions.columns
    first = batch.groupBy("app_key").agg(F.min("ord").alias("_first"))
    touched = first.join(history.state.select("app_key", "last_ord"), "app_key", "left").withColumn("late", F.coalesce(F.col("_first") <= F.col("last_ord"), F.lit(False)))
    late = touched.filter("late").select("app_key")
    on_time = batch.join(late, "app_key", "left_anti")

    going_on = _continued(on_time, history.state)
    fresh = going_on.filter(~F.col("_seed"))
    # The revision that was open ends with the first event that takes effect.
    ends = fresh.groupBy("app_key").agg(F.min("eff").alias("_end"))
    others = history.revisions.join(late, "app_key", "left_anti").join(ends, "app_key", "left")
    kept = others.withColumn("valid_to", F.coalesce("valid_to", "_end")).select(*columns)

    events = history.events.unionByName(batch)
    again = events.join(late, "app_key", "left_semi")
    replayed = effective_events(again).df
    revisions = kept.unionByName(_revisions(fresh, columns)).unionByName(_revisions(replayed, columns))
    known = history.state.join(touched.select("app_key"), "app_key", "left_anti")
    state = known.unionByName(_state(on_time, going_on.select("app_key", "_nth", "_slack"))).unionByName(_state(again, replayed))
    return History(events, state, revisions)
