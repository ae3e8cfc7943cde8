"""Dimensions with a history: who owned, ran and consumed what at an instant.

A history holds one row per fact and interval: keys, values, ``valid_from`` and ``valid_to`` (null: open). Joining histories
intersects their intervals; equal facts that touch become one, so a history stays as short as its changes allow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopledger.operators.intervals import join_valid
from hopledger.operators.topology import IMPACT_COLUMNS

# Later than any instant: stands for an open end while ends are compared.
NEVER = (1 << 63) - 1
_ENDS = ["valid_from", "valid_to"]


def _end(column: str | Column) -> Column:
    return F.coalesce(column if isinstance(column, Column) else F.col(column), F.lit(NEVER))


def coalesced(history: DataFrame) -> DataFrame:
    """Equal facts whose intervals overlap or touch as one row; empty intervals go."""
    facts = [c for c in history.columns if c not in _ENDS]
    rows = history.select(*facts, "valid_from", _end("valid_to").alias("_to")).filter(F.col("valid_from") < F.col("_to"))
    by_time = Window.partitionBy(*facts).orderBy("valid_from", "_to")
    reach = F.max("_to").over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    runs = rows.withColumn("_new", F.when(F.col("valid_from") <= reach, 0).otherwise(1))
    runs = runs.withColumn("_run", F.sum("_new").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    whole = runs.groupBy(*facts, "_run").agg(F.min("valid_from").alias("valid_from"), F.max("_to").alias("_to"))
    return whole.select(*facts, "valid_from", F.nullif(F.col("_to"), F.lit(NEVER)).alias("valid_to"))


def intersected(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Facts of both sides for as long as both hold.

    Each pair is found in one bucket only: where the later of the two begins, the earlier is valid, so starts are looked up (``join_valid``).
    """
    l_facts, r_facts = ([c for c in side.columns if c not in (*_ENDS, *keys)] for side in (left, right))
    mine = left.select(*keys, *l_facts, F.col("valid_from").alias("_l_from"), F.col("valid_to").alias("_l_to"))
    theirs = right.select(*keys, *r_facts, F.col("valid_from").alias("_r_from"), F.col("valid_to").alias("_r_to"))
    real = lambda df, side: df.filter(F.col(f"_{side}_from") < _end(f"_{side}_to"))
    mine, theirs = real(mine, "l"), real(theirs, "r")
    ends = lambda df, side: df.withColumns({"valid_from": F.col(f"_{side}_from"), "valid_to": F.col(f"_{side}_to")})
    begins = lambda df, side: df.withColumn("at_s", F.col(f"_{side}_from"))
    columns = [*keys, *l_facts, *r_facts, "_l_from", "_l_to", "_r_from", "_r_to"]
    # The right begins within the left, or the left begins within the right and later than it.
    one = join_valid(begins(theirs, "r"), ends(mine, "l"), keys).select(*columns)
    other = join_valid(begins(mine, "l"), ends(theirs, "r"), keys).filter(F.col("_l_from") > F.col("_r_from")).select(*columns)
    to = F.least(_end("_l_to"), _end("_r_to"))
    return one.unionByName(other).select(
        *keys, *l_facts, *r_facts, F.greatest("_l_from", "_r_from").alias("valid_from"), F.nullif(to, F.lit(NEVER)).alias("valid_to"))


def uncovered(whole: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, valid_from, valid_to): the parts of the intervals of ``whole`` in which no fact of ``history`` holds."""
    spans = coalesced(whole.select(*keys, *_ENDS))
    held = coalesced(intersected(spans, history.select(*keys, *_ENDS), keys))
    edges = spans.select(*keys, F.col("valid_from").alias("_at"), _end("valid_to").alias("_whole_to"), F.lit(0).alias("_kind"), F.col("valid_from").alias("_free"))
    # After a fact ends the time is free until the next begins, or the span ends: each held part carries its span's end along.
    inside = held.select(*keys, F.col("valid_from").alias("_at"), F.lit(None).cast("long").alias("_whole_to"), F.lit(1).alias("_kind"), _end("valid_to").alias("_free"))
    by_time = Window.partitionBy(*keys).orderBy("_at", "_kind")
    rows = edges.unionByName(inside).withColumns({
        "_next": F.lead("_at").over(by_time), "_next_kind": F.lead("_kind").over(by_time),
        "_span_to": F.last("_whole_to", ignorenulls=True).over(by_time)})
    until = F.when(F.col("_next_kind") == 1, F.col("_next")).otherwise(F.col("_span_to"))
    free = rows.select(*keys, F.col("_free").alias("valid_from"), F.least(until, F.col("_span_to")).alias("_to")).filter(F.col("valid_from") < F.col("_to"))
    return free.select(*keys, "valid_from", F.nullif(F.col("_to"), F.lit(NEVER)).alias("valid_to"))


@dataclass
class Dimensions:
    """Histories of app(app_phash, app, owner, criticality), runs_as(app_phash, svc_phash, service) and consumes(svc_phash, customer)."""

    app: DataFrame
    runs_as: DataFrame
    consumes: DataFrame

    def people(self) -> DataFrame:
        """(svc_phash, app, service, owner, customer, criticality) by interval; the customer is empty while there is none."""
        served = coalesced(intersected(self.runs_as, self.app, ["app_phash"]).drop("app_phash"))
        consumed = self.consumes.select("svc_phash", "customer", *_ENDS)
        with_some = intersected(served, consumed, ["svc_phash"])
        with_none = intersected(served, uncovered(served, consumed, ["svc_phash"]), ["svc_phash"]).withColumn("customer", F.lit(""))
        return coalesced(with_some.unionByName(with_none).select("svc_phash", *IMPACT_COLUMNS, *_ENDS))


def impact_dims_asof(exposed: DataFrame, people: DataFrame, lookups: DataFrame) -> DataFrame:
    """Q7 with the owner, service and customers of the instant looked at: ``lookups(iface_phash, at_s)`` against two histories.

    ``exposed`` is ``topology.exposure``, ``people`` is ``Dimensions.people``; both are kept as tables and looked up in.
    """
    hits = join_valid(lookups.select("iface_phash", "at_s").distinct(), exposed, ["iface_phash"]).select("iface_phash", "at_s", "svc_phash")
    return join_valid(hits, people, ["svc_phash"]).select("iface_phash", "at_s", *IMPACT_COLUMNS).distinct()
