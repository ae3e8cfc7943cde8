"""Interface catalog: harvest, build, upkeep and reference resolution."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from hopledger.functions.identity import (
    SPACES, expand_if_name, host_part, interface_hash, key_safe, normalize_token,
    plain_lower, strict_int, trim_spaces,
)

CATALOG_COLUMNS = [
    "phash", "device", "if_name", "metric_if_name", "if_descr", "if_alias",
    "instance", "vendor", "if_index", "observed_at",
]
INBOUND_OCTETS = "ifHCInOctets"
SUGGESTIONS = 8


def check_label_name(name: str) -> str:
    """A label chosen by the user must be a plain label name."""
    if not re.fullmatch(r"[a-zA-Z_][a-zA-Z0-9_]*", name):
        raise ValueError(f"invalid label name {name!r}")
    return name


def harvest_interfaces(
    samples: DataFrame, device_label: str | None = None, observation: Observation | None = None
) -> DataFrame:
    """Distinct interface identities of the inbound octet counter.

    ``samples`` carries raw labels: instance, if_index_raw, if_name, if_descr, if_alias and, if
    named, the device label. A non-numeric index drops the row (counted as ``skipped`` on
    ``observation``); a missing one is 0.
    """
    device = F.coalesce(F.col(check_label_name(device_label)), F.lit("")) if device_label else F.lit("")
    label = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = (
        samples.filter(F.col("metric") == INBOUND_OCTETS)
        .select(label("instance"), device.alias("device"), label("if_name"), label("if_descr"),
                label("if_alias"), label("if_index_raw"))
        .distinct()
    )
    return parse_index(rows, observation)


def parse_index(rows: DataFrame, observation: Observation | None = None) -> DataFrame:
    raw = F.col("if_index_raw")
    rows = rows.withColumn("if_index", F.when(raw == "", F.lit(0).cast("bigint")).otherwise(strict_int(raw)))
    if observation is not None:
        rows = rows.observe(observation, F.count_if(F.col("if_index").isNull()).alias("skipped"))
    return rows.filter(F.col("if_index").isNotNull()).drop("if_index_raw")


def name_device(rows: DataFrame, inventory: DataFrame | None) -> DataFrame:
    """Device label, then inventory (by instance, then by its host part), then host part."""
    rows = rows.withColumn("_host", host_part(F.col("instance")))
    found: list[Column] = []
    if inventory is not None:
        by_instance = inventory.select(F.col("ip").alias("instance"), F.col("device").alias("_by_instance"))
        by_host = inventory.select(F.col("ip").alias("_host"), F.col("device").alias("_by_host"))
        rows = rows.join(by_instance, "instance", "left").join(by_host, "_host", "left")
        found = [F.nullif(F.col("_by_instance"), F.lit("")), F.nullif(F.col("_by_host"), F.lit(""))]
    named = F.coalesce(F.nullif(F.col("device"), F.lit("")), *found, F.col("_host"))
    return rows.withColumn("raw_device", named).drop("_host", "_by_instance", "_by_host")


def judge_interfaces(rows: DataFrame, inventory: DataFrame | None = None, vendor: str = "") -> DataFrame:
    """C1 before the split: every observed row with its identity and a ``reason`` (null when good)."""
    rows = name_device(rows, inventory)
    # the description counts only where the name is nothing but blanks
    named = F.translate("if_name", SPACES, "") != ""
    rows = rows.withColumn("metric_if_name", F.col("if_name")).withColumns({
        "device": normalize_token(F.col("raw_device")),
        "_token": normalize_token(F.when(named, F.col("if_name")).otherwise(F.col("if_descr"))),
    })
    rows = rows.withColumn("if_name", expand_if_name(F.col("_token")))
    reason = (
        F.when(F.col("if_name") == "", "empty canonical name")
        .when(F.col("device") == "", "empty_device")
        .when(~key_safe(F.col("device")), "unsafe device")
        .when(~key_safe(F.col("if_name")), "unsafe ifName")
    )
    return rows.withColumns({
        "reason": reason,
        "vendor": F.lit(vendor),
        "phash": interface_hash(F.col("device"), F.col("if_name")),
    }).drop("raw_device", "_token")


def build_catalog(
    rows: DataFrame, observed_at: int | Column, inventory: DataFrame | None = None, vendor: str = ""
) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects with a reason)."""
    at = F.lit(observed_at) if isinstance(observed_at, int) else observed_at
    judged = judge_interfaces(rows, inventory, vendor).withColumn("observed_at", at.cast("bigint"))
    ok = judged.filter(F.col("reason").isNull()).drop("reason")
    return ok, judged.filter(F.col("reason").isNotNull()).drop("phash")


def identity_collisions(ok: DataFrame) -> DataFrame:
    """One row per further instance of an identity, beside the instance seen first.

    Grouping by instance comes first, so an identity seen in many samples is small before it meets
    its window; rows, not arrays, carry the instances.
    """
    seen = ok.groupBy("phash", "device", "if_name", "instance").agg(F.min("ord").alias("ord"))
    first = seen.groupBy("phash").agg(
        F.min_by("instance", "ord").alias("first_instance"), F.count(F.lit(1)).alias("_n")
    )
    return (
        seen.join(first.filter("_n > 1").drop("_n"), "phash")
        .filter(F.col("instance") != F.col("first_instance"))
        .select("phash", "device", "if_name", "first_instance", F.col("instance").alias("other_instance"))
    )


def latest_per_identity(ok: DataFrame) -> DataFrame:
    """The last row of an identity wins, by (observed_at, ord)."""
    newest = Window.partitionBy("phash").orderBy(F.desc("observed_at"), F.desc("ord"))
    # a rank filter of one is also applied before the shuffle, so a hot identity stays small
    return ok.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").select(*CATALOG_COLUMNS)


def refresh_catalog(old: DataFrame, new: DataFrame) -> DataFrame:
    """C4: new attributes overwrite old ones, interfaces no longer seen are kept."""
    old, new = old.alias("old"), new.alias("new")
    both = old.join(new, F.col("old.phash") == F.col("new.phash"), "full_outer")
    fresh = F.col("new.phash").isNotNull()
    return both.select(*[
        F.when(fresh, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in CATALOG_COLUMNS
    ])


def oldest_observation(catalog: DataFrame) -> DataFrame:
    """The earliest observation, zero meaning never; 0 when there is none."""
    seen = F.when(F.col("observed_at") != 0, F.col("observed_at"))
    return catalog.agg(F.coalesce(F.min(seen), F.lit(0).cast("bigint")).alias("oldest_observed_at"))


def interfaces_by_hash(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """Lookup by identity (C7 is reading the table)."""
    return catalog.join(wanted.select("phash").distinct(), "phash", "left_semi")


def recent_only(catalog: DataFrame, now_s: int, max_age_s: int | None = None) -> DataFrame:
    """Interfaces seen within ``max_age_s``; all of them when it is None, the default."""
    return catalog if max_age_s is None else catalog.filter(F.col("observed_at") >= now_s - max_age_s)


def catalog_tokens(catalog: DataFrame) -> DataFrame:
    """Each interface under every spelling it answers to.

    Domain ``c`` holds canonical names, ``l`` lowered alias and metric name. Matching on tokens is
    an equality join where the four spellings compared directly would be an OR of four conditions.
    """
    spelling = lambda domain, token: F.struct(F.lit(domain).alias("dom"), token.alias("token"))
    spellings = F.array(
        spelling("c", F.col("if_name")),
        spelling("c", expand_if_name(F.col("_descr"))),
        spelling("l", plain_lower(F.col("if_alias"))),
        spelling("l", plain_lower(F.col("metric_if_name"))),
    )
    named = catalog.withColumns({
        "device": normalize_token(F.col("device")), "_descr": normalize_token(F.col("if_descr")),
    })
    return named.withColumn("_s", F.explode(spellings)).select(
        "device", "_s.dom", "_s.token", "phash", "metric_if_name"
    ).filter(F.col("token") != "")


def reference_tokens(refs: DataFrame) -> DataFrame:
    """Distinct (device, ref) with the two tokens a reference may match by; none when it is blank."""
    distinct = refs.select("device", "ref").distinct()
    return distinct.withColumns({
        "_device": normalize_token(F.col("device")), "_token": normalize_token(F.col("ref")),
    }).withColumns({
        "_c": expand_if_name(F.col("_token")), "_l": plain_lower(trim_spaces(F.col("ref"))),
    }).drop("_token")


def _explode_reference(refs: DataFrame) -> DataFrame:
    """One row per usable token; a blank reference keeps one row without a token."""
    tokens = F.array(
        F.struct(F.lit("c").alias("dom"), F.col("_c").alias("token")),
        F.struct(F.lit("l").alias("dom"), F.col("_l").alias("token")),
    )
    usable = F.filter(tokens, lambda t: t["token"] != "")
    return refs.withColumn("_t", F.explode_outer(usable)).select(
        "device", "ref", "_device", F.col("_t.dom").alias("dom"), F.col("_t.token").alias("token")
    )


def resolve_refs(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(device, ref) to ``phash`` and ``status`` ok, no_match or ambiguous, one row per distinct pair.

    Interfaces sharing a token are reduced to the lowest and highest identity before the join; equal
    ends over both tokens mean exactly one match. No list of matches is ever built, whatever the
    number of interfaces behind a token.
    """
    ends = catalog_tokens(catalog).groupBy("device", "dom", "token").agg(
        F.min("phash").alias("_lo"), F.max("phash").alias("_hi")
    ).withColumnRenamed("device", "_device")
    status = (
        F.when(F.col("_lo").isNull(), "no_match").when(F.col("_lo") == F.col("_hi"), "ok").otherwise("ambiguous")
    )
    return (
        _explode_reference(reference_tokens(refs)).join(ends, ["_device", "dom", "token"], "left")
        .groupBy("device", "ref").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        .select("device", "ref", status.alias("status"),
                F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("phash"))
    )


def suggestions(catalog: DataFrame, most: int = SUGGESTIONS) -> DataFrame:
    """Per device the first ``most`` metric names in order, repeats kept, as rows with a rank."""
    in_order = Window.partitionBy("device").orderBy("metric_if_name", "phash")
    # the rank filter runs before the shuffle too: at most that many rows per device leave a task
    return (
        catalog.withColumn("device", normalize_token(F.col("device")))
        .withColumn("rank", F.row_number().over(in_order))
        .filter(F.col("rank") <= most)
        .select("device", "rank", "metric_if_name")
    )


def suggestion_lists(catalog: DataFrame, most: int = SUGGESTIONS) -> DataFrame:
    """C9 as one array of at most ``most`` names per device."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "metric_if_name")))
    return suggestions(catalog, most).groupBy("device").agg(
        F.transform(ranked, lambda s: s["metric_if_name"]).alias("suggestions")
    )


def ambiguous_matches(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """The interfaces an ambiguous reference matched, one row each."""
    unclear = resolve_refs(refs, catalog).filter("status = 'ambiguous'").select("device", "ref")
    tokens = _explode_reference(reference_tokens(unclear))
    spelled = catalog_tokens(catalog).withColumnRenamed("device", "_device")
    return (
        tokens.join(spelled, ["_device", "dom", "token"])
        .select("device", "ref", "phash", "metric_if_name").distinct()
    )
