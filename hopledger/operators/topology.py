"""Paths and blast radius at a point in time (Q1-Q12)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopledger.functions.identity import iface_label, strict_int, trim_spaces
from hopledger.functions.times import as_of_seconds, valid_at
from hopledger.operators.catalog import resolve_refs
from hopledger.operators.intervals import join_valid
from hopledger.operators.sieve import marked

HOP_COLUMNS = [
    "device", "if_name", "metric_if_name", "instance", "if_index",
    "seq", "direction", "provenance", "confidence",
]
IMPACT_COLUMNS = ["app", "service", "owner", "customer", "criticality"]


@dataclass
class Topology:
    """The tables of the graph, one DataFrame per node or edge type; a reader may leave out those it does not read."""

    catalog: DataFrame | None = None
    app: DataFrame | None = None
    service: DataFrame | None = None
    runs_as: DataFrame | None = None
    consumes: DataFrame | None = None
    takes: DataFrame | None = None
    hop: DataFrame | None = None


def _hop_details(topology: Topology, steps: DataFrame, carried: list[str]) -> DataFrame:
    interfaces = topology.catalog.withColumnRenamed("phash", "iface_phash").select(
        "iface_phash", "device", "if_name", "metric_if_name", "instance", "if_index"
    )
    provenance = F.coalesce(F.nullif(F.col("provenance"), F.lit("")), F.lit("declared"))
    return (
        steps.join(interfaces, "iface_phash").withColumn("provenance", provenance)
        .select(*carried, *HOP_COLUMNS).distinct()
    )


def app_paths(topology: Topology, at_s: int) -> DataFrame:
    """Q1 for every app at one instant: the interfaces of all its candidate paths.

    The instant filters the edges before any join. Order with ``in_path_order``.
    """
    open_now = topology.takes.filter(valid_at(F.lit(at_s), F.col("valid_from"), F.col("valid_to")))
    steps = (
        open_now.select("svc_phash", "path_phash", "provenance", "confidence")
        .join(topology.hop, "path_phash")
        .join(topology.runs_as, "svc_phash")
    )
    return _hop_details(topology, steps, ["app_phash"])


def app_paths_asof(topology: Topology, queries: DataFrame) -> DataFrame:
    """Q1 in bulk: ``queries(app_phash, at_s)``, each with its own instant."""
    wanted = queries.select("app_phash", "at_s").distinct().join(topology.runs_as, "app_phash")
    steps = (
        join_valid(wanted, topology.takes.drop("app_phash"), ["svc_phash"])
        .select("app_phash", "at_s", "path_phash", "provenance", "confidence")
        .join(topology.hop, "path_phash")
    )
    return _hop_details(topology, steps, ["app_phash", "at_s"])


def in_path_order(paths: DataFrame) -> DataFrame:
    """By position, ties by device, interface and direction."""
    lead = [c for c in ("app_phash", "at_s") if c in paths.columns]
    return paths.orderBy(*lead, "seq", "device", "if_name", "direction")


def exposure(topology: Topology, whole: bool = True) -> DataFrame:
    """Which service depends on which interface, and when: the history flattened for lookups.

    Several paths of one connection over the same interface collapse to one row; with ``whole=False`` only the hops of one path do, while
    they are still dealt by path. What answers lookups makes its rows distinct, so it needs no shuffle of the whole history for the rest.
    """
    rows = (
        topology.takes.select("svc_phash", "path_phash", "valid_from", "valid_to")
        .join(topology.hop.select("path_phash", "iface_phash"), "path_phash")
    )
    kept = ["iface_phash", "svc_phash", "valid_from", "valid_to"]
    return rows.select(*kept).distinct() if whole else rows.select("path_phash", *kept).distinct().select(*kept)


def _impact_rows(topology: Topology, hits: DataFrame, carried: list[str]) -> DataFrame:
    """App, owner and customers of the services hit; customers are optional. ``hits`` are distinct.

    A row names its service, so rows repeat only where two services have one name; else none are shuffled to find repeats among them.
    """
    apps = topology.app.select(
        "app_phash", F.col("name").alias("app"), "owner", F.coalesce("criticality", F.lit("")).alias("criticality")
    )
    services = topology.service.select("svc_phash", F.col("name").alias("service"))
    customers = topology.consumes.select("svc_phash", "customer").distinct()
    people = (
        topology.runs_as.join(apps, "app_phash").join(services, "svc_phash")
        .join(customers, "svc_phash", "left")
        .select("svc_phash", "app", "service", "owner",
                F.coalesce("customer", F.lit("")).alias("customer"), "criticality")
        .distinct()
    )
    rows = hits.select(*carried, "svc_phash").join(people, "svc_phash").select(*carried, *IMPACT_COLUMNS)
    ends = services.groupBy("service").agg(F.min("svc_phash").alias("_lo"), F.max("svc_phash").alias("_hi"))
    return rows if ends.filter(F.col("_lo") != F.col("_hi")).isEmpty() else rows.distinct()


def impact_at(topology: Topology, at_s: int) -> DataFrame:
    """Q2 for every interface at one instant."""
    now = exposure(Topology(**{
        **topology.__dict__,
        "takes": topology.takes.filter(valid_at(F.lit(at_s), F.col("valid_from"), F.col("valid_to"))),
    }))
    return _impact_rows(topology, now.select("iface_phash", "svc_phash").distinct(), ["iface_phash"])


def impact_asof(topology: Topology, lookups: DataFrame, exposed: DataFrame | None = None) -> DataFrame:
    """Q7: ``lookups(iface_phash, at_s)`` against the history, one distinct lookup answered once.

    The join goes by time buckets (``join_valid``), so a lookup meets little more than what is valid at its instant. The history of
    interfaces that nobody asks about is sifted out before it is shuffled.
    """
    wanted = lookups.select("iface_phash", "at_s").distinct()
    return _impact_of(topology, wanted, ["iface_phash", "at_s"], exposed)


def _impact_of(topology: Topology, wanted: DataFrame, carried: list[str], exposed: DataFrame | None) -> DataFrame:
    """The impact rows of ``wanted(iface_phash, at_s, carried)``."""
    exposed = exposure(topology) if exposed is None else exposed
    exposed = marked(exposed, wanted, ["iface_phash"], "_asked").filter("_asked").drop("_asked")
    hits = join_valid(wanted, exposed, ["iface_phash"], [*carried, "svc_phash"])
    return _impact_rows(topology, hits, carried)


def find_by_index(catalog: DataFrame, queries: DataFrame) -> DataFrame:
    """Q3, lookup: ``queries(instance, if_index)`` to status none, ok or ambiguous and the identity."""
    ends = catalog.groupBy("instance", "if_index").agg(F.min("phash").alias("_lo"), F.max("phash").alias("_hi"))
    status = F.when(F.col("_lo").isNull(), "none").when(F.col("_lo") == F.col("_hi"), "ok").otherwise("ambiguous")
    return (
        queries.select("instance", "if_index").distinct().join(ends, ["instance", "if_index"], "left")
        .select("instance", "if_index", status.alias("status"),
                F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("iface_phash"))
    )


def impact_by_index(topology: Topology, queries: DataFrame, exposed: DataFrame | None = None) -> DataFrame:
    """Q3: ``queries(qid, instance, if_index, at_s)``; rows only for a single interface.

    Here and below ``exposed`` is the stored ``exposure``; without it the history is joined anew.
    """
    found = queries.join(find_by_index(topology.catalog, queries), ["instance", "if_index"]).filter("status = 'ok'")
    return _impact_of(topology, found.select("qid", "iface_phash", "at_s"), ["qid"], exposed)


def impact_by_name(topology: Topology, queries: DataFrame, exposed: DataFrame | None = None) -> DataFrame:
    """Q4: ``queries(qid, device, ref, at_s)`` through reference resolution."""
    found = queries.join(resolve_refs(queries, topology.catalog), ["device", "ref"]).filter("status = 'ok'")
    found = found.withColumnRenamed("phash", "iface_phash")
    return _impact_of(topology, found.select("qid", "iface_phash", "at_s"), ["qid"], exposed)


def choose_mode(requests: DataFrame, now_s: Column) -> DataFrame:
    """Q5: ``requests(qid, instance, if_index_raw, device, ref, at_raw)`` to a ``mode``.

    The exact pair wins over the name pair and does not fall back to it, even with a bad index.
    """
    given = lambda c: F.coalesce(trim_spaces(F.col(c)), F.lit(""))
    rows = requests.select(
        "qid", given("instance").alias("instance"), given("if_index_raw").alias("if_index_raw"),
        given("device").alias("device"), given("ref").alias("ref"),
        as_of_seconds(F.col("at_raw"), now_s).alias("at_s"),
    ).withColumn("if_index", strict_int(F.col("if_index_raw")))
    exact = (F.col("instance") != "") & (F.col("if_index_raw") != "")
    named = (F.col("device") != "") & (F.col("ref") != "")
    mode = (
        F.when(F.col("at_s").isNull(), "invalid at")
        .when(exact & F.col("if_index").isNull(), "invalid ifIndex")
        .when(exact, "exact").when(named, "name").otherwise("invalid")
    )
    return rows.withColumn("mode", mode)


def resolve_targets(catalog: DataFrame, moded: DataFrame) -> DataFrame:
    """Rows of ``mode`` exact or name with ``target_status`` and ``iface_phash``."""
    exact = moded.filter("mode = 'exact'")
    exact = exact.join(find_by_index(catalog, exact), ["instance", "if_index"])
    name = moded.filter("mode = 'name'")
    name = name.join(resolve_refs(name, catalog).withColumnRenamed("phash", "iface_phash"), ["device", "ref"])
    columns = [*moded.columns, F.col("status").alias("target_status"), "iface_phash"]
    return exact.select(*columns).unionByName(name.select(*columns))


def answer_requests(
    topology: Topology, requests: DataFrame, now_s: Column, exposed: DataFrame | None = None
) -> DataFrame:
    """Q5, Q6: every request answered, with a ``note`` where there are no rows to give."""
    moded = choose_mode(requests, now_s)
    targets = resolve_targets(topology.catalog, moded)
    rows = targets.join(
        impact_asof(topology, targets.filter("target_status = 'ok'"), exposed), ["iface_phash", "at_s"], "left"
    )
    note = (
        F.when(F.col("target_status") == "no_match", "no interface matches")
        .when(F.col("target_status") == "ambiguous", "ambiguous interface reference")
        .when(F.col("app").isNull(), "no path known")
    )
    bad = moded.filter(~F.col("mode").isin("exact", "name")).select(
        "qid", "mode", F.col("mode").alias("note"),
        *[F.lit(None).cast("string").alias(c) for c in IMPACT_COLUMNS],
    )
    return rows.select("qid", "mode", note.alias("note"), *IMPACT_COLUMNS).unionByName(bad)


def list_apps(topology: Topology) -> DataFrame:
    """Q8."""
    return topology.app.select("name").orderBy("name")


def app_services(topology: Topology) -> DataFrame:
    """Q9: one service name per app: the lowest of several, the app's own name if there is none."""
    named = topology.runs_as.join(topology.service, "svc_phash").groupBy("app_phash").agg(
        F.min("name").alias("_service")
    )
    return topology.app.select("app_phash", F.col("name").alias("app")).join(named, "app_phash", "left").select(
        "app_phash", "app", F.coalesce("_service", "app").alias("service")
    )


def interface_selectors(paths: DataFrame) -> DataFrame:
    """Q10: the (instance, if_index) pairs of each app, in numeric index order, as ``selector``."""
    return (
        paths.select("app_phash", "instance", "if_index").distinct()
        .withColumn("selector", iface_label(F.col("instance"), F.col("if_index")))
        .orderBy("app_phash", "instance", "if_index")
    )


def selector_lists(paths: DataFrame) -> DataFrame:
    """Q10 as one array per app."""
    pairs = F.array_sort(F.collect_set(F.struct("instance", "if_index")))
    return paths.groupBy("app_phash").agg(
        F.transform(pairs, lambda p: iface_label(p["instance"], p["if_index"])).alias("selectors")
    )


def scope_samples(samples: DataFrame, selectors: DataFrame) -> DataFrame:
    """Q11: samples of the selected interfaces, unlabelled; an interface of many apps counts once."""
    return samples.join(selectors.select(F.col("selector").alias("iface")).distinct(), "iface", "left_semi")


def curated_paths(topology: Topology, curated: DataFrame, at_s: int) -> tuple[DataFrame, DataFrame]:
    """Q12: (paths of ``curated(app_phash)``, the curated apps without any)."""
    wanted = curated.select("app_phash").distinct()
    paths = app_paths(topology, at_s).join(wanted, "app_phash", "left_semi")
    return paths, wanted.join(paths, "app_phash", "left_anti")
