"""Declarations: explode, validate, gate and expand to edges."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopledger.functions.identity import entity_hash, key_safe, trim_spaces
from hopledger.functions.text import candidate_paths
from hopledger.operators.catalog import resolve_refs
from hopledger.operators.sieve import marked
from hopledger.sources.sinks import settled

# The directions a hop may declare.
DIRECTIONS = ("ingress", "egress", "transit")
DECLARED_CONFIDENCE = 1.0

ERROR_COLUMNS = ["file", "app", "dep", "path_ix", "code", "detail"]


def dependencies(decl: DataFrame) -> DataFrame:
    """One row per dependency, in order, with its candidate paths."""
    return decl.select("*", F.posexplode("depends_on").alias("dep_ix", "_dep")).select(
        "*", F.col("_dep.to").alias("to"), candidate_paths(F.col("_dep.path"), F.col("_dep.paths")).alias("_paths")
    ).drop("depends_on", "_dep")


def candidate_rows(decl: DataFrame) -> DataFrame:
    """One row per candidate path, index from 0."""
    return _paths_of(dependencies(decl))


def _paths_of(deps: DataFrame) -> DataFrame:
    return deps.select("*", F.posexplode("_paths").alias("path_ix", "_path")).select(
        "*", F.coalesce(F.col("_path.hops"), F.expr("array()")).alias("_hops")
    ).drop("_paths", "_path")


def without_hops(decl: DataFrame) -> DataFrame:
    """The same dependencies and candidate paths with no hops on them: all that ``takes`` and ``depends_on`` read, and far shorter rows to shuffle."""
    dep_type = decl.schema["depends_on"].dataType.elementType
    none = F.struct(F.lit(None).cast(dep_type["path"].dataType["hops"].dataType).alias("hops"))
    bare = lambda path: F.when(path.isNotNull(), none)
    return decl.withColumn("depends_on", F.transform("depends_on", lambda dep: F.when(dep.isNotNull(), F.struct(
        dep["to"].alias("to"), bare(dep["path"]).alias("path"), F.transform(dep["paths"], bare).alias("paths")))))


def explode_declarations(decl: DataFrame) -> DataFrame:
    """One row per hop; ``seq`` counts from 1 within its candidate path."""
    hop_rows = candidate_rows(decl).select("*", F.posexplode("_hops").alias("_seq", "_hop"))
    return hop_rows.select(
        "file", "app", "runs_as", "dep_ix", "to", "path_ix",
        (F.col("_seq") + 1).alias("seq"),
        F.coalesce(F.col("_hop.device"), F.lit("")).alias("device"),
        F.coalesce(F.col("_hop.if"), F.lit("")).alias("ref"),
        F.coalesce(F.col("_hop.direction"), F.lit("")).alias("direction"),
    )


def app_hash(app: Column) -> Column:
    return entity_hash("application", app)


def service_hash(service: Column) -> Column:
    return entity_hash("appservice", service)


def _blank(text: Column) -> Column:
    return F.coalesce(trim_spaces(text), F.lit("")) == ""


def _unsafe(text: Column) -> Column:
    return F.coalesce(~key_safe(text), F.lit(False))


def _errors(rows: DataFrame, dep: Column, path_ix: Column, *checks: tuple[str, Column, Column]) -> DataFrame:
    """A row per check that failed, of (code, failed, detail); rows without a fault are left out before any is listed."""
    found = [F.when(failed, F.struct(F.lit(code).alias("code"), detail.alias("detail"))) for code, failed, detail in checks]
    problems = F.explode(F.filter(F.array(*found), lambda p: p.isNotNull()))
    return rows.filter(reduce(or_, [failed for _, failed, _ in checks])).select(
        "file", F.coalesce("app", F.lit("")).alias("app"), dep.alias("dep"),
        path_ix.cast("int").alias("path_ix"), problems.alias("_p"),
    ).select("file", "app", "dep", "path_ix", "_p.code", "_p.detail")


def validate_declarations(decl: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per problem. The faulty references are written once, as hops are sifted by them and then joined with them."""
    none_s, none_i = F.lit(None).cast("string"), F.lit(None).cast("int")
    empty = F.lit("")
    identity = _errors(
        decl, none_s, none_i,
        ("empty_app", _blank(F.col("app")), empty),
        ("empty_runs_as", _blank(F.col("runs_as")), empty),
        ("unsafe_app", _unsafe(F.col("app")), F.col("app")),
        ("unsafe_runs_as", _unsafe(F.col("runs_as")), F.col("runs_as")),
    )
    customers = decl.select("file", "app", F.explode("consumed_by_customers").alias("_customer"))
    customer = _errors(customers, none_s, none_i, ("unsafe_customer", _unsafe(F.col("_customer")), F.col("_customer")))
    dep_name = F.coalesce(F.col("to"), empty)
    deps = _errors(
        dependencies(decl), dep_name, none_i,
        ("empty_dep", _blank(F.col("to")), empty),
        ("unsafe_dep", _unsafe(F.col("to")), F.col("to")),
        ("no_path", F.size("_paths") == 0, empty),
    )
    paths = _errors(candidate_rows(decl), dep_name, F.col("path_ix"), ("empty_hops", F.size("_hops") == 0, empty))
    hops = explode_declarations(decl)
    faulty = settled(resolve_refs(hops, catalog).filter("status <> 'ok'").select("device", "ref", "status"))
    # Most hops are in order: only those with a bad direction, and those whose reference may be faulty, are shuffled.
    wrong = ~F.col("direction").isin(*DIRECTIONS)
    suspects = marked(hops, faulty, ["device", "ref"], "_may").filter(F.col("_may") | wrong)
    judged = suspects.join(faulty, ["device", "ref"], "left")
    hop = _errors(
        judged, dep_name, F.col("path_ix"),
        ("bad_direction", wrong, F.col("direction")),
        ("unresolved_hop", F.col("status") == "no_match", F.concat_ws("/", "device", "ref")),
        ("ambiguous_hop", F.col("status") == "ambiguous", F.concat_ws("/", "device", "ref")),
    )
    return reduce(DataFrame.unionByName, [identity, customer, deps, paths, hop])


def duplicate_apps(decl: DataFrame) -> DataFrame:
    """D3: files declaring an app that an earlier file (in name order) already declares."""
    keyed = decl.select("file", "app", app_hash(F.col("app")).alias("app_phash"))
    first = keyed.groupBy("app_phash").agg(F.min("file").alias("first_file"))
    return keyed.join(first, "app_phash").filter(F.col("file") > F.col("first_file")).select(
        "file", "app", F.lit(None).cast("string").alias("dep"), F.lit(None).cast("int").alias("path_ix"),
        F.lit("duplicate_app").alias("code"), F.col("first_file").alias("detail"),
    )


def shared_names(decl: DataFrame) -> DataFrame:
    """Warnings: a service several apps run as, and a dependency target named twice in one file."""
    none_i = F.lit(None).cast("int")
    keyed = decl.select(
        "file", "app", app_hash(F.col("app")).alias("_app"), F.col("runs_as").alias("_service"),
        service_hash(F.col("runs_as")).alias("_svc"),
    )
    ends = keyed.groupBy("_svc").agg(F.min("_app").alias("_lo"), F.max("_app").alias("_hi"))
    service = keyed.join(ends.filter(F.col("_lo") != F.col("_hi")), "_svc").select(
        "file", "app", F.lit(None).cast("string").alias("dep"), none_i.alias("path_ix"),
        F.lit("shared_service").alias("code"), F.col("_service").alias("detail"),
    )
    repeated = (
        dependencies(decl).groupBy("file", "app", service_hash(F.col("to")).alias("_to"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min("to").alias("dep")).filter("_n > 1")
        .select("file", "app", "dep", none_i.alias("path_ix"), F.lit("repeated_dep").alias("code"),
                F.col("_n").cast("string").alias("detail"))
    )
    return service.unionByName(repeated)


def batch_errors(decl: DataFrame, catalog: DataFrame) -> DataFrame:
    """All errors of a batch: parse errors where the reader kept them, validation, duplicates.

    A file that fails to parse or to validate does not claim its app, so a later good file for the
    same app is no duplicate of it. The errors of validation are written once, as duplicates depend on them, and so are the claims, which
    meet each other.
    """
    parsed, broken = decl, None
    if "parse_error" in decl.columns:
        broken = decl.filter(F.col("parse_error").isNotNull()).select(
            "file", F.lit("").alias("app"), F.lit(None).cast("string").alias("dep"),
            F.lit(None).cast("int").alias("path_ix"), F.lit("parse").alias("code"),
            F.col("parse_error").alias("detail"),
        )
        parsed = decl.filter(F.col("parse_error").isNull()).drop("parse_error")
    invalid = settled(validate_declarations(parsed, catalog))
    claims = settled(parsed.select("file", "app").join(invalid.select("file").distinct(), "file", "left_anti"))
    out = invalid.unionByName(duplicate_apps(claims))
    return out if broken is None else broken.unionByName(out)


def loadable(decl: DataFrame, errors: DataFrame, validate_only: bool = False, hops: bool = True) -> DataFrame:
    """The declarations that still load; none when only validating. ``hops=False`` leaves their hops out.

    Names of files find the good ones first, so that of the declarations, which are many times as long, few others are shuffled.
    """
    bad = errors.select("file").distinct()
    likely = marked(decl, decl.select("file").join(bad, "file", "left_anti"), ["file"], "_may").filter("_may").drop("_may")
    good = (likely if hops else without_hops(likely)).join(bad, "file", "left_anti")
    return good.filter(F.lit(not validate_only))


def batch_status(decl: DataFrame, errors: DataFrame) -> DataFrame:
    """One row with the counts and whether the batch failed."""
    files = decl.agg(F.count_distinct("file").alias("files"))
    failed = errors.agg(F.count(F.lit(1)).alias("errors"), F.count_distinct("file").alias("bad_files"))
    return failed.select(
        files.scalar().alias("files"), "errors", "bad_files", (F.col("errors") > 0).alias("failed")
    )


def stamp_batch(decl: DataFrame, commit_time: int | None = None) -> DataFrame:
    """The commit time if given, else now, in seconds."""
    now = F.unix_seconds(F.current_timestamp())
    return decl.withColumn("at_s", F.coalesce(F.lit(commit_time).cast("bigint"), now))


def connection_hash(svc: Column, target: Column, source: Column, valid_from: Column) -> Column:
    """D6."""
    return entity_hash("connection", svc, target, source, valid_from)


def path_hash(conn: Column, path_ix: Column) -> Column:
    """D6."""
    return entity_hash("path", conn, path_ix)


def customer_hash(customer: Column) -> Column:
    """D7."""
    return entity_hash("customer", customer)


def business_service_hash(customer: Column, app: Column) -> Column:
    """D7."""
    return entity_hash("businessservice", customer, app)


def app_edges(decl: DataFrame) -> dict[str, DataFrame]:
    """D8, the edges without validity: app, service, runs_as, consumes.

    Customers are a select of their own, so an app without customers keeps its dependencies.
    """
    app_phash, svc_phash = app_hash(F.col("app")), service_hash(F.col("runs_as"))
    targets = dependencies(decl).select(service_hash(F.col("to")).alias("svc_phash"), F.col("to").alias("name"))
    own = decl.select(svc_phash.alias("svc_phash"), F.col("runs_as").alias("name"))
    consumed = decl.select("app", "runs_as", F.explode("consumed_by_customers").alias("customer"))
    return {
        "app": decl.select(app_phash.alias("app_phash"), F.col("app").alias("name"), "owner", "criticality"),
        "service": own.unionByName(targets).groupBy("svc_phash").agg(F.min("name").alias("name")),
        "runs_as": decl.select(app_phash.alias("app_phash"), svc_phash.alias("svc_phash")).distinct(),
        "consumes": consumed.select(
            customer_hash(F.col("customer")).alias("cust_phash"), "customer",
            business_service_hash(F.col("customer"), F.col("app")).alias("bs_phash"),
            svc_phash.alias("svc_phash"),
        ).distinct(),
    }


def dependency_edges(decl: DataFrame, catalog: DataFrame, refs: DataFrame | None = None) -> dict[str, DataFrame]:
    """D8, the edges with validity: depends_on, takes and hop.

    ``decl`` carries source, valid_from and valid_to of its revision. A hop exists only where its
    interface does. ``refs(device, ref)`` holds the references of ``decl`` and perhaps others, if they are to be had for less.
    """
    # Each hash is made where its parts are, not again for every dependency and path below.
    own = decl.withColumns({"app_phash": app_hash(F.col("app")), "svc_phash": service_hash(F.col("runs_as"))})
    keyed = dependencies(own).withColumn("to_svc_phash", service_hash(F.col("to")))
    conn = connection_hash(F.col("svc_phash"), F.col("to_svc_phash"), F.col("source"), F.col("valid_from"))
    validity = [
        "valid_from", "valid_to", F.lit("declared").alias("provenance"),
        F.lit(DECLARED_CONFIDENCE).alias("confidence"), "source", F.col("valid_from").alias("observed_at"),
    ]
    named = lambda rows: rows.withColumn("conn_phash", conn).withColumn(
        "path_phash", path_hash(F.col("conn_phash"), F.col("path_ix")))
    paths = _paths_of(keyed)
    # Connection and path follow from the other columns, so repeats go before the two are made.
    taken = named(paths.select("app_phash", "svc_phash", "to_svc_phash", "path_ix", *validity).distinct())
    hops = named(paths).select("path_phash", F.posexplode("_hops").alias("_seq", "_hop")).select(
        "path_phash", (F.col("_seq") + 1).alias("seq"),
        F.coalesce(F.col("_hop.device"), F.lit("")).alias("device"),
        F.coalesce(F.col("_hop.if"), F.lit("")).alias("ref"), F.col("_hop.direction").alias("direction"),
    )
    resolved = resolve_refs(hops if refs is None else refs, catalog).filter("status = 'ok'")
    return {
        "depends_on": keyed.select("app_phash", "svc_phash", "to_svc_phash", *validity).distinct(),
        "takes": taken.select("app_phash", "svc_phash", "to_svc_phash", "conn_phash", "path_phash", "valid_from", "valid_to",
                              "provenance", "confidence", "source", "observed_at"),
        "hop": hops.join(resolved, ["device", "ref"]).select(
            "path_phash", "seq", "direction", F.col("phash").alias("iface_phash")
        ).distinct(),
    }
