"""Headline queries on the driver tables; prints one JSON line.

The graph tables are built first (``build_topology``), as they are stored, and each query then runs
to the end of its plan without collecting. ``rows_per_s`` gives samples per second for the counter
rate and lookups per second for the bulk impact.
"""

from __future__ import annotations

import json
import os
import time

from hopledger.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
QUERIES = [
    "resolve_refs", "validate_declarations", "latest_per_identity", "revisions", "app_paths", "impact", "impact_asof",
    "answer_requests", "mapping_series", "instant_vector", "counter_rate", "if_egress_octets_rate", "if_util",
    "path_util_max", "path_rollups", "alert_path_hop_down", "alert_mapping_drift", "render_labels", "enrich_alerts",
]


def timed(action) -> float:
    begin = time.perf_counter()
    action()
    return round(time.perf_counter() - begin, 3)


def main() -> None:
    spark = build_session(
        "bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__driver__memory="16g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    from hopledger.plans import all_queries, domain

    queries = all_queries()
    seconds = {"build_topology": timed(lambda: (
        domain.topology(spark, SF_DIR), domain.mapping(spark, SF_DIR), domain.exposed(spark, SF_DIR),
        domain.alerts(spark, SF_DIR), domain.declarations(spark, SF_DIR),
    ))}
    for name in QUERIES:
        run = lambda: queries[name].build(spark, SF_DIR).write.format("noop").mode("overwrite").save()  # noqa: B023, E731
        seconds[name] = timed(run)
    counters = domain.samples(spark, SF_DIR).filter("metric not in ('ALERTS', 'ifHighSpeed', 'ifOperStatus')").count()
    lookups = domain.alerts(spark, SF_DIR).count()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "rows_per_s": {
            "counter_rate": round(counters / seconds["counter_rate"]),
            "impact_asof": round(lookups / seconds["impact_asof"]),
        },
    }))
    spark.stop()


if __name__ == "__main__":
    main()
