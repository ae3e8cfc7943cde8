"""Registered queries over the driver tables, each beside the SQL that checks it."""

from __future__ import annotations

import importlib

from hopledger.plans.registry import QUERIES, Query

MODULES = ["source_queries", "catalog_queries", "history_queries", "series_queries", "enrich_queries", "stream_queries"]


def all_queries() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"hopledger.plans.{module}")
    return dict(QUERIES)
