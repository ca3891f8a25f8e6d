"""All registered queries of the engine, the blueprint ids they cover, and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
IDS: dict[str, tuple[str, ...]] = {}


def query(ids: str, sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under its name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], IDS[f.__name__] = f, tuple(ids.split())
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


for _name in ("graph_queries", "path_queries", "rule_queries", "shape_queries", "text_queries", "domain_queries", "control_queries", "catalog_queries", "source_queries", "table_queries"):
    importlib.import_module(f"graphspark.domain.{_name}")
