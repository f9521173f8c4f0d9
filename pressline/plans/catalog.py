"""Query catalog: name -> (Spark job over the driver tables, DuckDB oracle SQL).

Each job takes ``(spark, sf_dir)``, reads whole tables (or views Spark derives
from them) and returns a DataFrame whose column names and types match its
oracle query. Doubles that come out of long float sums are rounded to 9 places
in both engines (their last bits differ between engines).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from pressline.plans import (queries_classify, queries_encode, queries_files, queries_ingest,  # noqa: F401
                                 queries_metrics, queries_profile, queries_text)
