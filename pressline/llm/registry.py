"""Queries of the training-data operators: name -> job, name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every operator module, which registers its query."""
    from pressline.llm import ann, chat, decontaminate, jaccard, licences, mixing, pii, quality, search, secrets, spelling, token_shards, toxicity  # noqa: F401
