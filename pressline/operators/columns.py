"""Evaluate expensive derived columns exactly once per row.

Catalyst inlines a projected expression into every later filter that uses it
and pushes such filters towards the scan (through projections and
repartitions). For cheap columns that is what we want; for a regex-heavy text
column it means the expression runs once in the filter and again in the
projection, and (before a round-robin spread) inside a single scan task.

``with_columns_once`` computes the given expressions inside a one-row
generator (``inline(array(struct(...)))``). Later filters refer to the
generator's output, so they stay above it and the expressions run once, after
any repartition below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_columns_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    keep = [F.col(c) for c in df.columns if c not in columns]
    packed = F.array(F.struct(*[expr.alias(name) for name, expr in columns.items()]))
    return df.select(*keep, F.inline(packed))


def in_range(c: Column, lo: int, hi: int) -> Column:
    """``lo <= c <= hi`` with ``c`` bound once (``between`` would copy it twice)."""
    return F.element_at(F.transform(F.array(c), lambda x: (x >= lo) & (x <= hi)), 1)
