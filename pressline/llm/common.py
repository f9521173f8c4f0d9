"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline.session import checkpoint_root

#: A side is broadcast only after it was counted and found to have at most this many narrow rows.
BROADCAST_ROWS = 1_000_000
#: Text bytes that a Python task holds in one numpy pass.
SLICE_BYTES = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    This cuts the lineage at a table that every executor sees; a lost executor costs a read of it."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/llm-stage/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(staged: DataFrame) -> DataFrame:
    """``broadcast(staged)`` if its counted rows keep within ``BROADCAST_ROWS``; else the table as it
    is, for a shuffle join. ``staged`` must be a narrow table that is cheap to count."""
    n = staged.limit(BROADCAST_ROWS + 1).count()
    return F.broadcast(staged) if n <= BROADCAST_ROWS else staged


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str,
                slice_bytes: int = SLICE_BYTES, text: str = "text") -> DataFrame:
    """``mapInArrow`` that hands ``fn`` slices of at most about ``slice_bytes`` of the binary
    column ``text`` (a longer text alone makes one slice), so memory doesn't follow Arrow's row count."""

    def run(batches):
        for batch in batches:
            for part in sliced(batch, text, slice_bytes):
                yield from fn(part)

    return df.mapInArrow(run, schema)


def sliced(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def binary_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the text's UTF-8 bytes; no other column passes, so no name can clash."""
    return df.select(F.col(key).cast("long").alias(key), F.col(text).cast("binary").alias(text))
