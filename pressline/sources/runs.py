"""Run records and training histories (JSON sinks) as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressline import constants as C

RUN_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("batch_size", T.IntegerType()),
    T.StructField("epochs", T.IntegerType()),
    T.StructField("lr", T.DoubleType()),
    T.StructField("warmup", T.IntegerType()),
    T.StructField("samples", T.LongType()),
    T.StructField("column_split_order", T.ArrayType(T.StringType())),
    T.StructField("note", T.StringType()),
    T.StructField("checkpoint", T.BooleanType()),
    T.StructField("blocksize", T.IntegerType()),
])


def run_record(spark: SparkSession, run_id: str, batch_size: int, epochs: int, lr: float,
               warmup: int, samples: int, column_split_order: Sequence[str] | None,
               note: str | None = None, checkpoint: bool | None = None,
               blocksize: int | None = None) -> DataFrame:
    """One-row run record; ``date`` is the job's current time as
    ``dd-MMM-yyyy (HH:mm:ss.SSSSSS)``. Classifier runs carry the label order,
    code-corpus runs carry ``checkpoint`` and ``blocksize`` instead."""
    row = [(run_id, batch_size, epochs, float(lr), warmup, samples,
            list(column_split_order) if column_split_order is not None else None,
            note, checkpoint, blocksize)]
    df = spark.createDataFrame(row, RUN_SCHEMA)
    return df.withColumn("date", F.date_format(F.current_timestamp(), C.RUN_DATE_FORMAT))


def append_run(record: DataFrame, path: str) -> None:
    record.write.mode("append").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([*RUN_SCHEMA.fields, T.StructField("date", T.StringType())])).json(path)


def label_order_of(runs: DataFrame, run_id: str) -> DataFrame:
    """``(label_idx, label)`` of one run."""
    return (runs.where(F.col("run_id") == run_id)
                .select(F.posexplode("column_split_order").alias("label_idx", "label")))


def write_history(history: DataFrame, path: str) -> None:
    """Per-phase history rows (two of them) as JSON, one file set per run."""
    history.coalesce(1).write.mode("overwrite").json(path)
