"""Materialisation and size-checked broadcast helpers.

* :func:`stage` writes a DataFrame as Parquet under the shared checkpoint folder
  and reads it back: the lineage is cut (a lost executor costs a re-read, not a
  recompute of the whole upstream job) and later scans prune columns.
* :func:`checked_broadcast` broadcasts a small side only after its row count was
  measured; past the bound it returns the side unhinted so the planner uses a
  shuffle join (with adaptive skew splitting on).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressline import constants as C
from pressline.session import checkpoint_root


STAGE_DIR = "pressline-stage"


def _stage_root(spark) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/{STAGE_DIR}"


def scratch_path(spark, name: str) -> str:
    """A new folder below the stage folder."""
    return f"{_stage_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``codec``: the files' compression, if another than the session's."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    (writer.option("compression", codec) if codec else writer).parquet(path)
    return spark.read.parquet(path)


def drop_stage(staged: DataFrame) -> None:
    """Delete the tables of :func:`stage` that a DataFrame reads, once every step that reads them has been written itself.
    All of what it reads must be staged."""
    spark = staged.sparkSession
    try:
        jvm = spark.sparkContext._jvm
    except Exception:  # noqa: BLE001 - Spark Connect: no driver-side context, the tables stay
        return
    folders = {file.rpartition("/")[0] for file in staged.inputFiles()}
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in sorted(folders)]
    for path in paths:
        if path.getParent().getName() != STAGE_DIR:
            raise ValueError(f"{path} isn't a staged table")
    for path in paths:
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(spark) -> bool:
    """Delete every staged table of this checkpoint folder (through the Hadoop
    file system of the shared folder). Call it after the results that read
    them were written; DataFrames built on staged tables fail afterwards."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_stage_root(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(path) and fs.delete(path, True))


def checked_broadcast(small: DataFrame, max_rows: int = C.MAX_BROADCAST_ROWS,
                      materialize: bool = True, max_bytes: int = C.MAX_BROADCAST_BYTES) -> DataFrame:
    """``broadcast(small)`` if it has at most ``max_rows`` rows and at most
    ``max_bytes`` bytes, else ``small``.

    Both bounds are measured, not estimated: the rows are counted (stopping
    past ``max_rows``), and only a side within the row bound has its rows'
    JSON text length summed (a cheap pass over at most ``max_rows`` rows).
    With ``materialize`` the side is checkpointed first (reliable checkpoint in
    the shared folder), so measuring it and joining with it do not run its
    upstream plan again.
    """
    side = small.checkpoint(eager=True) if materialize else small
    n = side.limit(max_rows + 1).count()
    if n > max_rows:
        return side
    size = side.select(F.sum(F.length(F.to_json(F.struct(*[side[c] for c in side.columns]))))).first()[0]
    return F.broadcast(side) if (size or 0) <= max_bytes else side
