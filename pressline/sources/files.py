"""Whole files, listed and read by tasks.

Spark's own readers list every file on the driver and deal a handful of small files to a task, so the driver's memory and the
number of tasks follow the files. Here folders are listed by tasks, the list is a staged table, and a task
reads some thousands of files one after the other; the driver sees counts only.

Tasks open a file system themselves, which works for ``TASK_SCHEMES``; what lies in another store is left to Spark's readers.
Files count as Spark's readers count them: hidden and empty ones don't.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressline.plans.stage import stage

TASK_SCHEMES = ("file", "hdfs")
FILES_PER_TASK = 5_000
BYTES_PER_TASK = 64 << 20
FOLDERS_PER_TASK = 16
LEAST_FILES = 50                # of a task, while there are fewer tasks than slots
LISTED_ROWS = 10_000            # of an Arrow batch
BATCH_BYTES = 16 << 20          # of contents that a task holds, besides one file
# Characters that Java's URI writes as percent codes in a path.
ENCODED = re.compile(r"[\x00-\x20\"#%<>?\[\\\]^`{|}\x7F-\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]")


@dataclass(frozen=True)
class Root:
    """A folder that tasks can open: its URI, its path there, and what precedes a path in Hadoop's full path."""
    uri: str
    path: str
    prefix: str


def task_root(spark: SparkSession, path: str) -> Root | None:
    """The folder at ``path`` for tasks, or None where only Spark's readers can go: other stores, patterns, single files."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: no driver-side context
        return None
    if any(c in path for c in "*?[]{}\\"):
        return None
    full = sc._jvm.org.apache.hadoop.fs.Path(path)
    files = full.getFileSystem(sc._jsc.hadoopConfiguration())
    full = files.makeQualified(full)
    scheme, below = full.toUri().getScheme(), full.toUri().getPath()
    if scheme not in TASK_SCHEMES or not files.exists(full) or not files.getFileStatus(full).isDirectory():
        return None
    prefix = full.toString().removesuffix(below)
    try:
        base = pafs.FileSystem.from_uri(prefix + quote(below))[1]
    except (pa.ArrowException, OSError, ValueError):
        return None
    return Root(prefix + quote(below), base.rstrip("/"), prefix)


def hidden(name: str, folder: bool = False) -> bool:
    """Whether Spark's readers skip a file or folder of this name."""
    if folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def encoded(path: str) -> str:
    """The path as Java's URI has it."""
    return ENCODED.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), path)


def list_files(spark: SparkSession, root: Root) -> DataFrame:
    """(path, uri, size) of every file below the root, ``uri`` as in Spark's ``_metadata.file_path``. Each level of folders is listed
    by tasks that share its folders."""
    def run(batches):
        files = pafs.FileSystem.from_uri(root.uri)[0]
        for batch in batches:
            for folder in batch["path"].to_pylist():
                found = []
                for f in files.get_file_info(pafs.FileSelector(folder)):
                    if f.type == pafs.FileType.Directory and not hidden(f.base_name, True):
                        found.append((f.path, None))
                    elif f.type == pafs.FileType.File and f.size and not hidden(f.base_name):
                        found.append((f.path, f.size))
                for a in range(0, len(found), LISTED_ROWS):
                    paths, sizes = zip(*found[a:a + LISTED_ROWS], strict=True)
                    uris = [root.prefix + encoded(p) for p in paths]
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(uris, pa.string()), pa.array(sizes, pa.int64())], ["path", "uri", "size"])

    level, folders, found = spark.createDataFrame([(root.path or "/",)], "path string"), 1, None
    while folders:
        listed = stage(level.repartition(math.ceil(folders / FOLDERS_PER_TASK)).mapInArrow(run, "path string, uri string, size long"), "file-list")
        here = listed.where("size IS NOT NULL")
        found = here if found is None else found.unionByName(here)
        level = listed.where("size IS NULL").select("path")
        folders = level.count()
    return found


def find_files(names: DataFrame, root: Root, name_col: str) -> DataFrame:
    """``names`` with the path and the size of the file that ``name_col``, relative to the root, names (NULL: there is none). Staged."""
    def run(batches):
        files = pafs.FileSystem.from_uri(root.uri)[0]
        for batch in batches:
            paths = []
            for name in batch[name_col].to_pylist():
                *folders, last = name.split("/")
                seen = last and not hidden(last) and not any(not f or hidden(f, True) for f in folders)
                paths.append(f"{root.path}/{name}" if seen else None)
            info = iter(files.get_file_info([p for p in paths if p]))
            sizes = [f.size if p and (f := next(info)).type == pafs.FileType.File and f.size else None for p in paths]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], [*batch.schema.names, "path", "size"])

    schema = T.StructType([*names.schema.fields, T.StructField("path", T.StringType()), T.StructField("size", T.LongType())])
    return stage(names.repartition(_tasks(names.sparkSession, names.count(), 0)).mapInArrow(run, schema), "found-files")


def _tasks(spark: SparkSession, files: int, size: int) -> int:
    slots = min(spark.sparkContext.defaultParallelism, math.ceil(files / LEAST_FILES))
    return max(1, slots, math.ceil(files / FILES_PER_TASK), math.ceil(size / BYTES_PER_TASK))


def read_files(found: DataFrame, root: Root) -> DataFrame:
    """``found`` (staged; path, size and others) with ``content``, the bytes of each file, instead of the size."""
    kept = [f for f in found.schema.fields if f.name != "size"]
    names = [f.name for f in kept]

    def run(batches):
        files = pafs.FileSystem.from_uri(root.uri)[0]
        for batch in batches:
            first, held, size = 0, [], 0
            for k, path in enumerate(batch["path"].to_pylist(), 1):
                with files.open_input_stream(path, compression=None) as f:
                    held.append(f.read())
                size += len(held[-1])
                if size >= BATCH_BYTES or k == batch.num_rows:
                    rows = batch.slice(first, k - first)
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(held, pa.binary())], [*names, "content"])
                    first, held, size = k, [], 0

    total = found.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    tasks = _tasks(found.sparkSession, total["n"], total["size"])
    return found.select(*names).repartition(tasks).mapInArrow(run, T.StructType([*kept, T.StructField("content", T.BinaryType())]))
