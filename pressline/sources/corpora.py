"""Training corpora readers: headerless topic CSV, labelled directory corpus,
and manifest + whole files (code corpus)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressline import constants as C
from pressline.operators.sampling import sample_exact
from pressline.plans.stage import stage
from pressline.sources.files import find_files, list_files, read_files, task_root
from pressline.sources.splits import read_quoted_csv

TOPIC_CSV_SCHEMA = T.StructType([
    T.StructField("label", T.IntegerType()),
    T.StructField("headline", T.StringType()),
    T.StructField("text", T.StringType()),
])


def read_topic_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ``label, headline, text`` CSV (quoted fields may span lines),
    with a ``doc_id`` for sampling and splitting: a hash of the row's content, the
    same whatever the file layout (equal rows share it). Files are read in byte
    ranges (:mod:`pressline.sources.splits`), so one large file is many tasks."""
    df = read_quoted_csv(spark, path, TOPIC_CSV_SCHEMA)
    return df.withColumn("doc_id", F.xxhash64("label", "headline", "text"))


# Names of files that Spark's text reader unpacks: such folders are left to it.
PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst|xz)$"


def read_labelled_dirs(spark: SparkSession, root: str) -> DataFrame:
    """``ROOT/<label>/<file>`` -> ``(doc_id, path, text, label)``: one row per
    whole file, label = parent directory name. Folders are listed and files read by tasks
    (:mod:`pressline.sources.files`), as there may be a file per text."""
    folder = task_root(spark, root)
    found = list_files(spark, folder) if folder else None
    if folder and found.where(F.col("path").rlike(PACKED)).isEmpty():
        df = read_files(found, folder).select(F.col("uri").alias("path"), F.col("content").cast("string").alias("text"))
    else:
        df = (spark.read.option("recursiveFileLookup", True)
              .text(root, wholetext=True)
              .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))
    return df.select(F.xxhash64("path").alias("doc_id"), "path", "text",
                     F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("label"))


def read_manifest_files(spark: SparkSession, manifest: str, source_root: str,
                        samples: int | None = None, seed: str = C.DEFAULT_SEED) -> DataFrame:
    """Manifest of relative file names -> optional exact sample of names ->
    blank names skipped -> whole files joined on path, decoded as UTF-8 text.

    Names may start with ``./``; a name with no file under the root fails the
    job, as the original does. Returns ``(name, path, text)``, one row for each
    time a name is listed.
    """
    names = spark.read.text(manifest).select(F.col("value").alias("name"))
    if samples is not None:
        names = sample_exact(names, samples, "name", seed)
    # the sampled names are staged: both the check and the read use them
    names = stage(names.where(F.col("name") != ""), "manifest")
    relative = F.regexp_replace(F.regexp_replace("name", r"(^|/)(\./)+", "$1"), "/+", "/")
    folder = task_root(spark, source_root)
    if folder:
        found = find_files(names.withColumn("_relative", relative), folder, "_relative")
        _none_missing(found.where("size IS NULL"), source_root)
        files = read_files(found.select("name", "path", "size"), folder)
        path = F.concat(F.lit(folder.prefix), "path").alias("path")
        return files.select("name", path, F.decode(F.col("content"), "UTF-8").alias("text"))
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(source_root)
    base = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base)
    root = base.toUri().getPath().rstrip("/") + "/"
    names = names.withColumn("_path", F.concat(F.lit(root), relative))
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source_root)
             .withColumn("_path", F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")))
    # paths only: the content column isn't read for this check
    _none_missing(names.join(found.select("_path"), "_path", "left_anti"), source_root)
    files = found.select("_path", "path", F.decode(F.col("content"), "UTF-8").alias("text"))
    return names.join(files, "_path").select("name", "path", "text")


def _none_missing(missing: DataFrame, source_root: str) -> None:
    some = missing.select("name").limit(5).collect()
    if some:
        raise FileNotFoundError(f"no file for {[r['name'] for r in some]} under {source_root}")
