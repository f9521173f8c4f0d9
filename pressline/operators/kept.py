"""Profile counts that are kept and brought up to date from the cells that changed.

Beside the partitioned article table lies a folder of kept counts: per cell, publication day and hour the number of
articles, scraped ones, errors and non-NULL values of each column. A cell's fingerprint is taken from its files
(names, lengths, times; a listing, no file is opened). A refresh reads the cells whose fingerprint changed, and no others: their new counts, less
their old ones, are signed changes that are added to the kept counts. All profile views are sums over the kept counts.

A refresh writes a new version and the readers take the newest whole one, so a job that is lost leaves the old counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressline.functions.text import day_of, hour_of
from pressline.operators.ingest import CELL
from pressline.plans.stage import stage
from pressline.sources.articles import path_exists

KEY = [*CELL, "day", "hour"]
FIXED = ["n_articles", "n_scraped", "n_errors"]
#: Cells of one read; more are read in several, so a path list stays short.
CELLS_PER_READ = 5000


def fingerprints(spark: SparkSession, table_path: str) -> DataFrame:
    """source_id, query_date, dir and fingerprint of each cell that has files."""
    decode = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    part = lambda name: decode(F.regexp_extract("path", rf"/{name}=([^/]+)/", 1))
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(table_path)
             .select("path", "length", "modificationTime", part("source_id").alias("source_id"), part("query_date").alias("query_date"),
                     F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("dir")))
    mark = F.xxhash64(F.sort_array(F.collect_list(F.struct("path", "length", "modificationTime"))))
    return files.where("source_id <> ''").groupBy(*CELL, "dir").agg(mark.alias("fingerprint"))


def counted_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if c not in CELL]


def cell_counts(rows: DataFrame) -> DataFrame:
    """Counts per cell, publication day and hour."""
    keys = [*CELL, day_of("published_at").alias("day"), hour_of("published_at").alias("hour")]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_articles"), F.count_if(F.coalesce("scraped", F.lit(False))).alias("n_scraped"),
        F.count_if(F.coalesce("error", F.lit(False))).alias("n_errors"), *[F.count(c).alias(f"n_{c}_set") for c in counted_columns(rows.columns)])


def latest(spark: SparkSession, kept_path: str) -> int:
    """Number of the newest whole version, -1 for none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(kept_path)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return -1
    found = [s.getPath().getName() for s in fs.listStatus(path)]
    whole = [int(n[2:]) for n in found if n.startswith("v=") and path_exists(spark, f"{kept_path}/{n}/cells/_SUCCESS")]
    return max(whole, default=-1)


def kept_counts(spark: SparkSession, kept_path: str) -> DataFrame:
    return spark.read.parquet(f"{kept_path}/v={latest(spark, kept_path)}/counts")


def read_cells(spark: SparkSession, table_path: str, dirs: list[str], schema: T.StructType) -> DataFrame:
    """The rows of the cells in ``dirs``; no other file is listed or read."""
    out = spark.createDataFrame([], schema)
    for a in range(0, len(dirs), CELLS_PER_READ):
        out = out.unionByName(spark.read.schema(schema).option("basePath", table_path).parquet(*dirs[a:a + CELLS_PER_READ]))
    return out


def refresh(spark: SparkSession, table_path: str, kept_path: str, schema: T.StructType) -> DataFrame:
    """Bring the counts of ``kept_path`` up to the table's state. ``schema``: the table's columns, cell keys as strings.
    Returns the signed changes that were added."""
    version = latest(spark, kept_path)
    now = stage(fingerprints(spark, table_path), "cell-prints")
    if version < 0:
        before = now.select(*CELL, "fingerprint").limit(0)
        old = cell_counts(spark.createDataFrame([], schema))
    else:
        before = spark.read.parquet(f"{kept_path}/v={version}/cells")
        old = kept_counts(spark, kept_path)
    seen = before.withColumnRenamed("fingerprint", "_was")
    changed = stage(now.join(seen, CELL, "left").where(~F.col("fingerprint").eqNullSafe(F.col("_was"))).select(*CELL, "dir"), "cells-changed")
    gone = before.join(now, CELL, "left_anti").select(*CELL)
    dirs = sorted(r.dir for r in changed.select("dir").collect())          # one row per changed cell
    new = cell_counts(read_cells(spark, table_path, dirs, schema))
    numbers = [c for c in new.columns if c not in KEY]
    undone = old.join(changed.select(*CELL).unionByName(gone), CELL, "left_semi")
    signed = new.unionByName(undone.select(*KEY, *[(-F.col(c)).alias(c) for c in numbers]))
    changes = stage(signed.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in numbers]).where(" OR ".join(f"`{c}` <> 0" for c in numbers)), "count-changes")
    merged = old.unionByName(changes).groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in numbers]).where("n_articles <> 0")
    merged.write.mode("overwrite").parquet(f"{kept_path}/v={version + 1}/counts")
    now.select(*CELL, "fingerprint").write.mode("overwrite").parquet(f"{kept_path}/v={version + 1}/cells")     # last: makes the version whole
    return changes


def kept_profile(counts: DataFrame) -> DataFrame:
    """A1-A3 per cell, as ``cell_profile`` gives them."""
    return counts.groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in FIXED])


def kept_total(counts: DataFrame) -> DataFrame:
    """A4: scraped articles over all cells."""
    return counts.agg(F.coalesce(F.sum("n_scraped"), F.lit(0)).cast("bigint").alias("total_scraped"))


def kept_daily(counts: DataFrame) -> DataFrame:
    """A6: per publication day and publisher the non-NULL count of every column."""
    sets = [c for c in counts.columns if c.startswith("n_") and c.endswith("_set")]
    return counts.groupBy("day", "source_id").agg(*[F.sum(c).alias(c.removesuffix("_set")) for c in sets])


def kept_hours(counts: DataFrame) -> DataFrame:
    """A7: 24 hourly bins per publisher, empty ones included; articles without a time are in none."""
    entry = F.when(F.col("hour").isNotNull(), F.struct("hour", "n"))
    per = counts.groupBy("source_id", "hour").agg(F.sum("n_articles").alias("n")).groupBy("source_id").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    bins = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.try_element_at(F.col("m"), h), F.lit(0)).cast("bigint"))
    return per.select("source_id", F.posexplode(bins).alias("hour", "n"))
