"""Collection profiling: per-(publisher, date) counts over a generated cell grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline import constants as C
from pressline.functions.text import hour_of


def date_sequence(first: str = C.FIRST_QUERY_DATE, last: str = C.LAST_QUERY_DATE):
    """Column: array of ``YYYY-MM-DD`` strings, one per day, inclusive."""
    days = F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.expr("interval 1 day"))
    return F.transform(days, lambda d: F.date_format(d, "yyyy-MM-dd"))


def source_dimension(spark: SparkSession, sources: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(s,) for s in sources], "source_id string")


def cell_grid(sources: DataFrame, first: str = C.FIRST_QUERY_DATE, last: str = C.LAST_QUERY_DATE) -> DataFrame:
    """Every (source_id, query_date) cell: each publisher row is expanded by a
    generator over the date range (no join)."""
    return sources.select("source_id", F.explode(date_sequence(first, last)).alias("query_date"))


def cell_profile(articles: DataFrame) -> DataFrame:
    """Per cell: articles, scraped, errors (a missing error flag is not an error)."""
    return articles.groupBy("source_id", "query_date").agg(
        F.count(F.lit(1)).alias("n_articles"),
        F.count_if(F.coalesce(F.col("scraped"), F.lit(False))).alias("n_scraped"),
        F.count_if(F.coalesce(F.col("error"), F.lit(False))).alias("n_errors"))


def profile_grid(grid: DataFrame, articles: DataFrame, root: str | None = None) -> DataFrame:
    """Grid left-joined with the cell profile of ``articles``; absent cells count 0."""
    return fill_grid(grid, cell_profile(articles), root)


def fill_grid(grid: DataFrame, prof: DataFrame, root: str | None = None) -> DataFrame:
    """Grid left-joined with a cell profile.

    Both sides are per-cell aggregates (at most sources x dates rows), so the
    join is small whatever the article count.
    """
    out = (grid.join(prof, ["source_id", "query_date"], "left")
               .select("source_id", "query_date",
                       *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
                         for c in ("n_articles", "n_scraped", "n_errors")],
                       F.col("n_articles").isNotNull().alias("present")))
    if root is not None:
        out = out.withColumn("partition_dir", F.concat_ws("/", F.lit(root.rstrip("/")), "query_date", "source_id"))
    return out


def missing_cells(grid: DataFrame, articles: DataFrame) -> DataFrame:
    """Cells with no articles (anti join against the distinct present cells)."""
    present = articles.select("source_id", "query_date").distinct()
    return grid.join(present, ["source_id", "query_date"], "left_anti")


def present_cells(grid: DataFrame, articles: DataFrame) -> DataFrame:
    present = articles.select("source_id", "query_date").distinct()
    return grid.join(present, ["source_id", "query_date"], "left_semi")


def hour_histogram(articles: DataFrame, keys: Sequence[str] = ("source_id",),
                   ts_col: str = "published_at") -> DataFrame:
    """24 hourly bins per key group, empty bins included.

    One scan: the (group, hour) counts are a partial/final aggregate; each
    group's at most 24 counts are gathered into a map and spread over the 24
    bins with a generator (0 where the map has no entry). No join, and no
    second pass to list the groups.
    """
    keys = list(keys)
    counts = (articles.groupBy(*keys, hour_of(ts_col).alias("hour"))
                      .agg(F.count(F.lit(1)).alias("n")))
    # rows without a timestamp keep their group (all-zero bins) but no map entry
    entry = F.when(F.col("hour").isNotNull(), F.struct("hour", "n"))
    per_group = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))
    bins = F.transform(F.sequence(F.lit(0), F.lit(23)),
                       lambda h: F.coalesce(F.try_element_at(F.col("_m"), h), F.lit(0)).cast("bigint"))
    return per_group.select(*keys, F.posexplode(bins).alias("hour", "n"))


def non_null_counts(df: DataFrame, keys: Sequence, columns: Sequence[str] | None = None) -> DataFrame:
    """Per key group, the non-NULL count of every column (or of the listed ones)."""
    columns = df.columns if columns is None else columns
    return df.groupBy(*keys).agg(*[F.count(F.col(c)).alias(f"n_{c}") for c in columns])
