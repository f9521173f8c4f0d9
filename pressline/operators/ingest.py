"""Listing ingest and incremental scraping as set-oriented jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressline import constants as C
from pressline.plans.stage import checked_broadcast, stage
from pressline.sources.articles import read_partitioned, write_partitioned

CELL = ["source_id", "query_date"]


def newest_per_cell(listings: DataFrame, limit: int | None = C.LISTING_PAGE_SIZE,
                    ts_col: str = "published_at", tie_col: str = "url",
                    rank_col: str | None = None) -> DataFrame:
    """The ``limit`` newest listings per (publisher, date), newest first.

    ``row_number() <= k`` is planned with a partial group limit before the
    shuffle, so each task sends at most ``k`` rows per cell: a hot cell does not
    pull all its rows into one task. ``limit=None`` keeps every listing.
    """
    if limit is None and rank_col is None:
        return listings
    w = Window.partitionBy(*CELL).orderBy(F.col(ts_col).desc(), F.col(tie_col))
    rn = rank_col or "_rn"
    out = listings.withColumn(rn, F.row_number().over(w))
    if limit is not None:
        out = out.where(F.col(rn) <= limit)
    return out if rank_col else out.drop(rn)


def as_ingested(listings: DataFrame) -> DataFrame:
    """Fresh listing rows: not scraped, no body, no error flag yet."""
    return (listings.withColumn("scraped", F.lit(False))
                    .withColumn("scraped_content", F.lit(None).cast("string"))
                    .withColumn("error", F.lit(None).cast("boolean")))


def keep_status(fresh: DataFrame, existing: DataFrame) -> DataFrame:
    """``fresh`` listings with the scrape state of the same article (cell and
    url) in ``existing``; the state of a scraped copy wins."""
    keys = [*CELL, "url"]
    state = F.struct(F.coalesce("scraped", F.lit(False)).alias("scraped"), "scraped_content", "error")
    old = (existing.where(F.col("url").isNotNull()).groupBy(*keys)
                   .agg(F.max(state).alias("_old")))
    joined = fresh.join(old, keys, "left")
    known = F.col("_old").isNotNull()
    return joined.select(*[
        F.when(known, F.col(f"_old.{c}")).otherwise(F.col(c)).alias(c)
        if c in ("scraped", "scraped_content", "error") else F.col(c) for c in fresh.columns])


def ingest_listings(listings: DataFrame, log: DataFrame, limit: int | None = C.LISTING_PAGE_SIZE,
                    existing: DataFrame | None = None) -> DataFrame:
    """The ingest rule over a publisher x date run: cells before each publisher's
    first failure (``log``: cell, ``failed``), newest page per cell, fresh status
    (or the status in ``existing``)."""
    cells = stop_at_first_failure(log).select(*CELL)
    rows = as_ingested(newest_per_cell(listings.join(cells, CELL, "left_semi"), limit))
    return rows if existing is None else keep_status(rows, existing)


def stop_at_first_failure(log: DataFrame, failed_col: str = "failed") -> DataFrame:
    """Keep, per publisher, only the dates before its first failed date.

    The first failure per publisher is a grouped min (one row per publisher);
    that small table is size-checked and broadcast to filter the log.
    """
    first = (log.groupBy("source_id")
                .agg(F.min(F.when(F.col(failed_col), F.col("query_date"))).alias("_first_fail")))
    first = checked_broadcast(first)
    return (log.join(first, "source_id")
               .where(F.col("_first_fail").isNull() | (F.col("query_date") < F.col("_first_fail")))
               .drop("_first_fail"))


def capped_work(cells: DataFrame, max_cells: int | None) -> DataFrame:
    """At most ``max_cells`` cells in (date, publisher) order; None/0 = all."""
    if not max_cells:
        return cells
    return cells.orderBy("query_date", "source_id").limit(max_cells)


def newest_page(pages: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """One page per key: the highest ``version``, ties (and pages without a
    version) by content hash. ``row_number() = 1`` is cut before the shuffle, so
    a key with very many pages sends few rows."""
    first = [F.col(version).desc()] if version else []
    w = Window.partitionBy(key).orderBy(*first, F.xxhash64(*pages.columns))
    return pages.where(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def apply_scrape(articles: DataFrame, pages: DataFrame, key: str = "url",
                 extract: Callable[[DataFrame], DataFrame] | None = None,
                 version: str | None = None) -> DataFrame:
    """One scrape pass: unscraped articles are joined to extracted pages on url.

    Success sets the body, ``scraped`` and ``error=false``; a failed or missing
    page sets ``error=true`` and leaves ``scraped`` false (retried next pass).
    Already scraped rows pass through untouched and never enter the join.
    Adds ``newly_scraped``. Of several stored pages of one url the newest
    counts (see :func:`newest_page`).

    ``pages`` holds ``key``, ``content_text`` and ``error``, or raw pages when
    ``extract`` is given (a function adding those two columns). The page store
    only grows while a pass only needs the pages of unscraped rows, so raw
    pages are first semi-joined on the key and only those are extracted: the
    regex work follows the size of the pass, not of the store.
    """
    done = articles.where(F.coalesce(F.col("scraped"), F.lit(False))) \
                   .withColumn("newly_scraped", F.lit(False))
    todo = articles.where(~F.coalesce(F.col("scraped"), F.lit(False)))
    pages = newest_page(pages.join(todo.select(key), key, "left_semi"), key, version)
    if extract is not None:
        pages = extract(pages)
    fetched = pages.select(F.col(key).alias("_k"), F.col("content_text").alias("_body"),
                           F.col("error").alias("_err"))
    # rows without a url match nothing: a key of their own spreads them over the tasks
    spread_key = F.coalesce(F.col(key), F.concat(F.lit("\0"), F.xxhash64(*todo.columns).cast("string")))
    joined = todo.withColumn("_key", spread_key).join(fetched, F.col("_key") == F.col("_k"), "left")
    ok = F.col("_k").isNotNull() & ~F.coalesce(F.col("_err"), F.lit(True))
    updated = (joined.withColumn("scraped_content", F.when(ok, F.col("_body")).otherwise(F.col("scraped_content")))
                     .withColumn("error", F.when(ok, F.lit(False)).otherwise(F.lit(True)))
                     .withColumn("scraped", ok)
                     .withColumn("newly_scraped", ok)
                     .drop("_key", "_k", "_body", "_err"))
    return done.unionByName(updated.select(*done.columns))


def scrape_run(table_path: str, grid: DataFrame, pages: DataFrame,
               extract: Callable[[DataFrame], DataFrame] | None = None, version: str | None = None,
               max_cells: int | None = None) -> DataFrame:
    """The scrape job over a partitioned article table: grid cells that hold
    unscraped listings (at most ``max_cells``; None/0 = all) -> one pass over
    those cells -> write them back. Returns the counts per cell it worked on.

    The updated cells are written aside before they replace the old ones, so a
    job that is lost halfway leaves the table as it was or can be run again.
    """
    spark = grid.sparkSession
    table = read_partitioned(spark, table_path)
    waiting = table.where(~F.coalesce(F.col("scraped"), F.lit(False))).select(*CELL).distinct()
    work = stage(capped_work(grid.join(waiting, CELL, "left_semi"), max_cells), "scrape-work")
    updated = stage(apply_scrape(table.join(work, CELL, "left_semi"), pages, extract=extract, version=version),
                    "scrape-pass")
    write_partitioned(updated.drop("newly_scraped").select(*table.columns), table_path)
    return updated.groupBy(*CELL).agg(
        F.count_if("newly_scraped").alias("n_newly_scraped"),
        F.count_if(~F.col("scraped") & F.col("error")).alias("n_failed"))
