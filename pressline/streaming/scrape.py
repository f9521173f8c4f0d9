"""The scrape pass as a Structured Streaming query.

Listings and fetched pages arrive in any order, in landing folders of their own. Both streams meet by url in one
stateful aggregate that keeps, per url, the listings that wait for it and the newest page so far (highest version, ties by content hash).
The newest page is a maximum and the listings are a set, so the state, and with it the table, doesn't depend on the order
or the batches in which files come; late pages and late listings are handled alike. Each micro-batch rewrites
the cells of the urls that changed; a batch that is run again writes the same rows again.

Listings that equal each other in all columns count once. A listing that was scraped before it arrived keeps its state. Listings without
a url wait for nothing: each has a key of its own and is an error, as in the batch pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pressline.functions.html import extract_pages
from pressline.operators.ingest import CELL
from pressline.plans.stage import stage
from pressline.sources.articles import path_exists, read_partitioned, write_partitioned

STATUS = ("scraped", "scraped_content", "error")


def url_key(columns: list[str], key: str = "url"):
    """The url, or for a listing without one a key of its own."""
    rest = F.xxhash64(*[F.col(c) for c in columns if c not in STATUS])
    return F.coalesce(F.col(key), F.concat(F.lit("\0"), rest.cast("string")))


def waiting_pages(listings: DataFrame, pages: DataFrame, version: str, key: str = "url",
                  extract: Callable[[DataFrame], DataFrame] = extract_pages) -> DataFrame:
    """Streaming: per url its listings and newest page (``update`` mode). ``extract`` adds ``content_text`` and
    ``error`` to raw pages, by column expressions only."""
    raw = pages.where(F.col(key).isNotNull()).withColumn("_hash", F.xxhash64(*[F.col(c) for c in pages.columns]))
    # the smallest hash of the highest version is the largest pair (version, not hash)
    page = F.struct(F.col(version).alias("version"), F.bitwise_not("_hash").alias("tie"), F.col("content_text").alias("text"), F.col("error").alias("failed"))
    fetched = extract(raw).select(F.col(key).alias("_key"), page.alias("page"))
    waiting = listings.select(url_key(listings.columns, key).alias("_key"), F.struct(*listings.columns).alias("listing"))
    both = waiting.unionByName(fetched, allowMissingColumns=True)
    return both.groupBy("_key").agg(F.collect_set("listing").alias("listings"), F.max("page").alias("page"))


def with_status(changed: DataFrame, columns: list[str]) -> DataFrame:
    """Listings of the changed urls with the status that their newest page gives, and ``_key``."""
    rows = changed.select("_key", "page", F.explode("listings").alias("l")).select("_key", "page", "l.*")
    done = F.coalesce("scraped", F.lit(False))
    ok = F.col("page").isNotNull() & ~F.coalesce(F.col("page.failed"), F.lit(True))
    new = {"scraped": ok, "scraped_content": F.when(ok, F.col("page.text")).otherwise(F.col("scraped_content")), "error": ~ok}
    return rows.select("_key", *[F.when(done, F.col(c)).otherwise(new[c]).alias(c) if c in STATUS else F.col(c) for c in columns])


def upsert_cells(rows: DataFrame, table_path: str, key: str = "url") -> None:
    """Put ``rows`` (with ``_key``) in place of the rows of the same cell and key; only their cells are rewritten."""
    spark = rows.sparkSession
    rows = stage(rows, "scrape-changed")
    new = rows.drop("_key")
    if path_exists(spark, table_path):
        old = read_partitioned(spark, table_path).select(*new.columns)
        kept = old.join(rows.select(*CELL).distinct(), CELL, "left_semi").withColumn("_key", url_key(new.columns, key))
        new = stage(kept.join(rows.select("_key", *CELL), ["_key", *CELL], "left_anti").select(*new.columns).unionByName(new), "scrape-cells")
    write_partitioned(new, table_path)


def start_scrape_stream(listings: DataFrame, pages: DataFrame, table_path: str, checkpoint_location: str, version: str = "page_id",
                        key: str = "url", extract: Callable[[DataFrame], DataFrame] = extract_pages, available_now: bool = True) -> StreamingQuery:
    """``listings`` and ``pages`` are streaming frames; ``listings`` has the article table's columns."""
    columns = listings.columns
    writer = (waiting_pages(listings, pages, version, key, extract).writeStream.outputMode("update")
              .foreachBatch(lambda changed, _batch: upsert_cells(with_status(changed, columns), table_path, key))
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
