"""The listing ingest, as a Structured Streaming query and as a batch job.

Landed API responses (one JSON object per fetched (publisher, date): the cell
keys, a fetch status and the article array) arrive in a landing folder. Each
micro-batch keeps successful fetches, flattens their articles, keeps the newest
page per cell, marks them unscraped, and overwrites exactly the cells it holds
in the partitioned article table (dynamic partition overwrite, so replaying a
batch after a failure is idempotent). Progress lives in the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pressline import constants as C
from pressline.operators.ingest import CELL, as_ingested, keep_status, newest_per_cell, stop_at_first_failure
from pressline.operators.profile import cell_grid, source_dimension
from pressline.plans.stage import stage
from pressline.sources.articles import (ARTICLE_SCHEMA, drop_cells, path_exists, read_partitioned,
                                        write_partitioned)

LANDING_SCHEMA = T.StructType([
    T.StructField("query_date", T.StringType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("articles", T.ArrayType(ARTICLE_SCHEMA)),
])

TABLE_COLUMNS = ["source_name", "author", "title", "description", "url", "published_at", "content",
                 "scraped", "scraped_content", "error", "query_date", "source_id"]


def landed_articles(responses: DataFrame) -> DataFrame:
    """Successful responses -> one row per article, cell keys from the response."""
    ok = responses.where(F.col("status") == "ok")
    a = ok.select("query_date", "source_id", F.explode("articles").alias("a"))
    return a.select(
        "query_date", "source_id",
        F.col("a.source.name").alias("source_name"), F.col("a.author").alias("author"),
        F.col("a.title").alias("title"), F.col("a.description").alias("description"), F.col("a.url").alias("url"),
        F.to_timestamp("a.publishedAt").alias("published_at"), F.col("a.content").alias("content"))


def ingest_batch(responses: DataFrame, table_path: str, limit: int | None = C.LISTING_PAGE_SIZE,
                 preserve_status: bool = False) -> None:
    """Overwrite the cells of all successful responses; a response without
    articles empties its cell. ``preserve_status`` keeps the scrape state of
    articles that the table already holds."""
    spark = responses.sparkSession
    rows = as_ingested(newest_per_cell(landed_articles(responses), limit)).select(*TABLE_COLUMNS)
    if preserve_status and path_exists(spark, table_path):
        rows = keep_status(rows, read_partitioned(spark, table_path)).select(*TABLE_COLUMNS)
    rows = stage(rows, "ingest")        # written aside: the table is read above and replaced below
    write_partitioned(rows, table_path)
    answered = responses.where(F.col("status") == "ok").select(*CELL).distinct()
    drop_cells(answered.join(rows.select(*CELL).distinct(), CELL, "left_anti"), table_path)


def ingest_landed(spark: SparkSession, landing_dir: str, table_path: str,
                  sources: Sequence[str] = tuple(C.CORE_SOURCES), first: str = C.FIRST_QUERY_DATE,
                  last: str = C.LAST_QUERY_DATE, limit: int | None = C.LISTING_PAGE_SIZE,
                  preserve_status: bool = False) -> DataFrame:
    """The batch job: landed responses of the publisher x date grid, each
    publisher up to its first failed (or missing) date, into the table. Returns
    the cells taken."""
    responses = stage(spark.read.schema(LANDING_SCHEMA).option("multiLine", True).json(landing_dir), "landed")
    cells = cell_grid(source_dimension(spark, sources), first, last)
    got = responses.groupBy(*CELL).agg(F.bool_or(F.col("status") == "ok").alias("_ok"))
    log = (cells.join(got, CELL, "left")
                .select(*CELL, (~F.coalesce("_ok", F.lit(False))).alias("failed")))
    taken = stage(stop_at_first_failure(log).select(*CELL), "ingest-cells")
    ingest_batch(responses.join(taken, CELL, "left_semi"), table_path, limit, preserve_status)
    return taken


def start_listing_stream(spark: SparkSession, landing_dir: str, table_path: str,
                         checkpoint_location: str, available_now: bool = True) -> StreamingQuery:
    stream = (spark.readStream.schema(LANDING_SCHEMA).option("multiLine", True).json(landing_dir))
    writer = (stream.writeStream
              .foreachBatch(lambda df, _epoch: ingest_batch(df, table_path))
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
