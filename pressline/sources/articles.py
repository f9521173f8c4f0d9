"""Article tables: the raw per-(date, publisher) JSON layout, the partitioned
table, and the fixture view derived from the driver's ``documents`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressline.functions.text import day_of
from pressline.sources.splits import read_json_arrays

LISTING_FILE = "articles.json"

SOURCE_STRUCT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
])

# One element of a landed listing file (fields the jobs touch; all others travel
# in the map ``extra``). ``scraped_content`` and ``error`` are
# absent until the first scrape attempt and read as NULL.
ARTICLE_SCHEMA = T.StructType([
    T.StructField("source", SOURCE_STRUCT),
    T.StructField("author", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("publishedAt", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("scraped", T.BooleanType()),
    T.StructField("scraped_content", T.StringType()),
    T.StructField("error", T.BooleanType()),
])

# Flat article columns used by every job after the scan.
FLAT_COLUMNS = ["source_id", "source_name", "author", "title", "description", "url", "published_at",
                "content", "scraped", "scraped_content", "error", "query_date"]


def flatten(raw: DataFrame) -> DataFrame:
    """One level of nesting out (``source.id`` -> ``source_id``), timestamp cast."""
    return raw.select(
        F.col("source.id").alias("source_id"),
        F.col("source.name").alias("source_name"),
        "author", "title", "description", "url",
        F.to_timestamp("publishedAt").alias("published_at"),
        "content", "scraped", "scraped_content", "error",
        *[c for c in ("query_date", "extra") if c in raw.columns],
    )


def partition_dir(root: str, query_date: Column, source_id: Column) -> Column:
    """``ROOT/DATE/SOURCE`` for each row."""
    return F.concat_ws("/", F.lit(root.rstrip("/")), query_date, source_id)


def read_listing_layout(spark: SparkSession, root: str, files: str = f"*/*/{LISTING_FILE}") -> DataFrame:
    """All ``ROOT/DATE/SOURCE/articles.json`` files (one JSON array each) as one scan.

    Date and publisher come from the file path, so one multi-path read replaces
    the per-(publisher, date) loop; absent partitions simply contribute no rows. ``files`` is the pattern below the
    root; folders may be named ``key=value``. Arrays are cut in byte ranges, so a large
    one is many tasks. Fields that the schema lacks come as text in ``extra``.
    """
    raw = read_json_arrays(spark, f"{root.rstrip('/')}/{files}", ARTICLE_SCHEMA)
    day, source = (F.regexp_extract("file", r"/(?:[^/=]+=)?([0-9]{4}-[0-9]{2}-[0-9]{2})/(?:[^/=]+=)?([^/]+)/[^/]+$", i) for i in (1, 2))
    return raw.select("*", day.alias("query_date"), source.alias("path_source_id")).where("query_date <> ''").drop("file")


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def read_partition(spark: SparkSession, root: str, query_date: str, source_id: str,
                   strict: bool = True) -> DataFrame:
    """One (date, publisher) listing, read from its own file only. The keys come
    from the path, whatever publisher id the rows carry. Strict mode fails when
    the file is absent; lenient mode returns no rows. An empty listing is a
    present one."""
    path = f"{root.rstrip('/')}/{query_date}/{source_id}/{LISTING_FILE}"
    if path_exists(spark, path):
        raw = read_json_arrays(spark, path, ARTICLE_SCHEMA)
    elif strict:
        raise FileNotFoundError(f"no articles for {root}/{query_date}/{source_id}")
    else:
        raw = spark.createDataFrame([], ARTICLE_SCHEMA).withColumn("extra", F.lit(None).cast("map<string,string>"))
    return (flatten(raw).withColumn("source_id", F.lit(source_id)).withColumn("query_date", F.lit(query_date)))


def write_partitioned(df: DataFrame, path: str) -> None:
    """Overwrite only the (query_date, source_id) partitions present in ``df``.
    Rows are gathered by cell first (few files per cell); the rebalance splits a
    hot cell over several tasks."""
    (df.hint("rebalance", "query_date", "source_id")
       .write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic")
       .partitionBy("query_date", "source_id")
       .parquet(path))


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """The partitioned article table; filters on the keys prune directories.
    The keys are read as the text they were written as (``007`` stays so)."""
    inferred = spark.read.parquet(path).schema
    keys = {"query_date", "source_id"}
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name in keys else f.dataType)
                           for f in inferred.fields])
    return spark.read.schema(schema).parquet(path)


def drop_cells(cells: DataFrame, path: str) -> None:
    """Delete the partitions of ``cells`` (source_id, query_date), a part of the
    publisher x date grid, walked one after the other."""
    spark = cells.sparkSession
    jvm = spark.sparkContext._jvm
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for c in cells.select("query_date", "source_id").distinct().toLocalIterator():
        cell = jvm.org.apache.hadoop.fs.Path(
            f"{path.rstrip('/')}/query_date={escape(c.query_date)}/source_id={escape(c.source_id)}")
        cell.getFileSystem(conf).delete(cell, True)


def present_partitions(articles: DataFrame) -> DataFrame:
    """Distinct (source_id, query_date) cells holding at least one article."""
    return articles.select("source_id", "query_date").distinct()


# ---------------------------------------------------------------------------
# Fixture view over the driver's ``documents`` table
# ---------------------------------------------------------------------------

BASE_EPOCH = 1587513600          # 2020-04-22T00:00:00Z, the first query date
SPREAD_SECONDS = 41 * 86400      # 41 query dates
URL_PREFIX = "https://example.test/a/"
CAPTION_LEAD = "Lead. FILE - In this file photo, a crowd.\n"


def articles_from_documents(documents: DataFrame) -> DataFrame:
    """The ``articles`` view of FIXTURES.md section 3.

    ``documents`` has no listing metadata, so this plants it deterministically
    from ``doc_id``: two publisher ids share a name, some titles are NULL, some
    rows are not yet scraped (with and without an error flag), some bodies
    carry a photo caption, half of them use blank-line paragraphs. The excerpt
    (``content``) is the whole text. All rows of ``documents`` are kept.
    """
    doc_id = F.col("doc_id")
    text = F.col("text")
    published = F.timestamp_seconds(F.lit(BASE_EPOCH) + (doc_id * 3547) % SPREAD_SECONDS) \
        .cast("timestamp_ntz")
    scraped = (doc_id % 11) != 3
    body = F.concat(
        F.when(doc_id % 7 == 0, F.lit(CAPTION_LEAD)).otherwise(F.lit("")),
        F.when(doc_id % 2 == 0, F.replace(text, F.lit("\n"), F.lit("\n\n"))).otherwise(text))
    return documents.select(
        doc_id,
        F.col("source").alias("source_id"),
        F.concat(F.lit("Pub"), (F.substring("source", 4, 1 << 20).cast("int") % 10).cast("string"))
         .alias("source_name"),
        F.when(doc_id % 13 == 0, F.lit(None).cast("string"))
         .otherwise(F.substring_index(text, "\n", 1)).alias("title"),
        published.alias("published_at"),
        day_of(published).alias("query_date"),
        F.concat(F.lit(URL_PREFIX), doc_id.cast("string")).alias("url"),
        scraped.alias("scraped"),
        F.when(doc_id % 22 == 3, F.lit(True)).when(doc_id % 11 == 3, F.lit(None).cast("boolean"))
         .otherwise(F.lit(False)).alias("error"),
        text.alias("content"),
        F.when(scraped, body).alias("scraped_content"),
    )


# Tables whose rows carry long text: per-row work (regexes, tokenising) dominates.
TEXT_TABLES = {"documents", "pages", "conversations"}


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan over all task slots when it has fewer splits than the
    cluster's parallelism (a single-row-group file is one split). On a large
    input the scan already has many more splits than slots and nothing changes."""
    try:
        slots = df.sparkSession.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - e.g. a Spark Connect session: leave the scan as it is
        return df
    return df.repartition(slots) if splits < slots else df


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def load_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles_from_documents(load_table(spark, sf_dir, "documents"))


# Same view in DuckDB SQL, for the oracle queries.
ARTICLES_SQL = f"""
SELECT doc_id,
       source AS source_id,
       'Pub' || CAST(CAST(substring(source, 4) AS INTEGER) % 10 AS VARCHAR) AS source_name,
       CASE WHEN doc_id % 13 = 0 THEN NULL ELSE split_part(text, chr(10), 1) END AS title,
       make_timestamp(CAST(({BASE_EPOCH} + (doc_id * 3547) % {SPREAD_SECONDS}) AS BIGINT) * 1000000) AS published_at,
       strftime(make_timestamp(CAST(({BASE_EPOCH} + (doc_id * 3547) % {SPREAD_SECONDS}) AS BIGINT) * 1000000), '%Y-%m-%d') AS query_date,
       '{URL_PREFIX}' || CAST(doc_id AS VARCHAR) AS url,
       doc_id % 11 <> 3 AS scraped,
       CASE WHEN doc_id % 22 = 3 THEN TRUE WHEN doc_id % 11 = 3 THEN NULL ELSE FALSE END AS error,
       text AS content,
       CASE WHEN doc_id % 11 <> 3 THEN
         (CASE WHEN doc_id % 7 = 0 THEN 'Lead. FILE - In this file photo, a crowd.' || chr(10) ELSE '' END) ||
         (CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(10) || chr(10)) ELSE text END)
       END AS scraped_content
FROM documents
"""
