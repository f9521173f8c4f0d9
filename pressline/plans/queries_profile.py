"""Registered queries: collection profile, partition inventory, dashboard views."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline import constants as C
from pressline.functions import text as tx
from pressline.operators import kept as K
from pressline.operators import profile as pr
from pressline.plans import sql_text as S
from pressline.plans.catalog import register
from pressline.plans.stage import scratch_path, stage
from pressline.plans.queries_text import (PUB_MAX_WORDS, PUB_MIN_DOCS, PUB_MIN_WORDS, PUB_SOURCES,
                                          PUBLISHER_SQL, SEARCH_CI)
from pressline.plans.training_set import publisher_training_set
from pressline.sources.articles import ARTICLES_SQL, drop_cells, load_articles, read_partitioned, write_partitioned

# A publisher of the dimension with no articles at all (tests the absent-cell rule).
ABSENT_SOURCE = "src99"
DATA_ROOT = "data"


def _cells(articles):
    """Counts per (publisher, date) cell: the one pass over the articles. Grid,
    presence and totals are all derived from this small staged table."""
    return stage(pr.cell_profile(articles), "cells")


def _grid(cells):
    """Date grid of every publisher seen in the table plus the absent one."""
    spark = cells.sparkSession
    absent = spark.createDataFrame([(ABSENT_SOURCE,)], "source_id string")
    return pr.cell_grid(cells.select("source_id").unionByName(absent).distinct())


GRID_SQL = f"""
WITH articles AS ({ARTICLES_SQL}),
sources AS (SELECT DISTINCT source_id FROM articles UNION SELECT '{ABSENT_SOURCE}'),
dates AS (SELECT strftime(d, '%Y-%m-%d') AS query_date
          FROM generate_series(DATE '{C.FIRST_QUERY_DATE}', DATE '{C.LAST_QUERY_DATE}', INTERVAL 1 DAY) t(d)),
grid AS (SELECT source_id, query_date FROM sources CROSS JOIN dates),
present AS (SELECT DISTINCT source_id, query_date FROM articles)
"""


@register("source_date_profile", GRID_SQL + f"""
, prof AS (SELECT source_id, query_date, count(*) AS n_articles,
                  count(*) FILTER (WHERE coalesce(scraped, false)) AS n_scraped,
                  count(*) FILTER (WHERE coalesce(error, false)) AS n_errors
           FROM articles GROUP BY source_id, query_date)
SELECT g.source_id, g.query_date,
       CAST(coalesce(p.n_articles, 0) AS BIGINT) AS n_articles,
       CAST(coalesce(p.n_scraped, 0) AS BIGINT) AS n_scraped,
       CAST(coalesce(p.n_errors, 0) AS BIGINT) AS n_errors,
       p.n_articles IS NOT NULL AS present,
       '{DATA_ROOT}/' || g.query_date || '/' || g.source_id AS partition_dir
FROM grid g LEFT JOIN prof p ON g.source_id = p.source_id AND g.query_date = p.query_date
""")
def q_source_date_profile(spark, sf_dir):
    cells = _cells(load_articles(spark, sf_dir))
    return pr.fill_grid(_grid(cells), cells, root=DATA_ROOT)


@register("missing_partitions", GRID_SQL + """
SELECT source_id, query_date FROM grid
WHERE NOT EXISTS (SELECT 1 FROM present p WHERE p.source_id = grid.source_id AND p.query_date = grid.query_date)
""")
def q_missing_partitions(spark, sf_dir):
    cells = _cells(load_articles(spark, sf_dir))
    return pr.missing_cells(_grid(cells), cells)


@register("present_partitions", GRID_SQL + """
SELECT source_id, query_date FROM grid
WHERE EXISTS (SELECT 1 FROM present p WHERE p.source_id = grid.source_id AND p.query_date = grid.query_date)
""")
def q_present_partitions(spark, sf_dir):
    cells = _cells(load_articles(spark, sf_dir))
    return pr.present_cells(_grid(cells), cells)


@register("scraped_total", GRID_SQL + """
, prof AS (SELECT source_id, query_date, count(*) AS n_articles,
                  count(*) FILTER (WHERE coalesce(scraped, false)) AS n_scraped
           FROM articles GROUP BY source_id, query_date)
SELECT CAST(sum(coalesce(p.n_scraped, 0)) AS BIGINT) AS total_scraped,
       CAST(sum(coalesce(p.n_articles, 0)) AS BIGINT) AS total_articles,
       CAST(count(*) AS BIGINT) AS cells
FROM grid g LEFT JOIN prof p ON g.source_id = p.source_id AND g.query_date = p.query_date
""")
def q_scraped_total(spark, sf_dir):
    cells = _cells(load_articles(spark, sf_dir))
    g = pr.fill_grid(_grid(cells), cells)
    return g.agg(F.sum("n_scraped").cast("bigint").alias("total_scraped"),
                 F.sum("n_articles").cast("bigint").alias("total_articles"),
                 F.count(F.lit(1)).alias("cells"))


@register("hour_histogram", f"""
WITH articles AS ({ARTICLES_SQL}),
groups AS (SELECT DISTINCT source_id FROM articles),
bins AS (SELECT source_id, CAST(h AS INTEGER) AS hour FROM groups CROSS JOIN range(24) t(h)),
counts AS (SELECT source_id, CAST(hour(published_at) AS INTEGER) AS hour, count(*) AS n
           FROM articles GROUP BY 1, 2)
SELECT b.source_id, b.hour, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM bins b LEFT JOIN counts c ON b.source_id = c.source_id AND b.hour = c.hour
""")
def q_hour_histogram(spark, sf_dir):
    return pr.hour_histogram(load_articles(spark, sf_dir), ["source_id"])


_TS_COLS = ["doc_id", "source_id", "source_name", "title", "query_date", "word_count", "training_content"]


def _training_set(spark, sf_dir):
    return publisher_training_set(load_articles(spark, sf_dir), PUB_MIN_WORDS, PUB_MAX_WORDS,
                                  PUB_MIN_DOCS, PUB_SOURCES)


@register("daily_source_counts", f"""
SELECT query_date AS day, source_id,
       {', '.join(f'count({c}) AS n_{c}' for c in _TS_COLS)}, count(query_date) AS n_published_at
FROM ({PUBLISHER_SQL}) ts
GROUP BY query_date, source_id
""")
def q_daily_source_counts(spark, sf_dir):
    ts = _training_set(spark, sf_dir)
    return pr.non_null_counts(ts, [tx.day_of("published_at").alias("day"), "source_id"])


@register("distinct_sources", f"""
SELECT DISTINCT source_id FROM ({PUBLISHER_SQL}) ts
""")
def q_distinct_sources(spark, sf_dir):
    return _training_set(spark, sf_dir).select("source_id").distinct()


@register("story_lookup", f"""
WITH articles AS ({ARTICLES_SQL})
SELECT doc_id, source_id, query_date, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published,
       title, coalesce(scraped_content, content) AS story_text, scraped
FROM articles
WHERE scraped AND coalesce(regexp_matches(title, {S.q(SEARCH_CI)}, 'i'), false)
""")
def q_story_lookup(spark, sf_dir):
    """Source/date lookup for every (publisher, date) selection at once."""
    from pressline.plans.dashboards import story_rows
    return story_rows(load_articles(spark, sf_dir), scraped_only=True, pattern=SEARCH_CI)


KEPT_TURN = "2020-05-10"          # cells from this date on are rewritten between two refreshes
KEPT_GONE = "2020-05-30"          # and emptied from this one on

KEPT_SQL = GRID_SQL + f"""
, final AS (SELECT * REPLACE (CASE WHEN query_date >= '{KEPT_TURN}' THEN doc_id % 2 = 0 ELSE scraped END AS scraped) FROM articles WHERE query_date < '{KEPT_GONE}'),
prof AS (SELECT source_id, query_date, count(*) AS n_articles, count(*) FILTER (WHERE coalesce(scraped, false)) AS n_scraped,
                count(*) FILTER (WHERE coalesce(error, false)) AS n_errors FROM final GROUP BY ALL)
"""


@register("kept_profile", KEPT_SQL + """
SELECT g.source_id, g.query_date, CAST(coalesce(p.n_articles, 0) AS BIGINT) AS n_articles, CAST(coalesce(p.n_scraped, 0) AS BIGINT) AS n_scraped,
       CAST(coalesce(p.n_errors, 0) AS BIGINT) AS n_errors, p.n_articles IS NOT NULL AS present
FROM grid g LEFT JOIN prof p ON g.source_id = p.source_id AND g.query_date = p.query_date
""")
def q_kept_profile(spark, sf_dir):
    """The collection profile from kept counts: a table, a refresh, rewritten and emptied cells, and a refresh of those."""
    table, kept = scratch_path(spark, "kept-table"), scratch_path(spark, "kept-counts")
    a = load_articles(spark, sf_dir).select("doc_id", "title", "url", "published_at", "scraped", "error", "query_date", "source_id")
    write_partitioned(a, table)
    schema = read_partitioned(spark, table).schema
    K.refresh(spark, table, kept, schema)
    grid = stage(_grid(K.kept_profile(K.kept_counts(spark, kept))), "kept-grid")
    write_partitioned(a.where(F.col("query_date").between(KEPT_TURN, KEPT_GONE)).withColumn("scraped", F.col("doc_id") % 2 == 0), table)
    drop_cells(grid.where(F.col("query_date") >= KEPT_GONE), table)
    K.refresh(spark, table, kept, schema)
    return pr.fill_grid(grid, K.kept_profile(K.kept_counts(spark, kept)))
