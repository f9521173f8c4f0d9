"""The dashboard views as parameterised DataFrame queries.

Each view of the original app (publisher/date lookup, parsed preview, training
set browser, page lookup) is a query over tables; widgets become parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressline.functions import text as tx
from pressline.operators import profile as pr
from pressline.plans.classify import score


def story_rows(articles: DataFrame, scraped_only: bool = False, pattern: str = "",
               case_sensitive: bool = False) -> DataFrame:
    """Optional scraped filter, then title search; the story text is the
    scraped body when present, else the listing excerpt (same row)."""
    df = articles
    if scraped_only:
        df = df.where(F.coalesce(F.col("scraped"), F.lit(False)))
    df = df.where(tx.title_matches("title", pattern, case_sensitive))
    return df.select("doc_id", "source_id", "query_date",
                     F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"),
                     "title", F.coalesce("scraped_content", "content").alias("story_text"),
                     "scraped")


def story_by_key(articles: DataFrame, key, key_col: str = "doc_id") -> DataFrame:
    """The story (rows) with this key, scraped or not."""
    return story_rows(articles).where(F.col(key_col) == F.lit(key))


def source_date_view(articles: DataFrame, model=None, remove_paragraphs: int = 0, scraped_only: bool = False,
                     pattern: str = "", case_sensitive: bool = False) -> DataFrame:
    """Every (publisher, date) selection of the view at once: story rows, the
    parsed text after paragraph removal (0 = keep all) and, given a classifier,
    its ``label`` and ``score`` for that text. Filter on ``source_id`` and
    ``query_date`` for one selection."""
    rows = story_rows(articles, scraped_only, pattern, case_sensitive)
    r = None if remove_paragraphs == 0 else remove_paragraphs
    parsed = rows.withColumn("training_content", tx.format_headline_body("story_text", "title", r))
    if model is not None:
        keep = parsed.columns
        scored = score(model, parsed.withColumn("training_content", F.coalesce("training_content", F.lit(""))), keep)
        parsed = scored.select(*keep, F.col("label_name").alias("label"), "score")
    return parsed.withColumnRenamed("training_content", "parsed")


def source_date_lookup(articles: DataFrame, source_id: str, query_date: str,
                       scraped_only: bool = False, pattern: str = "",
                       case_sensitive: bool = False) -> tuple[DataFrame, DataFrame]:
    """One (publisher, date) selection: ``(hour histogram, matching stories)``.

    The histogram is taken after the scraped filter and before the title
    search, as in the original view.
    """
    sel = articles.where((F.col("source_id") == source_id) & (F.col("query_date") == query_date))
    if scraped_only:
        sel = sel.where(F.coalesce(F.col("scraped"), F.lit(False)))
    hist = pr.hour_histogram(sel.withColumn("_all", F.lit(1)), ["_all"]).drop("_all")
    return hist, story_rows(sel, False, pattern, case_sensitive)


def parsed_preview(articles: DataFrame, remove_paragraphs: int = 0) -> DataFrame:
    """Marked-up text after paragraph removal; 0 means keep every paragraph."""
    r = None if remove_paragraphs == 0 else remove_paragraphs
    body = F.coalesce("scraped_content", "content")
    return articles.select("doc_id", "title", tx.format_headline_body(body, "title", r).alias("parsed"))


def training_lookup(training_set: DataFrame, source_id: str, query_date: str) -> DataFrame:
    """Training-set browser: one publisher and day."""
    return training_set.where((F.col("source_id") == source_id) &
                              (tx.day_of("published_at") == query_date))
