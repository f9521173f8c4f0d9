"""Training-set builders (publisher, topic, sentiment) as single DataFrame jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressline import constants as C
from pressline.functions import text as tx
from pressline.operators.columns import in_range, with_columns_once
from pressline.operators.sampling import sample_exact
from pressline.plans.stage import checked_broadcast, stage


def _marked_and_counted(keep: DataFrame, markup, source: DataFrame, min_words: int,
                        max_words: int) -> DataFrame:
    """``keep``'s columns + ``training_content`` + ``word_count``, inside the
    word range. Markup and count run once per row (see ``with_columns_once``)."""
    marked = with_columns_once(source, {"training_content": markup})
    counted = with_columns_once(marked, {"word_count": tx.word_count("training_content")})
    cols = [c for c in keep.columns if c not in ("training_content", "word_count")]
    return (counted.where(in_range(F.col("word_count"), min_words, max_words))
                   .select(*cols, "training_content", "word_count"))


def keep_large_groups(df: DataFrame, group_col: str, min_rows: int,
                      max_broadcast_rows: int = C.MAX_BROADCAST_ROWS) -> DataFrame:
    """Rows whose ``group_col`` group has at least ``min_rows`` rows; NULL groups drop.

    Group sizes are a partial/final hash aggregate (map-side combined, so a hot
    group costs one counter per task), the passing names are a size-checked
    broadcast, and the rows are semi-joined without being shuffled. A window
    ``count(*) over (partition by group)`` would move every row of a hot group
    into one task instead.
    """
    sizes = (df.where(F.col(group_col).isNotNull())
               .groupBy(group_col).agg(F.count(F.lit(1)).alias("_group_rows"))
               .where(F.col("_group_rows") >= min_rows)
               .select(group_col))
    return df.join(checked_broadcast(sizes, max_broadcast_rows), group_col, "left_semi")


def publisher_training_set(articles: DataFrame,
                           min_words: int = C.DEFAULT_MIN_WORDS,
                           max_words: int = C.DEFAULT_MAX_WORDS,
                           min_docs: int = C.DEFAULT_MIN_DOCS,
                           sources: Sequence[str] | None = tuple(C.CURRENT_SOURCES),
                           num_samples: int | None = None,
                           seed: str = C.DEFAULT_SEED,
                           materialize: bool = True) -> DataFrame:
    """Scraped articles -> caption removal -> markup -> word range -> group size
    (by publisher *name*) -> publisher-id selection -> optional exact sample.

    The order matters: the group-size test counts rows after the word filter and
    before the id selection, so the id filter must not move below it.
    With ``materialize`` the formatted rows are written once to the shared
    checkpoint folder, so the group count and the final selection read them
    instead of re-running the text pipeline.
    """
    body = tx.remove_captions(F.col("scraped_content"))
    scraped = articles.where(F.col("scraped")).select(
        "doc_id", "source_id", "source_name", "title", "published_at", "query_date", "scraped_content")
    formatted = _marked_and_counted(scraped.drop("scraped_content"),
                                    tx.format_headline_body(body, F.col("title")), scraped,
                                    min_words, max_words)
    if materialize:
        # rows of other publishers only count towards their group: their text stays behind
        if sources is not None:
            chosen = F.col("source_id").isin(list(sources))
            formatted = formatted.withColumn("training_content", F.when(chosen, F.col("training_content")))
        formatted = stage(formatted, "publisher-formatted")
    kept = keep_large_groups(formatted, "source_name", min_docs)
    if sources is not None:
        kept = kept.where(F.col("source_id").isin(list(sources)))
    if num_samples is not None:
        kept = sample_exact(kept, num_samples, "doc_id", seed)
    return kept


def topic_training_set(rows: DataFrame, min_words: int = 0, max_words: int = C.DEFAULT_MAX_WORDS,
                       num_samples: int | None = None, seed: str = C.DEFAULT_SEED,
                       id_col: str = "doc_id") -> DataFrame:
    """(label, headline, text) rows -> headline/body markup -> word range ->
    optional sample -> label as text."""
    out = _marked_and_counted(rows, tx.format_headline_body("text", "headline"), rows, min_words, max_words)
    if num_samples is not None:
        out = sample_exact(out, num_samples, id_col, seed)
    return out.withColumn("label", F.col("label").cast("string"))


def sentiment_training_set(rows: DataFrame, min_words: int = 0, max_words: int = C.DEFAULT_MAX_WORDS,
                           num_samples: int | None = None, seed: str = C.DEFAULT_SEED,
                           id_col: str = "doc_id") -> DataFrame:
    """(text, label) rows -> body-only markup -> word range -> optional sample."""
    out = _marked_and_counted(rows, tx.format_body_only("text"), rows, min_words, max_words)
    if num_samples is not None:
        out = sample_exact(out, num_samples, id_col, seed)
    return out
