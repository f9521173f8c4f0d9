"""Registered queries: training-set builders and text markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline.plans import sql_text as S
from pressline.operators.title_index import build_title_index, search_titles
from pressline.plans.catalog import register
from pressline.plans.stage import scratch_path, stage
from pressline.plans.training_set import publisher_training_set
from pressline.sources.articles import ARTICLES_SQL, load_articles

# Parameters of the checked publisher training set (FIXTURES.md section 3).
PUB_MIN_WORDS, PUB_MAX_WORDS, PUB_MIN_DOCS = 200, 600, 43
PUB_SOURCES = ["src0", "src2", "src7", "src9"]


def _with_articles(body: str) -> str:
    return f"WITH articles AS ({ARTICLES_SQL})\n{body}"


PUBLISHER_SQL = _with_articles(f"""
, formatted AS (
  SELECT doc_id, source_id, source_name, title, query_date,
         {S.format_headline_body(S.remove_captions('scraped_content'), 'title')} AS training_content
  FROM articles WHERE scraped
), counted AS (
  SELECT *, {S.word_count('training_content')} AS word_count FROM formatted
), ranged AS (
  SELECT * FROM counted WHERE word_count BETWEEN {PUB_MIN_WORDS} AND {PUB_MAX_WORDS}
), big AS (
  SELECT source_name FROM ranged WHERE source_name IS NOT NULL
  GROUP BY source_name HAVING count(*) >= {PUB_MIN_DOCS}
)
SELECT doc_id, source_id, source_name, title, query_date, word_count, training_content
FROM ranged
WHERE source_name IN (SELECT source_name FROM big)
  AND source_id IN ({', '.join(S.q(s) for s in PUB_SOURCES)})
""")


@register("publisher_training_set", PUBLISHER_SQL)
def q_publisher_training_set(spark, sf_dir):
    df = publisher_training_set(load_articles(spark, sf_dir), PUB_MIN_WORDS, PUB_MAX_WORDS,
                                PUB_MIN_DOCS, PUB_SOURCES)
    return df.select("doc_id", "source_id", "source_name", "title", "query_date",
                     "word_count", "training_content")


# ---------------------------------------------------------------------------
# Markup functions over whole tables
# ---------------------------------------------------------------------------

from pressline.functions import text as tx  # noqa: E402


def stories(spark, sf_dir):
    """Every article with its story text: the scraped body, else the excerpt."""
    return load_articles(spark, sf_dir).withColumn("body", F.coalesce("scraped_content", "content"))


def _with_stories(body: str) -> str:
    return _with_articles(f", stories AS (SELECT *, coalesce(scraped_content, content) AS body FROM articles)\n{body}")


@register("caption_removal", _with_stories(f"""
SELECT doc_id, contains(body, 'FILE - ') AS had_caption,
       {S.remove_captions('body')} AS cleaned_body
FROM stories
"""))
def q_caption_removal(spark, sf_dir):
    a = stories(spark, sf_dir)
    return a.select("doc_id", F.col("body").contains("FILE - ").alias("had_caption"),
                    tx.remove_captions("body").alias("cleaned_body"))


@register("headline_body_markup", _with_stories(f"""
, f AS (SELECT doc_id, {S.format_headline_body(S.remove_captions('body'), 'title')} AS training_content
        FROM stories)
SELECT doc_id, training_content, {S.word_count('training_content')} AS word_count FROM f
"""))
def q_headline_body_markup(spark, sf_dir):
    a = stories(spark, sf_dir)
    f = a.select("doc_id", tx.format_headline_body(tx.remove_captions("body"), "title")
                 .alias("training_content"))
    return f.withColumn("word_count", tx.word_count("training_content"))


@register("body_only_markup", _with_stories(f"""
, f AS (SELECT doc_id, {S.format_body_only('body')} AS training_content FROM stories)
SELECT doc_id, training_content, {S.word_count('training_content')} AS word_count FROM f
"""))
def q_body_only_markup(spark, sf_dir):
    a = stories(spark, sf_dir)
    f = a.select("doc_id", tx.format_body_only("body").alias("training_content"))
    return f.withColumn("word_count", tx.word_count("training_content"))


PREVIEW_R = [0, 1, 2, -1]


@register("paragraph_removal_preview", _with_stories(f"""
SELECT doc_id, r.r AS r,
       {S.format_headline_body('body', 'title', 'CASE WHEN r.r = 0 THEN NULL ELSE r.r END')} AS preview
FROM stories CROSS JOIN (VALUES {', '.join(f'({x})' for x in PREVIEW_R)}) AS r(r)
"""))
def q_paragraph_removal_preview(spark, sf_dir):
    """Dashboard preview: paragraph removal r, where r = 0 means "keep all"."""
    a = stories(spark, sf_dir)
    a = a.select("doc_id", "title", "body",
                 F.explode(F.array(*[F.lit(x) for x in PREVIEW_R])).alias("r"))
    r_eff = F.when(F.col("r") == 0, F.lit(None).cast("int")).otherwise(F.col("r"))
    return a.select("doc_id", "r", tx.format_headline_body("body", "title", r_eff).alias("preview"))


def _sql_unmark(x: str) -> str:
    return (f"replace(replace({x}, {S.q(tx.PARAGRAPH)}, chr(10) || chr(10)), "
            f"{S.q(tx.NEWLINE)}, chr(10))")


_HL = "'<HEADLINE>(.*)<HEADLINE/>'"


@register("decompile_markup", _with_stories(f"""
, f AS (SELECT doc_id,
               {_sql_unmark(S.format_headline_body('body', 'title'))} AS t,
               {_sql_unmark(S.format_body_only('body'))} AS body_only
        FROM stories)
SELECT doc_id, regexp_extract(t, {_HL}, 1) AS headline,
       replace(replace(regexp_replace(t, {_HL}, '', 'g'), {S.q(tx.BODY_OPEN)}, ''), {S.q(tx.BODY_CLOSE)}, '') AS body,
       body_only
FROM f
"""))
def q_decompile_markup(spark, sf_dir):
    a = stories(spark, sf_dir)
    d = tx.decompile_headline_body(tx.format_headline_body("body", "title"))
    return a.select("doc_id", d["headline"].alias("headline"), d["body"].alias("body"),
                    tx.decompile_body_only(tx.format_body_only("body")).alias("body_only"))


@register("word_counts", f"""
SELECT doc_id, {S.word_count('text')} AS n_words, CAST(length(text) AS INTEGER) AS n_chars,
       {S.word_count('text')} BETWEEN {PUB_MIN_WORDS} AND {PUB_MAX_WORDS} AS in_range
FROM documents
""")
def q_word_counts(spark, sf_dir):
    from pressline.sources.articles import load_table
    d = load_table(spark, sf_dir, "documents")
    wc = tx.word_count("text")
    return d.select("doc_id", wc.alias("n_words"), F.length("text").alias("n_chars"),
                    wc.between(PUB_MIN_WORDS, PUB_MAX_WORDS).alias("in_range"))


@register("ascii_clean", f"""
SELECT doc_id, {S.clean_ascii('text')} AS cleaned,
       CAST(length(text) - length({S.clean_ascii('text')}) AS INTEGER) AS removed
FROM documents
""")
def q_ascii_clean(spark, sf_dir):
    from pressline.sources.articles import load_table
    d = load_table(spark, sf_dir, "documents")
    c = tx.clean_ascii("text")
    return d.select("doc_id", c.alias("cleaned"), (F.length("text") - F.length(c)).alias("removed"))


SEARCH_CI, SEARCH_CS = "th[ae]", "Th[ae]"


@register("title_search_ci", _with_articles(f"""
SELECT doc_id, source_id, query_date, title FROM articles
WHERE coalesce(regexp_matches(title, {S.q(SEARCH_CI)}, 'i'), false)
"""))
def q_title_search_ci(spark, sf_dir):
    a = load_articles(spark, sf_dir)
    return a.where(tx.title_matches("title", SEARCH_CI)).select("doc_id", "source_id", "query_date", "title")


@register("title_search_cs", _with_articles(f"""
SELECT doc_id, source_id, query_date, title FROM articles
WHERE coalesce(regexp_matches(title, {S.q(SEARCH_CS)}), false)
"""))
def q_title_search_cs(spark, sf_dir):
    a = load_articles(spark, sf_dir)
    return a.where(tx.title_matches("title", SEARCH_CS, case_sensitive=True)) \
            .select("doc_id", "source_id", "query_date", "title")


SEARCH_INDEXED = "(and|the) ?(th|of)|tion[.,]"


@register("title_search_indexed", _with_articles(f"""
SELECT doc_id, source_id, query_date, title FROM articles
WHERE coalesce(regexp_matches(title, {S.q(SEARCH_INDEXED)}, 'i'), false)
"""))
def q_title_search_indexed(spark, sf_dir):
    """Title search over a trigram index of the articles: candidates by required trigrams, then the expression."""
    a = stage(load_articles(spark, sf_dir).select("doc_id", "source_id", "query_date", "title"), "titles")
    path = scratch_path(spark, "title-index")
    build_title_index(a, path)
    return search_titles(a, path, SEARCH_INDEXED)
