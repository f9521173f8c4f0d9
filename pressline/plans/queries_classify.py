"""Registered queries: topic / sentiment training sets (value-checked), the
MLlib classifier jobs (rows-only: model fits have no SQL equivalent) and their
contracts (value-checked: what holds whatever the fit gives)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline import constants as C
from pressline.operators.sampling import split_exact
from pressline.plans import sql_text as S
from pressline.plans.catalog import register
from pressline.plans.classify import (TrainResult, classify_pages, sentiment_classifier, topic_classifier,
                                      train_classifier)
from pressline.plans.queries_ingest import PAGES_SQL
from pressline.plans.queries_text import PUB_MAX_WORDS, PUB_MIN_DOCS, PUB_MIN_WORDS, PUB_SOURCES, PUBLISHER_SQL
from pressline.plans.training_set import (publisher_training_set, sentiment_training_set,
                                          topic_training_set)
from pressline.plans.dashboards import source_date_view, story_by_key
from pressline.plans.epochs import epoch_reports, train_epochs
from pressline.plans.stage import scratch_path
from pressline.sources.articles import ARTICLES_SQL, load_articles, load_table

TOPIC_MAX_WORDS = 1000


def topic_rows(spark, sf_dir):
    """Topic corpus rows from ``documents``: label = language (four classes),
    headline = first line, text = the whole document."""
    d = load_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("lang").alias("label"),
                    F.substring_index("text", "\n", 1).alias("headline"), "text")


def sentiment_rows(spark, sf_dir):
    """Sentiment corpus rows: documents with a quality label (0/1)."""
    d = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = load_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    return d.join(lab, "doc_id")


@register("topic_training_set", f"""
WITH f AS (SELECT doc_id, CAST(lang AS VARCHAR) AS label,
                  {S.format_headline_body('text', "split_part(text, chr(10), 1)")} AS training_content
           FROM documents),
c AS (SELECT *, {S.word_count('training_content')} AS word_count FROM f)
SELECT doc_id, label, word_count, training_content FROM c WHERE word_count BETWEEN 0 AND {TOPIC_MAX_WORDS}
""")
def q_topic_training_set(spark, sf_dir):
    t = topic_training_set(topic_rows(spark, sf_dir), 0, TOPIC_MAX_WORDS)
    return t.select("doc_id", "label", "word_count", "training_content")


@register("sentiment_training_set", f"""
WITH f AS (SELECT d.doc_id, CAST(l.quality AS VARCHAR) AS label, {S.format_body_only('d.text')} AS training_content
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
c AS (SELECT *, {S.word_count('training_content')} AS word_count FROM f)
SELECT doc_id, label, word_count, training_content FROM c WHERE word_count BETWEEN 0 AND {TOPIC_MAX_WORDS}
""")
def q_sentiment_training_set(spark, sf_dir):
    """Sentiment corpus: documents with a quality label (0/1), body-only markup."""
    t = sentiment_training_set(sentiment_rows(spark, sf_dir), 0, TOPIC_MAX_WORDS)
    return t.select("doc_id", "label", "word_count", "training_content")


TOPIC_SPLIT, SENTIMENT_SPLIT = 0.7, 0.7

_FITTED: dict[tuple, tuple[tuple, TrainResult]] = {}


def table_state(spark, sf_dir, tables) -> tuple:
    """What tells two states of the tables apart: path, length and time of each of their files."""
    found = []
    for t in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{t}.parquet")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files = fs.listFiles(path, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def _shared(spark, sf_dir, name, fit, tables) -> TrainResult:
    """One fit per application, job and state of its tables: the queries that show its
    predictions, history and contract read the same model and staged predictions. A changed table is fitted anew and the old fit let go."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    state = table_state(spark, sf_dir, tables)
    if key not in _FITTED or _FITTED[key][0] != state:
        _FITTED[key] = state, fit()
    return _FITTED[key][1]


def _publisher_model(spark, sf_dir):
    return _shared(spark, sf_dir, "publisher", lambda: train_classifier(
        publisher_training_set(load_articles(spark, sf_dir), PUB_MIN_WORDS, PUB_MAX_WORDS,
                               PUB_MIN_DOCS, PUB_SOURCES), "source_id", max_iter=20), ("documents",))


def _two_tables(rows, share):
    """The corpus as its two inputs, a train and a test table."""
    sides = split_exact(rows, share, "doc_id")
    return [sides.where(F.col("side") == s).drop("side") for s in ("train", "validation")]


def _topic_model(spark, sf_dir):
    return _shared(spark, sf_dir, "topic", lambda: topic_classifier(
        *_two_tables(topic_rows(spark, sf_dir), TOPIC_SPLIT), 0, TOPIC_MAX_WORDS), ("documents",))


def _sentiment_model(spark, sf_dir):
    return _shared(spark, sf_dir, "sentiment", lambda: sentiment_classifier(
        *_two_tables(sentiment_rows(spark, sf_dir), SENTIMENT_SPLIT), 0, TOPIC_MAX_WORDS), ("documents", "labels"))


def _validation(res):
    v = res.predictions.where(F.col("phase") == "validation")
    return v.select("doc_id", F.col("label").alias("truth_label"), F.col("label_name").alias("predicted_label"),
                    F.round("score", 6).alias("score"))


@register("publisher_classifier")
def q_publisher_classifier(spark, sf_dir):
    """Validation-side predictions of the publisher classifier."""
    return _validation(_publisher_model(spark, sf_dir))


@register("topic_classifier")
def q_topic_classifier(spark, sf_dir):
    """Test-table predictions of the topic classifier."""
    return _validation(_topic_model(spark, sf_dir))


@register("sentiment_classifier")
def q_sentiment_classifier(spark, sf_dir):
    """Test-table predictions of the sentiment classifier."""
    return _validation(_sentiment_model(spark, sf_dir))


HISTORY_EPOCHS, HISTORY_BATCH = 3, 256


def _passes(spark, sf_dir):
    """The publisher classifier trained in passes (one run per session and state of its table)."""
    def fit():
        ts = publisher_training_set(load_articles(spark, sf_dir), PUB_MIN_WORDS, PUB_MAX_WORDS, PUB_MIN_DOCS, PUB_SOURCES)
        rows = split_exact(ts.select("doc_id", "training_content", F.col("source_id").alias("label")), C.DEFAULT_TRAIN_SHARE, "doc_id", side_col="phase")
        return train_epochs(rows, scratch_path(spark, "passes"), HISTORY_EPOCHS, HISTORY_BATCH)
    return _shared(spark, sf_dir, "passes", fit, ("documents",))


@register("classifier_history")
def q_classifier_history(spark, sf_dir):
    """The record of a training in passes, a row per epoch and phase: rows, loss, Acc@1 and the metric report."""
    res = _passes(spark, sf_dir)
    return epoch_reports(res.history, len(res.model.labels)).drop("matrix", "seconds")


@register("classifier_history_contract", f"""
WITH ts AS ({PUBLISHER_SQL}),
k AS (SELECT *, row_number() OVER (ORDER BY {S.sample_key('doc_id')}, doc_id) AS rk, count(*) OVER () AS total FROM ts),
ph AS (SELECT CASE WHEN rk <= CAST(floor(CAST({C.DEFAULT_TRAIN_SHARE} AS DOUBLE) * total) AS BIGINT) THEN 'train' ELSE 'validation' END AS phase FROM k),
n AS (SELECT phase, count(*) AS n FROM ph GROUP BY phase)
SELECT CAST(e AS INTEGER) AS epoch, phase, CAST(n AS BIGINT) AS n,
       CAST(CASE WHEN phase = 'train' THEN ceil(n / {HISTORY_BATCH}) ELSE 1 END AS INTEGER) AS batches, CAST(n AS BIGINT) AS in_matrix, true AS consistent
FROM n CROSS JOIN range({HISTORY_EPOCHS}) t(e)
""")
def q_classifier_history_contract(spark, sf_dir):
    """What holds of the records whatever the fit gives: rows and batches of each pass, a matrix that holds every row and agrees with Acc@1."""
    h = _passes(spark, sf_dir).history
    total = F.aggregate("matrix", F.lit(0).cast("long"), lambda s, c: s + c["n"])
    hits = F.aggregate(F.filter("matrix", lambda c: c["truth"] == c["guess"]), F.lit(0).cast("long"), lambda s, c: s + c["n"])
    agrees = (F.abs(F.col("acc1") - 100.0 * hits / F.col("n")) < 1e-9) & (F.col("loss") > 0)
    return h.select("epoch", "phase", "n", "batches", total.alias("in_matrix"), agrees.alias("consistent"))


@register("page_classification")
def q_page_classification(spark, sf_dir):
    """Stored pages classified by the publisher model (failed pages: error rows)."""
    res = _publisher_model(spark, sf_dir)
    out = classify_pages(res.model, load_table(spark, sf_dir, "pages"))
    return out.select("page_id", "title", "label", F.round("score", 6).alias("score"), "error")


@register("page_classification_contract", PAGES_SQL + """
SELECT page_id, CASE WHEN error THEN NULL ELSE title0 END AS title, error, NOT error AS has_label,
       CASE WHEN error THEN NULL ELSE CAST(1.0 AS DOUBLE) END AS prob_total
FROM extracted
""")
def q_page_classification_contract(spark, sf_dir):
    """What holds of the classified pages whatever the fit gives: one row per page, a label where
    the page could be read, probabilities that sum to one."""
    out = classify_pages(_publisher_model(spark, sf_dir).model, load_table(spark, sf_dir, "pages"))
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)
    return out.select("page_id", "title", "error", F.col("label").isNotNull().alias("has_label"),
                      F.round(total, 6).alias("prob_total"))


def _contract(res):
    """Rows per phase and label, the label order, and the mean sum of the probabilities."""
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)
    return res.predictions.groupBy("phase", F.col("truth").alias("label_idx"), "label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(total), 6).alias("mean_prob_total"))


def _contract_sql(rows_sql: str, share: float, after: str = "true") -> str:
    """``rows_sql`` gives (doc_id, label, word_count); the split is by hash order, ``after`` filters the split rows."""
    return f"""
WITH src AS ({rows_sql}),
k AS (SELECT *, row_number() OVER (ORDER BY {S.sample_key('doc_id')}, doc_id) AS rk, count(*) OVER () AS total FROM src),
ph AS (SELECT label, CASE WHEN rk <= CAST(floor(CAST({share} AS DOUBLE) * total) AS BIGINT)
                          THEN 'train' ELSE 'validation' END AS phase FROM k WHERE {after}),
ord AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx FROM (SELECT DISTINCT label FROM ph))
SELECT ph.phase, ord.label_idx, ph.label, CAST(count(*) AS BIGINT) AS n, CAST(1.0 AS DOUBLE) AS mean_prob_total
FROM ph JOIN ord ON ph.label = ord.label GROUP BY ph.phase, ord.label_idx, ph.label
"""


@register("publisher_classifier_contract", _contract_sql(
    f"SELECT doc_id, source_id AS label FROM ({PUBLISHER_SQL}) ts", C.DEFAULT_TRAIN_SHARE))
def q_publisher_classifier_contract(spark, sf_dir):
    return _contract(_publisher_model(spark, sf_dir))


@register("topic_classifier_contract", _contract_sql(f"""
SELECT doc_id, CAST(lang AS VARCHAR) AS label,
       {S.word_count(S.format_headline_body('text', "split_part(text, chr(10), 1)"))} AS word_count FROM documents
""", TOPIC_SPLIT, f"word_count BETWEEN 0 AND {TOPIC_MAX_WORDS}"))
def q_topic_classifier_contract(spark, sf_dir):
    return _contract(_topic_model(spark, sf_dir))


@register("sentiment_classifier_contract", _contract_sql(f"""
SELECT d.doc_id, CAST(l.quality AS VARCHAR) AS label, {S.word_count(S.format_body_only('d.text'))} AS word_count
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
""", SENTIMENT_SPLIT, f"word_count BETWEEN 0 AND {TOPIC_MAX_WORDS}"))
def q_sentiment_classifier_contract(spark, sf_dir):
    return _contract(_sentiment_model(spark, sf_dir))


@register("source_date_view", f"""
WITH articles AS ({ARTICLES_SQL}), s AS (SELECT *, coalesce(scraped_content, content) AS story_text FROM articles)
SELECT doc_id, source_id, query_date, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published, title, story_text,
       scraped, {S.format_headline_body('story_text', 'title', '1')} AS parsed, true AS predicted
FROM s
""")
def q_source_date_view(spark, sf_dir):
    """The publisher/date view of all articles: story, text without its last paragraph, and whether the
    publisher model gave a label."""
    v = source_date_view(load_articles(spark, sf_dir), _publisher_model(spark, sf_dir).model, remove_paragraphs=1)
    return v.select("doc_id", "source_id", "query_date", "published", "title", "story_text", "scraped", "parsed",
                    (F.col("label").isNotNull() & F.col("score").between(0, 1 + 1e-9)).alias("predicted"))


STORY_KEY = 3       # an article without a scraped body


@register("story_by_key", f"""
WITH articles AS ({ARTICLES_SQL})
SELECT doc_id, source_id, query_date, title, coalesce(scraped_content, content) AS story_text, scraped
FROM articles WHERE doc_id = {STORY_KEY}
""")
def q_story_by_key(spark, sf_dir):
    """One story picked by its key; without a scraped body the excerpt is shown."""
    return story_by_key(load_articles(spark, sf_dir), STORY_KEY).select(
        "doc_id", "source_id", "query_date", "title", "story_text", "scraped")
