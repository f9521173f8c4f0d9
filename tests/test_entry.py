"""Driver contract: entry() runs; every query has a callable; the fast
queries match their DuckDB oracle on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from pressline.plans import catalog

from .conftest import SF_SMALL

TABLES = ("documents labels pages embeddings events conversations benchmark").split()
RUNS_ONLY = {"publisher_classifier", "topic_classifier", "sentiment_classifier", "classifier_history",
             "page_classification"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["doc_id", "source_id", "source_name", "title", "query_date", "word_count",
                          "training_content"]
    assert len(rows) > 0


def test_every_query_has_oracle_or_is_rows_only():
    # the library's own queries; those of the training-data operators (op1_ ... op10_, pipeline) have tests of their own
    catalog.load_all()
    qs, sql = catalog.QUERIES, catalog.ORACLE
    assert set(qs) <= set(E.queries()) and set(sql) <= set(E.oracle_sql())
    assert set(sql) <= set(qs)
    assert set(qs) - set(sql) == RUNS_ONLY
    assert len(qs) >= 50
    assert not any(n.lower().startswith("op") for n in qs)


def test_profile_queries_scan_the_articles_once(spark):
    """The result reads the staged cell counts, not the article table again."""
    for name in ("source_date_profile", "missing_partitions", "scrape_work_list"):
        files = E.queries()[name](spark, SF_SMALL).inputFiles()
        assert files and all("/pressline-stage/cells-" in f for f in files), name


def _norm(v):
    return repr(round(v, 9)) if isinstance(v, float) else repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


FAST = ["publisher_training_set", "decompile_markup", "paragraph_removal_preview", "source_date_profile",
        "classification_report", "binary_report", "label_one_hot", "page_extraction", "scrape_status_update",
        "train_validation_split", "token_blocks", "running_meters", "encode_documents", "vocabulary",
        "topk_labels", "displayed_scores", "scrape_run", "ingest_run", "daily_source_counts", "label_sparse",
        "page_layout_extraction", "title_search_indexed", "topic_csv_corpus", "listing_arrays", "manifest_blocks", "scrape_work_list_capped"]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle_sf0001(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    rel = duck.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    s = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    idx = [rel.columns.index(c) for c in cols]
    d = sorted(tuple(_norm(r[i]) for i in idx) for r in rel.fetchall())
    assert s == d
