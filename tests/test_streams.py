"""Streams end in the tables of the batch jobs, whatever the order and the batches of the files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pressline.functions.html import extract_pages
from pressline.operators import ingest as ig
from pressline.operators import profile as pr
from pressline.sources import articles as ar
from pressline.streaming.ingest import ingest_landed
from pressline.streaming.release import newest, start_release_stream
from pressline.streaming.scrape import start_scrape_stream, upsert_cells, waiting_pages, with_status

LISTING = "doc_id int, url string, scraped boolean, scraped_content string, error boolean, query_date string, source_id string"
PAGE = "page_id int, url string, html string"


@pytest.fixture()
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def page(text):
    return f"<title>t</title><article><p>{text}</p></article>" if text else "<p>nothing</p>"


LISTINGS = [(i, f"u{i % 9}" if i % 7 else None, i == 4, "old" if i == 4 else None, None, f"2020-04-2{2 + i % 2}", f"s{i % 3}") for i in range(20)]
PAGES = [(k, f"u{k % 11}", page(None if k % 5 == 0 else f"body {k}")) for k in range(26)] + [(3, "u3", page("tie")), (99, None, page("x"))]


def table_rows(spark, path):
    return sorted(map(tuple, ar.read_partitioned(spark, path).select("doc_id", "url", "scraped", "scraped_content", "error", "query_date", "source_id").collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_scrape_stream_equals_the_batch_pass(spark, tmp_path, few_partitions, seed):
    batch = str(tmp_path / "batch")
    ar.write_partitioned(spark.createDataFrame(LISTINGS, LISTING), batch)
    grid = pr.cell_grid(pr.source_dimension(spark, ["s0", "s1", "s2"]), "2020-04-22", "2020-04-23")
    ig.scrape_run(batch, grid, spark.createDataFrame(PAGES, PAGE), extract=lambda p: extract_pages(p).select("url", "content_text", "error"), version="page_id")
    rng = random.Random(seed)
    for folder, rows, names in (("listings", LISTINGS, LISTING), ("pages", PAGES, PAGE)):
        (tmp_path / folder).mkdir()
        rows = rng.sample(rows, len(rows))
        columns = [c.split()[0] for c in names.split(", ")]
        for f in range(2):
            with open(tmp_path / folder / f"{rng.random()}.json", "w") as out:
                out.writelines(json.dumps(dict(zip(columns, r, strict=True))) + "\n" for r in rows[f::2])

    def stream(folder, kind):
        return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(tmp_path / folder))
    table = str(tmp_path / "table")
    start_scrape_stream(stream("listings", LISTING), stream("pages", PAGE), table, str(tmp_path / "ck")).awaitTermination()
    assert table_rows(spark, table) == table_rows(spark, batch)
    # a batch that is run again changes nothing
    changed = waiting_pages(spark.createDataFrame(LISTINGS, LISTING), spark.createDataFrame(PAGES, PAGE), "page_id")
    columns = [c.split()[0] for c in LISTING.split(", ")]
    upsert_cells(with_status(changed.where("_key IN ('u1', 'u2', 'u5')"), columns), table)
    assert table_rows(spark, table) == table_rows(spark, batch)


def test_release_stream_equals_the_batch_ingest(spark, tmp_path, few_partitions):
    days = ["2020-04-22", "2020-04-23", "2020-04-24"]
    status = {"a": ["ok", "failed", "ok"], "b": ["ok", "ok", "ok"], "c": [None, "ok", "ok"], "d": ["ok", "retry", "ok"], "other": ["ok"] * 3}
    landing = tmp_path / "landing"
    landing.mkdir()
    answers = []
    for s, states in status.items():
        for d, st in zip(days, states, strict=True):
            for again in (["failed", "ok"] if st == "retry" else [st, st] if s == "b" else [st] if st else []):
                answers.append({"query_date": d, "source_id": s, "status": again, "articles": [
                    {"title": f"t{k}", "url": f"{s}{d}{k}{len(answers)}", "publishedAt": f"{d}T0{k}:00:00Z" if k else None} for k in range(3)]})
    random.Random(4).shuffle(answers)
    for k, a in enumerate(answers):
        (landing / f"{k:03d}.json").write_text(json.dumps(a))
    sources = ["a", "b", "c", "d"]
    batch, table = str(tmp_path / "batch"), str(tmp_path / "table")
    ingest_landed(spark, str(landing), batch, sources, days[0], days[-1], limit=4)
    start_release_stream(spark, str(landing), table, str(tmp_path / "ck"), sources, days[0], days[-1], limit=4, files_per_batch=5).awaitTermination()
    pick = lambda p: sorted(map(tuple, ar.read_partitioned(spark, p).select("source_id", "query_date", "title", "url", F.col("published_at").cast("string")).collect()), key=repr)
    assert pick(table) == pick(batch)
    assert {r[0] for r in pick(table)} == {"a", "b", "d"}


def test_newest_of_a_cell():
    rows = [{"url": "b", "_time": "2"}, {"url": "a", "_time": "2"}, {"url": "c"}, {"url": None, "_time": "3"}, {"url": "d", "_time": "1"}]
    assert [r["url"] for r in newest(rows, 4)] == [None, "a", "b", "d"]
