import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from pressline.functions import html as H
from pressline.operators import ingest as ig
from pressline.operators import profile as pr
from pressline.sources import articles as ar


def test_newest_page_of_150_listings(spark):
    base = dt.datetime(2020, 5, 1)
    rows = [("s1", "2020-05-01", f"u{i:03d}", base + dt.timedelta(minutes=i)) for i in range(150)]
    rows += [("s2", "2020-05-01", "x", base)]
    df = spark.createDataFrame(rows, "source_id string, query_date string, url string, published_at timestamp")
    out = ig.newest_per_cell(df, 100)
    s1 = sorted(r.url for r in out.where("source_id = 's1'").collect())
    assert len(s1) == 100 and s1[0] == "u050" and s1[-1] == "u149"
    assert out.where("source_id = 's2'").count() == 1
    fresh = ig.as_ingested(out).select("scraped", "scraped_content", "error").distinct().collect()
    assert [tuple(r) for r in fresh] == [(False, None, None)]


@pytest.mark.parametrize("fails,keep", [
    ({"2020-04-22"}, []),
    ({"2020-04-24"}, ["2020-04-22", "2020-04-23"]),
    (set(), ["2020-04-22", "2020-04-23", "2020-04-24", "2020-04-25"]),
])
def test_stop_at_first_failure(spark, fails, keep):
    dates = ["2020-04-22", "2020-04-23", "2020-04-24", "2020-04-25"]
    log = spark.createDataFrame([("s", d, d in fails or (d > "2020-04-24" and bool(fails))) for d in dates],
                                "source_id string, query_date string, failed boolean")
    got = sorted(r.query_date for r in ig.stop_at_first_failure(log).collect())
    assert got == keep


def test_capped_work(spark):
    cells = spark.createDataFrame([("b", "2020-04-23"), ("a", "2020-04-23"), ("c", "2020-04-22")],
                                  "source_id string, query_date string")
    got = [(r.query_date, r.source_id) for r in ig.capped_work(cells, 2).collect()]
    assert got == [("2020-04-22", "c"), ("2020-04-23", "a")]
    assert ig.capped_work(cells, None).count() == 3


def test_scrape_pass(spark):
    arts = spark.createDataFrame([
        (1, "u1", True, "old body", False),
        (2, "u2", False, None, None),      # page fetched fine
        (3, "u3", False, None, True),      # page failed again
        (4, "u4", False, None, None),      # no page at all
    ], "doc_id int, url string, scraped boolean, scraped_content string, error boolean")
    pages = spark.createDataFrame([("u2", "new body", False), ("u3", None, True)],
                                  "url string, content_text string, error boolean")
    out = {r.doc_id: r for r in ig.apply_scrape(arts, pages).collect()}
    assert (out[1].scraped, out[1].scraped_content, out[1].newly_scraped) == (True, "old body", False)
    assert (out[2].scraped, out[2].error, out[2].scraped_content, out[2].newly_scraped) == (True, False, "new body", True)
    assert (out[3].scraped, out[3].error) == (False, True)
    assert (out[4].scraped, out[4].error) == (False, True)


def test_scrape_pass_extracts_only_needed_pages(spark):
    arts = spark.createDataFrame([(1, "u1", True, "old", False), (2, "u2", False, None, None)],
                                 "doc_id int, url string, scraped boolean, scraped_content string, error boolean")
    raw = spark.createDataFrame([("u1", "<article><p>again</p></article>"),
                                 ("u2", "<article><p>fresh text</p></article>"),
                                 ("u9", "<article><p>unused</p></article>")], "url string, html string")
    seen = []

    def extract(p):
        seen.append(sorted(r.url for r in p.collect()))
        return H.extract_pages(p).select("url", "content_text", "error")

    out = {r.doc_id: r for r in ig.apply_scrape(arts, raw, extract=extract).collect()}
    assert seen == [["u2"]]           # scraped and unknown pages are never extracted
    assert (out[1].scraped_content, out[1].newly_scraped) == ("old", False)
    assert (out[2].scraped, out[2].scraped_content, out[2].newly_scraped) == (True, "fresh text", True)


def test_html_failures_give_error_rows(spark):
    pages = spark.createDataFrame([
        (1, "<html><title>T</title><body><p>no article</p></body></html>"),
        (2, "<html><title>T</title><article><h1>T</h1><p> </p></article></html>"),
        (3, None),
        (4, "<html><head><title>A &amp; B</title><script>x='</p>'</script></head><article><h1>A</h1>"
            "<p><b>Lead &quot;x&quot;<br><p>Second\n  para</p></article></html>"),
    ], "page_id int, html string")
    out = {r.page_id: r for r in pages.select("page_id", H.extract_page("html").alias("x")).select("page_id", "x.*").collect()}
    assert out[1].error and out[2].error and out[3].error
    assert out[1].content_text is None
    assert (out[4].title, out[4].content_text, out[4].error) == ("A & B", 'Lead "x"\n\nSecond para', False)


def test_raw_layout_roundtrip_and_profile(spark):
    root = tempfile.mkdtemp(prefix="pl-raw-")
    for date, src, n in [("2020-04-22", "s1", 2), ("2020-04-23", "s1", 1), ("2020-04-22", "s2", 1)]:
        d = os.path.join(root, date, src)
        os.makedirs(d)
        arts = [{"source": {"id": src, "name": src.upper()}, "title": f"t{i}", "url": f"{src}{date}{i}",
                 "publishedAt": f"{date}T0{i}:00:00Z", "content": "c", "scraped": i == 0,
                 **({"error": True} if i == 1 else {})} for i in range(n)]
        with open(os.path.join(d, "articles.json"), "w") as f:
            json.dump(arts, f)
    raw = ar.flatten(ar.read_listing_layout(spark, root))
    assert raw.count() == 4
    assert ar.read_partition(spark, root, "2020-04-22", "s1").count() == 2
    with pytest.raises(FileNotFoundError):
        ar.read_partition(spark, root, "2020-04-30", "s1", strict=True)
    assert ar.read_partition(spark, root, "2020-04-30", "s1", strict=False).count() == 0
    grid = pr.cell_grid(pr.source_dimension(spark, ["s1", "s2", "s3"]), "2020-04-22", "2020-04-23")
    prof = {(r.source_id, r.query_date): (r.n_articles, r.n_scraped, r.n_errors, r.present)
            for r in pr.profile_grid(grid, raw).collect()}
    assert prof[("s1", "2020-04-22")] == (2, 1, 1, True)
    assert prof[("s3", "2020-04-23")] == (0, 0, 0, False)
    assert pr.missing_cells(grid, raw).count() == 3
    # partitioned table: dynamic overwrite replaces only the cells written
    table = os.path.join(root, "table")
    ar.write_partitioned(raw, table)
    ar.write_partitioned(raw.where("source_id = 's2'").withColumn("title", F.lit("new")), table)
    t = ar.read_partitioned(spark, table)
    assert t.count() == 4
    assert t.where("source_id = 's2'").select("title").collect()[0].title == "new"
    assert t.where("source_id = 's1' and query_date = '2020-04-22'").count() == 2


def test_read_partition_by_path_keys_and_empty_listing(spark):
    root = tempfile.mkdtemp(prefix="pl-raw-")
    for src, arts in [("007", [{"source": {"id": None, "name": "N"}, "title": "t", "url": "u", "description": "d"}]), ("s2", [])]:
        d = os.path.join(root, "2020-04-22", src)
        os.makedirs(d)
        with open(os.path.join(d, "articles.json"), "w") as f:
            json.dump(arts, f)
    got = ar.read_partition(spark, root, "2020-04-22", "007")
    assert [(r.source_id, r.query_date, r.description) for r in got.collect()] == [("007", "2020-04-22", "d")]
    assert ar.read_partition(spark, root, "2020-04-22", "s2", strict=True).count() == 0
    table = os.path.join(root, "table")
    ar.write_partitioned(got, table)
    assert [r.source_id for r in ar.read_partitioned(spark, table).collect()] == ["007"]


def test_scrape_pass_two_pages_and_no_url(spark):
    arts = spark.createDataFrame([(1, "u1", False, None, None), (2, None, False, None, None), (3, None, None, None, None)],
                                 "doc_id int, url string, scraped boolean, scraped_content string, error boolean")
    pages = spark.createDataFrame([(1, "u1", "old", False), (2, "u1", "new", False), (3, None, "x", False)],
                                  "page_id int, url string, content_text string, error boolean")
    out = {r.doc_id: r for r in ig.apply_scrape(arts, pages, version="page_id").collect()}
    assert len(out) == 3 and ig.apply_scrape(arts, pages, version="page_id").count() == 3
    assert (out[1].scraped, out[1].scraped_content) == (True, "new")
    assert all((out[i].scraped, out[i].error) == (False, True) for i in (2, 3))


def _responses(spark, rows):
    from pressline.streaming.ingest import LANDING_SCHEMA
    data = [(d, s, status, None if arts is None else [
        (("x", "X"), None, t, "d", u, f"{d}T01:00:00Z", "c", None, None, None) for t, u in arts])
        for d, s, status, arts in rows]
    return spark.createDataFrame(data, LANDING_SCHEMA)


def test_ingest_batch_clears_empty_cells_and_keeps_status(spark):
    from pressline.streaming.ingest import ingest_batch
    table = os.path.join(tempfile.mkdtemp(prefix="pl-in-"), "table")
    day = "2020-04-22"
    ingest_batch(_responses(spark, [(day, "a", "ok", [("t1", "u1"), ("t2", "u2")]), (day, "b", "ok", [("t", "u")])]), table)
    t = ar.read_partitioned(spark, table)
    done = t.where("source_id = 'a'").withColumn("scraped", F.col("url") == "u1").withColumn(
        "scraped_content", F.when(F.col("url") == "u1", "body")).withColumn("error", F.lit(False)).collect()
    ar.write_partitioned(spark.createDataFrame(done, t.schema), table)
    again = _responses(spark, [(day, "a", "ok", [("t1b", "u1"), ("t3", "u3")]), (day, "b", "ok", []), (day, "c", "failed", None)])
    ingest_batch(again, table, preserve_status=True)
    got = {r.url: (r.title, r.scraped, r.scraped_content) for r in ar.read_partitioned(spark, table).collect()}
    assert got == {"u1": ("t1b", True, "body"), "u3": ("t3", False, None)}      # b is empty now
    ingest_batch(again, table)
    assert {r.scraped for r in ar.read_partitioned(spark, table).collect()} == {False}


def test_ingest_landed_stops_at_failed_or_missing_dates(spark):
    from pressline.streaming.ingest import ingest_landed
    base = tempfile.mkdtemp(prefix="pl-land-")
    landing = os.path.join(base, "landing")
    os.makedirs(landing)
    days = ["2020-04-22", "2020-04-23", "2020-04-24"]
    status = {"a": ["ok", "failed", "ok"], "b": ["ok", "ok", "ok"], "c": [None, "ok", "ok"], "other": ["ok"] * 3}
    for s, states in status.items():
        for d, st in zip(days, states):
            if st:
                with open(os.path.join(landing, f"{s}-{d}.json"), "w") as f:
                    json.dump({"query_date": d, "source_id": s, "status": st,
                               "articles": [{"title": s, "url": f"{s}{d}", "publishedAt": f"{d}T00:00:00Z"}]}, f)
    table = os.path.join(base, "table")
    taken = ingest_landed(spark, landing, table, ["a", "b", "c"], days[0], days[-1])
    want = {("a", days[0])} | {("b", d) for d in days}
    assert {(r.source_id, r.query_date) for r in taken.collect()} == want
    assert {(r.source_id, r.query_date) for r in ar.read_partitioned(spark, table).collect()} == want


def test_scrape_run_writes_back_the_capped_work(spark):
    table = os.path.join(tempfile.mkdtemp(prefix="pl-run-"), "table")
    rows = [(i, f"u{i}", i == 0, "old" if i == 0 else None, None, f"2020-04-2{2 + i % 3}", "s") for i in range(6)]
    ar.write_partitioned(spark.createDataFrame(
        rows, "doc_id int, url string, scraped boolean, scraped_content string, error boolean, query_date string, source_id string"), table)
    pages = spark.createDataFrame([(f"u{i}", f"b{i}", False) for i in range(5)], "url string, content_text string, error boolean")
    grid = pr.cell_grid(pr.source_dimension(spark, ["s", "none"]), "2020-04-22", "2020-04-24")
    counts = {r.query_date: (r.n_newly_scraped, r.n_failed) for r in ig.scrape_run(table, grid, pages, max_cells=2).collect()}
    assert counts == {"2020-04-22": (1, 0), "2020-04-23": (2, 0)}
    got = {r.doc_id: (r.scraped, r.scraped_content, r.error) for r in ar.read_partitioned(spark, table).collect()}
    assert got == {0: (True, "old", None), 3: (True, "b3", False), 1: (True, "b1", False), 4: (True, "b4", False),
                   2: (False, None, None), 5: (False, None, None)}
    ig.scrape_run(table, grid, pages)
    got = {r.doc_id: (r.scraped, r.error) for r in ar.read_partitioned(spark, table).collect()}
    assert got[2] == (True, False) and got[5] == (False, True)
