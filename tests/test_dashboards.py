import datetime as dt

from pressline.plans import dashboards as db


def _articles(spark):
    ts = dt.datetime(2020, 5, 1, 3, 15)
    rows = [
        (1, "s1", "2020-05-01", "The big story", ts, True, "Body one\n\nPara two", "excerpt 1"),
        (2, "s1", "2020-05-01", "small news", ts.replace(hour=7), False, None, "excerpt 2"),
        (3, "s1", "2020-05-02", "The other", ts, True, "x", "e"),
        (4, "s2", "2020-05-01", None, ts, True, "y", "e"),
    ]
    return spark.createDataFrame(rows, "doc_id long, source_id string, query_date string, title string, "
                                       "published_at timestamp, scraped boolean, scraped_content string, "
                                       "content string")


def test_source_date_lookup(spark):
    hist, stories = db.source_date_lookup(_articles(spark), "s1", "2020-05-01", pattern="the")
    h = {r.hour: r.n for r in hist.collect()}
    assert len(h) == 24 and h[3] == 1 and h[7] == 1 and sum(h.values()) == 2
    got = {r.doc_id: r.story_text for r in stories.collect()}
    assert got == {1: "Body one\n\nPara two"}
    hist2, stories2 = db.source_date_lookup(_articles(spark), "s1", "2020-05-01", scraped_only=True)
    assert sum(r.n for r in hist2.collect()) == 1
    assert [r.doc_id for r in stories2.collect()] == [1]


def test_unscraped_story_falls_back_to_excerpt(spark):
    rows = {r.doc_id: r.story_text for r in db.story_rows(_articles(spark)).collect()}
    assert rows[2] == "excerpt 2"


def test_parsed_preview_zero_keeps_all(spark):
    a = _articles(spark).where("doc_id = 1")
    keep = db.parsed_preview(a, 0).collect()[0].parsed
    drop = db.parsed_preview(a, 1).collect()[0].parsed
    assert "Para two" in keep and "Para two" not in drop


def test_training_lookup(spark):
    # selection is by publication day: doc 3 was published on 2020-05-01 too
    got = sorted(r.doc_id for r in db.training_lookup(_articles(spark), "s1", "2020-05-01").collect())
    assert got == [1, 2, 3]


def test_hour_histogram_bins_and_null_timestamps(spark):
    from pressline.operators.profile import hour_histogram
    rows = [("a", dt.datetime(2020, 5, 1, 3)), ("a", dt.datetime(2020, 5, 2, 3)), ("a", None),
            ("b", None), (None, dt.datetime(2020, 5, 1, 23))]
    df = spark.createDataFrame(rows, "source_id string, published_at timestamp")
    got = {(r.source_id, r.hour): r.n for r in hour_histogram(df).collect()}
    assert len(got) == 3 * 24                       # every group, 24 bins each
    assert got[("a", 3)] == 2 and sum(v for (k, _), v in got.items() if k == "a") == 2
    assert all(got[("b", h)] == 0 for h in range(24))
    assert got[(None, 23)] == 1
