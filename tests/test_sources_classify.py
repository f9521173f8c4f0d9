import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from pressline.plans import classify as cl
from pressline.plans.training_set import sentiment_training_set, topic_training_set
from pressline.sources import corpora as co
from pressline.sources import runs as rn
from pressline.streaming.ingest import start_listing_stream


def test_topic_csv_and_training_set(spark):
    d = tempfile.mkdtemp(prefix="pl-csv-")
    with open(os.path.join(d, "train.csv"), "w") as f:
        f.write('3,"Head, one","Body line\nsecond ""quoted"" line"\n1,Two,short body\n')
    df = co.read_topic_csv(spark, d)
    rows = sorted(df.collect(), key=lambda r: r.label)
    assert [r.label for r in rows] == [1, 3]
    assert rows[1].text == 'Body line\nsecond "quoted" line'
    t = topic_training_set(df, 0, 1000).collect()
    assert {r.label for r in t} == {"1", "3"}
    assert all(r.training_content.startswith(" <HEADLINE> ") for r in t)


def test_labelled_dirs(spark):
    root = tempfile.mkdtemp(prefix="pl-dirs-")
    for lab, txt in [("pos", "good\n\nfilm"), ("neg", "bad")]:
        os.makedirs(os.path.join(root, lab))
        with open(os.path.join(root, lab, "1.txt"), "w") as f:
            f.write(txt)
    df = co.read_labelled_dirs(spark, root)
    got = {r.label: r.text for r in df.collect()}
    assert got == {"pos": "good\n\nfilm", "neg": "bad"}
    s = {r.label: r.training_content for r in sentiment_training_set(df, 0, 1000).collect()}
    assert s["pos"] == "good <PARAGRAH> film"


def test_manifest_files(spark):
    root = tempfile.mkdtemp(prefix="pl-code-")
    os.makedirs(os.path.join(root, "src"))
    for name, body in [("a.py", "x = 1\n"), ("b.py", "print('é')\n")]:
        with open(os.path.join(root, "src", name), "w") as f:
            f.write(body)
    manifest = os.path.join(root, "manifest.txt")
    with open(manifest, "w") as f:
        f.write("a.py\n\nb.py\n")
    df = co.read_manifest_files(spark, manifest, os.path.join(root, "src"))
    assert {r.name: r.text for r in df.collect()} == {"a.py": "x = 1\n", "b.py": "print('é')\n"}
    assert co.read_manifest_files(spark, manifest, os.path.join(root, "src"), samples=2).count() <= 2
    with open(manifest, "w") as f:
        f.write("./a.py\na.py\n")
    assert [r.text for r in co.read_manifest_files(spark, manifest, os.path.join(root, "src")).collect()] == ["x = 1\n"] * 2
    with open(manifest, "w") as f:
        f.write("a.py\ngone.py\n")
    with pytest.raises(FileNotFoundError, match="gone.py"):
        co.read_manifest_files(spark, manifest, os.path.join(root, "src"))


def test_run_record_and_label_order(spark):
    path = tempfile.mkdtemp(prefix="pl-runs-") + "/runs"
    rec = rn.run_record(spark, "r1", 4, 10, 5e-5, 100, 79, ["src2", "src7", "src9"], "note")
    rn.append_run(rec, path)
    rn.append_run(rn.run_record(spark, "r2", 20, 2, 2e-5, 10000, 10, None, checkpoint=True, blocksize=512), path)
    runs = rn.read_runs(spark, path)
    assert runs.count() == 2
    order = [(r.label_idx, r.label) for r in rn.label_order_of(runs, "r1").orderBy("label_idx").collect()]
    assert order == [(0, "src2"), (1, "src7"), (2, "src9")]
    date = runs.where("run_id = 'r2'").collect()[0].date
    assert date[2] == "-" and "(" in date and date.endswith(")")


def test_classifier_end_to_end(spark):
    words = {"a": "alpha apple apricot", "b": "bravo banana berry", "c": "charlie cherry coconut"}
    rows = [(i, lab, " ".join([words[lab]] * (1 + i % 3))) for i, lab in enumerate("abc" * 20)]
    df = spark.createDataFrame(rows, "doc_id long, source_id string, training_content string")
    res = cl.train_classifier(df, "source_id", max_iter=20)
    assert res.labels == ["a", "b", "c"]
    preds = res.predictions.collect()
    assert len(preds) == 60
    assert all(abs(sum(r.scores) - 1.0) < 1e-9 for r in preds)
    hist = {r.phase: r for r in res.history.collect()}
    assert set(hist) == {"train", "validation"} and hist["train"].n == 42
    path = tempfile.mkdtemp(prefix="pl-model-")
    cl.save_model(res.model, path)
    again = cl.score(cl.load_model(path), df.limit(3), ["doc_id"]).collect()
    assert len(again) == 3
    pages = spark.createDataFrame(
        [(1, "<title>x</title><article><p>alpha apple apricot</p></article>"), (2, None)],
        "page_id long, html string")
    out = {r.page_id: r for r in cl.classify_pages(res.model, pages).collect()}
    assert out[1].label == "a" and not out[1].error
    assert out[2].error and out[2].label is None


def test_run_record_after_two_reads(spark):
    path = tempfile.mkdtemp(prefix="pl-runs-") + "/runs"
    for i in range(3):
        rn.append_run(rn.run_record(spark, f"r{i}", 4, 1, 0.1, 0, 9, ["a"]), path)
        assert rn.read_runs(spark, path).count() == i + 1
        assert len(rn.read_runs(spark, path).columns) == 11


def test_label_in_the_test_table_only(spark):
    train = spark.createDataFrame([(i, "ab"[i % 2], f"{'ab'[i % 2]} word") for i in range(20)],
                                  "doc_id long, label string, text string")
    test = spark.createDataFrame([(100, "a", "a word"), (101, "0new", "new word")], "doc_id long, label string, text string")
    res = cl.sentiment_classifier(train, test)
    assert res.labels == ["0new", "a", "b"]
    got = {r.doc_id: r for r in res.predictions.where("phase = 'validation'").collect()}
    assert set(got) == {100, 101} and got[100].label_name == "a" and got[101].truth == 0
    assert all(abs(sum(r.scores) - 1.0) < 1e-9 for r in got.values())


def test_training_job_leaves_its_records(spark):
    out = tempfile.mkdtemp(prefix="pl-job-")
    df = spark.createDataFrame([(i, "abc"[i % 3], f"{'abc'[i % 3]} word") for i in range(30)],
                               "doc_id long, source_id string, training_content string")
    cl.training_job(df, out, "run1", max_iter=5)
    assert [r.label for r in rn.label_order_of(rn.read_runs(spark, f"{out}/runs"), "run1").orderBy("label_idx").collect()] == list("abc")
    hist = {r.phase: r for r in spark.read.json(f"{out}/history/run1").collect()}
    assert set(hist) == {"train", "validation"}
    assert len(hist["train"].loss) == len(hist["train"].accuracy) == len(hist["train"].time) == 1
    assert sum(map(sum, hist["train"].confusion_matrix)) == 21
    assert cl.label_order(cl.load_model(f"{out}/models/run1")) == list("abc")


def test_streaming_ingest(spark):
    base = tempfile.mkdtemp(prefix="pl-stream-")
    landing = os.path.join(base, "landing")
    os.makedirs(landing)
    resp = [
        {"query_date": "2020-04-22", "source_id": "s1", "status": "ok",
         "articles": [{"source": {"id": "s1", "name": "S1"}, "title": f"t{i}", "url": f"u{i}",
                       "publishedAt": f"2020-04-22T{i % 24:02d}:{i // 24:02d}:00Z"} for i in range(120)]},
        {"query_date": "2020-04-23", "source_id": "s1", "status": "failed", "articles": []},
    ]
    for i, r in enumerate(resp):
        with open(os.path.join(landing, f"r{i}.json"), "w") as f:
            json.dump(r, f)
    table = os.path.join(base, "table")
    q = start_listing_stream(spark, landing, table, os.path.join(base, "ckpt"))
    q.awaitTermination(120)
    from pressline.sources.articles import read_partitioned
    t = read_partitioned(spark, table)
    assert t.count() == 100
    assert t.where(F.col("scraped")).count() == 0
    assert [r.query_date for r in t.select("query_date").distinct().collect()] == ["2020-04-22"]
