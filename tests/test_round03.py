"""Growth faults of round 3: files, jobs and tasks that followed the rows too closely."""

import glob

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pressline.operators import encode as en
from pressline.plans import epochs as ep
from pressline.plans import queries_files as qf
from pressline.plans import queries_ingest as qi
from pressline.sources.articles import articles_from_documents, flatten, read_listing_layout
from pressline.sources.corpora import read_labelled_dirs


def documents(spark, n, step=1):
    return spark.range(0, n * step, step, 4).select(F.col("id").alias("doc_id"), F.lit("src1").alias("source"), F.concat(F.lit("Title\nbody "), "id").alias("text"))


def test_listings_follow_cells_not_rows(spark, tmp_path):
    root = str(tmp_path / "root")
    # every id lies in another block of ARRAY_ROWS ids, but all articles in few cells
    articles = articles_from_documents(documents(spark, 2000, qf.ARRAY_ROWS)).withColumn("query_date", F.lit("2020-04-22"))
    qf.write_listing_arrays(articles, root)
    assert len(glob.glob(f"{root}/*/*/*.txt")) <= 2000 // qf.ARRAY_ROWS + 1
    back = flatten(read_listing_layout(spark, root, "query_date=*/source_id=*/*.txt"))
    assert sorted(r[0] for r in back.select("extra.page_rank").collect()) == sorted(str(k * qf.ARRAY_ROWS) for k in range(2000))


def test_listing_parts_of_null_and_repeated_rows(spark, tmp_path):
    root = str(tmp_path / "root")
    articles = articles_from_documents(documents(spark, 30)).withColumn("source_id", F.when(F.col("doc_id") % 3 > 0, F.lit("src1")))
    qf.write_listing_arrays(articles.unionByName(articles), root)
    assert flatten(read_listing_layout(spark, root, "query_date=*/source_id=*/*.txt")).count() == 60


def test_text_files_are_written_by_their_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("pyspark.sql.DataFrameWriter.text", lambda *_: (_ for _ in ()).throw(AssertionError("a commit moves each file")))
    rows = spark.createDataFrame([("a\nb", "1"), ("a\nb", "1"), (None, "0"), ("é", None)], "text string, label string").repartition(3)
    for root in (str(tmp_path / "dirs"), f"file://{tmp_path}/uri"):
        qf.write_labelled_dirs(rows, root)
        found = read_labelled_dirs(spark, root).select("text", "label").collect()
        assert sorted(map(tuple, found)) == [("\n", "_label=0"), ("a\nb\n", "_label=1"), ("a\nb\n", "_label=1"), ("é\n", "_label=__HIVE_DEFAULT_PARTITION__")]
        assert not glob.glob(f"{root.removeprefix('file://')}/*/.*")          # no checksum file beside each


def test_small_batches_need_no_job_each(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(k, " ".join(f"w{x}" for x in rng.integers(0, 30, 6)), "ab"[k % 2], "train" if k % 4 else "validation") for k in range(90)],
                                 "doc_id long, training_content string, label string, phase string")
    calls, sums = [], ep.batch_sums
    monkeypatch.setattr(ep, "batch_sums", lambda r, m, gradient: calls.append(gradient) or sums(r, m, gradient))

    def run(name, walk_rows):
        monkeypatch.setattr(ep, "WALK_ROWS", walk_rows)
        calls.clear()
        res = ep.train_epochs(rows, str(tmp_path / name), 2, 8, warmup=5)
        return res, sum(calls), res.history.drop("seconds").orderBy("epoch", "phase").collect()
    one, jobs, record = run("one", 1 << 17)
    assert jobs == 0
    chain, jobs, same = run("chain", 24)                      # three batches a walk
    assert jobs == 0 and same == record
    each, jobs, same = run("each", 0)                         # a distributed step for each batch
    assert jobs == 2 * 9 and same == record
    for other in (chain, each):
        assert np.array_equal(one.model.weights, other.model.weights) and np.array_equal(one.model.bias, other.model.bias)


def test_stream_landing_follows_the_scan(spark, tmp_path):
    qi.land(documents(spark, 400), str(tmp_path / "landing"))
    assert len(glob.glob(f"{tmp_path}/landing/*.parquet")) == 4


def test_lookup_slices_follow_tokens(spark):
    batch = pa.RecordBatch.from_arrays([pa.array([[1] * 3, None, [], [2] * 9, [3], [4]]), pa.array(range(6))], ["t", "k"])
    got = [b["k"].to_pylist() for b in en._slices([batch.slice(1), batch], "t", 4)]
    assert [k for part in got for k in part] == [1, 2, 3, 4, 5, *range(6)]
    assert all(sum(len(x or ()) for x in b["t"].to_pylist()) <= 4 or b.num_rows == 1 for b in en._slices([batch], "t", 4))


def test_python_batches_end_at_bytes(spark):
    from pressline.session import configure
    configure(spark)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])
    sizes = [r.n for r in spark.range(0, 100, 1, 1).select(F.expr("repeat('x', 1 << 20)").alias("t")).mapInArrow(run, "n long").collect()]
    assert len(sizes) > 1 and max(sizes) < 40 << 20


def test_licences_train_on_every_paragraph(spark):
    from pressline.llm import licences as li
    seen = []
    real = li.LogisticRegression.fit

    def fit(self, rows, *rest):
        seen.append(rows.agg(F.sum("n_train")).first()[0])
        return real(self, rows, *rest)
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("The license of house "), "id", F.lit(" was renewed.")).alias("text"))
    li.LogisticRegression.fit = fit
    try:
        out = li.scan_licences(docs)
    finally:
        li.LogisticRegression.fit = real
    assert seen[0] > 4500                 # four of five distinct paragraphs, the others calibrate
    assert out.count() == 6000
