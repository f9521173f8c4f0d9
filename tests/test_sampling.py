import hashlib

import pytest
from pyspark.sql import functions as F

from pressline.operators import sampling as sm


def md5_rank(ids, seed="pressline", *salts):
    key = lambda i: hashlib.md5(":".join([seed, *map(str, salts), str(i)]).encode()).hexdigest()
    return sorted(ids, key=lambda i: (key(i), i))


@pytest.fixture(scope="module")
def ids(spark):
    return spark.range(0, 1000).withColumnRenamed("id", "doc_id")


def test_sample_exact_top_n(ids):
    got = [r.doc_id for r in sm.sample_exact(ids, 20).collect()]
    assert sorted(got) == sorted(md5_rank(range(1000))[:20])


def test_sample_exact_large_n(ids):
    got = {r.doc_id for r in sm.sample_exact(ids, 300).collect()}
    assert got == set(md5_rank(range(1000))[:300])


@pytest.mark.parametrize("n", range(8))
def test_sample_of_repeated_and_null_ids_is_exact(spark, n):
    rows = [(1, "a"), (1, "b"), (1, "b"), (2, "c"), (None, "d"), (None, "d"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in sm.sample_exact(df, n).collect()]
    assert len(got) == n and all(got.count(r) <= rows.count(r) for r in got)
    again = [tuple(r) for r in sm.sample_exact(df.repartition(3), n).collect()]
    assert sorted(got, key=str) == sorted(again, key=str)     # the layout changes nothing


def test_split_of_one_repeated_id(spark):
    df = spark.createDataFrame([(7, i) for i in range(4)], "doc_id long, v int")
    sides = [r.side for r in sm.split_exact(df, 0.5).collect()]
    assert sorted(sides) == ["train", "train", "validation", "validation"]


def test_no_wide_top_n_in_the_sample_plan(ids):
    plan = sm.sample_exact(ids, 20)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan and "Exchange" not in plan


def test_lenient_sample_takes_all(ids):
    assert sm.sample_exact(ids, 1001, strict=False).count() == 1000


def test_no_epochs_no_batches(ids):
    assert sm.shuffle_batches(ids, 4, epochs=0).count() == 0
    with pytest.raises(ValueError):
        sm.shuffle_batches(ids, 4, epochs=-1)


def test_sample_larger_than_rows_raises(ids):
    with pytest.raises(ValueError):
        sm.sample_exact(ids, 1001)


@pytest.mark.parametrize("p", [0.0, 0.7, 1.0])
def test_split_exact_sizes_and_disjoint(ids, p):
    s = sm.split_exact(ids, p)
    train = {r.doc_id for r in s.where("side = 'train'").collect()}
    val = {r.doc_id for r in s.where("side = 'validation'").collect()}
    assert len(train) == int(p * 1000)
    assert not (train & val) and len(train | val) == 1000
    assert train == set(md5_rank(range(1000))[:int(p * 1000)])


def test_split_share_above_one_raises(ids):
    with pytest.raises(ValueError):
        sm.split_exact(ids, 1.1)


def test_shuffle_batches_matches_rank(spark):
    df = spark.range(0, 50).withColumnRenamed("id", "doc_id")
    b = sm.shuffle_batches(df, 4, epochs=2).collect()
    for e in (0, 1):
        order = md5_rank(range(50), "pressline", e)
        rows = sorted((r for r in b if r.epoch == e), key=lambda r: r.position)
        assert [r.doc_id for r in rows] == order
        assert [r.batch_id for r in rows] == [i // 4 for i in range(50)]


def test_global_rank_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sm, "_prefix_digits", lambda total, rows_per_bucket=0: 2)
    df = spark.range(0, 400).withColumnRenamed("id", "doc_id")
    r = sm.global_rank(df, sm.hash_key("doc_id"), "doc_id").collect()
    assert [x.doc_id for x in sorted(r, key=lambda x: x.rank)] == md5_rank(range(400))


def test_sample_count_accounting(spark):
    r = spark.range(1).select(sm.sample_count_accounting(F.lit(10), 4).alias("n")).collect()[0]
    assert r.n == 12


def test_checked_broadcast_bounds_rows_and_bytes(spark):
    from pressline.plans.stage import checked_broadcast

    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().logical().toString().lower()

    d = spark.range(1000).selectExpr("id", "repeat('x', 100) AS pad")
    assert hinted(checked_broadcast(d))
    assert not hinted(checked_broadcast(d, max_rows=999))          # row bound
    assert not hinted(checked_broadcast(d, max_bytes=10_000))      # byte bound
    assert checked_broadcast(d, max_bytes=10_000).count() == 1000  # same rows either way


def test_stage_and_drop_staged(spark):
    import pytest
    from pyspark.errors import PySparkException
    from py4j.protocol import Py4JJavaError

    from pressline.plans.stage import drop_staged, stage
    st = stage(spark.range(5), "unit")
    assert st.count() == 5
    assert drop_staged(spark)
    with pytest.raises((PySparkException, Py4JJavaError)):
        st.collect()
