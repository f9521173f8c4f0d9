"""Sparse label vectors: equal to the dense ones, and with very many labels."""

from pyspark.sql import functions as F

from pressline.functions import labels as lb
from pressline.operators import encode as en


def test_sets_equal_dense_vectors(spark):
    rows = [(1, "b|a"), (2, ""), (3, None), (4, "c"), (5, "a|a||d"), (5, "b|a"), (None, "d")]
    df = spark.createDataFrame(rows, "doc_id int, label string")
    sparse, order = en.encode_label_sets(df, "label")
    names = [r.label for r in order.orderBy("label_idx").collect()]
    assert names == ["a", "b", "c", "d"]
    got = sorted((r.doc_id or 0, r.label_set, r.label_idx) for r in sparse.collect())
    assert got == [(0, [3], 3), (1, [0, 1], 0), (2, [], 0), (3, [], 0), (4, [2], 2), (5, [0, 1], 0), (5, [0, 3], 0)]
    old = df.withColumn("one_hot", lb.one_hot("label", F.array(*[F.lit(n) for n in names]))).withColumn("label_idx", lb.label_index("one_hot"))
    new, _ = en.encode_labels(df, "label")
    assert sorted(map(repr, new.collect())) == sorted(map(repr, old.collect()))
    empty, order = en.encode_labels(df.limit(0), "label")
    assert empty.count() == 0 and order.count() == 0


def test_two_hundred_thousand_labels(spark):
    """A dense vector of these rows would hold 400,000 x 200,000 entries."""
    n = 200_000
    df = spark.range(2 * n).select("id", F.concat(F.lit("l"), F.lpad(F.col("id") % n, 6, "0"), F.lit("|l"), F.lpad((F.col("id") * 7) % n, 6, "0")).alias("label"))
    sparse, order = en.encode_label_sets(df, "label")
    assert order.count() == n
    a, b = F.col("id") % n, (F.col("id") * 7) % n
    want = F.when(a == b, F.array(a)).otherwise(F.array(F.least(a, b), F.greatest(a, b))).cast("array<int>")
    assert sparse.where((F.col("label_set") != want) | (F.col("label_idx") != want[0])).count() == 0
    assert sparse.count() == 2 * n
