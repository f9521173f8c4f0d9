"""Label and score-vector expressions (higher-order array functions, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressline.functions.text import ColumnOrName, _col


def label_parts(label: ColumnOrName, sep: str = "|") -> Column:
    """Non-empty parts of a label split on ``sep`` (NULL -> empty array)."""
    parts = F.split(F.coalesce(_col(label), F.lit("")), F.lit(r"\Q" + sep + r"\E"), -1)
    return F.filter(parts, lambda p: p != "")


def label_order(df: DataFrame, label_col: str, sep: str = "|") -> DataFrame:
    """Sorted distinct non-empty label parts as ``(label_idx, label)``.

    Label order is by code point (Spark's binary string order), 0-based. The
    distinct is a hash aggregate (map-side combined); the ranks are prefix sums
    over ranges of the labels, so their number has no bound.
    """
    from pressline.operators.ranges import prefix_sums
    from pressline.plans.stage import stage
    labels = stage(df.select(F.explode(label_parts(label_col, sep)).alias("label")).distinct(), "labels")
    return (prefix_sums(labels, [F.col("label")], F.lit(1), "_rank")
            .select(F.col("_rank").cast("int").alias("label_idx"), "label"))


def one_hot(label: ColumnOrName, order: Column, sep: str = "|") -> Column:
    """``array<int>`` over ``order``: 1 where the label holds that part (multi-hot)."""
    parts = label_parts(label, sep)
    return F.transform(order, lambda x: F.array_contains(parts, x).cast("int"))


def label_sets(df: DataFrame, label_col: str, order: DataFrame, sep: str = "|") -> DataFrame:
    """``df`` with ``label_set``: the sorted indices of the label's parts (a sparse multi-hot vector; empty for none).

    Only distinct label texts are taken apart: their parts meet ``order`` (label_idx, label) by a join, and the
    texts' index sets come back to the rows by another. Neither a row nor a task holds all labels."""
    from pressline.plans.stage import checked_broadcast, stage
    # one row per label text, however many rows carry it
    texts = stage(df.select(F.col(label_col).alias("_text")).where(F.col(label_col).isNotNull()).distinct(), "label-texts")
    parts = texts.select("_text", F.explode(F.array_distinct(label_parts("_text", sep))).alias("label"))
    sets = parts.join(order, "label").groupBy("_text").agg(F.sort_array(F.collect_list("label_idx")).alias("_set"))
    joined = df.join(checked_broadcast(sets), F.col(label_col) == F.col("_text"), "left").drop("_text")
    return joined.withColumn("label_set", F.coalesce("_set", F.array().cast("array<int>"))).drop("_set")


def dense_labels(label_set: ColumnOrName, n_labels: int) -> Column:
    """The multi-hot vector of a label set, for a known number of labels."""
    every = F.sequence(F.lit(0), F.lit(n_labels - 1)) if n_labels else F.array().cast("array<int>")
    return F.transform(every, lambda i: F.array_contains(_col(label_set), i).cast("int"))


def set_index(label_set: ColumnOrName) -> Column:
    """Index of a label set: its first, 0 for none (as the argmax of its vector)."""
    s = _col(label_set)
    return F.when(F.size(s) > 0, F.array_min(s)).otherwise(F.lit(0)).cast("int")


def label_index(one_hot_col: ColumnOrName) -> Column:
    """argmax of a one-hot vector: first 1, all-zero -> 0."""
    pos = F.array_position(_col(one_hot_col), 1)
    return F.when(pos > 0, pos - 1).otherwise(F.lit(0)).cast("int")


def argmax(scores: ColumnOrName) -> Column:
    """0-based index of the largest score; ties go to the first index."""
    s = _col(scores)
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def softmax(scores: ColumnOrName) -> Column:
    """Numerically stable softmax of a score array."""
    s = _col(scores)
    m = F.array_max(s)
    e = F.transform(s, lambda x: F.exp(x - m))
    total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / total)


def cross_entropy(scores: ColumnOrName, truth_idx: ColumnOrName) -> Column:
    """``logsumexp(scores) - scores[truth]`` (scores taken as logits)."""
    s = _col(scores)
    m = F.array_max(s)
    lse = m + F.log(F.aggregate(F.transform(s, lambda x: F.exp(x - m)), F.lit(0.0),
                                lambda acc, x: acc + x))
    return lse - F.element_at(s, _col(truth_idx) + 1)


def truth_rank(scores: ColumnOrName, truth_idx: ColumnOrName) -> Column:
    """1-based rank of the true label in a descending sort (ties: lower index first)."""
    s = _col(scores)
    t = _col(truth_idx)
    st = F.element_at(s, t + 1)
    better = F.filter(F.sequence(F.lit(0), F.size(s) - 1),
                      lambda i: (F.element_at(s, i + 1) > st) |
                                ((F.element_at(s, i + 1) == st) & (i < t)))
    return F.size(better) + 1


def topk_labels(df: DataFrame, scores_col: str, k: int, names: Column) -> DataFrame:
    """``df`` without its scores, one row for each of its ``k`` best labels:
    ``rank`` (from 1), ``label_idx``, ``label`` and ``score``; ties go to the
    lower index, and NULL scores come last."""
    s = _col(scores_col)
    # a map-side sort of one row's scores: highest first, then lowest index
    ranked = F.transform(s, lambda x, i: F.struct(F.coalesce(-x, F.lit(float("inf"))).alias("d"), i.alias("i"), x.alias("x")))
    best = F.slice(F.array_sort(ranked), 1, k)
    out = df.select(*[c for c in df.columns if c != scores_col], F.posexplode(best).alias("_pos", "_best"))
    return out.select(*[c for c in df.columns if c != scores_col], (F.col("_pos") + 1).cast("int").alias("rank"),
                      F.col("_best.i").cast("int").alias("label_idx"),
                      F.element_at(names, F.col("_best.i") + 1).alias("label"), F.col("_best.x").alias("score"))


def pad_truncate(ids: ColumnOrName, max_length: int, pad_id: int) -> tuple[Column, Column]:
    """``(input_ids, attention_mask)`` of exactly ``max_length`` ints."""
    ids = _col(ids)
    kept = F.slice(ids, 1, max_length)
    n = F.size(kept)
    pad = F.array_repeat(F.lit(pad_id), F.lit(max_length) - n)
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_length) - n))
    return F.concat(kept, pad), mask


def round_score(x: ColumnOrName, digits: int = 6) -> Column:
    """Half-even rounding of a score for display."""
    return F.bround(_col(x), digits)


def display_metric(x: ColumnOrName) -> Column:
    """Metric shown with two decimals."""
    return F.format_number(_col(x), 2)


def label_dimension(spark, labels) -> DataFrame:
    """``(label_idx, label)`` from a list of names or an ``{index: name}`` map
    (indices 0..n-1), ordered by index."""
    if isinstance(labels, dict):
        names = [labels[i] for i in range(len(labels))]
    else:
        names = list(labels)
    return spark.createDataFrame(list(enumerate(names)), "label_idx int, label string")
