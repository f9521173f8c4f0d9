"""Classification metrics as DataFrame aggregates.

The confusion matrix is a long table ``(truth, guess, n)``; every metric is an
aggregate over it (at most labels x labels rows), so the only pass over the
scored rows is one partial/final hash aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressline import constants as C
from pressline.functions import labels as lb


def label_grid(spark: SparkSession, n_labels: int) -> DataFrame:
    """All (truth, guess) pairs of ``n_labels`` labels, generated (no join)."""
    seq = F.sequence(F.lit(0), F.lit(n_labels - 1))
    return (spark.range(1).select(F.explode(seq).alias("truth"))
                 .select("truth", F.explode(seq).alias("guess")))


def confusion_matrix(scored: DataFrame, n_labels: int, truth: str = "truth",
                     guess: str = "guess") -> DataFrame:
    """``(truth, guess, n)`` for every cell of the label grid (absent cells 0).

    One entry per scored row, rows = truth, columns = guess. A label outside
    ``0..n_labels-1`` or NULL fails the job, as it has no cell.
    """
    def inside(c: str) -> Column:
        label = F.col(c).cast("int")
        return F.when(label.between(0, n_labels - 1), label).otherwise(
            F.raise_error(F.concat(F.lit(f"{c} outside 0..{n_labels - 1}: "), F.coalesce(label.cast("string"), F.lit("NULL")))))

    counts = (scored.groupBy(inside(truth).alias("truth"), inside(guess).alias("guess"))
                    .agg(F.count(F.lit(1)).alias("n")))
    grid = label_grid(scored.sparkSession, n_labels)
    return (grid.join(counts, ["truth", "guess"], "left")
                .select("truth", "guess", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def dense_matrix(matrix: DataFrame, n_labels: int, prefix: str = "guess_") -> DataFrame:
    """Rows = truth, one column per guess label (pivot with the values listed)."""
    return (matrix.groupBy("truth")
                  .pivot("guess", list(range(n_labels)))
                  .agg(F.sum("n"))
                  .select("truth", *[F.coalesce(F.col(str(i)), F.lit(0)).cast("bigint")
                                     .alias(f"{prefix}{i}") for i in range(n_labels)]))


def per_label(matrix: DataFrame) -> DataFrame:
    """``(label_idx, tp, n_true, n_guessed, precision, recall)`` with the 1e-7 smoothing."""
    cells = matrix.select(F.explode(F.array(
        F.struct(F.col("truth").alias("label_idx"), F.col("n").alias("n_true"), F.lit(0).cast("bigint").alias("n_guessed"),
                 F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(F.lit(0)).cast("bigint").alias("tp")),
        F.struct(F.col("guess").alias("label_idx"), F.lit(0).cast("bigint").alias("n_true"), F.col("n").alias("n_guessed"),
                 F.lit(0).cast("bigint").alias("tp")))).alias("c")).select("c.*")
    agg = cells.groupBy("label_idx").agg(F.sum("tp").alias("tp"), F.sum("n_true").alias("n_true"),
                                         F.sum("n_guessed").alias("n_guessed"))
    return agg.select("label_idx", "tp", "n_true", "n_guessed",
                      (F.col("tp") / (F.col("n_guessed") + F.lit(C.METRIC_EPSILON))).alias("precision"),
                      (F.col("tp") / (F.col("n_true") + F.lit(C.METRIC_EPSILON))).alias("recall"))


def f_beta(p: Column, r: Column, beta: float) -> Column:
    if beta < 0:
        raise ValueError("beta must be >= 0")
    b2 = float(beta) * float(beta)
    return F.try_divide((b2 + 1) * p * r, b2 * p + r)


def report_names(n_labels: int) -> list[str]:
    """The metrics of :func:`report`, in its order."""
    f = ["precision", "recall", "f1"] if n_labels == 2 else ["mean_precision", "mean_recall", "macro_f1"]
    return ["acc", "correct", "total", *f]


def report(matrix: DataFrame, n_labels: int, beta: float = 1.0) -> DataFrame:
    """Metric report ``(metric, value)``: values x100 except correct/total.

    Two labels: precision / recall / f1 of label 1; otherwise mean precision,
    mean recall and macro F from those means. Accuracy of an empty matrix is NULL.
    """
    if beta < 0:
        raise ValueError("beta must be >= 0")
    pl = per_label(matrix)
    # trace = sum of per-label hits, total = sum of per-label truths: one aggregate.
    if n_labels == 2:
        p = F.max(F.when(F.col("label_idx") == 1, F.col("precision")))
        r = F.max(F.when(F.col("label_idx") == 1, F.col("recall")))
    else:
        p, r = F.avg("precision"), F.avg("recall")
    names = report_names(n_labels)[3:]
    one = pl.agg(F.sum("tp").alias("correct"), F.sum("n_true").alias("total"), p.alias("p"), r.alias("r"))
    hundred = F.lit(100.0)
    def row(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))
    rows = F.array(
        row("acc", F.try_divide(F.col("correct").cast("double"), F.col("total")) * hundred),
        row("correct", F.col("correct")),
        row("total", F.col("total")),
        row(names[0], F.col("p") * hundred),
        row(names[1], F.col("r") * hundred),
        row(names[2], f_beta(F.col("p"), F.col("r"), beta) * hundred),
    )
    return one.select(F.inline(rows))


def scored_frame(scores: DataFrame, scores_col: str = "scores", truth_col: str = "truth") -> DataFrame:
    """Adds ``guess`` (argmax, first index on ties)."""
    return scores.withColumn("guess", lb.argmax(scores_col))


def topk_accuracy(scored: DataFrame, ks: list[int], scores_col: str = "scores",
                  truth_col: str = "truth") -> DataFrame:
    """``(k, accuracy)`` in percent: share of rows whose truth ranks within the top k."""
    ranked = scored.select(lb.truth_rank(scores_col, truth_col).alias("_r"))
    agg = ranked.agg(*[(F.avg((F.col("_r") <= k).cast("double")) * 100.0).alias(f"k{k}") for k in ks])
    return agg.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("accuracy"))
                                         for k in ks])))


def mean_cross_entropy(scored: DataFrame, scores_col: str = "scores", truth_col: str = "truth") -> Column:
    return F.avg(lb.cross_entropy(scores_col, truth_col))


def phase_meters(steps: DataFrame, keys=("epoch", "phase")) -> DataFrame:
    """Epoch/phase record from a step log ``(…, n, loss, acc, seconds)``: the
    n-weighted means the training meters report, plus batch and sample counts."""
    w = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    return steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("batches"),
        F.sum("n").cast("bigint").alias("samples"),
        w("loss").alias("loss"),
        w("acc").alias("accuracy"),
        F.avg("seconds").alias("batch_time"))


def running_meters(steps: DataFrame, every: int, keys=("epoch", "phase"), order: str = "batch",
                   bucket_rows: int = 1_000_000) -> DataFrame:
    """Running n-weighted mean of loss and accuracy at every ``every``-th batch.

    Prefix sums are two-phase so no task sees a whole epoch: batches are cut into
    ranges of ``bucket_rows``; range totals (a small table) give each range its
    starting sums; inside a range a window finishes the running sum.
    """
    keys = list(keys)
    b = F.floor(F.col(order) / bucket_rows).alias("_range")
    vals = steps.select(*keys, order, b, (F.col("loss") * F.col("n")).alias("_ln"),
                        (F.col("acc") * F.col("n")).alias("_an"), F.col("n").cast("double").alias("_n"))
    totals = vals.groupBy(*keys, "_range").agg(F.sum("_ln").alias("t_ln"), F.sum("_an").alias("t_an"),
                                                F.sum("_n").alias("t_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_range", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias("o" + c[1:])
                                                for c in ("t_ln", "t_an", "t_n")])
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = (vals.join(offsets, [*keys, "_range"])
               .select(*keys, order,
                       (F.col("o_ln") + F.sum("_ln").over(inside)).alias("s_ln"),
                       (F.col("o_an") + F.sum("_an").over(inside)).alias("s_an"),
                       (F.col("o_n") + F.sum("_n").over(inside)).alias("s_n")))
    return (run.where(F.pmod(F.col(order), F.lit(every)) == 0)
               .select(*keys, order, (F.col("s_ln") / F.col("s_n")).alias("avg_loss"),
                       (F.col("s_an") / F.col("s_n")).alias("avg_accuracy")))


def loss_windows(steps: DataFrame, every: int = C.LOSS_REPORT_EVERY, order: str = "step",
                 value: str = "loss") -> DataFrame:
    """Sum of ``value`` per run of ``every`` consecutive steps."""
    return (steps.groupBy(F.floor(F.col(order) / every).cast("bigint").alias("window_id"))
                 .agg(F.count(F.lit(1)).alias("steps"), F.sum(value).alias("loss_sum")))
