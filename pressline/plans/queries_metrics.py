"""Registered queries: evaluation metrics over score tables and step logs.

Score table (FIXTURES.md section 4): ``embeddings`` -> ``scores`` = dot products
of the whole vector with the ten mean vectors (one per label), ``truth`` =
label. Two-label table: ``labels`` with
``quality`` as truth and ``toxic`` as guess. Step log: ``events`` (one event =
one batch; loss = value; batch size from ``props.k``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline.functions import labels as lb
from pressline.operators import metrics as M
from pressline.operators.sampling import split_exact
from pressline.plans import sql_text as S
from pressline.plans.catalog import register
from pressline.sources.articles import load_table

N_LABELS = 10
TOPK = [1, 2, 3, 5]
RUNNING_EVERY = 10


def r9(c):
    return F.round(c, 9)


def mean_vectors(e):
    """``(label, dim, mean)`` per label and vector position: a partial/final aggregate."""
    values = e.select(F.col("label").cast("int").alias("label"), F.posexplode("embedding").alias("dim", "v"))
    return values.groupBy("label", "dim").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


def score_table(spark, sf_dir):
    e = load_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    # N_LABELS rows of one vector each
    rows = (mean_vectors(e).where(F.col("label").between(0, N_LABELS - 1)).groupBy("label")
            .agg(F.sort_array(F.collect_list(F.struct("dim", "mean"))).alias("m")).collect())
    means = {r["label"]: [x["mean"] for x in r["m"]] for r in rows}

    def dot(k):
        products = F.zip_with("embedding", F.lit(means[k]), lambda v, m: v.cast("double") * m)
        return r9(F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x))
    return e.select("vec_id", F.array(*[dot(k) for k in range(N_LABELS)]).alias("scores"),
                    F.col("label").cast("int").alias("truth"))


SCORES_SQL = f"""
WITH vals AS (SELECT CAST(label AS INTEGER) AS label, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS dim
              FROM embeddings),
means AS (SELECT label, dim, round(avg(CAST(v AS DOUBLE)), 6) AS mean FROM vals GROUP BY label, dim),
centres AS (SELECT label, list(mean ORDER BY dim) AS m FROM means GROUP BY label),
sc AS (SELECT e.vec_id, CAST(e.label AS INTEGER) AS truth,
              list(round(list_inner_product(CAST(e.embedding AS DOUBLE[]), c.m), 9) ORDER BY c.label) AS scores
       FROM embeddings e CROSS JOIN centres c GROUP BY e.vec_id, e.label),
scored AS (SELECT *, CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS guess FROM sc)
"""

MATRIX_SQL = SCORES_SQL + f"""
, grid AS (SELECT CAST(t AS INTEGER) AS truth, CAST(g AS INTEGER) AS guess
           FROM range({N_LABELS}) a(t) CROSS JOIN range({N_LABELS}) b(g)),
counts AS (SELECT truth, guess, count(*) AS n FROM scored GROUP BY truth, guess),
matrix AS (SELECT grid.truth, grid.guess, CAST(coalesce(counts.n, 0) AS BIGINT) AS n
           FROM grid LEFT JOIN counts ON grid.truth = counts.truth AND grid.guess = counts.guess)
"""


def _matrix(spark, sf_dir):
    return M.confusion_matrix(M.scored_frame(score_table(spark, sf_dir)), N_LABELS)


@register("confusion_matrix", MATRIX_SQL + "SELECT truth, guess, n FROM matrix")
def q_confusion_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir)


@register("confusion_matrix_dense", MATRIX_SQL + "SELECT truth, " + ", ".join(
    f"CAST(sum(CASE WHEN guess = {i} THEN n ELSE 0 END) AS BIGINT) AS guess_{i}" for i in range(N_LABELS))
    + " FROM matrix GROUP BY truth")
def q_confusion_matrix_dense(spark, sf_dir):
    return M.dense_matrix(_matrix(spark, sf_dir), N_LABELS)


PER_LABEL_SQL = """
, per AS (
  SELECT l AS label_idx,
         CAST(sum(CASE WHEN truth = l AND guess = l THEN n ELSE 0 END) AS BIGINT) AS tp,
         CAST(sum(CASE WHEN truth = l THEN n ELSE 0 END) AS BIGINT) AS n_true,
         CAST(sum(CASE WHEN guess = l THEN n ELSE 0 END) AS BIGINT) AS n_guessed
  FROM matrix CROSS JOIN (SELECT DISTINCT truth AS l FROM matrix) labels
  GROUP BY l),
pr AS (SELECT *, tp / (n_guessed + 1e-7) AS precision, tp / (n_true + 1e-7) AS recall FROM per)
"""


@register("per_label_metrics", MATRIX_SQL + PER_LABEL_SQL + """
SELECT CAST(label_idx AS INTEGER) AS label_idx, tp, n_true, n_guessed,
       round(precision, 9) AS precision, round(recall, 9) AS recall FROM pr
""")
def q_per_label_metrics(spark, sf_dir):
    p = M.per_label(_matrix(spark, sf_dir))
    return p.select("label_idx", "tp", "n_true", "n_guessed", r9(F.col("precision")).alias("precision"),
                    r9(F.col("recall")).alias("recall"))


def _report_sql(names, p_expr, r_expr):
    return f"""
, agg AS (SELECT sum(tp) AS correct, sum(n_true) AS total, {p_expr} AS p, {r_expr} AS r FROM pr)
SELECT metric, round(value, 9) AS value FROM (
  SELECT 'acc' AS metric, CAST(correct AS DOUBLE) / nullif(total, 0) * 100.0 AS value FROM agg
  UNION ALL SELECT 'correct', CAST(correct AS DOUBLE) FROM agg
  UNION ALL SELECT 'total', CAST(total AS DOUBLE) FROM agg
  UNION ALL SELECT '{names[0]}', p * 100.0 FROM agg
  UNION ALL SELECT '{names[1]}', r * 100.0 FROM agg
  UNION ALL SELECT '{names[2]}', 2.0 * p * r / nullif(p + r, 0) * 100.0 FROM agg)
"""


def _report_df(matrix, n_labels):
    return M.report(matrix, n_labels).select("metric", r9(F.col("value")).alias("value"))


@register("classification_report", MATRIX_SQL + PER_LABEL_SQL +
          _report_sql(("mean_precision", "mean_recall", "macro_f1"), "avg(precision)", "avg(recall)"))
def q_classification_report(spark, sf_dir):
    return _report_df(_matrix(spark, sf_dir), N_LABELS)


BINARY_MATRIX_SQL = """
WITH pairs AS (SELECT CAST(quality AS INTEGER) AS truth, CAST(toxic AS INTEGER) AS guess FROM labels),
grid AS (SELECT CAST(t AS INTEGER) AS truth, CAST(g AS INTEGER) AS guess FROM range(2) a(t) CROSS JOIN range(2) b(g)),
counts AS (SELECT truth, guess, count(*) AS n FROM pairs GROUP BY truth, guess),
matrix AS (SELECT grid.truth, grid.guess, CAST(coalesce(counts.n, 0) AS BIGINT) AS n
           FROM grid LEFT JOIN counts ON grid.truth = counts.truth AND grid.guess = counts.guess)
"""


@register("binary_report", BINARY_MATRIX_SQL + PER_LABEL_SQL + _report_sql(
    ("precision", "recall", "f1"), "max(CASE WHEN label_idx = 1 THEN precision END)",
    "max(CASE WHEN label_idx = 1 THEN recall END)"))
def q_binary_report(spark, sf_dir):
    lab = load_table(spark, sf_dir, "labels").select(F.col("quality").alias("truth"),
                                                     F.col("toxic").alias("guess"))
    return _report_df(M.confusion_matrix(lab, 2), 2)


@register("topk_accuracy", SCORES_SQL + f"""
, ranked AS (SELECT 1 + len(list_filter(range(0, {N_LABELS}),
                 lambda i: scores[i + 1] > scores[truth + 1] OR (scores[i + 1] = scores[truth + 1] AND i < truth))) AS r
             FROM sc)
SELECT k, round(avg(CASE WHEN r <= k THEN 1.0 ELSE 0.0 END) * 100.0, 9) AS accuracy
FROM ranked CROSS JOIN (VALUES {', '.join(f'({k})' for k in TOPK)}) AS ks(k)
GROUP BY k
""")
def q_topk_accuracy(spark, sf_dir):
    acc = M.topk_accuracy(score_table(spark, sf_dir), TOPK)
    return acc.select("k", r9(F.col("accuracy")).alias("accuracy"))


CE_SQL = "(list_max(scores) + ln(list_sum(list_transform(scores, lambda x: exp(x - list_max(scores))))) - scores[truth + 1])"


@register("cross_entropy_loss", SCORES_SQL + f"""
SELECT CAST(count(*) AS BIGINT) AS n, round(avg({CE_SQL}), 9) AS mean_loss FROM sc
""")
def q_cross_entropy_loss(spark, sf_dir):
    s = score_table(spark, sf_dir)
    return s.agg(F.count(F.lit(1)).alias("n"), r9(M.mean_cross_entropy(s)).alias("mean_loss"))


LABEL_ORDER_SQL = """
, ord AS (SELECT list(l ORDER BY l) AS names FROM (SELECT DISTINCT CAST(truth AS VARCHAR) AS l FROM sc))
"""


def _label_names(spark, sf_dir):
    s = score_table(spark, sf_dir)
    order = lb.label_order(s.select(F.col("truth").cast("string").alias("lab")), "lab")
    names = order.agg(F.transform(F.sort_array(F.collect_list(F.struct("label_idx", "label"))), lambda r: r["label"]))
    return s, names.scalar()


TOP_LABELS = 3


@register("topk_labels", SCORES_SQL + LABEL_ORDER_SQL + f"""
, ent AS (SELECT vec_id, unnest(range(1, {N_LABELS} + 1)) AS i, unnest(scores) AS score FROM sc),
rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, i) AS rank FROM ent)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, CAST(i - 1 AS INTEGER) AS label_idx, ord.names[i] AS label,
       round(score, 9) AS score
FROM rk, ord WHERE rank <= {TOP_LABELS}
""")
def q_topk_labels(spark, sf_dir):
    """The best labels of each vector, best first (ties: lower index first)."""
    s, names = _label_names(spark, sf_dir)
    return (lb.topk_labels(s.select("vec_id", "scores"), "scores", TOP_LABELS, names)
            .withColumn("score", r9(F.col("score"))))


@register("top_label", SCORES_SQL + LABEL_ORDER_SQL + """
SELECT vec_id, guess AS label_idx, ord.names[guess + 1] AS label, round(list_max(scores), 9) AS score
FROM scored, ord
""")
def q_top_label(spark, sf_dir):
    s, names = _label_names(spark, sf_dir)
    g = lb.argmax("scores")
    return s.select("vec_id", g.alias("label_idx"), F.element_at(names, g + 1).alias("label"),
                    r9(F.array_max("scores")).alias("score"))


@register("label_distribution", SCORES_SQL + LABEL_ORDER_SQL + """
, probs AS (SELECT vec_id, list_transform(scores, lambda x: exp(x - list_max(scores))) AS e FROM sc)
SELECT vec_id, CAST(i - 1 AS INTEGER) AS label_idx, ord.names[i] AS label,
       round(e[i] / list_sum(e), 9) AS prob
FROM probs, ord, range(1, 11) t(i)
""")
def q_label_distribution(spark, sf_dir):
    s, names = _label_names(spark, sf_dir)
    d = s.select("vec_id", F.posexplode(F.arrays_zip(names.alias("label"), lb.softmax("scores").alias("prob"))))
    return d.select("vec_id", F.col("pos").cast("int").alias("label_idx"), F.col("col.label").alias("label"),
                    r9(F.col("col.prob")).alias("prob"))


@register("displayed_scores", SCORES_SQL + """
SELECT vec_id, guess AS label_idx, round_even(list_max(scores) / 3, 6) AS score,
       format('{:.2f}', list_max(scores) / 3) AS shown
FROM scored
""")
def q_displayed_scores(spark, sf_dir):
    """Best score of each vector as the views show it (a third of it, so that there are digits to round)."""
    best = F.array_max("scores") / 3
    return score_table(spark, sf_dir).select("vec_id", lb.argmax("scores").alias("label_idx"),
                                             lb.round_score(best).alias("score"), lb.display_metric(best).alias("shown"))


PHASE_SHARE = 0.7


@register("phase_report", SCORES_SQL + f"""
, keyed AS (SELECT *, row_number() OVER (ORDER BY {S.sample_key('vec_id')}) AS rk,
                  count(*) OVER () AS total FROM scored),
ph AS (SELECT *, CASE WHEN rk <= CAST(floor(CAST({PHASE_SHARE} AS DOUBLE) * total) AS BIGINT)
                      THEN 'train' ELSE 'validation' END AS phase FROM keyed)
SELECT phase, CAST(count(*) AS BIGINT) AS n, round(avg({CE_SQL}), 9) AS loss,
       round(avg(CASE WHEN guess = truth THEN 100.0 ELSE 0.0 END), 9) AS acc1
FROM ph GROUP BY phase
""")
def q_phase_report(spark, sf_dir):
    """Per-phase evaluation record (loss, Acc@1) of a score table split 70/30."""
    s = split_exact(M.scored_frame(score_table(spark, sf_dir)), PHASE_SHARE, "vec_id", side_col="phase")
    return s.groupBy("phase").agg(
        F.count(F.lit(1)).alias("n"),
        r9(M.mean_cross_entropy(s)).alias("loss"),
        r9(F.avg(F.when(F.col("guess") == F.col("truth"), 100.0).otherwise(0.0))).alias("acc1"))


def step_log(spark, sf_dir):
    ev = load_table(spark, sf_dir, "events")
    return ev.select(
        (F.dayofmonth("ts") - 1).cast("int").alias("epoch"),
        F.when(F.col("event_type") == "error", "validation").otherwise("train").alias("phase"),
        F.col("event_id").alias("batch"),
        (F.get_json_object("props", "$.k").cast("int") + 1).alias("n"),
        F.col("value").alias("loss"),
        F.when(F.col("event_type") == "purchase", 100.0).otherwise(0.0).alias("acc"),
        (F.col("value") / 1000.0).alias("seconds"))


STEPS_SQL = """
WITH steps AS (
  SELECT CAST(day(ts) - 1 AS INTEGER) AS epoch,
         CASE WHEN event_type = 'error' THEN 'validation' ELSE 'train' END AS phase,
         event_id AS batch,
         CAST(json_extract_string(props, '$.k') AS INTEGER) + 1 AS n,
         value AS loss,
         CASE WHEN event_type = 'purchase' THEN 100.0 ELSE 0.0 END AS acc,
         value / 1000.0 AS seconds
  FROM events)
"""


@register("phase_meters", STEPS_SQL + """
SELECT epoch, phase, CAST(count(*) AS BIGINT) AS batches, CAST(sum(n) AS BIGINT) AS samples,
       round(sum(loss * n) / sum(n), 9) AS loss, round(sum(acc * n) / sum(n), 9) AS accuracy,
       round(avg(seconds), 9) AS batch_time
FROM steps GROUP BY epoch, phase
""")
def q_phase_meters(spark, sf_dir):
    m = M.phase_meters(step_log(spark, sf_dir))
    return m.select("epoch", "phase", "batches", "samples", *[r9(F.col(c)).alias(c)
                                                              for c in ("loss", "accuracy", "batch_time")])


@register("running_meters", STEPS_SQL + f"""
, run AS (SELECT epoch, phase, batch,
                 sum(loss * n) OVER w / sum(n) OVER w AS avg_loss,
                 sum(acc * n) OVER w / sum(n) OVER w AS avg_accuracy
          FROM steps
          WINDOW w AS (PARTITION BY epoch, phase ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT epoch, phase, batch, round(avg_loss, 9) AS avg_loss, round(avg_accuracy, 9) AS avg_accuracy
FROM run WHERE batch % {RUNNING_EVERY} = 0
""")
def q_running_meters(spark, sf_dir):
    r = M.running_meters(step_log(spark, sf_dir), RUNNING_EVERY)
    return r.select("epoch", "phase", "batch", r9(F.col("avg_loss")).alias("avg_loss"),
                    r9(F.col("avg_accuracy")).alias("avg_accuracy"))


@register("loss_windows", """
SELECT CAST(floor(event_id / 200) AS BIGINT) AS window_id, CAST(count(*) AS BIGINT) AS steps,
       round(sum(value), 9) AS loss_sum
FROM events GROUP BY 1
""")
def q_loss_windows(spark, sf_dir):
    ev = load_table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.col("value").alias("loss"))
    w = M.loss_windows(ev)
    return w.select("window_id", "steps", r9(F.col("loss_sum")).alias("loss_sum"))
