"""Text classifiers as ``pyspark.ml`` pipelines, evaluated with the metric
operators.

The original network is replaced by a distributed bag-of-words model
(regex tokens -> hashed term frequencies -> IDF -> multinomial logistic
regression). The interface is kept: sorted label order, a probability
distribution per document, top label and score, a per-phase history record
(loss, Acc@1, confusion metrics), and a saved model plus run record.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StringIndexer, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressline import constants as C
from pressline.functions import labels as lb
from pressline.functions import text as tx
from pressline.operators import metrics as M
from pressline.operators.encode import FAST_TOKEN_PATTERN
from pressline.operators.layout import extract_any_layout
from pressline.operators.sampling import split_exact
from pressline.plans.stage import stage
from pressline.plans.training_set import sentiment_training_set, topic_training_set
from pressline.sources import runs

NUM_FEATURES = 1 << 18


def classifier_pipeline(text_col: str = "training_content", label_col: str = "label",
                        max_iter: int = 10, reg_param: float = 0.0,
                        num_features: int = NUM_FEATURES, index=None) -> Pipeline:
    """``index`` is a fitted label indexer; without one the labels of the fitted rows are taken.
    Tokens are hashed to ``num_features`` slots (the model's width, so its coefficients are
    ``num_features`` x labels)."""
    tokens = RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=FAST_TOKEN_PATTERN,
                            gaps=False, toLowercase=False)
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features)
    idf = IDF(inputCol="_tf", outputCol="features")
    if index is None:
        index = label_indexer(label_col)
    lr = LogisticRegression(featuresCol="features", labelCol="label_idx", family="multinomial",
                            maxIter=max_iter, regParam=reg_param)
    return Pipeline(stages=[tokens, tf, idf, index, lr])


def label_indexer(label_col: str = "label") -> StringIndexer:
    return StringIndexer(inputCol=label_col, outputCol="label_idx", stringOrderType="alphabetAsc")


def label_order(model: PipelineModel) -> list[str]:
    return list(next(s for s in model.stages if isinstance(s, StringIndexerModel)).labels)


def score(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """Adds ``scores`` (probabilities in label order), ``guess``, ``label_name``
    and ``score`` (top probability)."""
    names = F.array(*[F.lit(x) for x in label_order(model)])
    out = model.transform(df).select(*keep, vector_to_array("probability").alias("scores"))
    g = lb.argmax("scores")
    return out.select("*", g.alias("guess"), F.element_at(names, g + 1).alias("label_name"),
                      F.array_max("scores").alias("score"))


def distribution(scored: DataFrame, model: PipelineModel, key: str) -> DataFrame:
    """Long form ``(key, label_idx, label, prob)``."""
    names = F.array(*[F.lit(x) for x in label_order(model)])
    z = scored.select(key, F.posexplode(F.arrays_zip(names.alias("label"), F.col("scores").alias("prob"))))
    return z.select(key, F.col("pos").alias("label_idx"), F.col("col.label").alias("label"),
                    F.col("col.prob").alias("prob"))


@dataclass
class TrainResult:
    model: PipelineModel
    labels: list[str]
    predictions: DataFrame      # both phases, with ``phase``, ``truth``, ``guess``, ``scores``
    history: DataFrame          # per phase: n, loss, acc1 and the metric report


def evaluate(pred: DataFrame, n_labels: int) -> DataFrame:
    """Per phase: rows, mean cross-entropy of the scores, Acc@1, and the report
    metrics as columns."""
    base = pred.groupBy("phase").agg(
        F.count(F.lit(1)).alias("n"),
        M.mean_cross_entropy(pred).alias("loss"),
        F.avg(F.when(F.col("guess") == F.col("truth"), 100.0).otherwise(0.0)).alias("acc1"))
    reports = []
    for phase in ("train", "validation"):
        m = M.confusion_matrix(pred.where(F.col("phase") == phase), n_labels)
        reports.append(M.report(m, n_labels).withColumn("phase", F.lit(phase)))
    names = M.report_names(n_labels)
    rep = reports[0].unionByName(reports[1]).groupBy("phase").pivot("metric", names).agg(F.first("value"))
    return base.join(rep, "phase", "left")


def history_record(history: DataFrame, pred: DataFrame, n_labels: int, seconds: float) -> DataFrame:
    """The record a training job leaves, one row per phase: ``loss``, ``accuracy`` and ``time`` as
    lists with one entry per epoch (the fit is one epoch), and the confusion matrix as rows of counts."""
    cells = []
    for phase in ("train", "validation"):
        m = M.confusion_matrix(pred.where(F.col("phase") == phase), n_labels)
        cells.append(m.withColumn("phase", F.lit(phase)))
    rows = (cells[0].unionByName(cells[1]).groupBy("phase", "truth")       # labels x labels cells
            .agg(F.transform(F.sort_array(F.collect_list(F.struct("guess", "n"))), lambda c: c["n"]).alias("row")))
    matrix = rows.groupBy("phase").agg(F.transform(F.sort_array(F.collect_list(F.struct("truth", "row"))),
                                                   lambda r: r["row"]).alias("confusion_matrix"))
    lists = history.select("phase", F.array("loss").alias("loss"), F.array("acc1").alias("accuracy"),
                           F.array(F.lit(float(seconds))).alias("time"))
    return lists.join(matrix, "phase")


def _fit_partitions(df: DataFrame) -> DataFrame:
    """At most one partition per task slot for the iterative fit.

    Every optimizer iteration aggregates one dense gradient (features x labels)
    per partition, so the traffic per iteration follows the partition count.
    Coalescing (no shuffle) to the cluster's parallelism bounds it by the
    cluster size instead of the data size; each task then reads its rows
    blockwise from the persisted split.
    """
    try:
        slots = df.sparkSession.sparkContext.defaultParallelism
        return df.coalesce(slots) if df.rdd.getNumPartitions() > slots else df
    except Exception:  # noqa: BLE001 - Spark Connect: keep the server's layout
        return df


def fit_and_score(rows: DataFrame, id_col: str, text_col: str, max_iter: int) -> TrainResult:
    """``rows`` (id, text, ``label``, ``phase``) -> model of the train rows, predictions of all rows,
    history. The label order comes from all rows, so a label may lie in one phase only. Rows without
    a label can't be trained on or judged and raise in the indexer."""
    tokens, tf, idf, index, lr = classifier_pipeline(text_col, "label", max_iter).getStages()
    # the fit reads its rows in several passes and the scoring once more: texts are tokenised and
    # hashed once, here, and every later pass reads the hashed frequencies
    rows = stage(tf.transform(tokens.transform(rows)).select(id_col, "phase", "label", tf.getOutputCol()),
                 "classifier-rows")
    index = index.fit(rows.select("label"))
    train = rows.where(F.col("phase") == "train")
    fitted = Pipeline(stages=[idf, index, lr]).fit(_fit_partitions(train))
    model = PipelineModel([tokens, tf, *fitted.stages])
    labels = label_order(model)
    pred = score(fitted, rows, [id_col, "phase", "label", "label_idx"])
    # the history reads the predictions several times: score once into the
    # shared folder instead of re-running the model
    pred = stage(pred.withColumn("truth", F.col("label_idx").cast("int")), "predictions")
    return TrainResult(model, labels, pred, evaluate(pred, len(labels)))


def _rows_of(df: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    return df.select(id_col, text_col, F.col(label_col).cast("string").alias("label"))


def train_classifier(training_set: DataFrame, label_col: str = "source_id",
                     text_col: str = "training_content", id_col: str = "doc_id",
                     train_share: float = C.DEFAULT_TRAIN_SHARE, max_iter: int = 10,
                     seed: str = C.DEFAULT_SEED) -> TrainResult:
    """One table: exact seeded split -> fit on the train side -> score both sides -> history."""
    data = _rows_of(training_set, id_col, text_col, label_col)
    return fit_and_score(split_exact(data, train_share, id_col, seed, side_col="phase"), id_col, text_col, max_iter)


def train_with_test_set(train: DataFrame, test: DataFrame, label_col: str = "label",
                        text_col: str = "training_content", id_col: str = "doc_id",
                        max_iter: int = 10) -> TrainResult:
    """Separate train and test tables (the topic and sentiment corpora come so); the test rows are
    the validation phase."""
    both = (_rows_of(train, id_col, text_col, label_col).withColumn("phase", F.lit("train"))
            .unionByName(_rows_of(test, id_col, text_col, label_col).withColumn("phase", F.lit("validation"))))
    return fit_and_score(both, id_col, text_col, max_iter)


def topic_classifier(train: DataFrame, test: DataFrame, min_words: int = 0, max_words: int = C.DEFAULT_MAX_WORDS,
                     num_samples: int | None = None, max_iter: int = 10, id_col: str = "doc_id") -> TrainResult:
    """Topic rows ``(id, label, headline, text)`` -> headline/body markup -> topic model."""
    sets = [topic_training_set(d, min_words, max_words, num_samples, id_col=id_col) for d in (train, test)]
    return train_with_test_set(*sets, id_col=id_col, max_iter=max_iter)


def sentiment_classifier(train: DataFrame, test: DataFrame, min_words: int = 0, max_words: int = C.DEFAULT_MAX_WORDS,
                         num_samples: int | None = None, max_iter: int = 10, id_col: str = "doc_id") -> TrainResult:
    """Labelled texts ``(id, text, label)`` -> body-only markup -> sentiment model."""
    sets = [sentiment_training_set(d, min_words, max_words, num_samples, id_col=id_col) for d in (train, test)]
    return train_with_test_set(*sets, id_col=id_col, max_iter=max_iter)


def training_job(training_set: DataFrame, out_dir: str, run_id: str, label_col: str = "source_id",
                 id_col: str = "doc_id", text_col: str = "training_content",
                 train_share: float = C.DEFAULT_TRAIN_SHARE, max_iter: int = 10, note: str | None = None) -> TrainResult:
    """Train, then leave a run record (``runs``), the history record (``history/<run>``) and the
    model (``models/<run>``) under ``out_dir``."""
    spark = training_set.sparkSession
    started = time.monotonic()
    result = train_classifier(training_set, label_col, text_col, id_col, train_share, max_iter)
    seconds = time.monotonic() - started
    samples = result.predictions.count()
    runs.append_run(runs.run_record(spark, run_id, 0, max_iter, 0.0, 0, samples, result.labels, note), f"{out_dir}/runs")
    record = history_record(result.history, result.predictions, len(result.labels), seconds)
    runs.write_history(record, f"{out_dir}/history/{run_id}")
    save_model(result.model, f"{out_dir}/models/{run_id}")
    return result


def classify_pages(model: PipelineModel, pages: DataFrame, remove_paragraphs: int = 0) -> DataFrame:
    """Page -> extracted (title, text) -> headline/body markup (paragraph removal,
    0 = keep all) -> one scoring pass -> top label, score and distribution.
    Pages that fail extraction yield a row with ``error`` and no label."""
    r = None if remove_paragraphs == 0 else remove_paragraphs
    ex = extract_any_layout(pages.select("page_id", "html")).drop("html")
    # one pass: failed pages are scored on empty text and their outputs blanked
    marked = ex.withColumn("training_content", F.when(F.col("error"), F.lit(""))
                           .otherwise(tx.format_headline_body("content_text", "title", r)))
    scored = score(model, marked, ["page_id", "title", "error"])
    ok = ~F.col("error")
    return scored.select("page_id", "title",
                         F.when(ok, F.col("label_name")).alias("label"),
                         F.when(ok, F.col("score")).alias("score"),
                         F.when(ok, F.col("scores")).alias("scores"),
                         "error")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
