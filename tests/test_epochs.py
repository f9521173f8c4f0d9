"""Training in passes: against plain numpy, stopped and resumed, records per pass."""

import json
import os
import tempfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressline.operators import metrics as M
from pressline.operators.sampling import shuffle_batches
from pressline.plans import epochs as ep

ARGS = dict(epochs=3, batch_size=60, lr=1.5, warmup=4, num_features=512)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    data = []
    for i in range(200):
        k = i % 3
        text = " ".join(rng.choice(words[k * 15:k * 15 + 30], rng.integers(0 if i == 7 else 1, 40)))
        data.append((i if i % 50 else None, text if i != 9 else None, f"l{k}", "train" if i % 4 else "validation"))
    data += data[:3]
    return spark.createDataFrame(data, "doc_id int, training_content string, label string, phase string").cache()


@pytest.fixture(scope="module")
def trained(rows):
    folder = tempfile.mkdtemp(prefix="pl-epochs-")
    return folder, ep.train_epochs(rows, folder, **ARGS)


def plain(spark, rows):
    """The same passes in numpy over dense rows."""
    width, labels = ARGS["num_features"], ["l0", "l1", "l2"]
    keyed = ep.bags(rows, "training_content", width).select("phase", "bag", "label", F.xxhash64("doc_id", "label", "bag").alias("_key"))

    def dense(found):
        x = np.zeros((len(found), width))
        for i, r in enumerate(found):
            np.add.at(x[i], np.array(r.bag, int), 1.0)
        return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300), np.array([labels.index(r.label) for r in found])

    def forward(x):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def judge(p, y):
        return -np.log(p[np.arange(len(y)), y]).sum(), (p.argmax(axis=1) == y).sum()
    w, b, out = np.zeros((width, 3)), np.zeros(3), []
    train = keyed.where("phase = 'train'")
    vx, vy = dense(keyed.where("phase = 'validation'").collect())
    step = 0
    for epoch in range(ARGS["epochs"]):
        found = shuffle_batches(train, ARGS["batch_size"], 1, "_key", f"{ep.C.DEFAULT_SEED}-{epoch}").collect()
        loss = hits = n = 0
        for k in range(max(r.batch_id for r in found) + 1):
            x, y = dense([r for r in found if r.batch_id == k])
            p = forward(x)
            a, c = judge(p, y)
            loss, hits, n, step = loss + a, hits + c, n + len(y), step + 1
            p[np.arange(len(y)), y] -= 1
            rate = ARGS["lr"] * min(1, step / ARGS["warmup"]) / len(y)
            w -= rate * x.T @ p
            b -= rate * p.sum(axis=0)
        a, c = judge(forward(vx), vy)
        out += [(epoch, "train", n, loss / n, 100 * hits / n), (epoch, "validation", len(vy), a / len(vy), 100 * c / len(vy))]
    return w, b, out


def test_equals_numpy_passes(spark, rows, trained):
    w, b, expect = plain(spark, rows)
    model = trained[1].model
    assert np.allclose(model.weights, w[model.slots], atol=1e-7) and np.allclose(model.bias, b, atol=1e-7)
    got = sorted((r.epoch, r.phase, r.n, r.loss, r.acc1) for r in trained[1].history.collect())
    for g, e in zip(got, expect, strict=True):
        assert g[:3] == e[:3] and g[3:] == pytest.approx(e[3:], abs=1e-7)
    assert got[-2][3] < got[0][3]                                       # it learns


def test_stopped_and_resumed_gives_the_same(spark, rows, trained):
    folder = tempfile.mkdtemp(prefix="pl-epochs-")
    ep.train_epochs(rows.repartition(5), folder, **ARGS, stop_after=2)
    os.remove(f"{folder}/records/epoch=1/_SUCCESS")                       # as if lost while writing the second pass
    again = ep.train_epochs(rows.repartition(3), folder, **ARGS)
    assert np.array_equal(again.model.weights, trained[1].model.weights) and np.array_equal(again.model.bias, trained[1].model.bias)
    same = lambda h: sorted(map(tuple, h.drop("seconds").collect()))
    assert same(again.history) == same(trained[1].history)
    assert np.array_equal(ep.load_softmax(spark, folder, 2, again.model.labels, 512).weights, again.model.weights)


def test_reports_equal_the_metric_operators(spark, rows, trained):
    model, history = trained[1].model, trained[1].history
    judged = ep.score(model, rows.where("phase = 'validation'"), "training_content", ["label"])
    truth = F.array_position(F.array(*[F.lit(x) for x in model.labels]), F.col("label")) - 1
    matrix = M.confusion_matrix(judged.withColumn("truth", truth.cast("int")), 3)
    expect = {r.metric: r.value for r in M.report(matrix, 3).collect()}
    last = ep.epoch_reports(history, 3).where("epoch = 2 AND phase = 'validation'").first().asDict()
    assert {k: last[k] for k in expect} == pytest.approx(expect)
    assert all(abs(sum(r.scores) - 1) < 1e-9 for r in judged.collect())


def test_job_leaves_lists_of_equal_length(spark, rows):
    out = tempfile.mkdtemp(prefix="pl-epochs-")
    ep.epoch_training_job(rows, out, "r1", 2, 100, num_features=256)
    lines = [json.loads(x) for f in Path(out, "history/r1").glob("*.json") for x in f.read_text().splitlines()]
    assert sorted(x["phase"] for x in lines) == ["train", "validation"]
    for x in lines:
        assert {len(x[c]) for c in ("loss", "accuracy", "batch_time", "confusion_matrix", "classification_metrics")} == {2}
    run = json.loads("".join(f.read_text() for f in Path(out, "runs").glob("*.json")))          # one row, beside empty part files
    assert (run["epochs"], run["batch_size"], run["column_split_order"]) == (2, 100, ["l0", "l1", "l2"])


def test_rows_without_label_raise_and_no_rows_judge(spark, rows, tmp_path):
    with pytest.raises(ValueError, match="label"):
        ep.train_epochs(rows.withColumn("label", F.when(F.col("doc_id") > 3, F.col("label"))), str(tmp_path / "a"), 1, 10)
    only = ep.train_epochs(rows.where("phase = 'train'"), str(tmp_path / "b"), 1, 1000, num_features=64)
    got = {r.phase: (r.n, r.loss) for r in only.history.collect()}
    assert got["validation"] == (0, None) and got["train"][0] > 0
