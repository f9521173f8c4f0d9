import math

import numpy as np
import pytest

from pressline.operators import metrics as M


def np_report(cm, beta=1.0):
    cm = np.asarray(cm, dtype=float)
    correct, total = np.trace(cm), cm.sum()
    rec = np.diag(cm) / (cm.sum(axis=1) + 1e-7)
    prec = np.diag(cm) / (cm.sum(axis=0) + 1e-7)
    out = {"acc": correct / total * 100 if total else None, "correct": correct, "total": total}
    if len(cm) == 2:
        p, r = prec[1], rec[1]
        names = ("precision", "recall", "f1")
    else:
        p, r = prec.mean(), rec.mean()
        names = ("mean_precision", "mean_recall", "macro_f1")
    b2 = beta * beta
    f = (b2 + 1) * p * r / (b2 * p + r) if (b2 * p + r) else None
    out.update({names[0]: p * 100, names[1]: r * 100, names[2]: None if f is None else f * 100})
    return out


def run_report(spark, pairs, n, beta=1.0):
    df = spark.createDataFrame(pairs or [], "truth int, guess int")
    m = M.confusion_matrix(df, n)
    return {r.metric: r.value for r in M.report(m, n, beta).collect()}, m


def dense(pairs, n):
    cm = np.zeros((n, n), dtype=int)
    for t, g in pairs:
        cm[t, g] += 1
    return cm


def close(a, b):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


CASES = [
    ([(0, 0), (1, 1), (2, 1), (2, 2), (0, 2)], 3),        # label 0 never guessed twice
    ([(0, 1), (0, 1), (1, 1)], 3),                          # label 2 never true nor guessed
    ([(1, 1), (0, 1), (1, 0), (0, 0), (1, 1)], 2),          # two labels
]


@pytest.mark.parametrize("pairs,n", CASES)
def test_report_matches_numpy(spark, pairs, n):
    got, m = run_report(spark, pairs, n)
    want = np_report(dense(pairs, n))
    assert set(got) == set(want)
    for k in want:
        assert close(got[k], want[k]), k
    cells = {(r.truth, r.guess): r.n for r in m.collect()}
    assert len(cells) == n * n
    assert cells == {(t, g): int(dense(pairs, n)[t, g]) for t in range(n) for g in range(n)}


def test_empty_matrix(spark):
    got, _ = run_report(spark, [], 3)
    assert got["acc"] is None and got["total"] == 0


def test_beta_zero_and_negative(spark):
    got, m = run_report(spark, CASES[0][0], 3, beta=0.0)
    want = np_report(dense(*CASES[0]), 0.0)
    assert close(got["macro_f1"], want["macro_f1"])
    with pytest.raises(ValueError):
        M.report(m, 3, beta=-1)


def test_dense_matrix(spark):
    pairs, n = CASES[0]
    df = spark.createDataFrame(pairs, "truth int, guess int")
    d = M.dense_matrix(M.confusion_matrix(df, n), n).orderBy("truth").collect()
    assert [[r[f"guess_{g}"] for g in range(n)] for r in d] == dense(pairs, n).tolist()


def test_topk_and_cross_entropy(spark):
    rows = [([0.1, 0.7, 0.2], 1), ([0.5, 0.3, 0.2], 2), ([0.3, 0.3, 0.4], 1)]
    df = spark.createDataFrame(rows, "scores array<double>, truth int")
    acc = {r.k: r.accuracy for r in M.topk_accuracy(df, [1, 2, 3]).collect()}
    # third row: index 2 scores higher and index 0 ties but comes first, so truth ranks 3rd
    assert acc == {1: pytest.approx(100 / 3), 2: pytest.approx(100 / 3), 3: pytest.approx(100.0)}
    ce = df.agg(M.mean_cross_entropy(df).alias("l")).collect()[0].l
    want = np.mean([np.log(np.exp(s).sum()) - s[t] for s, t in [(np.array(s), t) for s, t in rows]])
    assert ce == pytest.approx(want)


def test_meters(spark):
    steps = [(0, "train", b, n, float(b), 100.0 * (b % 2), 0.1) for b, n in zip(range(1, 7), [4, 4, 4, 4, 4, 2])]
    df = spark.createDataFrame(steps, "epoch int, phase string, batch int, n int, loss double, acc double, seconds double")
    ph = M.phase_meters(df).collect()[0]
    assert ph.samples == 22 and ph.batches == 6
    assert ph.loss == pytest.approx(sum(b * n for _, _, b, n, *_ in steps) / 22)
    run = {r.batch: r.avg_loss for r in M.running_meters(df, 2, bucket_rows=2).collect()}
    for k in (2, 4, 6):
        sub = [s for s in steps if s[2] <= k]
        assert run[k] == pytest.approx(sum(s[4] * s[3] for s in sub) / sum(s[3] for s in sub))


def test_labels_outside_the_matrix_fail(spark):
    import pytest
    from pyspark.errors import PySparkException
    for bad in ((0, 2), (None, 1), (-1, 0)):
        df = spark.createDataFrame([(0, 1), bad], "truth int, guess int")
        with pytest.raises(PySparkException, match="outside 0..1"):
            M.confusion_matrix(df, 2).collect()
