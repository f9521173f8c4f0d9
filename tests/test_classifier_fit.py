import random

from pyspark.sql import functions as F

from pressline.operators.encode import TOKEN_PATTERN
from pressline.plans import classify as cl


def test_texts_are_tokenised_once(spark, monkeypatch):
    """The passes of the fit and the scoring read hashed frequencies, not texts; the model itself still takes texts."""
    staged = {}

    def kept(df, name, real=cl.stage):
        staged[name] = out = real(df, name)
        return out

    monkeypatch.setattr(cl, "stage", kept)
    rows = [(i, "abc"[i % 3], f"{'abc'[i % 3]} word {i % 5}, <BODY> x{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, source_id string, training_content string")
    res = cl.train_classifier(df, "source_id", max_iter=5)
    assert "training_content" not in staged["classifier-rows"].columns
    assert staged["classifier-rows"].count() == 60
    got = {r.doc_id: r.scores for r in res.predictions.collect()}
    again = {r.doc_id: r.scores for r in cl.score(res.model, df, ["doc_id"]).collect()}
    assert got.keys() == again.keys() == {r[0] for r in rows}
    assert all(abs(a - b) < 1e-12 for k in got for a, b in zip(got[k], again[k], strict=True))


def test_fast_pattern_has_the_same_tokens(spark):
    assert cl.classifier_pipeline().getStages()[0].getPattern() == cl.FAST_TOKEN_PATTERN != TOKEN_PATTERN
    rnd = random.Random(3)
    points = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x10000), 0x10000, 0x1F600, 0x10FFFF]]
    pieces = ["<BODY>", "<BODY/>", "<", "/>", "<A_", "a9", "Z", "_", " ", "\n", "\u00a0", "\u0085", "\u3000", "\u200b", "\x1c", "\x7f", "\x00",
              "\u00e9", "\u0661", "\U0001f600", "<BODY", "<b>", "<_/>", "</BODY>"]
    texts = ["".join(points[a:a + 500]) for a in range(0, len(points), 500)]
    texts += [f"a{c}b {c}{c}" for c in points[:0x400]] + ["".join(rnd.choices(pieces, k=30)) for _ in range(2000)] + ["", " "]
    df = spark.createDataFrame([(t,) for t in texts], "training_content string")
    found = [F.regexp_extract_all("training_content", F.lit(p), F.lit(0)) for p in (TOKEN_PATTERN, cl.FAST_TOKEN_PATTERN)]
    n = df.select(F.size(found[0]).alias("n"), found[0].eqNullSafe(found[1]).alias("same")).agg(
        F.sum("n").alias("n"), F.count(F.when(~F.col("same"), 1)).alias("other")).first()
    assert n.n > 60_000 and n.other == 0
