import random

import numpy as np
from pyspark.sql import functions as F

from pressline.llm import jaccard
from pressline.llm.components import components
from pressline.llm.shingles import shingle_sets
from tests.llm.conftest import rows_of


def brute(rows):
    return sorted(jaccard.brute_force([(r[0], None if r[1] is None else r[1].encode()) for r in rows]), key=repr)


def test_edges_against_brute_force(spark, edge_rows, edge_docs, clashing, no_docs):
    want = brute(edge_rows)
    assert rows_of(jaccard.jaccard_components(edge_docs)) == want
    assert rows_of(jaccard.jaccard_components(clashing)) == want
    assert rows_of(jaccard.jaccard_components(no_docs)) == []


def test_near_copies_in_several_blocks(spark, monkeypatch):
    """Variants of one text around the threshold, more than a unit's block holds, and a shared passage."""
    rng = random.Random(4)
    base = [f"b{k}" for k in range(60)]
    passage = [f"p{k}" for k in range(25)]
    rows = []
    for i in range(90):
        text = list(base)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(60)] = f"e{rng.randrange(30)}"
        rows.append((i, " ".join(text), "en", "a"))
    for i in range(100, 130):
        rows.append((i, " ".join([f"u{i}x{k}" for k in range(rng.randint(3, 40))] + passage), "en", "a"))
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    got = rows_of(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    assert got == brute(rows)
    assert len({r[2] for r in got}) > 35


def test_shingle_sets_do_not_depend_on_neighbours():
    texts = [b"a b c d e f", b"", None, b"A  B\tC\nD E F", b"a b", b"x" * 9000]
    together = shingle_sets(texts)
    for t, s in zip(texts, together, strict=True):
        assert np.array_equal(shingle_sets([t])[0], s)
    assert [len(s) for s in together] == [2, 0, 0, 2, 1, 1]
    assert np.array_equal(together[0], together[3])


def test_components_of_a_long_chain(spark):
    edges = spark.range(0, 300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).union(spark.range(1000, 1003).select(F.lit(999), F.col("id")))
    got = {(r.node, r.root) for r in components(edges).collect()}
    assert got == {(k, 0) for k in range(1, 301)} | {(k, 999) for k in range(1000, 1003)}
