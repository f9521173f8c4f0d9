"""Hybrid lexical search against a plain scoring of all documents."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from pressline.llm import search
from tests.llm.conftest import DOC_SCHEMA, prose, rows_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def plain(docs, items, k=10):
    """item_id, rank, doc_id, score by scoring every document."""
    bags = [(d, Counter(TERM.findall((t or "").translate(LOW)))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for *_, n in bags)
    df = Counter(w for _, b, _ in bags for w in b)
    out = []
    for item, text in items:
        asked = set(TERM.findall((text or "").translate(LOW)))
        scored = []
        for row, (d, b, n) in enumerate(bags):
            m = 10 + 90 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 8 * m)) for w in asked if w in b)
            if s > 0:
                scored.append((-s, d is None, d or 0, row, d))
        out += [(item, r + 1, x[-1], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


ITEMS = [("a", prose(1, 30)), ("b", "one two"), ("c", None), ("d", ""), ("e", "--- !"), ("f", prose(3, 400, 11)), ("a", "ÜNÏ ünï w3x"), (None, "W7X w8x"), ("g", "missing words only")]


@pytest.mark.parametrize("block_terms", [search.BLOCK_TERMS, 40])
def test_edge_rows_equal_plain_scoring(spark, edge_rows, edge_docs, clashing, block_terms):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    expect = plain([r[:2] for r in edge_rows], ITEMS)
    for docs in (edge_docs, clashing.withColumn("rank", edge_docs.doc_id).withColumn("item", edge_docs.doc_id)):
        assert rows_of(search.search(docs, items, block_terms=block_terms).select("id", "rank", "doc_id", "score")) == expect


def test_skipping_in_small_shards(spark, monkeypatch):
    """Many shards, short and long lists, ties: rows equal those of the plain scoring."""
    rng = np.random.default_rng(5)
    words = [f"t{i}" for i in range(300)]
    p = 1 / np.arange(1, 301) ** 1.1
    docs = [(int(i), " ".join(rng.choice(words, rng.integers(1, 60), p=p / p.sum())), "en", "s") for i in rng.permutation(3000)]
    items = [(f"q{k}", " ".join(rng.choice(words, 12))) for k in range(40)]
    monkeypatch.setattr(search, "SHARD_DOCS", 256)
    df = search.search(spark.createDataFrame(docs, DOC_SCHEMA).repartition(3), spark.createDataFrame(items, "item_id string, text string"))
    assert rows_of(df.select("id", "rank", "doc_id", "score")) == plain([r[:2] for r in docs], items)


def test_blocks_are_skipped():
    """Blocks whose bounds stay below the k-th best aren't scored, and nothing is lost."""
    rng = np.random.default_rng(2)
    size = 20_000
    rare = rng.choice(size, 200, replace=False)
    counts = [[0] + ([1] if i in set(rare.tolist()) else []) for i in range(size)]
    ids = np.array([t for c in counts for t in c], np.int32)
    starts = np.r_[0, np.cumsum([len(c) for c in counts])]
    tfs = rng.integers(1, 4, len(ids)).astype(np.int32)
    m = rng.integers(50, 200, size)
    shard = search.Shard(np.arange(size), np.arange(size), m, starts, ids, tfs, np.array([3, 5000]))
    best = search.Best(10)
    scored = []
    total = np.zeros(size, np.int64)
    np.add.at(total, shard.docs, shard.gain)
    add = best.add
    best.add = lambda s, d, r: (scored.append(len(s)), add(s, d, r))
    shard.search(np.array([0, 1]), best)
    assert best.scores.tolist() == sorted(total, reverse=True)[:10]
    assert sum(scored) < size // 10


def test_empty_tables(spark, no_docs, edge_docs):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert search.search(no_docs, items).count() == 0
    assert search.search(edge_docs, items.limit(0)).count() == 0
    assert search.search(edge_docs, items.where("item_id IN ('c', 'd')")).count() == 0
