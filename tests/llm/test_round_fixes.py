"""Long structured words stay apart, items without id hit, neighbours are rows, long runs are read in linear time."""

import random
import re
import time

import numpy as np

from pressline.llm import ann, decontaminate, jaccard, pii
from pressline.llm.shingles import shingle_sets
from tests.llm.conftest import DOC_SCHEMA, prose, rows_of

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def test_structured_long_words_stay_apart(spark):
    bits = [bin(k).count("1") % 2 for k in range(1024)]
    one, other = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    docs = spark.createDataFrame([(1, one, "en", "a"), (2, other, "en", "a"), (3, one, "en", "a")], DOC_SCHEMA)
    assert rows_of(jaccard.jaccard_components(docs), "doc_id", "component_id") == [(1, 1), (2, 2), (3, 1)]
    a, b, c = shingle_sets([one.encode(), other.encode(), one.upper().encode()])
    assert a.tolist() == c.tolist() != b.tolist()


def test_items_without_id_are_hit(spark):
    docs = [(1, prose(9, 12)), (2, prose(9, 12) + " " + prose(4, 11)), (3, prose(2, 20))]
    items = [(None, prose(9, 12)), ("x", prose(4, 11))]
    frames = spark.createDataFrame([(*d, "en", "a") for d in docs], DOC_SCHEMA), spark.createDataFrame(items, "item_id string, text string")
    for size in (32 << 20, 60):
        got = rows_of(decontaminate.decontaminate(*frames, shard_bytes=size).drop("offsets"))
        assert got == sorted(decontaminate.brute_force([(i, t.encode()) for i, t in docs], [(i, t.encode()) for i, t in items]), key=repr)
        assert [(r[0], r[2] > 0, r[3], r[5]) for r in got] == [(1, True, 0, True), (2, True, 1, True), (3, False, 0, False)]


def test_neighbours_are_rows(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [0.6, 0.8])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = rows_of(ann.search(df, lambda i: i % 20 == 0), "query_id", "rank", "vec_id", "score")
    x = [np.array(np.array(v, np.float32), np.float64) for _, v in rows]
    want = []
    for q in (0, 1):
        near = sorted((-float(x[q] @ x[c]), rows[c][0], c) for c in range(5) if c != q)
        want += [(20, r + 1, v, -s) for r, (s, v, _) in enumerate(near)]
    assert [(a, b, c, round(d, 9)) for a, b, c, d in got] == sorted(((a, b, c, round(d, 9)) for a, b, c, d in want), key=repr)


def test_linear_patterns_equal_the_stated_ones():
    rng = random.Random(2)
    for _ in range(4000):
        t = "".join(rng.choice("a1.@-%é 2") for _ in range(rng.randrange(25)))
        assert [(a, b) for k, a, b in pii.email_spans(t)] == [m.span() for m in EMAIL.finditer(t)], t
        assert [m.span() for m in pii.PATTERNS["ip"].finditer(t)] == [m.span() for m in IP.finditer(t)], t
    for run in ("a" * 10**6, "9" * 10**6, "1." * 500_000, "+1 " * 333_333, "a@" * 500_000):
        began = time.monotonic()
        pii.base_spans("@" + run + "+")
        assert time.monotonic() - began < 4


def test_spans_are_counted(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co and 1.2.3.4", "en", "a"), (2, None, "en", "a")], DOC_SCHEMA)
    assert rows_of(pii.scan_personal(docs, pii.Field()), "doc_id", "n_email", "n_ip", "n_spans") == [(1, 1, 1, 2), (2, 0, 0, 0)]
