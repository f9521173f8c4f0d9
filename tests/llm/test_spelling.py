"""Spelling variant grouping against a plain comparison of all words."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pressline.llm import spelling
from tests.llm.conftest import DOC_SCHEMA, rows_of

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = {c: c + 32 for c in range(65, 91)}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows):
    n = Counter()
    for d, t in rows:
        for run in RUN.findall(t or ""):
            w = run.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 7:
                n[w] += 1
    n = {w: c for w, c in n.items() if c >= 2}
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 10 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=repr)


def variants(seed=3):
    """Words with chains of forms, replaced, dropped and added letters, ties, anagrams, accents, one very long word."""
    rng = np.random.default_rng(seed)
    abc = list("abcdeéüß÷")
    texts = []
    for k in range(40):
        base = "".join(rng.choice(abc, rng.integers(7, 14)))
        forms = [(base, 300)]
        for times in (30, 25, 3, 2, 2):
            w, _ = forms[rng.integers(len(forms))]
            at = int(rng.integers(len(w)))
            c = str(rng.choice(abc))
            forms.append((rng.choice([w[:at] + c + w[at + 1:], w[:at] + w[at + 1:], w[:at] + c + w[at:]]), times))
        texts.append(" ".join(str(w) for w, times in forms for _ in range(times)))
    texts += ["abcdabcd dcbadcba Abcdabcd ABCDABCD dcbadcba " * 20, ("é" * 4000 + " ") * 2 + ("é" * 3999 + " ") * 2, "tie-words: aaaaaaab aaaaaaab aaaaaaac aaaaaaac aaaaaaad aaaaaaad"]
    return [(k, t, "en", "s") for k, t in enumerate(texts)]


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


@pytest.mark.parametrize("bounds", [{}, {"cell": 8, "members": 5, "queries": 7, "sample": 50}])
def test_groups_equal_plain_comparison(spark, bounds):
    rows = variants()
    expect = plain([r[:2] for r in rows])
    assert sum(r[1] is not None for r in expect) > 20 and any(r[2] != r[1] for r in expect if r[1])
    assert rows_of(spelling.group_variants(spark.createDataFrame(rows, DOC_SCHEMA), **bounds).select(*COLUMNS)) == expect


def test_edge_rows(spark, edge_rows, edge_docs, clashing, no_docs):
    rows = [*edge_rows, *[(None, "Wörterbuch wörterbuch WÖRTERBUCH wörterbuch", None, None)] * 3]
    expect = plain([r[:2] for r in rows])
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    assert rows_of(spelling.group_variants(docs.selectExpr("*", "doc_id AS code", "doc_id AS n", "'x' AS unit")).select(*COLUMNS)) == expect
    assert spelling.group_variants(no_docs).count() == 0


def test_box_search_loses_no_neighbour():
    """Every pair within the box is in a leaf that the search returns; what remains of the steps is never negative."""
    rng = np.random.default_rng(1)
    codes = rng.choice(np.frombuffer(b"abcde", np.uint8), (600, 8))
    codes = np.unique(codes, axis=0)
    counts = spelling.vectors(codes)
    tree = spelling.Tree(counts, 4)
    q, leaf, up, down = tree.search(counts, np.ones(len(codes), np.int64), np.ones(len(codes), np.int64))
    assert min(up.min(), down.min()) >= 0
    got = {(int(a), int(m)) for a, b in zip(q, leaf, strict=True) for m in tree.order[tree.begin[b]:tree.begin[b + 1]]}
    for a in range(len(codes)):
        for b in np.flatnonzero(np.abs(counts.astype(int) - counts[a].astype(int)).sum(axis=1) <= 2):
            assert (a, int(b)) in got


def test_one_inserted():
    rng = np.random.default_rng(4)
    short, long = rng.choice([97, 98], (3000, 5)).astype(np.uint8), rng.choice([97, 98], (3000, 6)).astype(np.uint8)
    assert spelling.one_inserted(short, long).tolist() == [one_edit(bytes(a), bytes(b)) for a, b in zip(short, long, strict=True)]


def test_found_keeps_first_of_ties():
    f = spelling.Found(2)
    f.add(np.array([0, 0, 1]), np.array([5, 5, 1]), pa.array([b"b", b"a", b"z"]))
    f.add(np.array([0, 1]), np.array([5, 3]), pa.array([b"c", b"y"]))
    assert (f.count.tolist(), f.n.tolist(), f.best.tolist()) == ([3, 2], [5, 3], [b"a", b"y"])
