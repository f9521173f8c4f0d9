import json

import numpy as np
from pyspark.sql import functions as F

from pressline.llm import ann, chat, quality
from tests.llm.conftest import prose, rows_of

NEAREST = "query_id", "rank", "vec_id", "score"


def brute_nearest(rows, k, is_query):
    """Every usable row is a candidate for every query row but itself."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, (qi, qv) in enumerate(good):
        if is_query(qi):
            scored = sorted((-sum(a * b for a, b in zip(qv.tolist(), x.tolist(), strict=True)), i) for c, (i, x) in enumerate(good) if c != q)
            out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_nearest_with_edges(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(60)]
    rows += [(60 + i, rows[20][1]) for i in range(30)]                       # ties
    rows += [(200, None), (220, [0.0] * 6), (240, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (260, [float("nan")] * 6), (280, [float("inf")] + [1.0] * 5), (None, rows[0][1]), (300, []), (20, rows[20][1])]
    frame = spark.createDataFrame([(i, v, "x", 1, 1) for i, v in rows], "vec_id long, embedding array<float>, part string, i int, block int")
    got = ann.search(frame, lambda i: i % 20 == 0, k=20)
    assert sorted((q, r, v) for q, r, v, _ in rows_of(got, *NEAREST)) == [(q, r, v) for q, r, v, _ in brute_nearest(rows, 20, lambda i: i % 20 == 0)]
    assert ann.search(frame.limit(0), lambda i: i % 20 == 0).collect() == []
    few = ann.search(frame.where("vec_id < 5"), lambda i: i == 0)
    assert few.count() == 4


def test_recall_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 100)
    monkeypatch.setattr(ann, "QUERY_ROWS", 20)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32))
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 50 == 0, least=200).collect()
    want = {(q, v) for q, _, v, _ in brute_nearest(rows, 20, lambda i: i % 50 == 0)}
    assert len(got) == len(want) == 60 * 20
    assert len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want)


def test_neighbours_with_differing_norms(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 100)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 16))
    x *= rng.lognormal(sigma=1.0, size=(2000, 1)) / np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = [(q, r, v) for q, r, v, _ in brute_nearest([(i, v.tolist()) for i, v in enumerate(x)], 20, lambda i: i % 50 == 0)]
    for share in (0.5, 0.0):                             # whatever the first visits leave out, the bound brings
        got = ann.search(frame, lambda i: i % 50 == 0, centroids=16, share=share, least=100)
        assert sorted((q, r, v) for q, r, v, _ in rows_of(got, *NEAREST)) == want


def test_traverse_visits_in_order():
    books = np.array([[0.0], [1.0], [5.0]]), np.array([[0.0], [2.0]])
    held = {(0, 0): 1, (1, 0): 2, (0, 1): 1, (2, 1): 9}
    assert ann.traverse(np.array([0.1, 0.1]), books, held, 3) == {0: [0], 1: [0]}
    assert ann.traverse(np.array([0.1, 0.1]), books, held, 99) == {0: [0, 1], 1: [0], 2: [1]}


CALL = "conv_id long, turn long, call_id string, after string, tool string, arguments map<string,string>, status string"
RESULT = "call_id string, conv_id long, turn long, content string"


def test_link_calls(spark):
    ok = {"chars": "3", "words": "1", "prompt": '"abc"'}
    calls = [(1, 0, "a", None, "reply", ok), (1, 2, "b", "a", "reply", ok), (1, 4, "c", "b", "reply", ok), (2, 0, "d", "e", "reply", ok), (2, 1, "e", "d", "reply", ok),
             (3, 0, "f", "gone", "reply", {**ok, "chars": '"3"'}), (3, 1, "g", None, "other", ok), (3, 2, "h", None, "reply", ok), (3, 3, None, None, "reply", ok),
             (4, 0, "a", None, "reply", ok), (5, 0, "i", "d", "reply", None), (6, 0, "j", None, "reply", {**ok, "more": "1"}), (6, 1, "k", "d", "reply", ok)]
    results = [("a", 1, 1, 'say "hi"\né'), ("a", 1, 3, "later"), ("b", 1, 3, None), ("c", 1, 5, "x"), ("d", 2, 3, "x"), ("e", 2, 3, "x"), (None, 1, 1, "x"), ("zz", 1, 1, "x"), ("k", 6, 2, "x")]
    frame = spark.createDataFrame([(*c, "x") for c in calls], CALL)
    got = {(r.conv_id, r.turn): r for r in chat.link_calls(frame, spark.createDataFrame(results, RESULT)).collect()}
    status = {k: r.status for k, r in got.items()}
    assert status == {(1, 0): "ok", (1, 2): "ok", (1, 4): "ok", (2, 0): "cycle", (2, 1): "cycle", (3, 0): "invalid", (3, 1): "unknown_tool", (3, 2): "unanswered",
                      (3, 3): "unlinked", (4, 0): "duplicate", (5, 0): "invalid", (6, 0): "invalid", (6, 1): "cycle"}
    assert [got[1, t].depth for t in (0, 2, 4)] == [0, 1, 2]
    for r in got.values():
        read = json.loads(r.call_json)
        assert r.call_json == json.dumps(read, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(got[1, 0].call_json)["result"] == 'say "hi"\né'
    assert chat.link_calls(frame.limit(0), spark.createDataFrame([], RESULT)).collect() == []


def test_long_conversation(spark):
    talk = spark.createDataFrame([(1, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(1300)] + [(1, None, "user", "x"), (None, 1, "user", "x"), (2, 0, "assistant", "x"), (3, 0, "user", None)],
                                 "conv_id long, turn long, role string, text string")
    got = chat.link_calls(*chat.conversation_calls(talk)).orderBy("conv_id", "turn").collect()
    assert [r.depth for r in got] == [*range(650), 0]
    assert [r.status for r in got] == ["ok"] * 650 + ["invalid"]
    assert json.loads(got[400].call_json)["result"] == "t801"


def test_quality(spark, edge_docs, clashing, no_docs):
    rows, labels = [], []
    for i in range(300):
        kind = i % 3
        text = prose(i, 60) if kind == 0 else " ".join(["spam"] * 60) if kind == 1 else prose(i, 50) + " vile awful " + prose(i + 1, 9)
        rows.append((i, text, "en", f"s{i % 4}"))
        if i < 200:
            labels.append((i, int(kind != 1), int(kind == 2)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.row.doc_id: r for r in quality.judge(docs, marks).collect()}
    held = [i for i in got if i >= 200]
    assert sum(got[i].keep == (i % 3 == 0) for i in held) >= 0.97 * len(held)
    kept = quality.keep_good(docs, marks)
    assert kept.columns == docs.columns
    assert quality.keep_good(docs, marks.limit(0)).count() == len(rows)       # nothing learned, nothing rejected
    assert quality.judge(clashing, marks).count() == clashing.count()
    assert quality.keep_good(clashing, marks).columns == clashing.columns
    assert quality.judge(no_docs, marks).collect() == []


def test_sparse_sites_shrink(spark):
    rows = [("big", "en", 1.0)] * 60 + [("big", "en", 0.0)] * 40 + [("small", "en", 1.0)] + [(f"h{k}", "en", 0.0) for k in range(40)] + [(None, None, 0.0)] * 10
    got = {(r.host, r.path): r for r in quality.site_rates(spark.createDataFrame(rows, "host string, path string, bad double")).collect()}
    base = got["big", "en"].base_rate
    assert abs(got["big", "en"].path_rate - 0.6) < 0.1
    assert base < got["small", "en"].path_rate < 0.999 and got[None, None].path_rate < base
    assert F is not None
