"""The toxicity grammar: machines against plain rules, edge cases, held-out accuracy, labels kept out of scores."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressline.llm import toxicity as T
from tests.conftest import SF_CHECK
from tests.llm.conftest import DOC_SCHEMA, prose, rows_of


def plain_events(symbols):
    """The grammar said again as rules over positions of one clause."""
    events = {}
    for i, x in enumerate(symbols):
        if x in T.MATCHED:
            back = symbols[:i]
            events[i] = x + (T.NEGATED if "n" in back[-T.REACH_NEGATION:] else "") + (T.REPORTED if "r" in back or back.count("q") % 2 else "")
    for kinds in (tuple(m for m in T.MATCHED if m != "t"), ("t",)):
        target, waiting = None, None                                     # places of the last target, and of the hit that waits for one
        for i, x in enumerate(symbols):
            if x == "y":
                if waiting is not None and i - waiting <= T.REACH_TARGET:
                    events[i] = "y" + T.DIRECTED
                target, waiting = i, None
            elif x in kinds:
                near = target is not None and i - target <= T.REACH_TARGET
                events[i] += T.DIRECTED * near
                waiting = None if near else i
    return [events[i] for i in sorted(events)]


def test_composed_machine_equals_rules_and_chained_transducers():
    rng = np.random.default_rng(0)
    machine = T.grammar()
    chain = [T.negation(), T.reported_speech(), T.target("ip"), T.target("t")]
    inner = [s for s in T.SYMBOLS if s != T.END]
    for _ in range(3000):
        clause = [str(s) for s in rng.choice(inner, rng.integers(0, 12))]
        word, states = [], [t.start for t in chain]
        for x in (*clause, T.END):
            for k, t in enumerate(chain):
                states[k], x = t.step(states[k], x)
            word.append(x)
        expect = [x for x in word if x[0] in "ipt" or x == "y" + T.DIRECTED]
        assert machine.events(clause) == expect
        assert expect == plain_events(clause)


@pytest.mark.parametrize("text,events", [
    ("You are an idiot", ["p>"]), ("Idiots like you.", ["p", "y>"]), ("He is not an idiot", ["p~>"]), ('She wrote that the man was a moron', ["p\""]),
    ("I will kill you", ["t", "y>"]), ("the word \"moron\" is old", ["p\""]), ("a calm day", []), ("not bad. scum", ["p"]), ("you. scum", ["p"])])
def test_clauses_in_context(text, events):
    found = list(T.clauses(text.encode(), T.Lexicon({}), T.grammar()))
    assert [e for *_, es in found for e in es] == events
    for a, b, _ in found:
        assert text.encode()[a:b].decode() in text


def test_context_changes_a_clause_score():
    m = T.Model({}, T.FIXED_PARTS, T.FIXED_FINAL)

    def p(text):
        found, words, n = m.read(text.encode())
        return float(m.score(np.array([T.summary(T.rows_of_parts(found), words, n, m.weight)]))[0])
    assert p("you idiot") > p("the idiot") > p("not an idiot") > p("a calm day")
    assert p("you idiot") > p("she said you idiot")


def test_learned_terms_win_and_stems_match():
    words = T.Lexicon({b"grumbo": 6.0, b"blarg-": 4.0, b"idiot-": 2.5})
    assert [words.symbol(w) for w in (b"grumbo", b"grumbos", b"blargish", b"idiots", b"scum", b"you", b"plain")] == ["i2", "w", "i1", "i0", "p", "y", "w"]


def test_edge_rows(spark, edge_rows, edge_docs, clashing, no_docs):
    labels = spark.createDataFrame([(1, 0), (2, 0), (6, 1), (6, 0), (None, 1), (11, None)], "doc_id long, toxic int")
    for docs in (edge_docs, clashing):
        for known in (labels, labels.limit(0)):
            got = T.score(docs, T.fit(docs, known)).select("doc_id", "score").collect()
            assert sorted((r.doc_id or -1) for r in got) == sorted((r[0] or -1) for r in edge_rows)
            assert all(0 <= r.score <= 1 for r in got)
    assert T.score(no_docs, T.fit(no_docs, labels)).count() == 0
    empty = [(1, None), (2, ""), (3, " . ; \n")]
    got = T.score(spark.createDataFrame([(*r, "en", "a") for r in empty], DOC_SCHEMA), T.Model({}, T.FIXED_PARTS, T.FIXED_FINAL)).collect()
    assert len({r.score for r in got}) == 1 and all(r.clauses == [] for r in got)


def test_very_long_text_is_read_to_its_end(spark):
    long = "é" + prose(1, 200_000) + ". you idiot!"
    r = T.score(spark.createDataFrame([(1, long, "en", "a")], DOC_SCHEMA), T.Model({}, T.FIXED_PARTS, T.FIXED_FINAL)).first()
    assert [(long[c.start:c.end].strip(), c.events) for c in r.clauses] == [("you idiot", "p>")]


def test_folds_and_held_out_rows_never_train(spark):
    ids = list(range(400))
    got = dict(spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", T.held_out("doc_id")).collect())
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in ids}
    rows = [(i, ("you zorp " if i % 3 == 0 else "a calm day ") + prose(i, 20), "en", "a") for i in ids]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in ids], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    assert b"zorp" in model.terms
    flipped = labels.withColumn("toxic", F.when(T.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = T.fit(docs, flipped)
    assert other.terms == model.terms and np.array_equal(other.weight, model.weight) and all(np.array_equal(a, b) for a, b in zip(other.final, model.final, strict=True))
    scored = T.score(docs, model).join(labels, "doc_id").where(T.held_out("doc_id")).collect()
    assert scored and all((r.score >= T.LIMIT) == bool(r.toxic) for r in scored)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF_CHECK}/{t}.parquet") for t in ("documents", "labels"))
    judged = T.score(docs, T.fit(docs, labels)).withColumn("held", T.held_out("doc_id")).join(labels, "doc_id").where("held").select("score", "toxic").collect()
    hits = [r.toxic for r in judged if r.score >= T.LIMIT]
    bad = [r for r in judged if r.toxic]
    assert sum(hits) / len(hits) >= 0.9 and sum(r.score >= T.LIMIT for r in bad) / len(bad) >= 0.5


def test_query_has_a_row_per_document(spark, tmp_path, edge_docs):
    edge_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0), (6, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = T.op11_toxicity_grammar(spark, str(tmp_path))
    assert dict(got.dtypes) | {"n_clauses": "bigint"} == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int", "n_clauses": "bigint"}
    assert rows_of(got.select("doc_id")) == rows_of(edge_docs.select("doc_id"))
