import corpus_pipeline
from pressline.llm import decontaminate, jaccard, mixing, quality
from pressline.llm.common import read_table
from tests.conftest import SF_SMALL
from tests.llm.conftest import prose


def test_stages_follow_their_operators(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    def kept(name, ids):
        out = stages[name](spark, docs.where(docs.doc_id.isin(sorted(ids))), SF_SMALL)
        assert out.columns == docs.columns
        return [r.doc_id for r in out.select("doc_id").collect()]

    judged = {r.row.doc_id: r.keep for r in quality.judge(docs, read_table(spark, SF_SMALL, "labels")).collect()}
    good = sorted(kept("quality", text))
    assert good == sorted(i for i, k in judged.items() if k)
    groups = jaccard.brute_force([(i, None if text[i] is None else text[i].encode()) for i in good])
    single = sorted(kept("near_duplicates", good))
    assert single == sorted({c for _, _, c in groups})
    items = [(r.item_id, r.text.encode()) for r in read_table(spark, SF_SMALL, "benchmark").collect()]
    clean = sorted(kept("decontamination", single))
    assert clean == sorted(r[0] for r in decontaminate.brute_force([(i, None if text[i] is None else text[i].encode()) for i in single], items) if not r[5])
    part = docs.where(docs.doc_id.isin(clean))
    want = sorted(r.doc_id for r in mixing.mix(part).collect() for _ in range(-(-r.taken // r.size) if r.size else 1))
    assert sorted(kept("mixing", clean)) == want


def test_run_and_edges(spark, clashing, no_docs):
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert sum(r.n_sequences for r in out.collect()) > 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, no_docs, SF_SMALL).count() == 0, name
        assert stage(spark, clashing, SF_SMALL).columns == clashing.columns, name
    once = corpus_pipeline.near_duplicate_stage(spark, clashing, SF_SMALL)
    ids = [r.doc_id for r in once.select("doc_id").collect()]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) and None in ids


def test_mixing_takes_rows_not_ids(spark):
    """Rows without an id, or with one id, each follow their own epochs, so every source's budget is met but for the last document."""
    for own in (None, 7):
        rows = [(own, prose(k, 10 + k % 5), "en", "abc"[k % 3]) for k in range(120)] + [(own, "", "en", "a")]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        budget, got = {}, {}
        for r in mixing.mix(docs).collect():
            budget[r.source] = budget.get(r.source, 0) + r.taken
        out = corpus_pipeline.mixing_stage(spark, docs, SF_SMALL).collect()
        for r in out:
            got[r.source] = got.get(r.source, 0) + len(r.text.split())
        assert all(budget[s] <= got.get(s, 0) < budget[s] + 14 for s in budget), (budget, got)
        assert sum(r.text == "" for r in out) == 1


def test_rows_that_share_an_id_are_judged_alone(spark):
    schema = "doc_id long, text string, lang string, source string"

    def left(stage, rows):
        out = stage(spark, spark.createDataFrame([(i, t, "en", "a") for i, t in rows], schema), SF_SMALL)
        return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)

    leak = next(r.text for r in read_table(spark, SF_SMALL, "benchmark").where("item_id IS NOT NULL").collect() if len((r.text or "").split()) >= 10)
    clean = [(None, prose(1, 30)), (7, prose(2, 30)), (8, prose(3, 30))]
    assert left(corpus_pipeline.decontamination_stage, [*clean, (None, leak), (7, f"so {leak} too"), (9, leak)]) == sorted(clean, key=repr)
    one, two, three = prose(5, 80), prose(9, 80, 11), prose(4, 60, 13)
    near = one.replace(one.split()[3], "edit", 1)
    keep = [(None, one), (1, one), (5, two), (6, three), (6, prose(8, 50, 17)), (9, "")]
    assert left(corpus_pipeline.near_duplicate_stage, [*keep, (5, near), (6, three), (8, three), (9, "")]) == sorted(keep, key=repr)
