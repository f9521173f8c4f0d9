from pyspark.sql import functions as F

from pressline.functions import labels as lb
from pressline.operators import encode as en


def test_packing_small_example(spark):
    # 3 + 1 + 5 tokens, block 4: [a b c \n] [d \n e f], the tail is dropped.
    df = spark.createDataFrame([(1, "a b c"), (2, "d"), (3, "e f g h i")], "doc_id long, text string")
    blocks = {r.block_id: r.tokens for r in en.pack_blocks(df, "text", block_size=4).collect()}
    assert blocks == {0: ["a", "b", "c", "\n"], 1: ["d", "\n", "e", "f"]}


def _sequential(docs, block):
    toks = []
    for i, (_, t) in enumerate(sorted(docs)):
        if i:
            toks.append("\n")
        toks.extend(t.split())
    return {b: toks[b * block:(b + 1) * block] for b in range(len(toks) // block)}


def test_packing_many_ranges_equals_sequential(spark):
    docs = [(i, " ".join(f"w{i}x{j}" for j in range((i * 7) % 13))) for i in range(0, 300, 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.block_id: r.tokens for r in en.pack_blocks(df, "text", block_size=16, rows_per_range=7).collect()}
    assert got == _sequential(docs, 16)


def test_vocabulary_reserved_and_ranked(spark):
    df = spark.createDataFrame([("b a a <BODY> c b a",)], "t string")
    v = {r.token: (r.token_id, r.freq) for r in en.build_vocabulary(df, "t", vocab_size=11).collect()}
    assert v["<|endoftext|>"][0] == 0 and v["[CLS]"][0] == 1 and v["<unk>"][0] == 2
    assert v["<BODY>"] == (7, 1)
    assert v["a"] == (9, 3) and v["b"] == (10, 2) and "c" not in v   # capped at 11 ids


def test_encode_pads_and_maps_unknown(spark):
    df = spark.createDataFrame([(1, "a b zz"), (2, "")], "doc_id long, t string")
    vocab = en.build_vocabulary(spark.createDataFrame([("a b a",)], "t string"), "t")
    out = {r.doc_id: r for r in en.encode(df, "t", vocab, max_length=5).collect()}
    assert out[1].input_ids == [9, 10, en.UNK_ID, 0, 0]
    assert out[1].attention_mask == [1, 1, 1, 0, 0]
    assert out[2].input_ids == [0] * 5 and out[2].n_tokens == 0


def test_staged_tokens_path_equals_text_path(spark):
    df = spark.createDataFrame([(1, "a b zz a."), (2, ""), (3, "<BODY> b\nc")], "doc_id long, t string")
    by_text = en.build_vocabulary(df, "t", vocab_size=12)
    toks = en.stage_tokens(df, "t")
    by_tokens = en.build_vocabulary(toks, None, vocab_size=12, tokens_col="_tokens")
    assert sorted(by_text.collect()) == sorted(by_tokens.collect())
    a = {r.doc_id: r for r in en.encode(df, "t", by_text, max_length=6).collect()}
    b = {r.doc_id: r for r in en.encode(toks, None, by_tokens, max_length=6, tokens_col="_tokens").collect()}
    assert a == b


def test_rare_tokens_are_joined(spark):
    """Ids are the same whether a token is in the broadcast list or joined."""
    long_word = "w" * 1000
    rows = [(1, f"a b a {long_word} c"), (2, "d d d unseen"), (3, ""), (4, None), (4, "a e")]
    df = spark.createDataFrame(rows, "doc_id long, t string").withColumn("_tokens", en.tokenize("t"))
    vocab = en.build_vocabulary(df.where("t IS NULL OR NOT t LIKE '%unseen%'"), "t", rows_per_range=2).cache()
    ids = {r.token: r.token_id for r in vocab.collect()}
    assert sorted(ids.values()) == list(range(len(ids)))
    for head in (0, 10, 1000):
        got = en.lookup_ids(df, "_tokens", vocab, "ids", head_tokens=head).collect()
        assert len(got) == 5
        for r in got:
            assert r.ids == (None if r._tokens is None else [ids.get(t, en.UNK_ID) for t in r._tokens])


def test_vocabulary_over_many_ranges(spark):
    df = spark.range(2_001).selectExpr("concat('t', id) AS t")
    rows = en.build_vocabulary(df, "t", rows_per_range=100).collect()
    got = [r.token for r in sorted(rows, key=lambda r: r.token_id)]
    assert got == en.RESERVED + sorted(f"t{i}" for i in range(2_001))


def test_encode_all_windows(spark):
    df = spark.createDataFrame([(1, "a b a b a"), (2, "")], "doc_id long, t string")
    vocab = en.build_vocabulary(df, "t")
    got = {(r.doc_id, r.window_idx): (r.input_ids, r.attention_mask, r.n_tokens)
           for r in en.encode(df, "t", vocab, max_length=2, all_windows=True).collect()}
    assert got == {(1, 0): ([9, 10], [1, 1], 5), (1, 1): ([9, 10], [1, 1], 5), (1, 2): ([9, 0], [1, 0], 5),
                   (2, 0): ([0, 0], [0, 0], 0)}


def test_packing_text_keys_repeated_keys_and_tail(spark):
    docs = [(f"k{i:03d}", " ".join(f"w{i}x{j}" for j in range((i * 7) % 13))) for i in range(0, 300, 3)]
    df = spark.createDataFrame(docs, "path string, text string")
    got = {r.block_id: r.tokens for r in en.pack_blocks(df, "text", "path", 16, rows_per_range=7).collect()}
    assert got == _sequential(docs, 16)
    twice = spark.createDataFrame([("a", "x y z"), ("a", "x y z"), ("b", "u")], "path string, text string")
    got = {r.block_id: r.tokens for r in en.pack_blocks(twice, "text", "path", 4, keep_tail=True).collect()}
    assert got == {0: ["x", "y", "z", "\n"], 1: ["x", "y", "z", "\n"], 2: ["u"]}


def test_packing_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "a a a b"), (2, None), (3, "a")], "doc_id long, text string")
    got = [r.input_ids for r in en.pack_blocks(df, "text", block_size=3, ids=True).orderBy("block_id").collect()]
    assert got == [[9, 9, 9], [11, 10, 10]]      # a, the separator, b
    assert en.pack_blocks(df.where("false"), "text", block_size=3).count() == 0


def test_one_hot_multi_label(spark):
    df = spark.createDataFrame([(1, "a|b"), (2, ""), (3, None), (4, "b")], "id int, label string")
    out, order = en.encode_labels(df, "label")
    got = {r.id: (r.one_hot, r.label_idx) for r in out.collect()}
    assert [r.label for r in order.orderBy("label_idx").collect()] == ["a", "b"]
    assert got == {1: ([1, 1], 0), 2: ([0, 0], 0), 3: ([0, 0], 0), 4: ([0, 1], 1)}
    none, _ = en.encode_labels(df.where("id = 3"), "label")
    assert [(r.one_hot, r.label_idx) for r in none.collect()] == [([], 0)]


def test_many_labels(spark):
    df = spark.range(10_002).selectExpr("id", "concat('l', id) AS label")
    assert lb.label_order(df, "label").selectExpr("max(label_idx) AS m", "count(*) AS n").first() == (10_001, 10_002)
    out, _ = en.encode_labels(df.where("id < 3"), "label")
    assert sorted(r.one_hot for r in out.collect()) == [[0, 0, 1], [0, 1, 0], [1, 0, 0]]


def test_softmax_argmax_pad(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "s array<double>")
    ids, mask = lb.pad_truncate(F.array(F.lit(5), F.lit(6), F.lit(7)), 2, 0)
    r = df.select(lb.argmax("s").alias("a"), lb.softmax("s").alias("p"), ids.alias("i"), mask.alias("m")).collect()[0]
    assert r.a == 1
    assert abs(sum(r.p) - 1.0) < 1e-12
    assert r.i == [5, 6] and r.m == [1, 1]


def test_label_dimension_from_map_or_list(spark):
    a = [tuple(r) for r in lb.label_dimension(spark, {1: "b", 0: "a"}).orderBy("label_idx").collect()]
    b = [tuple(r) for r in lb.label_dimension(spark, ["a", "b"]).orderBy("label_idx").collect()]
    assert a == b == [(0, "a"), (1, "b")]


def test_label_order(spark):
    df = spark.createDataFrame([("b|a",), ("c",), (None,)], "label string")
    assert [(r.label_idx, r.label) for r in lb.label_order(df, "label").collect()] == [(0, "a"), (1, "b"), (2, "c")]


def test_topk_labels_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, [0.5, 2.0, 2.0]), (2, [None, -1.0, -3.0])], "id int, s array<double>")
    names = F.array(*[F.lit(x) for x in "abc"])
    got = sorted((r.id, r["rank"], r.label_idx, r.label) for r in lb.topk_labels(df, "s", 2, names).collect())
    assert got == [(1, 1, 1, "b"), (1, 2, 2, "c"), (2, 1, 1, "b"), (2, 2, 2, "c")]
