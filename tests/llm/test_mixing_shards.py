import hashlib
from collections import Counter

import numpy as np

from pressline.llm import mixing, token_shards
from tests.llm.conftest import rows_of


def expected_targets(sizes):
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, target, capped = 1.5 * sum(sizes.values()), {}, set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        free = sum(w for s, w in weights.items() if s not in capped)
        target = {s: 2.0 * sizes[s] if s in capped else left * weights[s] / free for s in sizes}
        over = {s for s in sizes if s not in capped and target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mix(spark, edge_rows, edge_docs, clashing, no_docs):
    got = mixing.mix(edge_docs).collect()
    assert len(got) == len(edge_rows)
    size = lambda t: len((t or "").encode().split())
    sizes = Counter()
    for _, t, _, s in edge_rows:
        sizes[s] += size(t)
    target = expected_targets(dict(sizes))
    for s in sizes:
        rows = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 * (1 + target[s]) for r in rows)
        assert sum(r.taken for r in rows) == int(target[s] + 1e-9)
        assert all(0 <= r.taken <= 2 * r.size for r in rows)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, size(t)) for i, t, _, _ in edge_rows)
    assert rows_of(mixing.mix(edge_docs)) == rows_of(mixing.mix(clashing)) == rows_of(edge_docs.sparkSession.createDataFrame(got))
    assert rows_of(mixing.mix(no_docs)) == []


def test_mix_over_several_buckets(spark, edge_docs, monkeypatch):
    whole = rows_of(mixing.mix(edge_docs))
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 2)
    assert rows_of(mixing.mix(edge_docs)) == whole


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        assert sorted(token_shards.feistel(np.arange(n), n, "k").tolist()) == list(range(n))
    assert token_shards.feistel(np.arange(50), 50, "a").tolist() != token_shards.feistel(np.arange(50), 50, "b").tolist()


def test_shards_round_trip(spark, edge_rows, edge_docs, clashing, no_docs):
    got = token_shards.token_shards(edge_docs, seq_len=64, shard_sequences=100).orderBy("shard").collect()
    enc = token_shards.encoder(token_shards.TOKENIZER_DIR, token_shards.TOKENIZER_FILE)
    end, want, tokens = np.array([token_shards.END_ID], "<u2").tobytes(), Counter(), 0
    for _, text, _, _ in edge_rows:
        ids = enc(text or "") + end
        tokens += len(ids) // 2
        for a in range(0, len(ids), 128):
            want[(ids[a:a + 128] + end * 64)[:128]] += 1
    assert [r.first_slot for r in got] == [100 * k for k in range(len(got))]
    assert all(r.n_sequences == 100 for r in got[:-1]) and all(len(r.payload) == r.n_sequences * r.stride for r in got)
    assert all(hashlib.sha256(r.payload).hexdigest() == r.sha256 for r in got) and sum(r.n_tokens for r in got) == tokens
    slots = [r.payload[a:a + 128] for r in got for a in range(0, len(r.payload), 128)]
    assert Counter(slots) == want
    frame = spark.createDataFrame(got)
    read = token_shards.read_slots(frame, 95, 10).collect()
    assert [r.slot for r in read] == list(range(95, 105))
    assert all(np.array(r.ids, "<u2").tobytes() == slots[r.slot] for r in read)
    assert token_shards.token_shards(clashing, seq_len=64, shard_sequences=100).count() == len(got)
    assert token_shards.token_shards(no_docs).collect() == []
