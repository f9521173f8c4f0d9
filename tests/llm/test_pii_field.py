"""The personal-data field: its sums and its decoding against enumeration, and what it adds on lines it hasn't seen."""

import random

import numpy as np

from pressline.llm import pii
from tests.llm.conftest import prose


def segmentations(n, most=pii.MOST_TOKENS):
    """All ways to read tokens 0..n: (first, last, kind) segments, a kind of -1 for one token of ordinary text."""
    if n == 0:
        return [[]]
    out = []
    for j in range(max(0, n - most), n):
        for head in segmentations(j, most):
            out += [head + [(j, n, k)] for k in range(len(pii.KINDS))]
            if j == n - 1:
                out.append(head + [(j, n, -1)])
    return out


def random_field(rng, features):
    field = pii.Field()
    field.weights = {f: np.array([rng.uniform(-2, 2) for _ in pii.KINDS]) for f in features}
    return field


def test_decoding_and_gradients_equal_enumeration():
    rng = random.Random(4)
    for case in range(300):
        n = rng.randrange(1, 5)
        words = [pii.made_number(rng).replace(" ", "") or "1" for _ in range(n)]
        text, tokens, at = " ".join(words), [], 0
        for w in words:
            tokens.append((at, at + len(w)))
            at += len(w) + 1
        names = sorted({f for i in range(n) for j in range(i + 1, min(n, i + pii.MOST_TOKENS) + 1) for f in pii.span_features(text, tokens[i][0], tokens[j - 1][1], j - i)})
        field = random_field(rng, names)
        score = {(i, j): field.score(f) for i, j, f in field.lattice(text, tokens)}
        every = [(sum(score[i, j][k] for i, j, k in path if k >= 0), path) for path in segmentations(n)]
        best = max(s for s, _ in every)
        got = field.decode(text, tokens)
        reached = [[(pii.KINDS[k], *pii.trimmed(text, tokens[i][0], tokens[j - 1][1])) for i, j, k in path if k >= 0] for s, path in every if s > best - 1e-9]
        assert [g[:3] for g in got] in reached
        if case % 3:
            continue
        # one learning step moves the weights by the rate times (gold less expected) counts
        gold_path = rng.choice(every)[1]
        gold = {(i, j): k for i, j, k in gold_path if k >= 0}
        total = np.logaddexp.reduce([s for s, _ in every])
        expected = {f: np.zeros(len(pii.KINDS)) for f in names}
        for s, path in every:
            for i, j, k in path:
                if k >= 0:
                    for f in pii.span_features(text, tokens[i][0], tokens[j - 1][1], j - i):
                        expected[f][k] += np.exp(s - total)
        for (i, j), k in gold.items():
            for f in pii.span_features(text, tokens[i][0], tokens[j - 1][1], j - i):
                expected[f][k] -= 1
        before = {f: w.copy() for f, w in field.weights.items()}
        old = pii.EPOCHS, pii.DECAY
        pii.EPOCHS, pii.DECAY = 1, 0.0
        try:
            field.learn([(n, field.lattice(text, tokens), gold)])
        finally:
            pii.EPOCHS, pii.DECAY = old
        for f in names:
            assert np.allclose(field.weights[f], before[f] - pii.RATE * expected[f], atol=pii.RATE * 1e-3 * 20)


def test_four_hundred_unseen_lines(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        d = pii.digits
        one = rng.choice([f"+1 ({d(rng, 3)}) {d(rng, 3)}-{d(rng, 4)}", f"u{d(rng, 3)}@mail.example.com", f"10.{rng.randrange(99)}.3.4", d(rng, 8), f"{d(rng, 4)}-0{rng.randrange(1, 9)}-11", f"{rng.randrange(90)}%"])
        rows.append((i, f"{prose(i, 6)} {one} {prose(i + 5, 4)}"))
    field = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    right = wrong = missed = 0
    for k in range(400):
        entity = pii.made_entity(rng) if k % 2 else None
        text = entity[1] if entity else pii.made_number(rng)
        line = f"{prose(k, 5)} {rng.choice(pii.CUES if entity else pii.OTHERS)} {text} and {prose(k + 3, 3)}"
        found = set(pii.all_spans(line, field)[1])
        at = line.index(text)
        want = {(entity[0], at, at + len(text))} if entity else set()
        right, wrong, missed = right + len(found & want), wrong + len(found - want), missed + len(want - found)
    assert right / (right + missed) >= 0.9 and right / (right + wrong) >= 0.95, (right, wrong, missed)
