import random
import re

import pytest

from pressline.llm import decontaminate, licences, pii, secrets
from tests.llm.conftest import prose, rows_of

RULES = {"assign": (re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I), 1, 8),
         "access": (re.compile(rb"AKIA[A-Z0-9]+"), 0, 16), "hex": (re.compile(rb"[0-9a-f]+"), 0, 32)}


def plain_secrets(raw):
    found = [(k, len(raw[:m.start()].decode()), len(raw[:m.end()].decode())) for k, (rule, group, least) in RULES.items()
             for m in rule.finditer(raw) if len(m[group]) >= least]
    return sorted(found, key=lambda s: (s[1], list(RULES).index(s[0])))


def test_secrets_against_plain_patterns():
    rng = random.Random(11)
    parts = ["password", "token", "secret", "api_key", "APIKEY", "Passwd", ":", "=", ": ", " = ", "\"", "'", "abc", "abcdefghij", "AKIA", "AKIAABCDEFGHIJKL",
             "0123456789abcdef" * 2, "é", "x", ".", "\n", ",", "-", "token=", "a" * 9, " ", "-----BEGIN RSA ", "PRIVATE KEY-----", "BEGIN"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))).encode() for _ in range(1500)]
    for text, spans in zip(texts, secrets.scan_texts(texts), strict=True):
        base = [s for s in spans if s[0] in RULES]
        assert base == plain_secrets(text), text
        assert not any(a < e and s < b for k, a, b in spans if k not in RULES for _, s, e in base)


def test_secrets_added(spark, clashing, no_docs):
    text = "ghp_" + "aB3" * 12 + " and -----BEGIN RSA PRIVATE KEY-----\nxyz"
    assert [s[0] for s in secrets.scan_texts([text.encode()])[0]] == ["forge", "pem"]
    got = secrets.scan_secrets(clashing).collect()
    assert len(got) == clashing.count() and all(r.spans == "" for r in got)
    assert secrets.scan_secrets(no_docs).collect() == []


def test_decontamination(spark, edge_rows, edge_docs, clashing, no_docs):
    items = [(1, prose(5, 14)), (2, prose(5, 9).title()), (3, "One, two!"), (4, None), (5, ""), (None, prose(9, 12)), (3, "ÜNÏ çödé"), (7, prose(3, 10, 11)), (8, "absent words only here")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    enc = lambda rows: [(r[0], None if r[1] is None else r[1].encode()) for r in rows]
    short = [r for r in edge_rows if r[0] not in (6, 7)]
    want = sorted(decontaminate.brute_force(enc(short), enc(items)), key=repr)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    few = edge_docs.where("doc_id IS NULL OR doc_id NOT IN (6, 7)")
    assert rows_of(decontaminate.decontaminate(few, frame), *columns) == want
    assert rows_of(decontaminate.decontaminate(few, frame, shard_bytes=30), *columns) == want      # several shards
    assert {r[0]: r[3] for r in rows_of(decontaminate.decontaminate(clashing, frame), *columns)}[6] == 1
    assert not any(r.contaminated for r in decontaminate.decontaminate(edge_docs, frame.limit(0)).collect())
    assert decontaminate.decontaminate(no_docs, frame).collect() == []
    raw = "Say: one -- TWO, three".encode()
    assert [raw[a:b] for a, b in decontaminate.word_offsets(raw)] == [b"Say", b"one", b"TWO", b"three"]


def test_personal_base_spans():
    text = "é a.b@mail.example.com, 10.0.255.1 300.1.1.1 4111 1111 1111 1111 x +1 (988) 555-2485 x " + "9" * 6000
    assert [(k, text[a:b]) for k, a, b in pii.base_spans(text)] == [
        ("email", "a.b@mail.example.com"), ("ip", "10.0.255.1"), ("phone", "+1 (988) 555-2485")]
    assert [k for k, _, _ in pii.base_spans("x 4111 1111 1111 1111 y")] == ["card"]
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_personal_field(spark, clashing, no_docs):
    rng = random.Random(2)
    rows = []
    for i in range(200):
        n = "".join(rng.choice("0123456789") for _ in range(10))
        one = rng.choice([f"+1 ({n[:3]}) {n[3:6]}-{n[6:]}", f"u{n[:3]}@mail.example.com", f"10.{int(n[:2])}.3.4", n, f"{n[:4]}-{n[4:6]}-{n[6:8]}"])
        rows.append((i, f"word call {one} word", "en", "a"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    field = pii.train(docs)
    assert field.weights
    right = 0
    for _, text, _, _ in rows:
        base, every = pii.all_spans(text, field)
        assert set(base) <= set(every)
        found = [(k, a, b) for tokens in pii.regions(text) for k, a, b, _ in field.decode(text, tokens)]
        right += set(found) == set(base)
    assert right >= 0.95 * len(rows)
    got = pii.scan_personal(docs).collect()
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got) == sum(len(pii.base_spans(r[1])) for r in rows)
    assert len(pii.scan_personal(clashing).collect()) == clashing.count()
    assert pii.scan_personal(no_docs).collect() == []


def test_personal_training_mix_at_any_size(spark, monkeypatch):
    """The smallest keys of many regions all begin with the same byte; repeated regions count once."""
    shown = []
    one = pii.training_sample
    monkeypatch.setattr(pii, "training_sample", lambda text, base, tokens, plain: shown.append((text, plain)) or one(text, base, tokens, plain))
    rows = [(i, f"call +1 (988) {i // 10000 + 200}-{i % 10000:04} now") for i in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pii.train(docs, most=30)
    assert len(shown) == 30 and 4 <= sum(plain for _, plain in shown) <= 16
    few = [(i, f"call +1 (988) 200-{i:04} now") for i in range(20)]
    shown.clear()
    pii.train(spark.createDataFrame(few * 40, "doc_id long, text string"), most=20)
    assert len(shown) == len({text for text, _ in shown}) == 20


def test_licences(spark, clashing, no_docs):
    lines = {1: ("Licensed under the Apache License, Version 2.0.", "apache"), 2: ("Released under the MIT License.", "mit"), 3: ("All rights reserved.", "reserved"),
             4: ("this work is LICENSED under the GNU general public license, version 3", "gpl"), 5: ("the public was there with a version of it", "none"),
             6: ("plain words of no matter", "none"), 7: (None, "none"), 8: ("", "none")}
    rows = [(i, None if t is None else f"{prose(i, 20)}\n{t}\n{prose(i + 9, 20)}" if t else t) for i, (t, _) in lines.items()]
    rows += [(100 + i, f"{prose(i, 12)} public {prose(i, 5)} version") for i in range(60)] + [(1, "again the same id"), (None, "MIT License")]
    got = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i].family for i in lines} == {i: f for i, (_, f) in lines.items()}
    assert len(got) == len({i for i, _ in rows}) and got[1].confirmed and got[2].n_paragraphs == 1
    assert licences.scan_licences(clashing).count() == clashing.select("doc_id").distinct().count()
    assert licences.scan_licences(no_docs).collect() == []


def test_wrapped_and_reworded_notices(spark):
    header = ("    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n"
              "    the Free Software Foundation, either version 3 of the License.")
    texts = {1: header, 2: " * Permission is hereby granted, free of charge,\n * to any person obtaining\n * a copy of this software.", 3: "Distributed under the terms of the MIT License.",
             4: "All rights reserved.", 5: "the public was there\nwith a version of it"}
    rows = [(i, f"{prose(i, 20)}\n\n{t}\n\n{prose(i + 9, 20)}") for i, t in texts.items()]
    rows += [(100 + i, f"{prose(i, 12)} public {prose(i, 5)} version") for i in range(60)]
    rows += [(200 + i, f"w{i}x distributed under the terms of the MIT License") for i in range(60)]
    got = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: (got[i].family, got[i].confirmed, got[i].n_paragraphs) for i in texts} == {
        1: ("gpl", True, 1), 2: ("mit", True, 1), 3: ("unknown", False, 1), 4: ("reserved", True, 1), 5: ("none", False, 0)}


def test_every_family_of_a_document(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, f"Released under the MIT License.\n{prose(1, 9)}\n{gpl}\n{gpl}"), (2, "Licensed under the Apache License, Version 2.0. All rights reserved."), (None, gpl), (None, "All rights reserved."), (3, "plain")]
    rows += [(100 + i, f"{prose(i, 12)} public {prose(i, 5)} version") for i in range(60)]
    got = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    held = {i: {(f.family, f.likely, f.n_paragraphs, f.confirmed) for f in got[i].families} for i in (1, 2, 3, None)}
    assert held == {1: {("mit", "mit", 1, True), ("gpl", "gpl", 2, True)}, 2: {("apache", "apache", 1, True), ("reserved", "reserved", 1, True)}, 3: set(),
                    None: {("gpl", "gpl", 1, True), ("reserved", "reserved", 1, True)}}
    assert all(got[i].family == got[i].families[0].family for i in (1, 2, None))


@pytest.mark.parametrize("name", ["licences", "mixing"])
def test_native_operators_have_no_python_nodes(name):
    import inspect

    from pressline.llm import mixing
    source = inspect.getsource({"licences": licences, "mixing": mixing}[name])
    assert not re.search(r"mapIn|applyIn|udf|\.rdd|toPandas|map_batches", source)
