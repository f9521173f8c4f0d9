"""Arguments of tool calls: parsed, validated, canonical; repeated rows; a plain linking to compare with."""

import json
import random

import pytest

from pressline.llm import chat
from tests.llm.conftest import rows_of

CALL = "conv_id long, turn long, call_id string, after string, tool string, arguments map<string,string>"
RESULT = "call_id string, conv_id long, turn long, content string"


def some_json(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind == 0:
        return rng.choice([True, False, None])
    if kind == 1:
        return rng.choice([0, -1, 7, 10**25, 1.5, -2.25e-9, 100.0])
    if kind < 5:
        return "".join(rng.choice(['a', '"', "\\", "é", "\n", "\x01", "/", " ", "𝄞", " ", "<"]) for _ in range(rng.randrange(6)))
    if kind == 5:
        return [some_json(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["b", "a", "é", "", 'q"', "Z"]): some_json(rng, depth + 1) for _ in range(rng.randrange(4))}


def test_random_arguments_equal_json_dumps(spark):
    rng = random.Random(1)
    maps = [{f"k{j}é": some_json(rng) for j in rng.sample(range(12), rng.randrange(5))} for _ in range(500)]
    raw = [{k: json.dumps(v, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5) for k, v in m.items()} for m in maps]
    calls = spark.createDataFrame([(1, i, f"c{i}", None, "t", m) for i, m in enumerate(raw)], CALL)
    got = {r.turn: r for r in chat.link_calls(calls, spark.createDataFrame([], RESULT), {"t": {f"k{j}é": {} for j in range(12)}}).collect()}
    for i, m in enumerate(maps):
        want = {"after": None, "arguments": m, "id": f"c{i}", "name": "t", "result": None}
        assert got[i].call_json == json.dumps(want, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert got[i].status == "unanswered"


@pytest.mark.parametrize("raw", ['"a"b"', "NaN", "01", "", "{", "'x'", '"\\ud800"', "[" * 100_000])
def test_what_is_not_json_is_invalid_and_the_line_still_json(raw):
    line, ok = chat.read_arguments([("k", raw)], {"k": {}})
    assert not ok and json.loads(line) == {"k": raw}


SCHEMA = {"n": {"type": "number", "required": True, "minimum": 0}, "e": {"enum": ["x", 1]}, "b": {"type": "boolean"},
          "l": {"type": "array", "least": 1, "items": {"type": "integer"}}, "o": {"type": "object", "properties": {"s": {"type": "string", "required": True, "least": 2}}}}


@pytest.mark.parametrize("values,ok", [
    ({"n": 0}, True), ({"n": 1.5, "e": "x", "b": False, "l": [1, 2], "o": {"s": "ab"}}, True), ({}, False), ({"n": -1}, False), ({"n": True}, False), ({"n": "1"}, False),
    ({"n": 1, "e": True}, False), ({"n": 1, "e": 1}, True), ({"n": 1, "b": 0}, False), ({"n": 1, "l": []}, False), ({"n": 1, "l": [1.0]}, False),
    ({"n": 1, "o": {}}, False), ({"n": 1, "o": {"s": "é"}}, False), ({"n": 1, "o": {"s": "éé", "t": 1}}, False), ({"n": 1, "z": 1}, False)])
def test_schemas(values, ok):
    assert chat.read_arguments([(k, json.dumps(v)) for k, v in values.items()], SCHEMA)[1] is ok


def test_repeated_rows_and_empty_conversations(spark, tmp_path):
    good = {"chars": "3", "words": "1", "prompt": '"abc"'}
    calls = [(1, 0, "a", None, "reply", good)] * 2 + [(1, 0, "a", None, "reply", {**good, "prompt": '"xyz"'}), (1, 2, "b", "a", "reply", good), (None, None, "b", "a", "reply", good)]
    got = chat.link_calls(spark.createDataFrame(calls, CALL), spark.createDataFrame([("a", 1, 1, "r"), ("b", 1, 3, "s")], RESULT))
    assert sorted((r.call_id, r.status) for r in got.collect()) == [("a", "duplicate"), ("a", "duplicate"), ("a", "ok"), ("b", "duplicate"), ("b", "ok")]
    spark.createDataFrame([], "conv_id long, turn long, role string, text string, status string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert chat.op7_tool_calls(spark, str(tmp_path)).count() == 0


def test_clashing_columns(spark):
    talk = [(1, 0, "user", "hello there"), (1, 1, "assistant", "yes"), (1, 2, "user", "  "), (2, 0, "user", None)]
    df = spark.createDataFrame([(*t, "x", 1, 2, 3) for t in talk], "conv_id long, turn long, role string, text string, status string, row int, depth int, part int")
    assert rows_of(chat.link_calls(*chat.conversation_calls(df)), "conv_id", "turn", "depth", "status") == [(1, 0, 0, "ok"), (1, 2, 1, "invalid"), (2, 0, 0, "invalid")]
