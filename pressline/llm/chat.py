"""Chat formatting: tool-call linking.

Calls and results are joined by their identifier, calls are ordered so that each comes after the one it depends on, the
arguments are validated against the tool's schema, and every call becomes one canonical JSON line (keys in order, no blanks, UTF-8).
A conversation of any length is a set of rows, never one value, so a hot conversation needs no large task.

The order is by depth: a call that waits for no other has depth 0, any other one more than its
predecessor. Depths come from pointer doubling over the ``after`` links, ceil(log2(longest chain)) joins; links that never reach a
root lie on a cycle (status ``cycle``), which also holds for the calls behind it.

Status of a call: ``invalid`` if an argument is no JSON or the arguments break the schema, ``unknown_tool`` without a schema, ``cycle``, ``unanswered``
without a result, else ``ok``. Edge cases: calls without an id are ``unlinked`` and results without an id are left out; an id that
several calls share goes to the first of them (by conversation, turn, then row), later ones, equal rows too, are ``duplicate``; of several
results of one id the first counts; an ``after`` that names no call counts as none; null arguments are an empty object; empty tables
give empty results; further columns are ignored.

The query reads the calls out of ``conversations``: every user turn asks the tool ``reply`` for an answer (arguments: the prompt's
length and words), after the previous user turn of the conversation; the assistant's next turn is the result.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressline.llm.common import read_table, stage
from pressline.llm.registry import register

#: Argument schemas by tool: name -> what its value must be. ``type`` is integer, number, string, boolean, array, object or null; ``minimum`` holds for
#: numbers, ``least`` for the length of strings and arrays, ``items`` for an array's members, ``properties`` for an object's (no others are let in), ``enum`` for any.
SCHEMAS = {"reply": {"chars": {"type": "integer", "required": True, "minimum": 1}, "words": {"type": "integer", "required": True, "minimum": 1},
                     "prompt": {"type": "string", "required": True, "least": 1}}}
TYPES = {"string": str, "boolean": bool, "array": list, "object": dict, "null": type(None)}


def fits(value, spec: dict) -> bool:
    """Whether a parsed JSON value is what ``spec`` asks for."""
    kind = spec.get("type")
    if kind in ("integer", "number"):
        if isinstance(value, bool) or not isinstance(value, int if kind == "integer" else (int, float)) or value < spec.get("minimum", value):
            return False
    elif kind is not None and not isinstance(value, TYPES[kind]):
        return False
    if isinstance(value, (str, list)) and len(value) < spec.get("least", 0):
        return False
    if "enum" in spec and not any(value == e and type(value) is type(e) for e in spec["enum"]):
        return False
    if isinstance(value, list) and "items" in spec and not all(fits(v, spec["items"]) for v in value):
        return False
    return not isinstance(value, dict) or "properties" not in spec or fit_all(value, spec["properties"])


def fit_all(values: dict, schema: dict) -> bool:
    return values.keys() <= schema.keys() and all(fits(values[k], s) if k in values else not s.get("required", False) for k, s in schema.items())


def refused(token: str):
    raise ValueError(token)


def canonical(value) -> str:
    """Canonical JSON: keys in code-point order, no blanks, UTF-8. Raises for text that UTF-8 can't hold."""
    out = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    out.encode()
    return out


def read_arguments(pairs, schema: dict | None) -> tuple[str, bool]:
    """The canonical JSON of a map of JSON values, and whether it satisfies the schema. A value that isn't JSON stands as a
    string of its text and is never valid; a missing value is null."""
    values, sound = {}, True
    for key, raw in pairs or ():
        try:
            values[key] = None if raw is None else json.loads(raw, parse_constant=refused)
            canonical(values[key])
        except (ValueError, RecursionError):
            values[key], sound = raw, False
    # a map's null value counts as absent, as a missing key does
    given = {k: v for (k, raw), v in zip(pairs or (), values.values(), strict=True) if raw is not None}
    return canonical(values), sound and schema is not None and fit_all(given, schema)


def with_arguments(calls: DataFrame, schemas: dict) -> DataFrame:
    """``calls`` with ``arguments`` read: args_json and args_ok, and a row number."""
    rows = calls.select("conv_id", "turn", "call_id", "after", "tool", F.map_entries("arguments").alias("arguments"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "arguments")

    def run(batches):
        for batch in batches:
            read = [read_arguments([(p["key"], p["value"]) for p in pairs or ()], schemas.get(tool))
                    for pairs, tool in zip(batch["arguments"].to_pylist(), batch["tool"].to_pylist(), strict=True)]
            keep = [n for n in batch.schema.names if n != "arguments"]
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in keep], pa.array([j for j, _ in read], pa.string()), pa.array([ok for _, ok in read], pa.bool_())],
                                             [*keep, "args_json", "args_ok"])

    return rows.mapInArrow(run, kinds + ", args_json string, args_ok boolean").withColumn("row", F.monotonically_increasing_id())


def json_lines(linked: DataFrame) -> DataFrame:
    """``call_json`` of each call from after, args_json, call_id, tool and result."""
    keep = [c for c in linked.columns if c not in ("after", "args_json", "tool", "result")]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in linked.select(*keep).schema.fields)

    def run(batches):
        for batch in batches:
            lines = []
            for after, args, name, tool, result in zip(*(batch[c].to_pylist() for c in ("after", "args_json", "call_id", "tool", "result")), strict=True):
                lines.append('{"after":%s,"arguments":%s,"id":%s,"name":%s,"result":%s}' % (canonical(after), args, canonical(name), canonical(tool), canonical(result)))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], pa.array(lines, pa.string())], [*keep, "call_json"])

    return linked.mapInArrow(run, kinds + ", call_json string")


def json_string(text):
    """A JSON string of the text: one field's worth of ``to_json``, whose escapes are fixed."""
    line = F.to_json(F.struct(text.alias("s")))
    return F.when(text.isNotNull(), line.substr(F.lit(6), F.length(line) - 6))


def depths(calls: DataFrame) -> DataFrame:
    """call_id, depth (null on a cycle) by pointer doubling. ``calls``: call_id, after (both unique or null)."""
    # rows without a link skip the joins, where they would all meet in one task
    root = (F.lit(None).cast("string").alias("up"), F.lit(0).cast("long").alias("steps"))
    known = calls.select(F.col("call_id").alias("known_id"))
    waiting = calls.where("after IS NOT NULL").join(known, F.col("after") == F.col("known_id"), "left")
    now = stage(calls.where("after IS NULL").select("call_id", *root).union(
        waiting.select("call_id", "known_id", F.when(F.col("known_id").isNull(), 0).otherwise(1).cast("long"))), "chat-depth")
    n, covered = now.count(), 1
    while covered <= n and not now.where("up IS NOT NULL").isEmpty():
        above = now.select(F.col("call_id").alias("a_id"), F.col("up").alias("a_up"), F.col("steps").alias("a_steps"))
        further = now.where("up IS NOT NULL").join(above, F.col("up") == F.col("a_id"))
        now = stage(now.where("up IS NULL").select("call_id", "up", "steps").union(
            further.select("call_id", "a_up", F.col("steps") + F.col("a_steps"))), "chat-depth")
        covered *= 2
    return now.select("call_id", F.when(F.col("up").isNull(), F.col("steps")).alias("depth"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """Per call: conv_id, turn, call_id, depth, status, call_json.

    ``calls``: conv_id, turn, call_id, after, tool, arguments (map of JSON values by name); ``results``: call_id, conv_id, turn, content."""
    calls = stage(with_arguments(calls, schemas), "chat-calls")          # the row number tells equal rows apart
    named = calls.where("call_id IS NOT NULL")
    place = F.struct(*[F.col(c).isNull().alias(f"no_{c}") if k % 2 else F.col(c) for c in ("conv_id", "turn") for k in (1, 0)], "row")
    first = named.groupBy("call_id").agg(F.min(F.struct(place.alias("place"), F.col("after"))).alias("f"))
    depth = depths(first.select("call_id", "f.after"))
    answer = results.where("call_id IS NOT NULL").groupBy("call_id").agg(
        F.min(F.struct(F.col("conv_id").isNull().alias("a"), "conv_id", F.col("turn").isNull().alias("b"), "turn", "content")).alias("r"))
    once = first.select("call_id", F.col("f.place.row").alias("first_row")).join(depth, "call_id").join(
        answer.select("call_id", F.col("r.content").alias("content"), F.lit(True).alias("answered")), "call_id", "left")
    known = F.coalesce(F.col("tool").isin(*schemas), F.lit(False))
    status = (F.when(F.col("call_id").isNull(), "unlinked").when(F.col("row") != F.col("first_row"), "duplicate")
              .when(~known, "unknown_tool").when(~F.col("args_ok"), "invalid")
              .when(F.col("depth").isNull(), "cycle").when(F.col("answered").isNull(), "unanswered").otherwise("ok"))
    # calls without an id skip the join, where they would all meet in one task
    joined = named.join(once, "call_id").unionByName(calls.where("call_id IS NULL"), allowMissingColumns=True).withColumn("status", status)
    linked = joined.select("conv_id", "turn", "call_id", F.when(~F.col("status").isin("unlinked", "duplicate"), F.col("depth")).alias("depth"), "status",
                           "after", "args_json", "tool", F.when(F.col("status") == "ok", F.col("content")).alias("result"))
    return json_lines(linked).select("conv_id", "turn", "call_id", "depth", "status", "call_json")


def conversation_calls(talk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The calls and results that the turns of ``conversations`` amount to. Turns without conversation or number are left out.

    The turn before is found by a join on the numbered turns' neighbours, taken from ranges of turns: a window over a whole
    conversation would put a hot one into one task."""
    rows = stage(talk.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "role", "text"), "chat-turns")
    span = 256  # turns of a conversation in one window; the last of earlier ranges are carried over in a small table
    laid = rows.withColumn("part", F.floor(F.col("turn") / span))
    ends = laid.groupBy("conv_id", "part").agg(F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("end"))
    carried = ends.select(F.col("conv_id").alias("c_conv"), F.col("part").alias("c_part"), F.max("end").over(
        Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    inside = Window.partitionBy("conv_id", "part").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    linked = laid.withColumn("near", F.max(F.when(F.col("role") == "user", F.col("turn"))).over(inside)) \
        .join(carried, (F.col("conv_id") == F.col("c_conv")) & (F.col("part") == F.col("c_part"))) \
        .withColumn("before", F.coalesce("near", "carried"))
    name = lambda t: F.when(F.col(t).isNotNull(), F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), F.col(t).cast("string")))
    text = F.coalesce(F.col("text"), F.lit(""))
    arguments = F.create_map(F.lit("chars"), F.length(text).cast("string"), F.lit("prompt"), json_string(text),
                             F.lit("words"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("string"))
    calls = linked.where("role = 'user'").select("conv_id", "turn", name("turn").alias("call_id"), name("before").alias("after"), F.lit("reply").alias("tool"),
                                                 arguments.alias("arguments"))
    results = linked.where("role = 'assistant'").select(name("before").alias("call_id"), "conv_id", "turn", F.col("text").alias("content"))
    return calls, results


_TEXT = "coalesce(to_json({}), 'null')"
SQL = f"""
WITH w AS (SELECT conv_id, turn, role, text, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p
           FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv_id, turn, p, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS depth FROM w WHERE role = 'user'),
r AS (SELECT conv_id, p AS turn, first(text ORDER BY turn, text NULLS FIRST) AS content, true AS answered FROM w WHERE role = 'assistant' AND p IS NOT NULL GROUP BY conv_id, p),
j AS (SELECT c.*, content, answered, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS words, 'call-' || c.conv_id || '-' || c.turn AS call_id,
             CASE WHEN p IS NOT NULL THEN 'call-' || c.conv_id || '-' || p END AS after FROM c LEFT JOIN r USING (conv_id, turn)),
s AS (SELECT *, CASE WHEN length(t) < 1 OR words < 1 THEN 'invalid' WHEN answered IS NULL THEN 'unanswered' ELSE 'ok' END AS status FROM j)
SELECT conv_id, turn, call_id, CAST(depth AS BIGINT) AS depth, status,
       '{{"after":' || {_TEXT.format("after")} || ',"arguments":{{"chars":' || length(t) || ',"prompt":' || to_json(t) || ',"words":' || words || '}},"id":' || to_json(call_id)
       || ',"name":"reply","result":' || CASE WHEN status = 'ok' THEN {_TEXT.format("content")} ELSE 'null' END || '}}' AS call_json
FROM s
"""


@register("op7_tool_calls", SQL)
def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = conversation_calls(read_table(spark, sf_dir, "conversations"))
    return link_calls(calls, results)
