"""Splittable scans of files whose records hold the separator: quoted CSV and JSON arrays.

A file is read in byte ranges as *pieces* (text up to the next line break, or up to the next closing brace). Whether a
piece ends a record depends on all bytes before it: open quotes, and for JSON the nesting. Both are the states of a
small automaton whose steps compose, so a first scan sums each byte range up for either quote state it may
start in (quote parity, change of depth, least depth at a piece's end). Prefix sums over these summaries (a row per range) give every range its
true start, and a second scan cuts the records. Records that lie across ranges leave as fragments and are
put together by the range in which they begin; all others never leave their task.

The text is scanned twice and not shuffled, but for the fragments. Bytes per range follow ``spark.sql.files.maxPartitionBytes``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressline import constants as C
from pressline.plans.stage import stage


@dataclass(frozen=True)
class Syntax:
    """Piece separator, whether a backslash escapes within quotes, whether brackets nest, the depth at which a
    record ends, what closes a record's text, and whether an unclosed last record is kept."""
    separator: str
    escapes: bool
    nests: bool
    depth: int
    closing: str
    keep_open: bool


QUOTED_CSV = Syntax("\n", False, False, 0, "", True)
JSON_ARRAY = Syntax("}", True, True, 1, "}", False)


def _ends(values: pa.Array, syntax: Syntax) -> tuple[np.ndarray, list[np.ndarray]]:
    """Per piece: whether quotes stay odd from the first piece to its end, and for a start outside and one
    inside of quotes the change of depth from the first piece to its end (separator included)."""
    values = values.cast(pa.large_string()) if pa.types.is_string(values.type) else values
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1]
    data = values.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.empty(0, np.uint8)
    at = offsets - offsets[0]
    quote = raw == 0x22
    if syntax.escapes and len(raw):
        place = np.arange(len(raw))
        start = np.repeat(at[:-1], np.diff(at))
        last_other = np.maximum.accumulate(np.where(raw != 0x5C, place, -1))
        before = np.r_[-1, last_other[:-1]]                       # last byte before this one that is no backslash
        quote &= (place - 1 - np.maximum(before, start - 1)) % 2 == 0
    odd = np.cumsum(quote) & 1
    total = np.r_[0, odd]
    inside = total[at[1:]].astype(bool)
    depths = [np.zeros(len(values), np.int64)] * 2
    if syntax.nests:
        step = ((raw == 0x7B) | (raw == 0x5B)).astype(np.int64) - ((raw == 0x7D) | (raw == 0x5D))
        depths = []
        for begun_inside in (0, 1):
            within = (odd ^ begun_inside).astype(bool)
            depth = np.r_[0, np.cumsum(np.where(within, 0, step))][at[1:]]
            depths.append(depth - np.cumsum(~(inside ^ bool(begun_inside))))     # the separator closes a brace, unless quoted
    return inside, depths


def _runs(batches, columns):
    """(key, batch slice) for each run of rows of one (file, start)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch[columns[0]].dictionary_encode().indices.to_numpy()
        starts = batch[columns[1]].to_numpy()
        change = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (starts[1:] != starts[:-1])])
        for a, b in zip(change, np.r_[change[1:], batch.num_rows], strict=True):
            yield (batch[columns[0]][int(a)].as_py(), int(starts[a])), batch.slice(int(a), int(b - a))


def _pieces(spark: SparkSession, path, syntax: Syntax) -> DataFrame:
    return (spark.read.option("lineSep", syntax.separator).text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"))


def _summaries(pieces: DataFrame, syntax: Syntax) -> DataFrame:
    """Per range: file, start, parity, depth0/depth1 (change), least0/least1 (least depth at the end of a piece
    outside of quotes) for a start outside and inside of quotes."""

    def run(batches):
        key, parity, depth, least = None, False, [0, 0], [None, None]

        def out():
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([int(parity)]), *(pa.array([d], pa.int64()) for d in depth),
                                               *(pa.array([x], pa.int64()) for x in least)], ["file", "start", "parity", "depth0", "depth1", "least0", "least1"])
        for here, part in _runs(batches, ("file", "start")):
            if here != key:
                if key is not None:
                    yield out()
                key, parity, depth, least = here, False, [0, 0], [None, None]
            inside, depths = _ends(part["value"], syntax)
            new = list(depth)
            for s in (0, 1):
                level = depths[s ^ int(parity)] + depth[s]
                outside = level[~(inside ^ parity ^ bool(s))]
                if len(outside):
                    low = int(outside.min())
                    least[s] = low if least[s] is None else min(least[s], low)
                new[s] = int(level[-1])
            depth, parity = new, bool(parity ^ inside[-1])
        if key is not None:
            yield out()

    return pieces.mapInArrow(run, "file string, start long, parity long, depth0 long, depth1 long, least0 long, least1 long")


def _starts(summaries: DataFrame, syntax: Syntax) -> DataFrame:
    """Per range: the state at its start, whether a record ends in it, and the range in which the record begins that is open at its start."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    quoted = summaries.withColumn("inside", F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2)
    mine = lambda c: F.when(F.col("inside") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1"))
    deep = quoted.withColumn("_change", mine("depth")).withColumn("level", F.coalesce(F.sum("_change").over(before), F.lit(0)))
    ends = deep.withColumn("ends", F.coalesce(F.col("level") + mine("least") <= syntax.depth, F.lit(False)))
    whole = Window.partitionBy("file")
    opener = F.coalesce(F.max(F.when(F.col("ends"), F.col("start"))).over(before), F.min("start").over(whole))
    return ends.withColumn("opener", opener).select("file", "start", "inside", "level", "opener")


def _cut(pieces: DataFrame, syntax: Syntax) -> DataFrame:
    """file, opener, start, whole, closed, text of records and fragments. Pieces carry their range's state."""
    sep = syntax.separator

    def run(batches):
        key = None
        rows: list = []

        def out():
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3]), pa.array(cols[4]),
                                               pa.array(cols[5], pa.large_string()).cast(pa.string())], ["file", "opener", "start", "whole", "closed", "text"])

        def rest():
            """What is left at the range's end is the beginning, or a middle part, of a record."""
            if held:
                rows.append((key[0], opener, key[1], False, False, sep.join(held)))
        held: list = []
        opener = 0
        for here, part in _runs(batches, ("file", "start")):
            if here != key:
                rest()
                key, held = here, []
                parity, level, opener = bool(part["inside"][0].as_py()), part["level"][0].as_py(), part["opener"][0].as_py()
                first = opener == key[1]                              # nothing before this range belongs to its first record
            inside, depths = _ends(part["value"], syntax)
            level_at = depths[int(parity)] + level
            ends = np.flatnonzero((level_at == syntax.depth) & ~(inside ^ parity))
            values, a = part["value"].to_pylist(), 0
            for b in ends:
                held += values[a:b + 1]
                rows.append((key[0], opener, key[1], first, True, sep.join(held)))
                held, a, opener, first = [], int(b) + 1, key[1], True
            held += values[a:]
            level, parity = int(level_at[-1]), bool(parity ^ inside[-1])
            if len(rows) >= 1000:
                yield out()
        rest()
        if rows:
            yield out()

    return pieces.mapInArrow(run, "file string, opener long, start long, whole boolean, closed boolean, text string")


def record_texts(spark: SparkSession, path, syntax: Syntax) -> DataFrame:
    """(file, text): one row per record of the files at ``path``, in parallel over byte ranges."""
    pieces = _pieces(spark, path, syntax)
    starts = stage(_starts(_summaries(pieces, syntax), syntax), "split-starts")
    if starts.limit(C.MAX_BROADCAST_ROWS + 1).count() <= C.MAX_BROADCAST_ROWS:
        stated = pieces.join(F.broadcast(starts), ["file", "start"])          # keeps the order of a range's pieces
    else:
        stated = (pieces.withColumn("_at", F.monotonically_increasing_id()).join(starts, ["file", "start"])
                  .repartition("file", "start").sortWithinPartitions("file", "start", "_at").drop("_at"))
    cut = stage(_cut(stated.select("file", "start", "value", "inside", "level", "opener"), syntax), "split-records")
    joined = (cut.where(~F.col("whole")).groupBy("file", "opener")            # the fragments of one record
              .agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("parts"), F.max("closed").alias("closed")))
    if not syntax.keep_open:
        joined = joined.where("closed")
    mended = joined.select("file", F.array_join(F.transform("parts", lambda p: p["text"]), syntax.separator).alias("text"))
    return cut.where("whole").select("file", "text").unionByName(mended).select("file", F.concat("text", F.lit(syntax.closing)).alias("text"))


def read_quoted_csv(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """Headerless CSV with quoted fields that may hold line breaks; quotes are doubled within quotes. Empty lines are skipped."""
    texts = record_texts(spark, path, QUOTED_CSV).select(F.regexp_replace("text", "\r$", "").alias("text")).where("text <> ''")
    options = {"escape": '"', "multiLine": "true"}
    return texts.select(F.from_csv("text", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options).alias("r")).select("r.*")


def read_json_arrays(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """``file``, the fields of ``schema``, and ``extra`` (a map of every other field to its text) for each object of the JSON arrays at ``path``.

    An object that can't be parsed has NULL in all fields."""
    texts = record_texts(spark, path, JSON_ARRAY).select("file", F.regexp_replace("text", r"^[\[,\s\x{FEFF}]+", "").alias("text"))
    known = F.array(*[F.lit(f.name) for f in schema.fields])
    parsed = texts.select("file", F.from_json("text", schema).alias("r"), F.from_json("text", "map<string,string>").alias("m"))
    extra = F.map_filter("m", lambda k, _: ~F.array_contains(known, k))
    return parsed.select("file", "r.*", F.when(F.size(extra) > 0, extra).alias("extra"))
