"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark items.

Text is normalised to lower-case ASCII letters, digits and non-ASCII bytes, with single spaces
between words. Every item gives windows of ``WINDOW`` consecutive words (an item of fewer words is
one window); each distinct window, between spaces, is a pattern. The automaton reads each
document once and reports every window's end, overlapping ones too; ends are mapped back to word
numbers, and, on request, to byte offsets in the original text.

The patterns are broadcast in shards of at most ``SHARD_BYTES`` bytes (one shard for usual
benchmarks), so an executor's memory doesn't grow with the benchmark; each shard is one more scan.

Edge cases: null or empty texts have no words; items without words have no window; items without an
id are left out; items with the same id count once, whichever of them occurs; repeated documents
each get their row; an empty benchmark hits nothing; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline.llm.common import binary_text, map_batches, read_table, stage
from pressline.llm.registry import register

WINDOW = 10
SHARD_BYTES = 32 << 20

_WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_NORMAL = bytes(b if b in _WORD_BYTES else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(_NORMAL).split() if raw else []


def windows_of(words: list[bytes], size: int = WINDOW) -> list[list[bytes]]:
    if not words:
        return []
    return [words[i:i + size] for i in range(max(1, len(words) - size + 1))]


def item_patterns(items: DataFrame, size: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> Iterator[list[tuple[bytes, int, list[str]]]]:
    """Shards of (window text, words in it, ids of its items), each small enough to broadcast."""

    def windows(batch):
        rows = {(i, b" ".join(w), len(w)) for i, raw in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist(), strict=True)
                for w in windows_of(words_of(raw), size)}
        ids, texts, counts = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.binary()), pa.array(counts, pa.int32())],
                                         ["item_id", "pattern", "n"])

    named = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    # the set leaves out null: a window of items without id only has no name to report, but counts as hit
    grouped = stage(map_batches(named, windows, "item_id string, pattern binary, n int").groupBy("pattern", "n")
                    .agg(F.array_sort(F.collect_set("item_id")).alias("ids")), "decontaminate-windows")
    shard, held = [], 0
    for row in grouped.orderBy("pattern").toLocalIterator():
        shard.append((bytes(row.pattern), row.n, list(row.ids)))
        held += len(row.pattern) + sum(map(len, row.ids))
        if held >= shard_bytes:
            yield shard
            shard, held = [], 0
    if shard:
        yield shard


_BUILT: dict[str, ahocorasick.Automaton] = {}


def automaton(key: str, patterns) -> ahocorasick.Automaton:
    """The automaton of a shard; a Python worker builds it once and keeps the last one."""
    if key not in _BUILT:
        made = ahocorasick.Automaton()
        for k, (pattern, _, _) in enumerate(patterns):
            made.add_word(f" {pattern.decode('latin-1')} ", k)
        made.make_automaton()
        _BUILT.clear()
        _BUILT[key] = made
    return _BUILT[key]


def hits(words: list[bytes], found, patterns) -> tuple[list[tuple[int, int]], set[str]]:
    """Spans of words hit (start, end) and the ids of the items that occur."""
    text = b" " + b" ".join(words) + b" "
    matches = [(end, k) for end, k in found.iter(text.decode("latin-1"))]
    if not matches:
        return [], set()
    spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
    after = np.searchsorted(spaces, [end for end, _ in matches])  # words before the closing space
    spans = [(int(a) - patterns[k][1], int(a)) for a, (_, k) in zip(after, matches, strict=True)]
    return spans, {i for k in {k for _, k in matches} for i in patterns[k][2]}


def word_offsets(raw: bytes) -> list[tuple[int, int]]:
    """Byte offsets (start, end) in the original text of each of its words."""
    plain = np.frombuffer(b" " + raw.translate(_NORMAL) + b" ", np.uint8) != 0x20
    edges = np.diff(plain.astype(np.int8))
    return list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))


def scan(docs: DataFrame, patterns, size: int = WINDOW) -> DataFrame:
    """One pass with one shard: doc_id, n_words, spans (words hit: array of start, end), ids, offsets
    (the spans' byte offsets in the original text, joined where they touch)."""
    shared = docs.sparkSession.sparkContext.broadcast(patterns)
    key = uuid.uuid4().hex
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))),
                     ("ids", pa.list_(pa.string())), ("offsets", pa.list_(pa.list_(pa.int64())))])

    def run(batch):
        rules = shared.value
        found = automaton(key, rules) if rules else None
        rows = []
        for i, raw in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            words = words_of(raw)
            spans, ids = hits(words, found, rules) if words and found else ([], set())
            joined = []
            for a, b in sorted(spans):
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = max(b, joined[-1][1])
                else:
                    joined.append([a, b])
            at = word_offsets(raw) if joined else []
            rows.append((i, len(words), joined, sorted(ids), [[at[a][0], at[b - 1][1]] for a, b in joined]))
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return map_batches(binary_text(docs), run, "doc_id long, n_words long, spans array<array<bigint>>, ids array<string>, offsets array<array<bigint>>")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, offsets."""
    shards = item_patterns(items, size, shard_bytes)
    first, second = next(shards, []), next(shards, None)
    if second is None:
        hit = scan(docs, first, size)
    else:  # one shard at a time is on the driver; the shards' spans meet per row, which a row number made before the scans identifies
        rows = stage(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "decontaminate-rows")
        each = [stage(scan(rows.select(F.col("row").alias("doc_id"), "text"), s, size), "decontaminate-hits") for s in chain((first, second), shards)]
        every = each[0]
        for more in each[1:]:
            every = every.unionByName(more)
        hit = (every.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
                                           F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"),
                                           F.flatten(F.collect_list("offsets")).alias("offsets"))
               .withColumnRenamed("doc_id", "row").join(rows.select("row", "doc_id"), "row").drop("row"))
    # sorted spans, overlaps counted once: the running end is carried along
    covered = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end")),
                          lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s[1] - F.greatest(s[0], acc["end"]))).alias("n"),
                                                  F.greatest(acc["end"], s[1]).alias("end")), lambda acc: acc["n"])
    return hit.select("doc_id", "n_words", covered.alias("n_hit"), F.size("ids").cast("long").alias("n_items"),
                      F.sha2(F.array_join(F.array_sort("ids"), ","), 256).alias("items_sha256"),
                      (covered > 0).alias("contaminated"), "offsets")


@register("op2_decontaminate")
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("offsets")


def brute_force(docs, items, size: int = WINDOW):
    """Word-by-word reference for small fixtures: rows of (doc_id, n_words, n_hit, n_items, sha256, contaminated)."""
    wins = {}
    for i, raw in items:
        for w in windows_of(words_of(raw), size):
            wins.setdefault(tuple(w), set()).update([str(i)] if i is not None else [])
    out = []
    for i, raw in docs:
        words, hit, ids = words_of(raw), set(), set()
        for w, who in wins.items():
            for a in range(len(words) - len(w) + 1):
                if tuple(words[a:a + len(w)]) == w:
                    hit.update(range(a, a + len(w)))
                    ids |= who
        out.append((i, len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out
