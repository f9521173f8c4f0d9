"""Token-ID output in training order: fixed-stride binary shards.

Documents become token ids (a public byte-level BPE; an end id closes each document) and are cut into
sequences of ``seq_len`` ids, the last one filled up with the end id. Every sequence has a dense
number: documents are laid out by the hash of their id in buckets of about ``ROWS_PER_BUCKET``, and a
prefix sum over buckets, then inside a bucket, gives each document's first number. A keyed Feistel
network over the smallest even number of bits that holds all sequences permutes the numbers; a result
past the end is encrypted again until it falls inside (cycle walking), so the slots are a permutation
of 0..n-1. Slots are dealt to shards of ``SHARD_SEQUENCES``; a shard is one row whose payload
holds its sequences in slot order, ``stride`` bytes each (ids as little-endian unsigned 16 bits).

A reader that stopped at slot s goes on at shard ``s // SHARD_SEQUENCES``, byte
``(s % SHARD_SEQUENCES) * stride``; ``read_slots`` does that.

Edge cases: null and empty texts, and documents of any length, give at least the end id, hence one
sequence; repeated rows each give their own sequences (their order among themselves doesn't matter, as
they are equal); rows without id are laid out under the empty id; an empty table gives no shard;
special tokens' strings in a text are ordinary text; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressline.llm.common import map_batches, read_table, small_side, stage
from pressline.llm.registry import register

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER_FILE = "byte_bpe_50k.tiktoken"
END_ID = 50256
SEQ_LEN = 512
SHARD_SEQUENCES = 4096
ROWS_PER_BUCKET = 4096
KEY = "training-order-1"
ROUNDS = 6
#: Fixed value: the vocabulary's split pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Texts to little-endian 16-bit ids."""

    def __init__(self, folder: str, file: str):
        import tiktoken
        with open(os.path.join(folder, file), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text).astype("<u2").tobytes()


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(folder: str, file: str) -> Encoder:
    if (folder, file) not in _ENCODERS:
        _ENCODERS[folder, file] = Encoder(folder, file)
    return _ENCODERS[folder, file]


def encode(docs: DataFrame, folder: str = TOKENIZER_DIR, file: str = TOKENIZER_FILE) -> DataFrame:
    """doc_id, key (hash of the id) and tokens (16-bit ids, the end id last) of every row."""
    out = pa.schema([("doc_id", pa.int64()), ("tokens", pa.binary())])
    end = np.array([END_ID], "<u2").tobytes()

    def run(batch):
        enc = encoder(folder, file)
        tokens = [enc(t.decode() if t else "") + end for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(tokens, pa.binary())], schema=out)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return map_batches(texts, run, "doc_id long, tokens binary").withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def feistel(number: np.ndarray, n: int, key: str, rounds: int = ROUNDS) -> np.ndarray:
    """The slot of each number in 0..n-1: a keyed permutation of 0..n-1."""
    half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little")) for r in range(rounds)]

    def once(x):
        left, right = x >> half, x & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(32)
            f *= np.uint64(0xD6E8FEB86659FD93)
            f ^= f >> np.uint64(29)
            left, right = right, left ^ (f & mask)
        return left << half | right

    slot = once(np.asarray(number, np.uint64))
    while len(far := np.flatnonzero(slot >= n)):
        slot[far] = once(slot[far])
    return slot.astype(np.int64)


def number_sequences(sizes: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``sizes`` (row, key, n_seq) with ``first``, the number of each row's first sequence."""
    n_rows = sizes.count()
    buckets = max(1, -(-n_rows // rows_per_bucket))
    laid = sizes.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48)) * buckets))
    totals = laid.groupBy("bucket").agg(F.sum("n_seq").alias("total"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    starts = small_side(totals.select(F.col("bucket").alias("b"), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("start")))
    inside = Window.partitionBy("bucket").orderBy("key", "n_seq", "row").rowsBetween(Window.unboundedPreceding, -1)
    return (laid.withColumn("within", F.coalesce(F.sum("n_seq").over(inside), F.lit(0)))
            .join(starts, F.col("bucket") == F.col("b"))
            .select("row", (F.col("start") + F.col("within")).alias("first")))


def token_shards(docs: DataFrame, seq_len: int = SEQ_LEN, shard_sequences: int = SHARD_SEQUENCES, key: str = KEY,
                 folder: str = TOKENIZER_DIR, file: str = TOKENIZER_FILE) -> DataFrame:
    """One row per shard: shard, first_slot, n_sequences, seq_len, stride, n_tokens (ids that aren't
    filling), sha256 of the payload, payload."""
    stride = 2 * seq_len
    rows = stage(encode(docs, folder, file).withColumn("row", F.monotonically_increasing_id())
                 .withColumn("n_seq", F.ceil(F.octet_length("tokens") / F.lit(float(stride))).cast("long")), "token-rows")
    firsts = stage(number_sequences(rows.select("row", "key", "n_seq")), "token-numbers")
    total = rows.agg(F.sum("n_seq")).first()[0] or 0
    numbered = rows.select("row", "tokens").join(small_side(firsts), "row").select("first", "tokens")
    out = pa.schema([("shard", pa.int64()), ("slot", pa.int64()), ("n", pa.int32()), ("ids", pa.binary())])
    filling = np.array([END_ID], "<u2").tobytes() * seq_len

    def cut(batch):
        slots, sizes, ids = [], [], []
        for first, tokens in zip(batch["first"].to_pylist(), batch["tokens"].to_pylist(), strict=True):
            n = -(-len(tokens) // stride)
            slots.append(np.arange(first, first + n))
            for a in range(0, n * stride, stride):
                piece = tokens[a:a + stride]
                sizes.append(len(piece) // 2)
                ids.append(piece + filling[len(piece):])
        slot = feistel(np.concatenate(slots), total, key)
        yield pa.RecordBatch.from_arrays([pa.array(slot // shard_sequences), pa.array(slot), pa.array(sizes, pa.int32()),
                                          pa.array(ids, pa.binary())], schema=out)

    n_shards = max(1, -(-total // shard_sequences))
    placed = map_batches(numbered, cut, "shard long, slot long, n int, ids binary", text="tokens")
    # slots are uniform, so ranges of shards are even; a range holds whole shards in slot order
    parts = min(n_shards, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_shards // 8))
    laid = placed.repartition(parts, "shard").sortWithinPartitions("slot")
    final = pa.schema([("shard", pa.int64()), ("first_slot", pa.int64()), ("n_sequences", pa.int64()), ("seq_len", pa.int64()),
                       ("stride", pa.int64()), ("n_tokens", pa.int64()), ("sha256", pa.string()), ("payload", pa.binary())])

    def write(batches):
        now, ids, n, first = None, [], 0, 0

        def done():
            payload = b"".join(ids)
            return pa.RecordBatch.from_pylist([{"shard": now, "first_slot": first, "n_sequences": len(ids), "seq_len": seq_len, "stride": stride,
                                                "n_tokens": n, "sha256": hashlib.sha256(payload).hexdigest(), "payload": payload}], schema=final)

        for batch in batches:
            shard, slot = batch["shard"].to_numpy(), batch["slot"].to_numpy()
            size, data = batch["n"].to_numpy(), batch["ids"].to_pylist()
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)] if len(shard) else []
            for a, b in pairwise(edges):
                if shard[a] != now:
                    if now is not None:
                        yield done()
                    now, ids, n, first = int(shard[a]), [], 0, int(slot[a])
                ids += data[a:b]
                n += int(size[a:b].sum())
        if now is not None:
            yield done()

    return laid.mapInArrow(write, "shard long, first_slot long, n_sequences long, seq_len long, stride long, n_tokens long, sha256 string, payload binary")


def read_slots(shards: DataFrame, start: int, count: int) -> DataFrame:
    """slot and ids (array of int) of the slots start..start+count-1, in order: only their shards' rows are read and each
    sequence is sliced from its fixed offset."""
    stop = start + count
    slots = F.sequence(F.greatest(F.col("first_slot"), F.lit(start)), F.least(F.col("first_slot") + F.col("n_sequences"), F.lit(stop)) - 1)
    at = ((F.col("slot") - F.col("first_slot")) * F.col("stride")).cast("int")
    ids = F.transform(F.sequence(F.lit(0), F.col("seq_len").cast("int") - 1), lambda k: F.conv(F.concat(
        F.hex(F.substring(F.col("bytes"), 2 * k.cast("int") + 2, 1)), F.hex(F.substring(F.col("bytes"), 2 * k.cast("int") + 1, 1))), 16, 10).cast("int"))
    return (shards.where((F.col("first_slot") < stop) & (F.col("first_slot") + F.col("n_sequences") > start))
            .withColumn("slot", F.explode(slots)).withColumn("bytes", F.substring(F.col("payload"), at + 1, F.col("stride").cast("int")))
            .select("slot", ids.alias("ids")).orderBy("slot"))


@register("op6_token_shards")
def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(read_table(spark, sf_dir, "documents"))
