"""Tokenising, vocabularies, fixed-length encoding and token-block packing.

Tokens come from one regular expression (markup markers are atomic tokens,
then ASCII letter/digit runs, then any other single non-space character), run
by ``regexp_extract_all`` inside the JVM.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressline import constants as C
from pressline.functions import labels as lb
from pressline.functions.text import HEADLINE_BODY_MARKERS, PY_WHITESPACE_CLASS, ColumnOrName, _col
from pressline.operators.columns import with_columns_once
from pressline.operators.ranges import ROWS_PER_RANGE, prefix_sums
from pressline.plans.stage import drop_stage, stage

TOKEN_PATTERN = f"<[A-Z_]+/?>|[A-Za-z0-9]+|[^A-Za-z0-9{PY_WHITESPACE_CLASS}]"

# The matches of ``TOKEN_PATTERN``, in a form that takes Java's matcher about a third of the
# time: the alternatives begin with different characters, so their order is free, and ASCII words,
# marks and blanks are settled by one table lookup before the class with all blanks of Unicode.
FAST_TOKEN_PATTERN = (r"\p{Alnum}++|<[A-Z_]++/?>|\p{Punct}|(?![\x09-\x0D\x1C-\x20])"
                      f"[^A-Za-z0-9{PY_WHITESPACE_CLASS}]")

# Reserved ids: end-of-text doubles as padding, then the class token, the
# unknown-token id, then the markup markers (atomic, never split).
PAD_TOKEN = "<|endoftext|>"
CLS_TOKEN = "[CLS]"
UNK_TOKEN = "<unk>"
RESERVED = [PAD_TOKEN, CLS_TOKEN, UNK_TOKEN] + HEADLINE_BODY_MARKERS
PAD_ID, CLS_ID, UNK_ID = 0, 1, 2
SEPARATOR = "\n"

# Tokens looked up from a broadcast list: the most frequent ids whose text, measured, sums up to at most so many
# bytes, and only tokens of at most HEAD_TOKEN_BYTES. All other tokens
# are joined; being rarer than every listed one, none of them is a hot key.
HEAD_BYTES = 32 << 20
HEAD_STEP = 50_000
HEAD_TOKEN_BYTES = 256
# Tokens that a task looks up at once: what it holds besides its Arrow batch doesn't follow the batch.
SLICE_ITEMS = 500_000


def tokenize(text: ColumnOrName) -> Column:
    """``array<string>`` of tokens, in text order."""
    return F.regexp_extract_all(_col(text), F.lit(FAST_TOKEN_PATTERN), F.lit(0))


def build_vocabulary(df: DataFrame, text_col: str | None, vocab_size: int | None = None,
                     tokens_col: str | None = None, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``(token_id, token, freq)``: reserved tokens first, then every other token
    by (freq desc, token). ``vocab_size`` keeps only that many ids; by default
    every distinct token has one.

    Tokens come from ``tokens_col`` when given (an already tokenised, staged
    column), else from tokenising ``text_col``. Counting is an exploded hash
    aggregate (map-side combined: a very frequent token is one counter per
    task). Ids are ranks over ranges of the counts, so no task sees all tokens.
    """
    if vocab_size is not None and vocab_size < len(RESERVED):
        raise ValueError("vocab_size smaller than the reserved tokens")
    spark = df.sparkSession
    toks = F.col(tokens_col) if tokens_col else tokenize(text_col)
    counts = (df.select(F.explode(toks).alias("token"))
                .groupBy("token").agg(F.count(F.lit(1)).alias("freq")))
    # the two consumers below filter on the grouping key, which Catalyst would
    # push under the aggregate (two tokenising passes); stage the counts once
    counts = stage(counts, "token-counts")
    ranked = prefix_sums(counts.where(~F.col("token").isin(RESERVED)),
                         [F.col("freq").desc(), F.col("token")], F.lit(1), "_rank", rows_per_range)
    ranked = ranked.select((F.col("_rank") + len(RESERVED)).cast("int").alias("token_id"), "token", "freq")
    if vocab_size is not None:
        ranked = ranked.where(F.col("token_id") < vocab_size)
    reserved_freq = counts.where(F.col("token").isin(RESERVED))
    reserved = (spark.createDataFrame([(i, t) for i, t in enumerate(RESERVED)], "token_id int, token string")
                     .join(reserved_freq, "token", "left")
                     .select("token_id", "token", F.coalesce("freq", F.lit(0)).cast("bigint").alias("freq")))
    return reserved.unionByName(ranked)


def stage_tokens(df: DataFrame, text_col: str, tokens_col: str = "_tokens") -> DataFrame:
    """Tokenise ``text_col`` once into ``tokens_col`` (replacing the text) and
    write the result to the shared folder. Jobs that both count and encode
    tokens read it twice instead of running the markup and the tokeniser twice;
    the write also cuts the lineage."""
    return stage(df.select(*[c for c in df.columns if c != text_col], tokenize(text_col).alias(tokens_col)),
                 "doc-tokens")


_VOCAB_CACHE: dict[str, tuple[pa.Array, pa.Array]] = {}


def _slices(batches, items_col: str, most: int = SLICE_ITEMS):
    """The batches in slices of at most ``most`` items of an array column (a longer row is a slice of its own)."""
    for batch in batches:
        ends = batch[items_col].offsets.to_numpy()
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def _lookup_batches(head_bc, key: str, tokens_col: str, keep: list[str], out_col: str, open_col: str | None):
    """``mapInArrow`` body: the columns ``keep`` and ``out_col`` = ids of ``tokens_col``. Tokens outside the broadcast list are
    NULL and listed in ``open_col`` with their positions; without that column they get the unknown id.

    Per Arrow batch, all tokens are looked up at once with ``index_in``
    (a vectorised hash probe, no Python objects per token).
    """
    def run(batches):
        head = _VOCAB_CACHE.get(key)
        if head is None:
            head = head_bc.value
            _VOCAB_CACHE.clear()      # a reused Python worker keeps one list
            _VOCAB_CACHE[key] = head
        for batch in _slices(batches, tokens_col):
            col = batch[tokens_col]
            flat = col.flatten().cast(pa.string())
            codes = head[1].take(pc.index_in(flat, value_set=head[0]))
            offsets = pc.subtract(col.offsets, col.offsets[0]).cast(pa.int32())
            columns, names = [batch[n] for n in keep], [*keep, out_col]
            if open_col is None:
                codes = pc.fill_null(codes, UNK_ID)
            columns.append(pa.ListArray.from_arrays(offsets, codes, mask=col.is_null()))
            if open_col is not None:
                ends = offsets.to_numpy()
                lost = np.flatnonzero(codes.is_null().to_numpy(zero_copy_only=False))
                before = np.searchsorted(lost, ends)
                row = np.repeat(np.arange(len(col)), np.diff(before))
                pairs = pa.StructArray.from_arrays([pa.array(lost - ends[row], pa.int32()), flat.take(pa.array(lost))], ["position", "token"])
                columns.append(pa.ListArray.from_arrays(pa.array(before, pa.int32()), pairs))
                names.append(open_col)
            yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def head_size(vocab: DataFrame, most_bytes: int = HEAD_BYTES) -> int:
    """How many of the first ids the broadcast list holds: the steps of ``HEAD_STEP`` ids whose
    tokens sum up to at most ``most_bytes``."""
    fits = most_bytes // 8                                   # ids past this can't fit: a token costs eight bytes at least
    sizes = (vocab.where((F.col("token_id") < fits) & (F.octet_length("token") <= HEAD_TOKEN_BYTES))
                  .groupBy(F.floor(F.col("token_id") / HEAD_STEP).alias("step"))
                  .agg(F.sum(F.octet_length("token") + 8).alias("size")).collect())     # at most fits / HEAD_STEP rows
    total = n = 0
    for step, size in sorted(sizes):
        total += size
        if total > most_bytes:
            break
        n = (step + 1) * HEAD_STEP
    return n


def lookup_ids(df: DataFrame, tokens_col: str, vocab: DataFrame, out_col: str,
               head_tokens: int | None = None, keep_tokens: bool = True) -> DataFrame:
    """``df`` with ``out_col`` = the vocabulary ids of ``tokens_col`` (tokens
    that the vocabulary lacks get the unknown id; a NULL array stays NULL), and without
    ``tokens_col`` itself unless ``keep_tokens`` is set.

    The frequent tokens (``head_tokens`` of them; by default what ``HEAD_BYTES`` hold) are looked up per Arrow batch from a
    broadcast list. Only the positions that it leaves open go on: (row, position, token) meet the rest of the vocabulary
    by a shuffle join and come back as (position, id), so no other token is shuffled or written as text.
    """
    spark = df.sparkSession
    # both halves read the ranks: write them once
    vocab = stage(vocab.select("token", "token_id"), "vocabulary")
    if head_tokens is None:
        head_tokens = head_size(vocab)
    is_head = (F.col("token_id") < head_tokens) & (F.octet_length("token") <= HEAD_TOKEN_BYTES)
    head = vocab.where(is_head).select("token", "token_id").toArrow()      # measured: at most HEAD_BYTES of text
    head_bc = spark.sparkContext.broadcast((head["token"].combine_chunks().cast(pa.string()), head["token_id"].combine_chunks().cast(pa.int32())))
    kept = [f for f in df.schema.fields if keep_tokens or f.name != tokens_col]
    names = [f.name for f in kept]
    rest = vocab.where(~is_head).select("token", "token_id")
    open_type = "array<struct<position:int,token:string>>"
    schema = T.StructType([*kept, T.StructField(out_col, T.ArrayType(T.IntegerType()))])
    if vocab.count() == head.num_rows:                        # what the list lacks is unknown
        return df.mapInArrow(_lookup_batches(head_bc, uuid.uuid4().hex, tokens_col, names, out_col, None), schema)
    looked = df.mapInArrow(_lookup_batches(head_bc, uuid.uuid4().hex, tokens_col, names, out_col, "_open"),
                           T.StructType([*schema.fields, T.StructField("_open", T._parse_datatype_string(open_type))]))
    # written once, so that the row number means the same row in both readings
    looked = stage(looked.withColumn("_row", F.monotonically_increasing_id()), "token-ids")
    has_open = F.size("_open") > 0
    found = (looked.where(has_open).select("_row", F.inline("_open")).join(rest, "token")
                   .groupBy("_row").agg(F.collect_list(F.struct("position", "token_id")).alias("_found"))
                   .select("_row", F.col("_found.position").alias("_position"), F.col("_found.token_id").alias("_id")))
    # rows without such tokens skip the join
    names.append(out_col)
    plain = looked.where(~F.coalesce(has_open, F.lit(False))).select(*names)
    joined = looked.where(has_open).join(found, "_row", "left").select(*names, "_position", "_id")
    return plain.unionByName(joined.mapInArrow(_fill_batches(out_col), schema))


def _fill_batches(out_col: str):
    """``mapInArrow`` body: the ids found for a row, put at their positions; what is still open is unknown."""
    def run(batches):
        for batch in batches:
            ids, position, found = (batch[c] for c in (out_col, "_position", "_id"))
            offsets = ids.offsets.to_numpy() - ids.offsets[0].as_py()
            flat = pc.fill_null(ids.flatten(), UNK_ID).to_numpy(zero_copy_only=False).copy()
            per_row = pc.fill_null(pc.list_value_length(position), 0).to_numpy(zero_copy_only=False)
            at = np.repeat(offsets[:-1], per_row) + position.flatten().to_numpy(zero_copy_only=False)
            flat[at.astype(np.int64)] = found.flatten().to_numpy(zero_copy_only=False)
            out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            keep = [n for n in batch.schema.names if n not in (out_col, "_position", "_id")]
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in keep], out], names=[*keep, out_col])
    return run


def encode(df: DataFrame, text_col: str | None, vocab: DataFrame,
           max_length: int = C.DEFAULT_SEQUENCE_LENGTH, tokens_col: str | None = None,
           all_windows: bool = False) -> DataFrame:
    """Replaces ``text_col`` (or the token array ``tokens_col``) by
    ``n_tokens``, ``input_ids`` and ``attention_mask`` (both exactly
    ``max_length`` long, padded with the end-of-text id).

    A text keeps its first ``max_length`` tokens, as in the original encoder;
    with ``all_windows`` it gives one row for each run of ``max_length`` tokens,
    numbered by ``window_idx`` (a text without tokens gives one padded row).
    Text is tokenised in the JVM and dropped before the id lookup, so only the
    other columns and the token arrays cross into Python (Arrow batches).
    """
    if max_length <= 0:
        raise ValueError("max_length must be > 0")
    if tokens_col:
        tokens = df.withColumnRenamed(tokens_col, "_tokens") if tokens_col != "_tokens" else df
    else:
        tokens = with_columns_once(df, {"_tokens": tokenize(text_col)}).drop(text_col)
    tokens = tokens.withColumn("_tokens", F.coalesce("_tokens", F.array().cast("array<string>")))
    out = lookup_ids(tokens, "_tokens", vocab, "_ids", keep_tokens=False).withColumn("n_tokens", F.size("_ids"))
    if all_windows:
        last = F.greatest(F.ceil(F.col("n_tokens") / max_length) - 1, F.lit(0)).cast("int")
        out = out.withColumn("window_idx", F.explode(F.sequence(F.lit(0), last)))
        out = out.withColumn("_ids", F.slice("_ids", F.col("window_idx") * max_length + 1, F.lit(max_length)))
    input_ids, mask = lb.pad_truncate("_ids", max_length, PAD_ID)
    return (out.withColumn("input_ids", input_ids)
               .withColumn("attention_mask", mask)
               .drop("_ids"))


def encode_label_sets(df: DataFrame, label_col: str, sep: str = "|") -> tuple[DataFrame, DataFrame]:
    """Sparse label vectors: ``df`` with ``label_set`` (sorted indices) and ``label_idx``, and the label order as
    ``(label_idx, label)``. A row's size follows its own labels, whatever the number of labels."""
    order = stage(lb.label_order(df, label_col, sep), "label-order")
    sets = lb.label_sets(df, label_col, order, sep)
    return sets.withColumn("label_idx", lb.set_index("label_set")), order


def encode_labels(df: DataFrame, label_col: str, sep: str = "|") -> tuple[DataFrame, DataFrame]:
    """One-hot label vectors in sorted label order; returns (frame, label order
    as ``(label_idx, label)``). Each row holds an entry per label; with many labels use :func:`encode_label_sets`."""
    out, order = encode_label_sets(df, label_col, sep)
    one_hot = lb.dense_labels("label_set", order.count())
    return out.withColumn("one_hot", one_hot).select(*df.columns, "one_hot", "label_idx"), order


# ---------------------------------------------------------------------------
# Token-block packing
# ---------------------------------------------------------------------------

def with_separator(tokens: ColumnOrName) -> Column:
    """The tokens of a row and the separator that follows them (NULL: none)."""
    return F.concat(F.coalesce(_col(tokens), F.array().cast("array<string>")), F.array(F.lit(SEPARATOR)))


def pack_arrays(df: DataFrame, items_col: str, order_col: str, block_size: int, out_col: str = "tokens",
                rows_per_range: int = ROWS_PER_RANGE, keep_tail: bool = False) -> DataFrame:
    """Concatenate the arrays of every row in ``order_col`` order, leave out the
    very last item (the separator behind the last row) and cut the rest into
    blocks of ``block_size``. Returns ``(block_id, out_col)``. The incomplete
    tail is dropped as in the original job unless ``keep_tail`` is set.

    ``order_col`` may be of any sortable type; rows with equal keys are ordered
    by content. Plan: prefix sums run over ``(key, length)`` only. Starts are
    joined to the arrays by row number (the one shuffle of the arrays). Blocks
    that lie wholly inside a row are emitted where they are; only the first and
    last piece of a row are grouped (a block has at most ``block_size`` pieces).
    """
    if block_size <= 0:
        raise ValueError("block_size must be > 0")
    B = block_size
    staged = stage(df.select(F.col(order_col).alias("_key"), F.col(items_col).alias("_t"),
                             F.monotonically_increasing_id().alias("_row")).where(F.size("_t") > 0), "pack-items")
    lens = staged.select("_key", F.size("_t").cast("bigint").alias("_len"), F.xxhash64("_t").alias("_hash"), "_row")
    starts = prefix_sums(lens, [F.col("_key"), F.col("_hash"), F.col("_row")], F.col("_len"), "_start", rows_per_range)
    total = lens.agg(F.sum("_len")).first()[0] or 0
    usable = max(total - 1, 0)
    if not keep_tail:
        usable = usable // B * B
    placed = (starts.where(F.col("_start") < usable)
                    .select("_row", "_start", F.least(F.col("_start") + F.col("_len"), F.lit(usable)).alias("_end"))
                    .join(staged.select("_row", "_t"), "_row"))
    blocks = F.sequence(F.floor(F.col("_start") / B), F.floor((F.col("_end") - 1) / B))
    pieces = placed.select("_t", "_start", "_end", F.explode(blocks).alias("block_id"))
    lo = F.greatest(F.col("_start"), F.col("block_id") * B)
    hi = F.least(F.col("_end"), (F.col("block_id") + 1) * B)
    pieces = pieces.select("block_id", lo.alias("_lo"), hi.alias("_hi"),
                           F.slice("_t", (lo - F.col("_start") + 1).cast("int"), (hi - lo).cast("int")).alias(out_col))
    whole = F.col("_hi") - F.col("_lo") == F.least(F.lit(B), F.lit(usable) - F.col("block_id") * B)
    shared = (pieces.where(~whole).groupBy("block_id")
                    .agg(F.sort_array(F.collect_list(F.struct("_lo", out_col))).alias("_ps"))
                    .select("block_id", F.flatten(F.transform("_ps", lambda p: p[out_col])).alias(out_col)))
    return pieces.where(whole).select("block_id", out_col).unionByName(shared)


def pack_blocks(df: DataFrame, text_col: str, order_col: str = "doc_id",
                block_size: int = C.DEFAULT_BLOCK_SIZE, rows_per_range: int = ROWS_PER_RANGE,
                ids: bool = False, keep_tail: bool = False) -> DataFrame:
    """Token blocks of all texts in ``order_col`` order, one separator token
    between rows: ``(block_id, tokens)``, or ``(block_id, input_ids)`` with the
    ids of the corpus's own vocabulary when ``ids`` is set."""
    toks = with_columns_once(df.select(order_col, text_col), {"_tokens": with_separator(tokenize(text_col))})
    toks = toks.select(F.col(order_col), "_tokens")
    if not ids:
        return pack_arrays(toks, "_tokens", order_col, block_size, "tokens", rows_per_range, keep_tail)
    toks = stage(toks, "doc-tokens", "zstd")
    found = lookup_ids(toks, "_tokens", build_vocabulary(toks, None, tokens_col="_tokens"), "_ids", keep_tokens=False)
    blocks = pack_arrays(found, "_ids", order_col, block_size, "input_ids", rows_per_range, keep_tail)
    # the blocks read their staged ids; what these came from goes
    drop_stage(found)
    drop_stage(toks)
    return blocks
