"""Exact, reproducible sampling, splitting, shuffling and ranking.

Randomness is a seeded hash: ``md5(seed || ':' || id)`` orders the rows. The same
bytes come out of Spark and DuckDB, so results are checkable, and no task
depends on ``rand()`` or on partition layout.

Scale notes
-----------
* Samples and splits of every size find the exact n-th key from hash-prefix
  histograms. md5 is uniform, so prefix buckets are balanced; each histogram is
  at most 65,536 rows (a fixed bound), reads only the id column, and the final
  selection is a filter that runs in every task.
* Rows that share the n-th key (a repeated or NULL id) are told apart by a hash
  of the whole row, then by row number; only those rows are staged for it. Rows
  that are alike in every column are interchangeable.
* Global ranks (batch shuffling) use per-prefix-bucket counts as offsets plus a
  row number inside each bucket, never one window over all rows. The number of
  buckets follows the number of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressline import constants as C
from pressline.plans.stage import stage

KEY = "_sample_key"
HEX_STEP = 4            # hex digits added per histogram pass (65,536 buckets)


def hash_key(id_col: str | Column, seed: str = C.DEFAULT_SEED, *salts) -> Column:
    """``md5(seed:[salt:]...id)`` as lowercase hex."""
    parts = [F.lit(str(seed))] + [s if isinstance(s, Column) else F.lit(str(s)) for s in salts]
    idc = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat_ws(":", *parts, idc.cast("string")))


def _histogram(df: DataFrame, prefix: str, digits: int) -> list[tuple[str, int]]:
    start = len(prefix) + 1
    scoped = df if not prefix else df.where(F.substring(KEY, 1, len(prefix)) == prefix)
    rows = (scoped.groupBy(F.substring(KEY, start, digits).alias("d"))
                  .agg(F.count(F.lit(1)).alias("n"))
                  .collect())          # at most 16**digits rows
    return sorted((r["d"], r["n"]) for r in rows)


def kth_key(df: DataFrame, k: int, first_hist: list[tuple[str, int]] | None = None,
            key_digits: int = 32) -> tuple[str, int, int]:
    """Exact k-th smallest value (1-based) of the hex column ``KEY`` as ``(key,
    rows needed at this key, rows at this key)``.

    Each pass adds ``HEX_STEP`` digits. A prefix that holds one row is enough to
    read the key itself. ``first_hist`` is the whole-table histogram when the
    caller already has it."""
    prefix, need = "", k
    while True:
        hist = first_hist if first_hist is not None and not prefix else _histogram(df, prefix, HEX_STEP)
        before = 0
        for digit, n in hist:
            if before + n >= need:
                break
            before += n
        else:
            raise ValueError(f"k={k} exceeds the number of rows")
        prefix += digit
        need -= before
        if len(prefix) >= key_digits:
            return prefix, need, n
        if n == 1:
            return df.where(F.substring(KEY, 1, len(prefix)) == prefix).select(KEY).first()[0], 1, 1


def _mark_first(df: DataFrame, k: int, id_col: str, seed: str, total: int | None = None,
                hist: list[tuple[str, int]] | None = None) -> DataFrame:
    """``df`` with boolean ``_first``: true on exactly the ``k`` rows that come
    first in the seeded hash order (0 <= k <= rows)."""
    keyed = df.withColumn(KEY, hash_key(id_col, seed))
    if k <= 0:
        return df.withColumn("_first", F.lit(False))
    if k >= total:
        return df.withColumn("_first", F.lit(True))
    t, need, at = kth_key(keyed, k, hist)
    if need == at:
        return keyed.withColumn("_first", F.col(KEY) <= t).drop(KEY)
    # several rows share the k-th key: order just those by content, then by row number
    content = F.md5(F.to_json(F.struct(*[df[c] for c in df.columns]), {"ignoreNullFields": "false"}))
    number = F.md5(F.monotonically_increasing_id().cast("string"))
    ties = stage(keyed.where(F.col(KEY) == t).withColumn(KEY, F.concat(content, number)), "sample-ties")
    last, _, _ = kth_key(ties, need, key_digits=64)
    return (keyed.where(F.col(KEY) != t).withColumn("_first", F.col(KEY) < t)
                 .unionByName(ties.withColumn("_first", F.col(KEY) <= last)).drop(KEY))


def _first_histogram(df: DataFrame, id_col: str, seed: str) -> tuple[list[tuple[str, int]], int]:
    hist = _histogram(df.select(hash_key(id_col, seed).alias(KEY)), "", HEX_STEP)
    return hist, sum(n for _, n in hist)


def sample_exact(df: DataFrame, n: int, id_col: str = "doc_id", seed: str = C.DEFAULT_SEED,
                 strict: bool = True) -> DataFrame:
    """Exactly ``n`` rows without replacement, chosen by the seeded hash order.

    ``strict`` raises when ``n`` exceeds the number of rows (as the original
    sampler does); otherwise all rows are taken. Repeated ids count as the rows
    they are.
    """
    if n < 0:
        raise ValueError("n must be >= 0")
    hist, total = _first_histogram(df, id_col, seed)
    if strict and total < n:
        raise ValueError(f"cannot take a sample of {n} from {total} rows")
    return _mark_first(df, n, id_col, seed, total, hist).where("_first").drop("_first")


def split_exact(df: DataFrame, train_share: float, id_col: str = "doc_id",
                seed: str = C.DEFAULT_SEED, side_col: str = "side") -> DataFrame:
    """Tag ``int(train_share * n)`` rows ``train`` and the rest ``validation``.

    One DataFrame with a side column: the validation side is the complement, so
    the two never overlap and no anti join is needed.
    """
    if train_share > 1:
        raise ValueError("train share cannot be > 1")
    # the whole-table histogram gives the row count and the first search step
    hist, total = _first_histogram(df, id_col, seed)
    marked = _mark_first(df, int(train_share * total), id_col, seed, total, hist)
    return marked.withColumn(side_col, F.when(F.col("_first"), "train").otherwise("validation")).drop("_first")


def _prefix_digits(total: int, rows_per_bucket: int = 200_000) -> int:
    if total <= rows_per_bucket:
        return 1
    return max(1, math.ceil(math.log(total / rows_per_bucket, 16)))


def global_rank(df: DataFrame, key: Column, id_col: str, partition_cols: list[str] | None = None,
                rank_col: str = "rank") -> DataFrame:
    """1-based rank of each row by a uniform hex hash ``key`` (ties by id).

    Offsets per (partition, hash-prefix bucket) come from a count table
    (<= groups * 16**digits rows; the planner broadcasts it when it is small);
    inside each bucket a row number finishes the rank. Work per task is
    ~ rows / 16**digits.
    """
    parts = partition_cols or []
    keyed = df.withColumn(KEY, key)
    total = df.count()
    digits = _prefix_digits(total)
    bucket = F.substring(KEY, 1, digits)
    keyed = keyed.withColumn("_bucket", bucket)
    counts = keyed.groupBy(*parts, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w_off = Window.partitionBy(*parts).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*parts, "_bucket",
                            F.coalesce(F.sum("_n").over(w_off), F.lit(0)).alias("_offset"))
    w_in = Window.partitionBy(*parts, "_bucket").orderBy(KEY, id_col)
    ranked = (keyed.join(offsets, [*parts, "_bucket"])
                   .withColumn(rank_col, F.col("_offset") + F.row_number().over(w_in)))
    return ranked.drop(KEY, "_bucket", "_offset")


def shuffle_batches(df: DataFrame, batch_size: int, epochs: int = 1, id_col: str = "doc_id",
                    seed: str = C.DEFAULT_SEED) -> DataFrame:
    """Per epoch, a seeded shuffle cut into batches of ``batch_size`` (last may be short).

    Adds ``epoch``, ``position`` (1-based) and ``batch_id`` (0-based).
    """
    if batch_size <= 0:
        raise ValueError("batch_size must be > 0")
    if epochs < 0:
        raise ValueError("epochs must be >= 0")
    # no epochs, no rows (a sequence from 0 to -1 would count down)
    numbers = F.sequence(F.lit(0), F.lit(epochs - 1)) if epochs else F.array().cast("array<int>")
    per_epoch = df.withColumn("epoch", F.explode(numbers))
    key = hash_key(id_col, seed, F.col("epoch"))
    ranked = global_rank(per_epoch, key, id_col, ["epoch"], rank_col="position")
    return ranked.withColumn("batch_id", F.floor((F.col("position") - 1) / batch_size).cast("bigint"))


def sample_count_accounting(n_rows: Column, batch_size: int) -> Column:
    """Samples a batch loader reports: ``ceil(n / b) * b``."""
    return (F.ceil(n_rows / F.lit(batch_size)) * F.lit(batch_size)).cast("bigint")
