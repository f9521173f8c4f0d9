"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key. Within a source the documents are laid out by that key in
buckets of about ``ROWS_PER_BUCKET`` rows (the key is uniform, so buckets stay even however large a
source is), the word counts' prefix sum is the sum over earlier buckets plus the sum inside the
bucket, and each source is cut at its exact budget: whole epochs first, then the first documents of
the order, the last of them in part.

Edge cases: a null or empty text has size 0 and takes 0; documents without a source form the last
source; repeated rows are mixed like any others, each row on its own; rows with the same key are
ordered by doc_id and size, so equal rows are interchangeable; an empty table gives an empty result;
columns besides doc_id, text and source are ignored. If all texts are empty, all targets are 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressline.llm.common import read_table, small_side, stage
from pressline.llm.registry import register

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5          # of all sizes, in total
MAX_EPOCHS = 2       # a source's target is at most so many times its size
ROWS_PER_BUCKET = 4096


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: source, source_size, n_rows, target.

    The targets solve ``target = min(cap, level * weight)`` with their sum at the share: sources in
    the order of cap / weight, the level after capping the first k is (total - their caps) / (the
    other weights), and a source is capped if its cap lies below the level that it would get.
    ``sizes`` has a source and a size column; the windows below run over one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    per = (per.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
           .withColumn("caps_before", F.coalesce(F.sum("cap").over(order), F.lit(0)))
           .withColumn("weights_left", F.sum("weight").over(everything)
                       - F.coalesce(F.sum("weight").over(order), F.lit(0)))
           .withColumn("level", (F.col("total") - F.col("caps_before")) / F.col("weights_left"))
           .withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
           .withColumn("final", F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "source", "level")))
                       .over(everything)["level"]))
    return per.select("source", "source_size", "n_rows",
                      F.when(F.col("capped"), F.col("cap").cast("double"))
                      .otherwise(F.col("final") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
        max_epochs: int = MAX_EPOCHS, carry: Sequence[str] = ()) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, and the columns ``carry``, which also order equal rows."""
    sizes = stage(docs.select("doc_id", "source", *carry,
                              F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                              F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key")), "mix-sizes")
    targets = small_side(stage(source_targets(sizes, weights, share, max_epochs), "mix-targets"))
    t = targets.select(F.col("source").alias("t_source"), "source_size", "n_rows", "target")
    # the key's first 48 bits as a fraction pick one of the source's buckets, in key order
    part = F.conv(F.substring("key", 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))
    laid = (sizes.join(t, F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_source")
            .withColumn("bucket", F.floor(part * F.ceil(F.col("n_rows") / ROWS_PER_BUCKET)).cast("long")))
    inside = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_first(), "size", *carry) \
        .rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (laid.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
              .select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"),
                      F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("start")))
    placed = (laid.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(starts, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket"))))
    before = F.col("start") + F.col("within")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *carry)


def mix_sql(docs: str) -> str:
    """DuckDB: the same cut from window sums over whole sources. ``docs`` names a relation."""
    return f"""
    mix_sizes AS (SELECT doc_id, source,
        coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
        md5(coalesce(doc_id::VARCHAR, '')) AS key FROM {docs}),
    mix_per AS (SELECT source, sum(size)::BIGINT AS source_size FROM mix_sizes GROUP BY source),
    mix_ranked AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)] AS weight FROM mix_per),
    mix_caps AS (SELECT *, 2 * source_size AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM mix_ranked),
    mix_levels AS (SELECT *, (total - coalesce(sum(cap) OVER o, 0)::DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
        FROM mix_caps WINDOW o AS (ORDER BY cap::DOUBLE / weight, encode(source) NULLS LAST
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    mix_final AS (SELECT arg_min(level, row(cap::DOUBLE / weight, encode(source))) AS final FROM mix_levels
        WHERE NOT cap <= level * weight),
    mix_targets AS (SELECT source, source_size,
        CASE WHEN cap <= level * weight THEN cap::DOUBLE ELSE final * weight END AS target
        FROM mix_levels LEFT JOIN mix_final ON true),
    mix_placed AS (SELECT s.*, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
            coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id NULLS FIRST, size
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
        FROM mix_sizes s JOIN mix_targets t ON s.source IS NOT DISTINCT FROM t.source),
    mixed AS (SELECT doc_id, size, source_size, target,
        (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
         + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END
            * source_size - before)))::BIGINT AS taken FROM mix_placed)"""


@register("op3_mixing", f"WITH {mix_sql('documents')} SELECT doc_id, size, source_size, target, taken FROM mixed")
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).drop("source")
