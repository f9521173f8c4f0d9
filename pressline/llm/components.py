"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressline.llm.common import stage


def _star(edges: DataFrame) -> DataFrame:
    """Every neighbour of u above u is tied to the least of u and its neighbours; then, of the edges
    directed downwards, all that u sees is tied to the least it sees. Only minima are grouped, so a vertex of many
    links makes no large group; the joins on u are split by adaptive execution if it is hot."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    large = (both.join(least, F.col("u") == F.col("w")).where(F.col("v") > F.col("u"))
             .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    low = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
    small = down.join(low, F.col("u") == F.col("w")).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(low.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v: long) but the roots, which are the components' least nodes."""
    now = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen, now = mark, stage(_star(now), "links")
