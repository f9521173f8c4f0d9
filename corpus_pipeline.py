"""Corpus pipeline: five stages over ``documents``, each written and read again as the next one's input.

quality -> near duplicates -> decontamination -> mixing -> token shards. Every stage but the last returns the columns
of documents. ORACLE_SQL is None, since the trained classifier and the tokens have no SQL; the tests hold each stage against its operator
and brute force.

Edge cases follow the operators. Decisions are carried by row, not by doc_id, so rows without one, or that share one, are judged
each on its own. Rows without doc_id pass the near-duplicate stage (they have no component), and a
document id that occurs in several rows of one text keeps one of them.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline.llm import decontaminate, jaccard, mixing, quality, token_shards
from pressline.llm.common import read_table, small_side, stage

ORACLE_SQL = None


def packed(docs: DataFrame) -> DataFrame:
    """The rows as one column, so that no column of theirs clashes with those of a stage."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """The packed rows with row_id, a number of each row's own. They are written, so that the numbers stay the same in every read."""
    return stage(packed(docs).withColumn("row_id", F.monotonically_increasing_id()), f"pipeline-{name}-rows")


def without(rows: DataFrame, drop: DataFrame) -> DataFrame:
    """The documents' columns of the numbered rows whose row_id isn't in ``drop`` (one column, staged)."""
    return rows.join(small_side(drop.toDF("drop_id")), F.col("row_id") == F.col("drop_id"), "left_anti").select("row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (low quality or toxic) go."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest id stays; of rows with one id and no words, one."""
    rows = numbered(docs, "near-duplicates")
    own = F.when(F.col("row.doc_id").isNotNull(), F.col("row_id"))
    found = jaccard.jaccard_components(rows.select(own.alias("doc_id"), F.col("row.text").alias("text")))
    some = stage(found.where("doc_id <> component_id OR (doc_id IS NOT NULL AND n_shingles = 0)")
                 .select(F.col("doc_id").alias("member"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("group")), "pipeline-linked")
    heads = some.where("group IS NOT NULL").select(F.col("group").alias("member"), "group").distinct()
    members = stage(some.unionByName(heads), "pipeline-members")
    ids = rows.select("row_id", F.col("row.doc_id").alias("own_id")).join(small_side(members), F.col("row_id") == F.col("member")) \
        .select("row_id", "own_id", "group", F.when(F.col("group").isNull(), F.col("own_id")).alias("empty_id"))
    ids = stage(ids, "pipeline-member-ids")
    first = stage(ids.groupBy("group", "empty_id").agg(F.min(F.struct("own_id", "row_id")).alias("f")).select(F.col("f.row_id").alias("first_id")), "pipeline-first")
    drop = stage(ids.join(small_side(first), F.col("row_id") == F.col("first_id"), "left_anti").select("row_id"), "pipeline-duplicates")
    return without(rows, drop)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a window of a benchmark item go."""
    rows = numbered(docs, "decontamination")
    found = decontaminate.decontaminate(rows.select(F.col("row_id").alias("doc_id"), F.col("row.text").alias("text")), read_table(spark, sf_dir, "benchmark"))
    return without(rows, stage(found.where("contaminated").select("doc_id"), "pipeline-contaminated"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: once for each epoch that reaches it. A document that the cut takes in part
    stays whole; one that no epoch reaches goes."""
    rows = numbered(docs, "mixing")
    mixed = mixing.mix(rows.select("row_id", "row.doc_id", "row.text", "row.source"), carry=["row_id"])
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    # documents that the mix takes just once need no mark; empty texts, which have no words to take, stay
    other = stage(mixed.where((F.col("size") > 0) & (times != 1)).select(F.col("row_id").alias("mix_id"), times.alias("times")), "pipeline-mix")
    joined = rows.join(small_side(other), F.col("row_id") == F.col("mix_id"), "left")
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), F.coalesce("times", F.lit(1))))).select("row.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token shards in training order."""
    return token_shards.token_shards(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_shards", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
