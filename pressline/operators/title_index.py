"""Title search over a trigram index.

The index holds, per trigram of a title's folded text, the titles (by hash) and the cells in which they stand. A pattern
gives an and/or tree of trigrams that every match must hold; the tree is tested against the postings of its
trigrams only, and the regular expression is run over the rows of the titles that are left. A pattern that requires no trigram, or that
is written in a way whose meaning isn't certain, searches all titles. Either way the result is that of the full scan.

Folding follows the case-insensitive search: A-Z, and the four letters that fold to ASCII ones. Required trigrams are printable ASCII, so
whatever else a title holds can't lose a match. The tree serves searches with and without case.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline.functions.text import title_matches
from pressline.operators.ingest import CELL

BUCKETS = 64
INDEX_SCHEMA = "trigram string, title_hash long, source_id string, query_date string, bucket int"
# FIXED VALUES: letters beyond ASCII that match an ASCII letter without case.
FOLD_FROM, FOLD_TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\u212a\u017f\u0130\u0131", "abcdefghijklmnopqrstuvwxyzksii"
#: Spellings that the two regular expression dialects read differently: octal and back references, classes within
#: classes, comments mode, quoting.
UNSURE = re.compile(r"\\[0-9QEvhHRXGZzpPkN]|\[[^\]]*\[|&&|\(\?[a-z]*x|\[\]|\[\^\]")


def folded(title: Column) -> Column:
    return F.translate(title, FOLD_FROM, FOLD_TO)


def trigrams(title: Column) -> Column:
    """Distinct trigrams of the folded title, in one pass of the expression over it."""
    return F.array_distinct(F.regexp_extract_all(folded(title), F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def build_title_index(articles: DataFrame, path: str) -> None:
    """Write the index of ``articles`` (title and cell): bucket, trigram, title hash, cell."""
    titles = articles.where("title IS NOT NULL").select(F.xxhash64("title").alias("title_hash"), "title", *CELL).distinct()
    rows = titles.select(F.explode(trigrams(F.col("title"))).alias("trigram"), "title_hash", *CELL)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("trigram"), F.lit(BUCKETS)).cast("int"))
    # a frequent trigram's rows are spread by title as well, so no bucket is one task
    (rows.repartition("bucket", F.pmod("title_hash", F.lit(16))).sortWithinPartitions("bucket", "trigram")
         .write.mode("overwrite").partitionBy("bucket").parquet(path))


# ---- patterns

def required(pattern: str):
    """The and/or tree of trigrams that each match of ``pattern`` holds: ("and" | "or", [...]), a trigram, or None for no requirement."""
    if UNSURE.search(pattern):
        return None
    try:
        tree = re._parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    return _joined("and", _sequence(tree))


def _joined(kind: str, nodes: list):
    """``None`` among "or" nodes leaves no requirement; among "and" nodes it adds none."""
    if kind == "or" and any(n is None for n in nodes):
        return None
    nodes = [n for n in nodes if n is not None]
    unique = list(dict.fromkeys(map(repr, nodes)))
    nodes = [next(n for n in nodes if repr(n) == u) for u in unique]
    return None if not nodes else nodes[0] if len(nodes) == 1 else (kind, nodes)


def _runs(text: str) -> list[str]:
    """Trigrams of the printable ASCII runs of a literal text, folded."""
    text = text.translate(str.maketrans(FOLD_FROM, FOLD_TO))
    return [w[i:i + 3] for w in re.findall(r"[\x20-\x7e]+", text) for i in range(len(w) - 2)]


def _sequence(tree) -> list:
    found, literal = [], ""
    for op, arg in tree:
        name = str(op)
        if name == "SUBPATTERN" and all(str(o) == "LITERAL" for o, _ in arg[3]):
            literal += "".join(chr(c) for _, c in arg[3])
            continue
        if name == "LITERAL":
            literal += chr(arg)
            continue
        found += _runs(literal)
        literal = ""
        if name == "SUBPATTERN":
            found.append(_joined("and", _sequence(arg[3])))
        elif name == "ATOMIC_GROUP":
            found.append(_joined("and", _sequence(arg)))
        elif name == "BRANCH":
            found.append(_joined("or", [_joined("and", _sequence(b)) for b in arg[1]]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            found.append(_joined("and", _sequence(arg[2])))
    return found + _runs(literal)


def leaves(tree) -> list[str]:
    if tree is None:
        return []
    return [tree] if isinstance(tree, str) else sorted({t for n in tree[1] for t in leaves(n)})


def _holds(tree, names: list[str]) -> Column:
    if isinstance(tree, str):
        return F.col(f"_t{names.index(tree)}")
    parts = [_holds(n, names) for n in tree[1]]
    return reduce((lambda a, b: a & b) if tree[0] == "and" else (lambda a, b: a | b), parts)


def candidates(spark: SparkSession, index_path: str, pattern: str) -> DataFrame | None:
    """title_hash and cell of the titles that hold the pattern's trigrams; None if it requires none."""
    tree = required(pattern)
    if tree is None:
        return None
    names = leaves(tree)
    # constants, so the buckets are folded into a partition filter
    buckets = [F.col("bucket") == F.pmod(F.xxhash64(F.lit(t)), F.lit(BUCKETS)).cast("int") for t in names]
    read = spark.read.schema(INDEX_SCHEMA).parquet(index_path).where(reduce(lambda x, y: x | y, buckets) & F.col("trigram").isin(names))
    per = read.groupBy("title_hash", *CELL).agg(*[F.bool_or(F.col("trigram") == t).alias(f"_t{i}") for i, t in enumerate(names)])
    return per.where(_holds(tree, names)).select("title_hash", *CELL)


def search_titles(articles: DataFrame, index_path: str, pattern: str, case_sensitive: bool = False) -> DataFrame:
    """The rows of ``articles`` whose title matches, as ``title_matches`` finds them over all titles."""
    found = candidates(articles.sparkSession, index_path, pattern) if pattern else None
    verified = title_matches("title", pattern, case_sensitive)
    if found is None:
        return articles.where(verified)
    keyed = articles.withColumn("_hash", F.xxhash64("title"))
    return keyed.join(found.withColumnRenamed("title_hash", "_hash"), ["_hash", *CELL], "left_semi").where(verified).select(*articles.columns)


def search_report(articles: DataFrame, index_path: str, pattern: str, case_sensitive: bool = False) -> DataFrame:
    """One row: trigrams required, index rows read, rows verified by the expression, and rows matched."""
    spark = articles.sparkSession
    names = leaves(required(pattern) if pattern else None)
    found = candidates(spark, index_path, pattern) if pattern else None
    keyed = articles.withColumn("_hash", F.xxhash64("title"))
    verified = keyed if found is None else keyed.join(found.withColumnRenamed("title_hash", "_hash"), ["_hash", *CELL], "left_semi")
    index_rows = spark.read.schema(INDEX_SCHEMA).parquet(index_path).where(F.col("trigram").isin(names)).count() if names else 0
    return verified.agg(F.lit(len(names)).alias("n_trigrams"), F.lit(index_rows).cast("long").alias("n_index_rows"), F.count(F.lit(1)).alias("n_verified"),
                        F.count_if(title_matches("title", pattern, case_sensitive)).alias("n_matched"))
