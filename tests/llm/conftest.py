import pytest

WORDS = [f"w{k}x" for k in range(400)]


def prose(start, n, step=7):
    return " ".join(WORDS[(start + k * step + k * k) % len(WORDS)] for k in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """doc_id, text, lang, source: nulls, empty and very long texts, copies, near copies, ties, few words."""
    long = prose(3, 60_000, 11)
    near = prose(5, 80).split()
    rows = [(1, prose(1, 60), "en", "a"), (2, prose(1, 60).upper(), "en", "a"), (3, None, "en", "b"), (4, "", None, "b"), (5, " \t\n", "de", None),
            (6, long, "en", "a"), (7, long + " tail", "en", None), (8, "one two", "en", "b"), (9, "One  two", "en", "b"), (10, "ünï çödé ß", "de", "c"),
            (None, prose(1, 60), None, "c"), (11, prose(9, 40), "en", "a"), (11, prose(9, 40), "en", "a"), (12, prose(2, 30), "fr", "c")]
    for k in range(12):
        rows.append((20 + k, " ".join(w if p != 6 * k + 3 else f"edit{k}" for p, w in enumerate(near)), "en", "a"))
    for k in range(6):
        rows.append((40 + k, " ".join(w if p % 20 != k else f"far{k}" for p, w in enumerate(near)), "en", "a"))
    return rows


DOC_SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, DOC_SCHEMA)


@pytest.fixture(scope="session")
def clashing(edge_docs):
    """The same rows with further columns named like those that operators make."""
    from pyspark.sql import functions as F
    names = ["size", "row", "cls", "n", "key", "bucket", "target", "taken", "words", "keep", "posterior", "spans", "slot", "host", "path", "line", "rep", "mix_id", "times", "id"]
    return edge_docs.select("*", *[F.lit("x").alias(n) for n in names])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
