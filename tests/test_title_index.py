"""Indexed title search equals the full scan; trees of required trigrams."""

import random

import pytest
from pyspark.sql import functions as F

from pressline.functions.text import title_matches
from pressline.operators import title_index as ti
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("pattern,tree", [
    ("abcd", ("and", ["abc", "bcd"])), ("Ab", None), ("abc|xyz", ("or", ["abc", "xyz"])), ("abc|x", None), ("(abc)d", ("and", ["abc", "bcd"])),
    ("(abc|xyz)+def", ("and", [("or", ["abc", "xyz"]), "def"])), ("(abc)*def", "def"), ("ab[cd]ef", None), ("a.c", None), ("^the end$", ("and", ["the", "he ", "e e", " en", "end"])),
    ("abé abc", ("and", [" ab", "abc"])), (r"\Qa.b\E", None), (r"a\.b", "a.b"), ("ab{0,2}cde", "cde"), ("(?:abc)?", None), ("K\u212aLM", ("and", ["kkl", "klm"])), ("", None),
    ("a[b[c]]def", None), ("(?x) a b c", None), (r"abc\1", None), ("(abc", None)])
def test_required_trigrams(pattern, tree):
    assert ti.required(pattern) == tree


PARTS = ["the", "The", "ion", "e t", "o", "th", "que", "[ae]", "[^x]", ".", ".*", "\\w+", "\\s", "é", "ñ", "K", "der", "ung", ",", "\\.", "er|en", "(ent|the)", "(tion)?", "(an|en)+", "^", "$", "\\b", "e{1,2}", "ſ"]


def test_random_patterns_equal_full_scan(spark, tmp_path, monkeypatch):
    rng = random.Random(11)
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    titles = d.select(F.substring_index("text", "\n", 1).alias("title"), F.col("source").alias("source_id"), F.concat(F.lit("2020-04-2"), (F.col("doc_id") % 9).cast("string")).alias("query_date"))
    more = spark.createDataFrame([(None, "s", "2020-04-22"), ("", "s", "2020-04-22"), ("ab", "s", "2020-04-22"), ("THE \u212aing of Pa\u017fs", "s", "2020-04-22"), ("İstanbul ılık", "s", "2020-04-23"),
                                  ("twice", "s", "2020-04-22"), ("twice", "s", "2020-04-22")], titles.schema)
    a = titles.unionByName(more).coalesce(2).cache()
    monkeypatch.setattr(ti, "BUCKETS", 2)
    ti.build_title_index(a, str(tmp_path))
    patterns = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 6))) for _ in range(200)] + ["king of pass", "KING", "istanbul", "twice", ""]
    indexed = [p for p in dict.fromkeys(patterns) if p and ti.required(p) is not None]
    assert len(indexed) > 80
    for start in range(0, len(indexed), 30):
        some = indexed[start:start + 30]
        tests = [title_matches("title", p, case) for p in some for case in (False, True)]
        full = a.select(*[F.count_if(t) for t in tests]).first()
        found = None
        for i, p in enumerate(some):
            one = ti.candidates(spark, str(tmp_path), p).withColumn("i", F.lit(i))
            found = one if found is None else found.unionByName(one)
        keyed = a.withColumn("title_hash", F.xxhash64("title")).join(found, ["title_hash", "source_id", "query_date"])
        got = keyed.select(*[F.count_if((F.col("i") == k // 2) & t) for k, t in enumerate(tests)]).first()
        for k, (x, y) in enumerate(zip(got, full, strict=True)):
            assert x == y, (some[k // 2], k % 2)
    for p, case in (("king of pass", False), ("twice", True), ("istanbul", False), ("", False), ("th[ae]", False)):
        want = sorted(map(tuple, a.where(title_matches("title", p, case)).collect()), key=repr)
        assert sorted(map(tuple, ti.search_titles(a, str(tmp_path), p, case).collect()), key=repr) == want
    report = ti.search_report(a, str(tmp_path), "king of", False).first()
    assert report.n_matched == 1 and report.n_verified < 20 and report.n_trigrams == 5
