"""Splittable readers against readers of whole files, at many split sizes."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import types as T

from pressline.sources import splits
from pressline.sources.articles import ARTICLE_SCHEMA
from pressline.sources.corpora import TOPIC_CSV_SCHEMA

ALPHABET = ["a", "b ", '"', '""', ",", "\n", "\n\n", "é", "{", "}", "[", "]", "\\", '\\"', " x", "}\n{", "'"]


def text(rng, most=30):
    return "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(most)))


@pytest.fixture()
def split_bytes(spark):
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    before = {k: spark.conf.get(k, None) for k in keys}

    def use(n):
        spark.conf.set(keys[0], str(n))
        spark.conf.set(keys[1], "1")
        spark.conf.set(keys[2], "1")
    yield use
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("size,n", [(13, 2), (400, 60), (1 << 20, 60)])
def test_csv_equals_one_task_reader(spark, tmp_path, split_bytes, size, n):
    rng = random.Random(size)
    rows = [(k % 5, text(rng), text(rng, 60)) for k in range(n)] + [(1, "x" * 2 * n, 'long "quoted"\n' * n), (2, "", "last")]
    for name, eol in (("a.csv", "\n"), ("b.csv", "\r\n")):
        buf = io.StringIO()
        csv.writer(buf, quoting=csv.QUOTE_ALL, lineterminator=eol).writerows(rows)
        (tmp_path / name).write_text(buf.getvalue(), newline="")
    (tmp_path / "c.csv").write_text('1,plain,unquoted\n\n2,"a ""b""",c')          # empty line, no line break at the end
    split_bytes(size)
    got = splits.read_quoted_csv(spark, str(tmp_path), TOPIC_CSV_SCHEMA)
    texts = splits.record_texts(spark, str(tmp_path / "a.csv"), splits.QUOTED_CSV)
    if size < 1000:
        assert splits._pieces(spark, str(tmp_path), splits.QUOTED_CSV).select("file", "start").distinct().count() > 10
    assert texts.count() == len(rows)
    expect = [*rows, *rows, (1, "plain", "unquoted"), (2, 'a "b"', "c")]
    blank = lambda r: tuple(x or None for x in r[1:])
    assert sorted(((r[0], *blank(r)) for r in got.collect()), key=repr) == sorted(((r[0], *blank(r)) for r in expect), key=repr)


@pytest.mark.parametrize("size,n", [(41, 2), (700, 60), (1 << 20, 60)])
def test_json_array_equals_whole_file_reader(spark, tmp_path, split_bytes, size, n):
    rng = random.Random(size)
    rows = []
    for k in range(n):
        r = {"source": {"id": f"s{k % 3}", "name": text(rng)}, "title": text(rng) if k % 4 else None, "url": f"u{k}", "content": text(rng, 80)}
        if k % 3 == 0:
            r |= {"urlToImage": text(rng), "nested": {"a": [{"b": "}"}, {"c": "]"}], "n": k}, "rank": k}
        rows.append(r)
    rows.append({"content": "z" * 5 * n, "title": "} { \\ \" ]" * n})
    for folder, dump in (("1", json.dumps(rows)), ("2", json.dumps(rows, indent=1, ensure_ascii=False)), ("3", "[]"), ("4", " [ ] \n"), ("5", json.dumps(rows[:1]) + "\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "articles.json").write_text(dump)
    split_bytes(size)
    whole = spark.read.schema(ARTICLE_SCHEMA).option("multiLine", True).json(f"{tmp_path}/*/articles.json")
    got = splits.read_json_arrays(spark, f"{tmp_path}/*/articles.json", ARTICLE_SCHEMA)
    names = [f.name for f in ARTICLE_SCHEMA.fields]
    assert sorted(map(repr, got.select(*names).collect())) == sorted(map(repr, whole.select(*names).collect()))
    assert got.count() == 2 * len(rows) + 1
    extra = {r.url: r.extra for r in got.where("file LIKE '%/1/articles.json'").collect()}
    for r in rows[:n]:
        more = extra[r["url"]]
        if "rank" in r:
            assert set(more) == {"urlToImage", "nested", "rank"} and more["urlToImage"] == r["urlToImage"]
            assert json.loads(more["nested"]) == r["nested"] and more["rank"] == str(r["rank"])
        else:
            assert more is None


def test_empty_folder_and_missing_quotes(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
    assert splits.read_quoted_csv(spark, str(tmp_path), schema).count() == 0
    (tmp_path / "f.csv").write_text('x,"open\nto the end')
    assert [tuple(r) for r in splits.read_quoted_csv(spark, str(tmp_path / "f.csv"), schema).collect()] == [("x", "open\nto the end")]
