"""Kept counts equal a full pass after random overwrites, and a refresh reads the changed cells only."""

import datetime as dt
import random

from pyspark.sql import functions as F

from pressline.operators import kept as K
from pressline.operators import profile as pr
from pressline.sources import articles as ar

SCHEMA = "title string, url string, published_at timestamp, scraped boolean, error boolean, query_date string, source_id string"


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_random_overwrites(spark, tmp_path):
    rng = random.Random(7)
    table, kept = str(tmp_path / "table"), str(tmp_path / "kept")
    cells = [(f"2020-04-2{d}", s) for d in range(2, 6) for s in ("a", "007", "x:y z+")]
    base = dt.datetime(2020, 4, 22)

    def listing(day, s):
        return [(rng.choice([None, "t"]), f"u{rng.random()}", rng.choice([None, base + dt.timedelta(hours=rng.randrange(60))]), rng.choice([None, True, False]),
                 rng.choice([None, True, False]), day, s) for _ in range(rng.randrange(1, 5))]
    ar.write_partitioned(spark.createDataFrame([r for c in cells for r in listing(*c)], SCHEMA), table)
    schema = spark.createDataFrame([], SCHEMA).schema
    K.refresh(spark, table, kept, schema)
    for turn in range(5):
        chosen = rng.sample(cells, 10)
        empty, full = chosen[:2], chosen[2:]
        ar.write_partitioned(spark.createDataFrame([r for c in full for r in listing(*c)], SCHEMA), table)
        ar.drop_cells(spark.createDataFrame(empty, "query_date string, source_id string"), table)
        changes = K.refresh(spark, table, kept, schema)
        touched = {(r.query_date, r.source_id) for r in changes.select("query_date", "source_id").distinct().collect()}
        assert touched <= set(chosen)
        whole, counts = ar.read_partitioned(spark, table), K.kept_counts(spark, kept)
        profile = ("source_id", "query_date", "n_articles", "n_scraped", "n_errors")
        assert rows_of(K.kept_profile(counts), *profile) == rows_of(pr.cell_profile(whole), *profile), turn
    assert rows_of(K.kept_hours(counts), "source_id", "hour", "n") == rows_of(pr.hour_histogram(whole), "source_id", "hour", "n")
    full = pr.non_null_counts(whole, [F.date_format("published_at", "yyyy-MM-dd").alias("day"), "source_id"], [c for c in whole.columns if c not in ("query_date", "source_id")])
    assert rows_of(K.kept_daily(counts), *full.columns) == rows_of(full, *full.columns)
    assert K.kept_total(counts).first()[0] == whole.where("scraped").count()
    assert K.refresh(spark, table, kept, schema).count() == 0                   # nothing changed


def test_refresh_reads_changed_cells_only(spark, tmp_path):
    table = str(tmp_path / "table")
    ar.write_partitioned(spark.createDataFrame([("t", "u", None, True, None, "2020-04-22", s) for s in "abc"], SCHEMA), table)
    schema = spark.createDataFrame([], SCHEMA).schema
    dirs = [r.dir for r in K.fingerprints(spark, table).where("source_id = 'b'").collect()]
    read = K.read_cells(spark, table, dirs, schema)
    assert {f.split("source_id=")[1][0] for f in read.inputFiles()} == {"b"} and [r.source_id for r in read.collect()] == ["b"]


def test_lost_refresh_leaves_the_old_counts(spark, tmp_path):
    table, kept = str(tmp_path / "table"), str(tmp_path / "kept")
    ar.write_partitioned(spark.createDataFrame([("t", "u", None, True, None, "2020-04-22", "a")], SCHEMA), table)
    schema = spark.createDataFrame([], SCHEMA).schema
    K.refresh(spark, table, kept, schema)
    spark.range(3).write.parquet(f"{kept}/v=1/counts")                            # lost before its cells were written
    assert K.latest(spark, kept) == 0 and K.kept_total(K.kept_counts(spark, kept)).first()[0] == 1
    ar.write_partitioned(spark.createDataFrame([("t", "u", None, False, None, "2020-04-22", "a")], SCHEMA), table)
    K.refresh(spark, table, kept, schema)
    assert K.latest(spark, kept) == 1 and K.kept_total(K.kept_counts(spark, kept)).first()[0] == 0
