"""Whole files are listed and read by tasks, and count as Spark's own readers count them."""

import collections
import glob
import gzip
import os

import pytest
from pyspark.sql import functions as F

from pressline.plans import queries_files as qf
from pressline.plans.stage import drop_stage, scratch_path, stage
from pressline.sources import corpora as co
from pressline.sources import files as fl


def put(root, name, content):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content)


@pytest.fixture
def tree(tmp_path):
    root = str(tmp_path / "odd é%20 root")
    for name, content in [("pos/1.txt", b"good\n\nfilm"), ("a b/1 é%.txt", b"x\n"), ("_label=1/2.txt", "é".encode()), ("top.txt", b"t"), ("neg/deep/er/3.txt", b"d"),
                          ("_hid/4.txt", b"h"), (".h/5.txt", b"h"), ("_metadata_d/6.txt", b"m"), ("neg/_f.txt", b"h"), ("neg/_f=.txt", b"e"), ("neg/.g", b"h"), ("neg/empty.txt", b""), ("neg/c._COPYING_", b"c"), ("neg/_metadata", b"m")]:
        put(root, name, content)
    os.makedirs(f"{root}/neg/none")
    os.symlink(f"{root}/top.txt", f"{root}/neg/link.txt")
    return root


def by_spark(monkeypatch, read):
    with monkeypatch.context() as m:
        m.setattr(co, "task_root", lambda *_: None)
        return read()


def labelled(spark, root):
    return sorted((r.path, r.doc_id, r.text, r.label) for r in co.read_labelled_dirs(spark, root).collect())


def test_labelled_dirs_as_spark_reads_them(spark, tree, monkeypatch):
    assert fl.task_root(spark, tree)
    found = labelled(spark, tree)
    assert found == by_spark(monkeypatch, lambda: labelled(spark, tree)) and len(found) == 8
    put(tree, "pos/packed.gz", gzip.compress(b"unpacked"))            # left to Spark, which unpacks it
    found = labelled(spark, tree)
    assert found == by_spark(monkeypatch, lambda: labelled(spark, tree)) and any(r[2] == "unpacked" for r in found)


def test_other_roots_are_left_to_spark(spark, tree):
    assert fl.task_root(spark, f"{tree}/*") is None and fl.task_root(spark, f"{tree}/pos/1.txt") is None and fl.task_root(spark, f"{tree}/gone") is None
    assert {r[2] for r in labelled(spark, f"{tree}/po*")} == {"good\n\nfilm"}


def test_manifest_files_as_spark_reads_them(spark, tree, tmp_path, monkeypatch):
    manifest = str(tmp_path / "manifest.txt")

    def read(*names):
        with open(manifest, "w") as f:
            f.write("\n".join(names))
        return sorted(map(tuple, co.read_manifest_files(spark, manifest, tree).collect()))
    names = ["a b/1 é%.txt", "top.txt", "", "top.txt", "./top.txt", "neg//_f=.txt", "neg/././link.txt", "_metadata_d/6.txt", "_label=1/2.txt"]
    assert read(*names) == by_spark(monkeypatch, lambda: read(*names)) and len(read(*names)) == 8
    assert read("") == []
    for name in ["neg/empty.txt", "neg/_f.txt", "_hid/4.txt", "neg/../top.txt", "/top.txt", "top.txt/", "neg", "gone.txt", "neg/."]:
        for run in (read, lambda *n: by_spark(monkeypatch, lambda: read(*n))):
            with pytest.raises(FileNotFoundError, match="no file for"):
                run("top.txt", name)


def written(spark, root, n):
    rows = spark.range(0, n, 1, 2).select(F.lit("x").alias("folder"), F.col("id").cast("string").alias("text"))
    return qf.write_text_files(rows, root)


def test_tasks_and_driver_do_not_follow_files(spark, tmp_path, monkeypatch):
    root, manifest = str(tmp_path / "root"), str(tmp_path / "manifest")
    names = written(spark, root, 400)
    names.write.text(manifest)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    try:
        for df in (co.read_labelled_dirs(spark, root), co.read_manifest_files(spark, manifest, root)):
            assert sorted(r.text for r in df.select("text").collect()) == sorted(f"{k}\n" for k in range(400))
            assert not [f for f in df.inputFiles() if root in f]            # no list of them on the driver
            assert df.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        monkeypatch.setattr(fl, "FILES_PER_TASK", 20)
        assert co.read_labelled_dirs(spark, root).rdd.getNumPartitions() == 20
        monkeypatch.setattr(fl, "BYTES_PER_TASK", 50)
        assert co.read_labelled_dirs(spark, root).rdd.getNumPartitions() == 30      # 1,490 bytes
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_large_files_in_small_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fl, "BATCH_BYTES", 10)
    root = str(tmp_path)
    for k in range(30):
        put(root, f"l/{k}.txt", b"x" * k)
    assert sorted(len(r.text) for r in co.read_labelled_dirs(spark, root).collect()) == list(range(1, 30))


def test_written_folders_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(qf, "FOLDER_FILES", 10)
    root = str(tmp_path / "root")
    names = sorted(r.name for r in written(spark, root, 45).collect())
    files = glob.glob(f"{root}/**/*.txt", recursive=True)
    assert sorted(os.path.relpath(f, root) for f in files) == names and len(names) == 45
    assert max(collections.Counter(map(os.path.dirname, files)).values()) == 10


def test_a_dropped_stage_is_gone_and_others_stay(spark):
    one, two = stage(spark.range(5), "drop-one"), stage(spark.range(5), "drop-two", "zstd")
    drop_stage(one)
    assert not any(os.path.exists(f.removeprefix("file://")) for f in one.inputFiles()) and two.count() == 5
    with pytest.raises(ValueError, match="staged"):
        drop_stage(spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))


def test_manifest_blocks_leave_no_texts_behind(spark, monkeypatch):
    made = []
    monkeypatch.setattr(qf, "scratch_path", lambda s, name: made.append(scratch_path(s, name)) or made[-1])
    df = qf.q_manifest_blocks(spark, "/root/testdata/sf0.001")
    folder = next(p for p in made if "/code-files-" in p).removeprefix("file:")
    assert os.path.isdir(folder) and not glob.glob(f"{folder}/**/*.txt", recursive=True)
    assert df.count() == df.agg(F.max("block_id") + 1).first()[0] > 0
