"""Registered queries from files to the last table: the corpora are written from the driver tables in their
original layouts (quoted CSV, labelled folders, manifest and files, JSON arrays) and read back by the library's readers."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import functions as F

from pressline import constants as C
from pressline.operators import encode as en
from pressline.plans import sql_text as S
from pressline.plans.catalog import register
from pressline.plans.classify import sentiment_classifier, topic_classifier
from pressline.plans.queries_classify import TOPIC_MAX_WORDS, _contract, _shared
from pressline.plans.queries_encode import _vocab_sql
from pressline.plans.queries_text import _with_articles
from pressline.plans.stage import drop_stage, scratch_path, stage
from pressline.plans.training_set import sentiment_training_set, topic_training_set
from pressline.sources.articles import flatten, load_articles, load_table, read_listing_layout
from pressline.sources.corpora import read_labelled_dirs, read_manifest_files, read_topic_csv

TOPICS = 4
BLOCK = C.DEFAULT_BLOCK_SIZE
FOLDER_FILES = 5_000                # files of a written folder, at most: one task lists a folder
ARRAY_ROWS = 500                    # articles of a written listing, about: a cell with more of them is several listings


def write_topic_csv(rows, path):
    """(label, headline, text) as headerless CSV, all fields quoted."""
    (rows.select("label", "headline", "text").write.option("quoteAll", True).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def _topic_rows(spark, sf_dir):
    d = load_table(spark, sf_dir, "documents")
    return d.select("doc_id", (F.col("doc_id") % TOPICS + 1).cast("int").alias("label"),
                    F.substring_index("text", "\n", 1).alias("headline"), "text")


TOPIC_MARKUP = S.format_headline_body("text", "split_part(text, chr(10), 1)")


@register("topic_csv_corpus", f"""
WITH f AS (SELECT CAST(doc_id % {TOPICS} + 1 AS VARCHAR) AS label, {TOPIC_MARKUP} AS training_content FROM documents),
c AS (SELECT *, {S.word_count('training_content')} AS word_count FROM f)
SELECT label, word_count, training_content FROM c WHERE word_count BETWEEN 0 AND {TOPIC_MAX_WORDS}
""")
def q_topic_csv_corpus(spark, sf_dir):
    """Quoted CSV with line breaks in its fields -> splittable reader -> topic training set."""
    path = scratch_path(spark, "topic-csv")
    write_topic_csv(_topic_rows(spark, sf_dir), path)
    return topic_training_set(read_topic_csv(spark, path), 0, TOPIC_MAX_WORDS).select("label", "word_count", "training_content")


def _root_contract_sql(label: str, side: str, markup: str, rows: str) -> str:
    """Rows per phase and label of a corpus that comes as a train and a test root."""
    return f"""
WITH m AS (SELECT {label} AS label, CASE WHEN {side} THEN 'validation' ELSE 'train' END AS phase, {markup} AS x FROM {rows}),
ph AS (SELECT label, phase FROM m WHERE {S.word_count('x')} BETWEEN 0 AND {TOPIC_MAX_WORDS}),
ord AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx FROM (SELECT DISTINCT label FROM ph))
SELECT ph.phase, ord.label_idx, ph.label, CAST(count(*) AS BIGINT) AS n, CAST(1.0 AS DOUBLE) AS mean_prob_total
FROM ph JOIN ord ON ph.label = ord.label GROUP BY ALL
"""


@register("topic_roots_contract", _root_contract_sql(f"CAST(doc_id % {TOPICS} + 1 AS VARCHAR)", "doc_id % 3 = 0", TOPIC_MARKUP, "documents"))
def q_topic_roots_contract(spark, sf_dir):
    """The topic job from its two CSV roots: read, mark up, fit on one, judge the other."""
    def fit():
        roots = []
        for test in (False, True):
            roots.append(scratch_path(spark, "topic-root"))
            write_topic_csv(_topic_rows(spark, sf_dir).where((F.col("doc_id") % 3 == 0) == F.lit(test)), roots[-1])
        return topic_classifier(*[read_topic_csv(spark, r) for r in roots], 0, TOPIC_MAX_WORDS, max_iter=5)
    return _contract(_shared(spark, sf_dir, "topic-roots", fit, ("documents",)))


def write_text_files(rows, root):
    """(folder, text) as ROOT/<part>[/<folder>]/<file>, a file per row that ends with a line break; returns the files' names below the root.

    Tasks write their rows straight to the shared folder, without a commit that moves each file. A part is a run of ``FOLDER_FILES`` rows
    of one task. Names follow task and row, so a task that runs again writes the same files."""
    def run(batches):
        files, base = pafs.FileSystem.from_uri(root)
        part, n, made = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            names = []
            for folder, text in zip(batch["folder"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if n % FOLDER_FILES == 0:
                    made = set()
                below = f"{part:05d}-{n // FOLDER_FILES:05d}" + (f"/{folder}" if folder else "")
                if below not in made:
                    files.create_dir(f"{base}/{below}", recursive=True)
                    made.add(below)
                names.append(f"{below}/part-{part:05d}-{n:09d}.txt")
                with files.open_output_stream(f"{base}/{names[-1]}") as out:
                    out.write((text or "").encode() + b"\n")
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    return stage(rows.select("folder", "text").mapInArrow(run, "name string"), "written-files")


def drop_text_files(names, root):
    """Deletes the files that :func:`write_text_files` wrote below ``root`` (``names``: what it returned), a part at a time, in tasks."""
    def run(batches):
        files, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for part in batch["part"].to_pylist():
                if files.get_file_info(f"{base}/{part}").type == pafs.FileType.Directory:      # else this task ran before
                    files.delete_dir(f"{base}/{part}")
            yield batch

    parts = names.select(F.substring_index("name", "/", 1).alias("part")).distinct()
    parts.repartition(names.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "part string").count()


def write_labelled_dirs(rows, path):
    """(text, label) as ROOT/<part>/<label>/<file>, a file per row. Each file ends with a line break."""
    label = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    write_text_files(rows.select(F.concat(F.lit("_label="), label).alias("folder"), "text"), path)


def _labelled(spark, sf_dir):
    lab = load_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    return load_table(spark, sf_dir, "documents").select("doc_id", "text").join(lab, "doc_id")


def _read_dirs(spark, path):
    return read_labelled_dirs(spark, path).withColumn("label", F.regexp_replace("label", "^_label=", ""))


BODY_MARKUP = S.format_body_only("d.text || chr(10)")
LABELLED = "documents d JOIN labels l ON d.doc_id = l.doc_id"


@register("labelled_dirs_corpus", f"""
WITH c AS (SELECT CAST(l.quality AS VARCHAR) AS label, {BODY_MARKUP} AS training_content FROM {LABELLED})
SELECT label, {S.word_count('training_content')} AS word_count, training_content FROM c
WHERE {S.word_count('training_content')} BETWEEN 0 AND {TOPIC_MAX_WORDS}
""")
def q_labelled_dirs_corpus(spark, sf_dir):
    """Labelled folders, a file per text -> whole-file reader -> sentiment training set."""
    path = scratch_path(spark, "labelled-dirs")
    write_labelled_dirs(_labelled(spark, sf_dir), path)
    return sentiment_training_set(_read_dirs(spark, path), 0, TOPIC_MAX_WORDS).select("label", "word_count", "training_content")


@register("sentiment_roots_contract", _root_contract_sql("CAST(l.quality AS VARCHAR)", "d.doc_id % 3 = 0", BODY_MARKUP, LABELLED))
def q_sentiment_roots_contract(spark, sf_dir):
    """The sentiment job from its train and test folders."""
    def fit():
        roots = []
        for test in (False, True):
            roots.append(scratch_path(spark, "sentiment-root"))
            write_labelled_dirs(_labelled(spark, sf_dir).where((F.col("doc_id") % 3 == 0) == F.lit(test)), roots[-1])
        return sentiment_classifier(*[_read_dirs(spark, r) for r in roots], 0, TOPIC_MAX_WORDS, max_iter=5)
    return _contract(_shared(spark, sf_dir, "sentiment-roots", fit, ("documents", "labels")))


@register("manifest_blocks", "WITH " + _vocab_sql(
    f"SELECT row_number() OVER (ORDER BY md5(text || chr(10))) AS doc_id, "
    f"list_append(regexp_extract_all(text || chr(10), {S.q(en.TOKEN_PATTERN)}), chr(10)) AS t FROM documents") + f"""
, u AS (SELECT doc_id, unnest(t) AS tok, unnest(range(1, len(t) + 1)) AS i FROM toks),
g AS (SELECT v.token_id, row_number() OVER (ORDER BY u.doc_id, u.i) - 1 AS pos FROM u JOIN vocab v ON u.tok = v.token),
tot AS (SELECT count(*) - 1 AS usable FROM g)
SELECT CAST(pos // {BLOCK} AS BIGINT) AS block_id, CAST(count(*) AS INTEGER) AS n_tokens, sha256(string_agg(token_id::VARCHAR, ' ' ORDER BY pos)) AS ids_sha256
FROM g, tot WHERE pos < (usable // {BLOCK}) * {BLOCK} GROUP BY 1
""")
def q_manifest_blocks(spark, sf_dir):
    """Manifest (with blank lines) and files -> texts -> ids of the corpus's vocabulary -> token blocks."""
    files, manifest = scratch_path(spark, "code-files"), scratch_path(spark, "manifest-list")
    names = write_text_files(load_table(spark, sf_dir, "documents").select(F.lit("").alias("folder"), "text"), files)
    names.select(F.explode(F.array(F.col("name"), F.lit(""))).alias("name")).write.text(manifest)
    texts = stage(read_manifest_files(spark, manifest, files).select(F.md5("text").alias("key"), "text"), "manifest-texts", "zstd")
    drop_text_files(names, files)            # a file per text takes whole blocks of disk: nearly three times the tables' size
    blocks = en.pack_blocks(texts, "text", "key", BLOCK, ids=True)
    drop_stage(texts)
    return blocks.select("block_id", F.size("input_ids").alias("n_tokens"), F.sha2(F.array_join("input_ids", " "), 256).alias("ids_sha256"))


def write_listing_arrays(articles, root):
    """Articles as ROOT/DATE/SOURCE/articles files of JSON arrays with one field, ``page_rank``, that the article schema lacks."""
    element = F.to_json(F.struct(
        F.struct(F.col("source_id").alias("id"), F.col("source_name").alias("name")).alias("source"), "title", "url",
        F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"), "content", "scraped", "scraped_content", "error",
        F.col("doc_id").alias("page_rank")))
    cell = ["query_date", "source_id"]
    # a cell's number of listings follows its own rows, so files follow rows and cells, not rows alone
    sizes = articles.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / ARRAY_ROWS).alias("_parts"))
    rows, sizes = articles.select(*cell, element.alias("e")), sizes.select(*[F.col(c).alias(f"_{c}") for c in cell], "_parts")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cell]
    cells = rows.join(sizes, same).select(*cell, "e", F.pmod(F.xxhash64("e"), F.col("_parts")).alias("part"))
    arrays = cells.groupBy("query_date", "source_id", "part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("e"), ",\n"), F.lit("]")).alias("value"))
    arrays.select("value", "query_date", "source_id").write.option("maxRecordsPerFile", 1).partitionBy("query_date", "source_id").text(root)


@register("listing_arrays", _with_articles("""
SELECT source_id, source_name, title, url, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published, scraped, error,
       sha256(content) AS content_sha256, sha256(scraped_content) AS body_sha256, query_date, '{"page_rank":"' || CAST(doc_id AS VARCHAR) || '"}' AS extra
FROM articles
"""))
def q_listing_arrays(spark, sf_dir):
    """Listings as JSON arrays of any size -> splittable reader -> flat articles with the fields that no schema names."""
    root = scratch_path(spark, "listing-arrays")
    write_listing_arrays(load_articles(spark, sf_dir), root)
    flat = flatten(read_listing_layout(spark, root, "query_date=*/source_id=*/*.txt"))
    return flat.select("source_id", "source_name", "title", "url", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"), "scraped", "error",
                       F.sha2("content", 256).alias("content_sha256"), F.sha2("scraped_content", 256).alias("body_sha256"), "query_date",
                       F.to_json("extra").alias("extra"))
