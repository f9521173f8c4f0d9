"""Registered queries: sampling, splitting, shuffling, label encoding,
vocabulary, fixed-length encoding and token-block packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline import constants as C
from pressline.functions import text as tx
from pressline.operators import encode as en
from pressline.operators import sampling as sm
from pressline.plans import sql_text as S
from pressline.plans.catalog import register
from pressline.plans.queries_text import PUBLISHER_SQL, _with_articles
from pressline.plans.training_set import publisher_training_set
from pressline.sources.articles import ARTICLES_SQL, load_articles, load_table

SAMPLE_N = 50
SPLIT_SHARE = C.DEFAULT_TRAIN_SHARE
BATCH_SIZE, EPOCHS = 4, 2
BLOCK = C.DEFAULT_BLOCK_SIZE
ENCODE_LENGTH = C.DEFAULT_SEQUENCE_LENGTH


@register("sample_exact", _with_articles(f"""
SELECT doc_id, source_id FROM articles ORDER BY {S.sample_key('doc_id')}, doc_id LIMIT {SAMPLE_N}
"""))
def q_sample_exact(spark, sf_dir):
    a = load_articles(spark, sf_dir).select("doc_id", "source_id")
    return sm.sample_exact(a, SAMPLE_N, "doc_id")


@register("train_validation_split", f"""
WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY {S.sample_key('doc_id')}) AS rk,
                  count(*) OVER () AS total FROM documents)
SELECT doc_id, CASE WHEN rk <= CAST(floor(CAST({SPLIT_SHARE} AS DOUBLE) * total) AS BIGINT)
                    THEN 'train' ELSE 'validation' END AS side
FROM k
""")
def q_train_validation_split(spark, sf_dir):
    d = load_table(spark, sf_dir, "documents").select("doc_id")
    return sm.split_exact(d, SPLIT_SHARE, "doc_id")


@register("shuffle_batches", f"""
WITH e AS (SELECT doc_id, CAST(ep AS INTEGER) AS epoch FROM documents CROSS JOIN range({EPOCHS}) t(ep)),
r AS (SELECT doc_id, epoch,
             row_number() OVER (PARTITION BY epoch ORDER BY {S.sample_key('doc_id', C.DEFAULT_SEED, 'CAST(epoch AS VARCHAR)')}, doc_id) AS position
      FROM e)
SELECT doc_id, epoch, CAST(position AS BIGINT) AS position, CAST(floor((position - 1) / {BATCH_SIZE}) AS BIGINT) AS batch_id
FROM r
""")
def q_shuffle_batches(spark, sf_dir):
    d = load_table(spark, sf_dir, "documents").select("doc_id")
    b = sm.shuffle_batches(d, BATCH_SIZE, EPOCHS, "doc_id")
    return b.select("doc_id", "epoch", F.col("position").cast("bigint").alias("position"), "batch_id")


@register("sample_accounting", f"""
SELECT CAST(count(*) AS BIGINT) AS n_rows, {BATCH_SIZE} AS batch_size,
       CAST(ceil(count(*) / {BATCH_SIZE}) AS BIGINT) AS n_batches,
       CAST(ceil(count(*) / {BATCH_SIZE}) * {BATCH_SIZE} AS BIGINT) AS reported_samples
FROM ({PUBLISHER_SQL}) ts
""")
def q_sample_accounting(spark, sf_dir):
    from pressline.plans.queries_text import PUB_MAX_WORDS, PUB_MIN_DOCS, PUB_MIN_WORDS, PUB_SOURCES
    ts = publisher_training_set(load_articles(spark, sf_dir), PUB_MIN_WORDS, PUB_MAX_WORDS,
                                PUB_MIN_DOCS, PUB_SOURCES)
    n = F.count(F.lit(1))
    return ts.agg(n.alias("n_rows"), F.lit(BATCH_SIZE).alias("batch_size"),
                  F.ceil(n / BATCH_SIZE).cast("bigint").alias("n_batches"),
                  sm.sample_count_accounting(n, BATCH_SIZE).alias("reported_samples"))


# Multi-label text: language and publisher joined with the label separator.
MULTI_LABEL_SQL = "lang || '|' || source"

LABELS_SQL = f"""
WITH lab AS (SELECT doc_id, {MULTI_LABEL_SQL} AS label FROM documents),
parts AS (SELECT doc_id, list_filter(string_split(coalesce(label, ''), '|'), lambda p: p <> '') AS parts FROM lab),
ord AS (SELECT list(l ORDER BY l) AS names FROM (SELECT DISTINCT unnest(parts) AS l FROM parts))
"""


def _multi_label(spark, sf_dir):
    d = load_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat_ws("|", "lang", "source").alias("label"))


@register("label_order", LABELS_SQL + """
SELECT CAST(i - 1 AS INTEGER) AS label_idx, names[i] AS label FROM ord, range(1, len(names) + 1) t(i)
""")
def q_label_order(spark, sf_dir):
    from pressline.functions.labels import label_order
    return label_order(_multi_label(spark, sf_dir), "label")


@register("label_one_hot", LABELS_SQL + """
, oh AS (SELECT doc_id, list_transform(names, lambda x: CAST(list_contains(parts, x) AS INTEGER)) AS one_hot FROM parts, ord)
SELECT doc_id, array_to_string(one_hot, '') AS one_hot,
       CAST(CASE WHEN list_position(one_hot, 1) > 0 THEN list_position(one_hot, 1) - 1 ELSE 0 END AS INTEGER) AS label_idx
FROM oh
""")
def q_label_one_hot(spark, sf_dir):
    out, _ = en.encode_labels(_multi_label(spark, sf_dir), "label")
    return out.select("doc_id", F.array_join("one_hot", "").alias("one_hot"), "label_idx")


@register("label_sparse", LABELS_SQL + """
, sets AS (SELECT doc_id, list_sort(list_filter(list_transform(range(len(names)), lambda i: CASE WHEN list_contains(parts, names[i + 1]) THEN i END), lambda i: i IS NOT NULL)) AS s
           FROM parts, ord)
SELECT doc_id, array_to_string(s, ',') AS label_set, CAST(coalesce(s[1], 0) AS INTEGER) AS label_idx FROM sets
""")
def q_label_sparse(spark, sf_dir):
    """Sparse label vectors: the sorted indices of each row's labels."""
    out, _ = en.encode_label_sets(_multi_label(spark, sf_dir), "label")
    return out.select("doc_id", F.array_join("label_set", ",").alias("label_set"), "label_idx")


def _markup_corpus(spark, sf_dir):
    """Marked-up text of every article (the excerpt where no body was scraped) and its label text."""
    a = load_articles(spark, sf_dir)
    body = F.coalesce("scraped_content", "content")
    return a.select("doc_id", F.concat_ws("|", "source_name", "source_id").alias("label"),
                    tx.format_headline_body(tx.remove_captions(body), "title").alias("training_content"))


def _reserved_values() -> str:
    return ", ".join(f"({i}, {S.q(t)})" for i, t in enumerate(en.RESERVED))


def _vocab_sql(tokens_sql: str) -> str:
    """``counts`` and ``vocab`` over ``toks (doc_id, t)``."""
    reserved_list = ", ".join(S.q(t) for t in en.RESERVED)
    return f"""
toks AS ({tokens_sql}),
counts AS (SELECT tok AS token, count(*) AS freq FROM (SELECT unnest(t) AS tok FROM toks) GROUP BY tok),
reserved AS (SELECT * FROM (VALUES {_reserved_values()}) AS r(token_id, token)),
ranked AS (SELECT CAST(row_number() OVER (ORDER BY freq DESC, token) + {len(en.RESERVED) - 1} AS INTEGER) AS token_id,
                  token, CAST(freq AS BIGINT) AS freq
           FROM counts WHERE token NOT IN ({reserved_list})),
vocab AS (SELECT CAST(r.token_id AS INTEGER) AS token_id, r.token, CAST(coalesce(c.freq, 0) AS BIGINT) AS freq
          FROM reserved r LEFT JOIN counts c ON r.token = c.token
          UNION ALL SELECT token_id, token, freq FROM ranked)
"""


BODY_SQL = "coalesce(scraped_content, content)"
MARKUP_TOKENS_SQL = (f"SELECT doc_id, regexp_extract_all("
                     f"{S.format_headline_body(S.remove_captions(BODY_SQL), 'title')}, {S.q(en.TOKEN_PATTERN)}) AS t "
                     f"FROM articles")


@register("vocabulary", f"WITH articles AS ({ARTICLES_SQL}),\n" + _vocab_sql(MARKUP_TOKENS_SQL)
          + "SELECT token_id, token, freq FROM vocab")
def q_vocabulary(spark, sf_dir):
    """Every distinct token of the marked-up articles, with its id."""
    return en.build_vocabulary(_markup_corpus(spark, sf_dir), "training_content")


@register("encode_documents", f"WITH articles AS ({ARTICLES_SQL}),\n" + _vocab_sql(MARKUP_TOKENS_SQL) + f"""
, flat AS (SELECT doc_id, unnest(t) AS tok, unnest(range(1, len(t) + 1)) AS pos FROM toks),
ids AS (SELECT f.doc_id, list(v.token_id ORDER BY f.pos) AS ids
        FROM flat f JOIN vocab v ON f.tok = v.token GROUP BY f.doc_id),
enc AS (SELECT toks.doc_id, coalesce(ids.ids, []) AS ids FROM toks LEFT JOIN ids ON toks.doc_id = ids.doc_id),
win AS (SELECT doc_id, len(ids) AS n_tokens, CAST(w AS INTEGER) AS window_idx,
               ids[w * {ENCODE_LENGTH} + 1 : (w + 1) * {ENCODE_LENGTH}] AS kept
        FROM (SELECT *, unnest(range(greatest(CAST(ceil(len(ids) / {ENCODE_LENGTH}) AS BIGINT), 1))) AS w FROM enc)),
lab AS (SELECT doc_id, list_filter([source_name, source_id], lambda p: p <> '') AS parts FROM articles),
ord AS (SELECT list(l ORDER BY l) AS names FROM (SELECT DISTINCT unnest(parts) AS l FROM lab)),
oh AS (SELECT doc_id, list_transform(names, lambda x: CAST(list_contains(parts, x) AS INTEGER)) AS one_hot,
              array_to_string(names, ',') AS label_order FROM lab, ord)
SELECT win.doc_id, window_idx, CAST(n_tokens AS INTEGER) AS n_tokens,
       array_to_string(list_concat(kept, list_transform(range({ENCODE_LENGTH} - len(kept)), lambda x: {en.PAD_ID})), ' ') AS input_ids,
       repeat('1', len(kept)) || repeat('0', {ENCODE_LENGTH} - len(kept)) AS attention_mask,
       array_to_string(one_hot, '') AS one_hot, label_order,
       CAST(CASE WHEN list_position(one_hot, 1) > 0 THEN list_position(one_hot, 1) - 1 ELSE 0 END AS INTEGER) AS label_idx
FROM win JOIN oh ON win.doc_id = oh.doc_id
""")
def q_encode_documents(spark, sf_dir):
    """The encoded training set: every window of ids with its mask, the one-hot label row and the label order."""
    toks = en.stage_tokens(_markup_corpus(spark, sf_dir), "training_content")
    vocab = en.build_vocabulary(toks, None, tokens_col="_tokens")
    labelled, order = en.encode_labels(toks, "label")
    enc = en.encode(labelled, None, vocab, ENCODE_LENGTH, tokens_col="_tokens", all_windows=True)
    names = order.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("label_idx", "label"))),
                                               lambda r: r["label"]), ","))
    return enc.select("doc_id", "window_idx", "n_tokens", F.array_join("input_ids", " ").alias("input_ids"),
                      F.array_join("attention_mask", "").alias("attention_mask"),
                      F.array_join("one_hot", "").alias("one_hot"), names.scalar().alias("label_order"), "label_idx")


@register("token_blocks", "WITH " + _vocab_sql(
    f"SELECT doc_id, list_append(regexp_extract_all(text, {S.q(en.TOKEN_PATTERN)}), chr(10)) AS t FROM documents") + f"""
, u AS (SELECT doc_id, unnest(t) AS tok, unnest(range(1, len(t) + 1)) AS i FROM toks),
g AS (SELECT v.token_id, row_number() OVER (ORDER BY u.doc_id, u.i) - 1 AS pos FROM u JOIN vocab v ON u.tok = v.token),
tot AS (SELECT count(*) - 1 AS usable FROM g),
b AS (SELECT CAST(pos // {BLOCK} AS BIGINT) AS block_id, list(token_id ORDER BY pos) AS ids
      FROM g, tot WHERE pos < (usable // {BLOCK}) * {BLOCK} GROUP BY 1)
SELECT block_id, CAST(len(ids) AS INTEGER) AS n_tokens, array_to_string(ids, ' ') AS input_ids FROM b
""")
def q_token_blocks(spark, sf_dir):
    """Blocks of token ids over all documents, one separator between two documents."""
    d = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    b = en.pack_blocks(d, "text", "doc_id", BLOCK, ids=True)
    return b.select("block_id", F.size("input_ids").alias("n_tokens"), F.array_join("input_ids", " ").alias("input_ids"))
