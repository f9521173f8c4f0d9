"""Ranked lexical search: a hybrid of term-at-a-time and document-at-a-time evaluation.

One pass turns every document into its length and the counts of those of its terms that some item asks for. A second
pass takes these narrow rows in shards of consecutive documents and keeps, per item, the best ``k``:

1. Term at a time: the item's short lists are summed into one list of accumulators (document, sum).
2. Document at a time: this list is one more iterator beside the item's long lists. Each iterator has its largest
   contribution per block of documents; a block whose bounds add up to less than the item's k-th best score so
   far is skipped in all lists at once, and the rest are scored, those of the largest bound first. The k-th largest accumulator is a
   bound from the start, as no contribution is below zero.

A task's best k per item meet in a window of at most k rows per task and item, so no document is dropped
before its score is known to be too small.

Items are a stated query set: they are taken in blocks of about ``BLOCK_TERMS`` terms, each block against all documents, so what is sent to
the tasks has a bound at any number of items. Weights and lengths come from all documents.

Edge cases: null and empty texts have no terms and don't count; items without terms have no rows; repeated document
rows are documents of their own, with ranks of their own, equal scores by id (null ids last); repeated items each get their
list; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressline.llm.common import map_batches, read_table, small_side, stage
from pressline.llm.registry import register

BLOCK_TERMS = 500_000
#: Documents and postings that a task holds at once, and documents of a block that is skipped or scored as a whole.
SHARD_DOCS, SHARD_POSTINGS, BLOCK_DOCS = 16_384, 4_000_000, 64
#: A list is short if it holds fewer than one in so many of the shard's documents.
SHORT_SHARE = 64
#: Length normalisation in hundredths, scale of a term's share and of its weight.
LENGTH_PART, SCALE, WEIGHT = 90, 1_000_000_000, 1000

_TERM = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms(raw: bytes | None) -> list[bytes]:
    return raw.translate(_TERM).split() if raw else []


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """item (a number of its own per row), the item's id, and its distinct terms; staged."""
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(key).alias("id"), F.col(text).cast("binary").alias("text"))

    def run(batch):
        found = [sorted(set(terms(t))) for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["item"], batch["id"], pa.array(found, pa.list_(pa.binary()))], ["item", "id", "terms"])

    return stage(map_batches(rows, run, f"item long, id {rows.schema['id'].dataType.simpleString()}, terms array<binary>").where("size(terms) > 0"), "search-items")


def postings(docs: DataFrame, vocabulary: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document with terms: row, doc_id, n (terms with repeats), ids and tfs of the asked terms; staged."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most about BLOCK_TERMS terms
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))

    def run(batch):
        known = shared.value.get
        ns, ids, tfs = [], [], []
        for raw in batch["text"].to_pylist():
            words = terms(raw)
            seen = Counter(map(known, words))
            seen.pop(None, None)
            ns.append(len(words))
            ids.append(list(seen.keys()))
            tfs.append(list(seen.values()))
        yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], pa.array(ns, pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                                          pa.array(tfs, pa.list_(pa.int32()))], ["row", "doc_id", "n", "ids", "tfs"])

    return stage(map_batches(rows, run, "row long, doc_id long, n long, ids array<int>, tfs array<int>").where("n > 0"), "search-postings")


def weights(listed: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """Weight of each term id, the number of documents and the number of all their terms."""
    n_docs, n_terms = (int(x or 0) for x in listed.agg(F.count(F.lit(1)), F.sum("n")).first())
    df = np.zeros(size, np.int64)
    counted = listed.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("df")).toPandas()  # a row per asked term
    df[counted["id"].to_numpy(np.int64)] = counted["df"].to_numpy(np.int64)
    return np.array([math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64), n_docs, n_terms


def lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    if len(n) and LENGTH_PART * int(n.max()) * n_docs >= 1 << 63:
        return np.array([100 - LENGTH_PART + LENGTH_PART * int(x) * n_docs // n_terms for x in n], np.int64)
    return 100 - LENGTH_PART + LENGTH_PART * n.astype(np.int64) * n_docs // n_terms


class Best:
    """The best k rows of one item so far: scores, ids, rows; ids of null are the largest."""

    def __init__(self, k: int):
        self.k = k
        self.scores = self.ids = self.rows = np.empty(0, np.int64)
        self.least = 1

    def add(self, scores, ids, rows):
        s, d, r = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.rows, rows)))
        top = np.lexsort((r, d, -s))[:self.k]
        self.scores, self.ids, self.rows = s[top], d[top], r[top]
        if len(top) == self.k:
            self.least = int(self.scores[-1])


class Shard:
    """Inverted lists of some consecutive documents with the contributions of their postings."""

    def __init__(self, row, doc, m, starts, ids, tfs, weight):
        self.row, self.doc, size = row, doc, len(row)
        at = np.repeat(np.arange(size), np.diff(starts))
        order = np.argsort(ids, kind="stable")                       # by term, then document
        tf = tfs[order].astype(np.int64)
        self.docs, term = at[order], ids[order]
        self.gain = weight[term] * (SCALE * tf // (1000 * tf + 8 * m[self.docs]))
        self.blocks = -(-size // BLOCK_DOCS)
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.empty(0, np.int64)
        self.lists = {int(t): (int(a), int(b)) for t, a, b in zip(term[first], first, np.r_[first[1:], len(term)][:len(first)], strict=True)}
        self.most_short = max(1, size // SHORT_SHARE)
        self.bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def bound(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Of a long list: where each block begins in it, and the largest contribution in each block."""
        if t not in self.bounds:
            a, b = self.lists[t]
            begin = a + np.searchsorted(self.docs[a:b], np.arange(self.blocks + 1) * BLOCK_DOCS)
            self.bounds[t] = begin, largest(self.gain, begin)
        return self.bounds[t]

    def accumulate(self, ranges) -> tuple[np.ndarray, np.ndarray]:
        """Term at a time: documents of the short lists, ascending, with summed contributions."""
        if not ranges:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        docs = np.concatenate([self.docs[a:b] for a, b in ranges])
        gain = np.concatenate([self.gain[a:b] for a, b in ranges])
        order = np.argsort(docs, kind="stable")
        docs, gain = docs[order], gain[order]
        first = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
        return docs[first], np.add.reduceat(gain, first)

    def search(self, asked, best: Best) -> None:
        ranges = [(t, *self.lists[t]) for t in asked if t in self.lists]
        if not ranges:
            return
        docs, sums = self.accumulate([(a, b) for _, a, b in ranges if b - a <= self.most_short])
        long = [self.bound(t) for t, a, b in ranges if b - a > self.most_short]
        begin = np.searchsorted(docs, np.arange(self.blocks + 1) * BLOCK_DOCS)
        bound = largest(sums, begin)
        for _, most in long:
            bound = bound + most
        least = best.least
        if len(sums) >= best.k:
            least = max(least, int(np.partition(sums, len(sums) - best.k)[len(sums) - best.k]))
        order = np.argsort(-bound, kind="stable")
        at, step = 0, 4
        while at < len(order) and bound[order[at]] >= least:
            chosen = order[at:at + step]
            chosen = np.sort(chosen[bound[chosen] >= least])         # document order, the rest is skipped
            total = np.zeros(len(chosen) * BLOCK_DOCS, np.int64)
            for d, g, b in [(docs, sums, begin), *((self.docs, self.gain, b) for b, _ in long)]:
                lo, n = b[chosen], b[chosen + 1] - b[chosen]
                pos = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                slot = np.repeat(np.arange(len(chosen)) - chosen, n) * BLOCK_DOCS + d[pos]
                total[slot] += g[pos]                                # a document is in a list once
            hit = np.flatnonzero(total >= max(1, least))
            if len(hit):
                where = chosen[hit // BLOCK_DOCS] * BLOCK_DOCS + hit % BLOCK_DOCS
                best.add(total[hit], self.doc[where], self.row[where])
                least = max(least, best.least)
            at, step = at + step, step * 2


def largest(gain: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Largest contribution of each block [begin[i], begin[i + 1]), 0 for an empty one."""
    out = np.zeros(len(begin) - 1, np.int64)
    full = np.flatnonzero(begin[1:] > begin[:-1])
    if len(full):
        out[full] = np.maximum.reduceat(gain[:begin[-1]], begin[full])
    return out


def search_block(listed: DataFrame, asked: list[tuple[int, np.ndarray]], weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item, row, doc_id, score: the best k of each task for each item of one block."""
    shared = listed.sparkSession.sparkContext.broadcast((asked, weight))
    null = np.iinfo(np.int64).max

    def run(batches):
        items, w = shared.value
        best = [Best(k) for _ in items]
        held: list = []

        def flush():
            row, doc, n, counts, ids, tfs = (np.concatenate(x) for x in zip(*held, strict=True))
            shard = Shard(row, doc, lengths(n, n_docs, n_terms), np.r_[0, np.cumsum(counts)], ids, tfs, w)
            for (_, wanted), b in zip(items, best, strict=True):
                shard.search(wanted, b)
            held.clear()

        docs = size = 0
        for batch in batches:
            for start in range(0, batch.num_rows, SHARD_DOCS // 4):
                part = batch.slice(start, SHARD_DOCS // 4)
                ids, tfs = part["ids"], part["tfs"]
                count = np.diff(ids.offsets.to_numpy())
                held.append((part["row"].to_numpy(), part["doc_id"].fill_null(null).to_numpy(), part["n"].to_numpy(), count,
                             ids.flatten().to_numpy(), tfs.flatten().to_numpy()))
                docs, size = docs + part.num_rows, size + int(count.sum())
                if docs >= SHARD_DOCS or size >= SHARD_POSTINGS:
                    flush()
                    docs = size = 0
        if held:
            flush()
        for (item, _), b in zip(items, best, strict=True):
            if len(b.rows):
                ids = pa.array(b.ids, mask=b.ids == null)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.rows), item)), pa.array(b.rows), ids, pa.array(b.scores)], ["item", "row", "doc_id", "score"])

    return listed.select("row", "doc_id", "n", "ids", "tfs").mapInArrow(run, "item long, row long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS, item_key: str = "item_id", key: str = "doc_id") -> DataFrame:
    """Per row of ``items`` its k best documents: item (row number), id, rank, doc_id, score."""
    queries = item_terms(items, item_key)
    blocks = max(1, math.ceil((queries.agg(F.sum(F.size("terms"))).first()[0] or 0) / block_terms))
    found = None
    for block in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).select("item", "terms").collect()  # about block_terms terms
        vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in mine for t in r.terms}))}
        listed = postings(docs, vocabulary, key)
        weight, n_docs, n_terms = weights(listed, len(vocabulary))
        asked = [(r.item, np.array([vocabulary[bytes(t)] for t in r.terms], np.int32)) for r in mine]
        part = search_block(listed, asked, weight, n_docs, n_terms, k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(small_side(queries.select("item", "id")), "item").select("item", "id", "rank", "doc_id", "score")


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FIND = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_FIND} AS t FROM documents WHERE text IS NOT NULL),
l AS (SELECT r, doc_id, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
s AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nt FROM l),
p AS (SELECT r, w, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS w FROM d) GROUP BY ALL),
i AS (SELECT q, item_id, unnest(t) AS w FROM (SELECT row_number() OVER () AS q, item_id, list_distinct({_FIND}) AS t FROM benchmark WHERE text IS NOT NULL)),
f AS (SELECT w, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS g FROM p, s WHERE w IN (SELECT w FROM i) GROUP BY w, nd),
c AS (SELECT q, item_id, l.doc_id, l.r, sum(g * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // nt))))::BIGINT AS score
      FROM i JOIN f USING (w) JOIN p USING (w) JOIN l USING (r), s GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, r) AS k FROM c WHERE score > 0)
SELECT item_id, k::INT AS rank, doc_id, score FROM k WHERE k <= 10
"""


@register("op12_hybrid_search", SQL)
def op12_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")
