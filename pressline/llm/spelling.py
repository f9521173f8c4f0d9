"""Spelling variant grouping: k-d trees over letter-count vectors.

A word's vector counts each of its letters. One edit moves it by at most two in L1: a replaced letter lowers one count by one
and raises another, an inserted letter raises one. So the neighbours of a word lie in a box search that may step up
in one letter and down in one (same length), or up in one only (one letter longer); shorter neighbours
are found from their own side.

Words of one length are dealt into cells by the first splits of their tree, which are fitted on a bounded sample of the words (``SAMPLE``; it
decides how even the cells are, not what is found). Each word goes once into its cell as a member, and as a query, with what remains
of its steps, into each cell that its box reaches. A cell that is larger than ``UNIT_WORDS`` is cut into
units, and so are its queries, so no task holds more than that. A unit builds the rest of the
tree over its members, runs its queries through it in batches, and verifies the order of letters of what
the leaves hold. Only sums and the best neighbour of each word leave a unit, never the pairs.

Edge cases: null and empty texts have no words; a null id counts as an empty string in the hash; repeated rows count
repeatedly; words of any length are handled (a length has trees of its own); ties of n go to the first word in code-point order; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline.llm.common import read_table, sliced, small_side, stage
from pressline.llm.registry import register

LEAST_LETTERS, LEAST_COUNT, FORM_TIMES, DROP_ONE_IN = 7, 2, 10, 31
#: Words of a cell that the first splits aim at, members of a unit at most, queries of a unit, sampled words per length.
CELL_WORDS, UNIT_WORDS, UNIT_QUERIES, SAMPLE = 16_384, 65_536, 262_144, 20_000
LEAF = 16
#: Distinct words that a task holds before it hands them on, queries and candidate pairs of one numpy pass, bytes of a matrix.
HELD_WORDS, QUERY_BATCH, PAIRS, MATRIX = 500_000, 8192, 2_000_000, 64 << 20

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LETTERS},}}")
#: Latin-1 byte to dimension: a-z, then the 64 letters and signs from 0xC0.
_DIM = np.zeros(256, np.int64)
_DIM[0x61:0x7B] = np.arange(26)
_DIM[0xC0:] = np.arange(26, 90)
DIMS = 90


# ---- words

def words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """code (the word in Latin-1 bytes), n: words of at least LEAST_LETTERS letters and LEAST_COUNT occurrences; staged."""
    rows = docs.select(F.col(key).cast("string").alias("id"), F.col(text).cast("binary").alias("text"))

    def run(batches):
        held: Counter = Counter()

        def flush():
            yield pa.RecordBatch.from_arrays([pa.array([w.encode("latin-1") for w in held], pa.binary()), pa.array(list(held.values()), pa.int64())], ["code", "n"])
            held.clear()

        for batch in batches:
            for part in sliced(batch, "text", 2 << 20):
                for name, raw in zip(part["id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    if not raw:
                        continue
                    seen = Counter(_RUN.findall(raw.translate(_LOWER).decode("utf-8", "replace")))
                    start = crc32(f"{name or ''}:".encode())
                    for w in [w for w in seen if crc32(w.encode(), start) % DROP_ONE_IN == 0]:
                        n, at = seen.pop(w), crc32(w.encode(), start) % len(w)
                        if len(w) > LEAST_LETTERS:
                            held[w[:at] + w[at + 1:]] += n
                    held.update(seen)
                    if len(held) >= HELD_WORDS:
                        yield from flush()
        yield from flush()

    return stage(rows.mapInArrow(run, "code binary, n long").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT), "spelling-words")


def letters(column: pa.Array, length: int) -> np.ndarray:
    """Words of one length as a matrix of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, length)


def vectors(codes: np.ndarray) -> np.ndarray:
    """Letter counts of each row."""
    n, length = codes.shape
    out = np.empty((n, DIMS), np.uint8 if length < 256 else np.int32)
    step = max(1, MATRIX // (8 * max(length, DIMS)))
    for a in range(0, n, step):
        part = _DIM[codes[a:a + step]]
        part += np.arange(len(part))[:, None] * DIMS
        out[a:a + step] = np.bincount(part.ravel(), minlength=len(part) * DIMS).reshape(-1, DIMS)
    return out


# ---- trees

class Tree:
    """Splits (dimension, threshold, children); a child below zero is leaf ``~child``. Leaves hold ranges of ``order``."""

    def __init__(self, counts: np.ndarray, most: int):
        self.dim, self.limit, self.left, self.right, self.begin = [], [], [], [], [0]
        order = np.arange(len(counts))
        parts: list[np.ndarray] = []

        def leaf(rows):
            parts.append(rows)
            self.begin.append(self.begin[-1] + len(rows))
            return ~(len(parts) - 1)

        todo, self.root = [(order, None, None)], -1
        while todo:
            rows, parent, side = todo.pop()
            split = self.split(counts[rows]) if len(rows) > most else None
            if split is None:
                node = leaf(rows)
            else:
                node, (d, t) = len(self.dim), split
                self.dim.append(d)
                self.limit.append(t)
                self.left.append(0)
                self.right.append(0)
                low = counts[rows, d] <= t
                todo += [(rows[~low], node, self.right), (rows[low], node, self.left)]
            if side is None:
                self.root = node
            else:
                side[parent] = node
        self.order = np.concatenate(parts)
        self.dim, self.limit, self.left, self.right, self.begin = (np.array(x, np.int64) for x in (self.dim, self.limit, self.left, self.right, self.begin))

    @staticmethod
    def split(counts: np.ndarray) -> tuple[int, int] | None:
        """The split whose smaller side is largest, among thresholds next to each dimension's mean."""
        n, mean = len(counts), counts.mean(axis=0)
        best = None
        for t in (np.floor(mean), np.ceil(mean) - 1):
            low = np.count_nonzero(counts <= t, axis=0)
            d = int(np.argmax(np.minimum(low, n - low)))
            if min(low[d], n - low[d]) and (best is None or min(low[d], n - low[d]) > best[0]):
                best = min(low[d], n - low[d]), d, int(t[d])
        return best and best[1:]

    def search(self, counts: np.ndarray, up: np.ndarray, down: np.ndarray):
        """query, leaf, up and down that remain, for each leaf that a query's box reaches.

        A step is spent where the query lies just beside the split; a split two steps away cuts the branch."""
        q = np.arange(len(counts))
        node, found = np.full(len(counts), self.root), []
        while len(q):
            end = node < 0
            if end.any():
                found.append((q[end], ~node[end], up[end], down[end]))
                q, node, up, down = q[~end], node[~end], up[~end], down[~end]
                if not len(q):
                    break
            gap = counts[q, self.dim[node]].astype(np.int64) - self.limit[node]      # <= 0: left side
            left = (gap <= 0) | ((gap == 1) & (down > 0))
            right = (gap > 0) | ((gap == 0) & (up > 0))
            spent_down, spent_up = (gap == 1)[left], (gap == 0)[right]
            q, node, up, down = (np.concatenate([q[left], q[right]]), np.concatenate([self.left[node[left]], self.right[node[right]]]),
                                 np.concatenate([up[left], up[right] - spent_up]), np.concatenate([down[left] - spent_down, down[right]]))
        if not found:
            return (np.empty(0, np.int64),) * 4
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def first_splits(known: DataFrame, cell: int, sample: int) -> dict[int, Tree]:
    """Per length with more than ``cell`` words, the first splits, from at most ``sample`` of its words."""
    sizes = known.groupBy(F.length("code").alias("length")).count().where(F.col("count") > cell).collect()  # at most words / cell rows
    trees = {}
    for r in sizes:
        took = [bytes(x.code) for x in known.where(F.length("code") == r["length"]).orderBy(F.xxhash64("code"), "code").limit(sample).select("code").collect()]
        counts = vectors(np.frombuffer(b"".join(took), np.uint8).reshape(len(took), -1))
        trees[r["length"]] = Tree(counts, max(1, len(took) * cell // r["count"]))
    return trees


def routed(known: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """length, cell, asks (false for members), up, down, code, n: every word as a member of its cell and as a query of the cells in reach."""
    shared = known.sparkSession.sparkContext.broadcast(trees)  # words / cell splits

    def run(batches):
        tops = shared.value
        for batch in batches:
            code, n = batch["code"], batch["n"]
            size = np.diff(np.frombuffer(code.buffers()[1], np.int32)[code.offset:code.offset + len(code) + 1])
            for length in np.unique(size):
                rows = np.flatnonzero(size == length)
                for part in np.array_split(rows, -(-len(rows) // QUERY_BATCH)):
                    mine, count = code.take(pa.array(part)), n.take(pa.array(part))
                    v = vectors(letters(mine, length))
                    none, one = np.zeros(len(part), np.int64), np.ones(len(part), np.int64)
                    for target, asks, up, down in ((length, False, none, none), (length, True, one, one), (length + 1, True, one, none)):
                        if target in tops:
                            q, cell, u, d = tops[target].search(v, up, down)
                        else:
                            q, cell, u, d = np.arange(len(part)), none, up, down
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), target, np.int32)), pa.array(cell, pa.int32()), pa.array(np.full(len(q), asks)),
                                                          pa.array(u, pa.int8()), pa.array(d, pa.int8()), mine.take(pa.array(q)), count.take(pa.array(q))],
                                                         ["length", "cell", "asks", "up", "down", "code", "n"])

    return known.select("code", "n").mapInArrow(run, "length int, cell int, asks boolean, up tinyint, down tinyint, code binary, n long")


def units(routes: DataFrame, members: int, queries: int) -> DataFrame:
    """The routed rows with ``unit``: cells past the bounds are cut, members against every cut of the queries and queries against every cut of the members."""
    sizes = stage(routes.groupBy("length", "cell").agg(F.count_if(~F.col("asks")).alias("m"), F.count_if("asks").alias("q")).where("m > 0")
                  .select("length", "cell", F.ceil(F.col("m") / members).cast("int").alias("m_cuts"),
                          F.greatest(F.lit(1), F.ceil(F.col("q") / queries).cast("int")).alias("q_cuts")), "spelling-cells")
    mine = F.pmod(F.xxhash64("code"), F.when(F.col("asks"), F.col("q_cuts")).otherwise(F.col("m_cuts")))
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("asks"), F.col("m_cuts")).otherwise(F.col("q_cuts")) - 1))
    cut = routes.join(small_side(sizes), ["length", "cell"]).withColumn("mine", mine).withColumn("other", others)
    a, b = F.when(F.col("asks"), F.col("other")).otherwise(F.col("mine")), F.when(F.col("asks"), F.col("mine")).otherwise(F.col("other"))
    return cut.select(F.xxhash64("length", "cell", a, b).alias("unit"), "length", F.col("cell"), a.alias("a"), b.alias("b"), "asks", "up", "down", "code", "n")


# ---- units

class Unit:
    """The members of one unit, their tree, and what the queries have found for them."""

    def __init__(self, code: pa.Array, n: np.ndarray, length: int):
        self.length, self.code, self.n = length, letters(code, length), n
        counts = vectors(self.code)
        self.tree = Tree(counts, LEAF)
        order = self.tree.order
        self.code, self.n, self.names = self.code[order], n[order], code.take(pa.array(order))
        self.mark = marks(counts[order])
        self.found = Found(len(n))

    def near(self, codes: np.ndarray, counts: np.ndarray, up: np.ndarray, down: np.ndarray):
        """Yields (query, member) for each pair that one edit parts."""
        q, leaf, _, _ = self.tree.search(counts, up, down)
        begin = self.tree.begin
        size = begin[leaf + 1] - begin[leaf]
        mark, longer = marks(counts), codes.shape[1] < self.length
        ends = np.cumsum(size)
        a = 0
        while a < len(q):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, side="right")))
            n = size[a:b]
            member = np.repeat(begin[leaf[a:b]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            asker = np.repeat(q[a:b], n)
            close = np.flatnonzero(np.bitwise_count(mark[asker] ^ self.mark[member]) <= (1 if longer else 2))
            step = max(1, MATRIX // (4 * self.length))
            for c in range(0, len(close), step):
                x, y = asker[close[c:c + step]], member[close[c:c + step]]
                ok = one_inserted(codes[x], self.code[y]) if longer else np.count_nonzero(codes[x] != self.code[y], axis=1) == 1
                if ok.any():
                    yield x[ok], y[ok]
            a = b


def marks(counts: np.ndarray) -> np.ndarray:
    """64 parities of letter counts (letters 64 apart share one): an edit changes at most two."""
    odd = (counts & 1).astype(bool)
    odd[:, :DIMS - 64] ^= odd[:, 64:]
    return np.packbits(odd[:, :64], axis=1).view(np.uint64).ravel()


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether dropping one byte of ``long`` gives ``short``: the equal beginning and the equal end cover it."""
    size = short.shape[1]
    head, tail = short != long[:, :-1], (short != long[:, 1:])[:, ::-1]
    lead = np.where(head.any(axis=1), head.argmax(axis=1), size)
    trail = np.where(tail.any(axis=1), tail.argmax(axis=1), size)
    return lead + trail >= size


class Found:
    """Per word: number of near words, and the best of them (largest n, then the first in order)."""

    def __init__(self, size: int):
        self.count, self.n, self.best = np.zeros(size, np.int64), np.zeros(size, np.int64), np.full(size, None, object)

    def add(self, at: np.ndarray, n: np.ndarray, names: pa.Array) -> None:
        """``names[i]``, seen n[i] times, is near word at[i]."""
        np.add.at(self.count, at, 1)
        order = np.lexsort((-n, at))
        at, n = at[order], n[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        most = np.repeat(n[first], np.diff(np.r_[first, len(at)]))
        top = np.flatnonzero((n == most) & (n >= self.n[at]))
        for a, k, w in zip(at[top].tolist(), n[top].tolist(), names.take(pa.array(order[top])).to_pylist(), strict=True):
            if k > self.n[a] or self.best[a] is None or w < self.best[a]:
                self.n[a], self.best[a] = k, w

    def batch(self, names: pa.Array):
        rows = np.flatnonzero(self.count)
        return pa.RecordBatch.from_arrays([names.take(pa.array(rows)), pa.array(self.count[rows]), pa.array(self.n[rows]),
                                           pa.array(self.best[rows].tolist(), pa.binary())], ["code", "n_near", "best_n", "best"])


def search_units(rows: DataFrame) -> DataFrame:
    """code, n_near, best_n, best: what each unit knows of a word. Rows come by unit, members first."""

    def run(batches):
        key, members, unit = None, [], None
        for batch in batches:
            ids = [batch[c].to_numpy() for c in ("length", "cell", "a", "b")]
            asks = batch["asks"].to_numpy(zero_copy_only=False)
            change = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in ids], axis=0) | (asks[1:] != asks[:-1])]) if batch.num_rows else []
            for a, b in zip(change, [*change[1:], batch.num_rows], strict=True):
                here = tuple(int(x[a]) for x in ids)
                if here != key:
                    if unit is not None:
                        yield unit.found.batch(unit.names)
                    key, members, unit = here, [], None
                part = batch.slice(a, b - a)
                if not asks[a]:
                    members.append(part)
                    continue
                if unit is None and members:
                    whole = pa.Table.from_batches(members).combine_chunks()
                    unit = Unit(whole["code"].combine_chunks(), whole["n"].to_numpy(), key[0])
                if unit is not None:
                    for s in range(0, part.num_rows, QUERY_BATCH):
                        yield from answers(unit, part.slice(s, QUERY_BATCH))
        if unit is not None:
            yield unit.found.batch(unit.names)

    return rows.mapInArrow(run, "code binary, n_near long, best_n long, best binary")


def answers(unit: Unit, part: pa.RecordBatch):
    code, n = part["code"], part["n"].to_numpy()
    size = np.array([len(w) for w in code.to_pylist()])
    for length in np.unique(size):
        rows = np.flatnonzero(size == length)
        names, mine = code.take(pa.array(rows)), n[rows]
        codes, found = letters(names, length), Found(len(rows))
        for x, y in unit.near(codes, vectors(codes), part["up"].to_numpy()[rows].astype(np.int64), part["down"].to_numpy()[rows].astype(np.int64)):
            found.add(x, unit.n[y], unit.names.take(pa.array(y)))
            if length < unit.length:
                unit.found.add(y, mine[x], names.take(pa.array(x)))
        yield found.batch(names)


# ---- groups

def near_words(known: DataFrame, cell: int = CELL_WORDS, members: int = UNIT_WORDS, queries: int = UNIT_QUERIES, sample: int = SAMPLE) -> DataFrame:
    """code, n_near, best_n, best for each word that has a near one."""
    routes = stage(routed(known, first_splits(known, cell, sample)), "spelling-routes")
    rows = units(routes, members, queries)
    dealt = rows.repartition("unit").sortWithinPartitions("unit", "length", "cell", "a", "b", "asks")
    top = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return search_units(dealt.drop("unit")).groupBy("code").agg(F.sum("n_near").alias("n_near"), top.alias("top")) \
        .select("code", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """code, root: the last word of each chain of forms. ``forms``: code, form. A form occurs ten times as often, so chains are short."""
    step = forms.select(F.col("code").alias("at"), F.col("form").alias("next"))
    moving, done = forms.select("code", F.col("form").alias("root")), []
    while True:
        went = stage(moving.join(step, F.col("root") == F.col("at"), "left"), "spelling-chains")
        done.append(went.where("next IS NULL").select("code", "root"))
        moving = went.where("next IS NOT NULL").select("code", F.col("next").alias("root"))
        if moving.isEmpty():
            return reduce(DataFrame.unionByName, done)


def group_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", **bounds) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of ``words(docs)``."""
    known = words(docs, key, text)
    chosen = F.col("best_n") >= FORM_TIMES * F.col("n")
    judged = stage(known.join(near_words(known, **bounds), "code", "left")
                   .select("code", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(chosen, F.col("best")).alias("form"),
                           F.when(chosen, F.col("best_n")).alias("form_n")), "spelling-forms")
    ends = roots(judged.where("form IS NOT NULL").select("code", "form"))
    return judged.join(ends, "code", "left").select(
        latin(F.col("code")).alias("word"), latin(F.col("form")).alias("form"), latin(F.coalesce("root", "code")).alias("root"), "n", "n_near", "form_n")


def latin(code):
    return F.decode(code, "ISO-8859-1")


@register("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(read_table(spark, sf_dir, "documents"))
