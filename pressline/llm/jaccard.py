"""N-gram Jaccard join with set-relation skipping.

Documents are sets of word shingles; two link when 100 * intersection >= threshold * union. Equal sets
form a class and are handled once. The links between classes are found in these steps:

1. *Screen*. Sorted by hash, the first common shingles of two linked sets x, y (x the smaller) lie in the first
   ``slack(n) + need(x)`` of either, slack being what may be missing. So a set can only link if at least
   ``need`` of that prefix occur in other sets. One shuffle of packed fingerprints counts this; a fingerprint collision
   only lets a set stay. Most documents end here.
2. *Index lists*. The shingles of the sets that stay are counted, sets of which fewer than the threshold occur
   elsewhere go, and the others are sorted by frequency. Each prefix shingle, with the set's size and the position,
   goes to the list of its shingle *and block of sizes*. A position bounds the size that a partner can have, so an entry visits
   the block above its own only if its position still allows such partners: blocks are skipped by position.
3. *Answers*. Every list has a pivot, its most central set, and every set is compared with its pivots
   exactly. What remains is derived from the pivot's answers: the overlap of two members y, z of pivot P is
   |P| - |P\\y| - |P\\z| + the overlap of their differences from P. Pairs whose distances to P differ by more than the allowed
   distance, or that both link to P, need no look. Members are dealt to units of two blocks of at most ``BLOCK``
   sets, so no task holds a whole group, and a unit returns only a spanning forest of the links that it found.

Two linked sets share a prefix shingle, hence a list, hence a pivot: no link between different texts is lost. The components are those of
pivot links and forests.

Edge cases: null or empty texts and texts without words have 0 shingles and link with nothing, their
component is their own id; repeated rows and equal texts are one class; rows without doc_id keep
their shingle count, have no component and link with nothing; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline.llm.common import binary_text, map_batches, read_table, small_side, stage
from pressline.llm.components import components
from pressline.llm.registry import register
from pressline.llm.shingles import set_digest, shingle_sets

WORDS = 5
THRESHOLD = 80       # in hundredths
#: A 1 / SCREEN part of a set's shingles must be shared within the screened prefix.
SCREEN = 8
BLOCK = 512
#: Columns of the 0/1 matrices that a unit holds at a time.
COLUMNS = 2048


def least_overlap(n, threshold: int):
    """The least part of a set of n that a linked set shares with it."""
    return -(-threshold * n // 100)


def doc_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (distinct shingles) and cls (digest of the set) of every document."""
    out = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64())])

    def run(batch):
        sets = shingle_sets(batch["text"].to_pylist(), words)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(s) for s in sets], pa.int64()),
                                          pa.array([set_digest(s) for s in sets], pa.int64())], schema=out)

    return map_batches(binary_text(docs), run, "doc_id long, n long, cls long")


def _packed(pieces, buckets: int, short: bool):
    """One row per bucket of the entries (hash, class) of several sets: bucket, hashes, classes."""
    h = np.concatenate([p for p, _ in pieces])
    c = np.repeat(np.array([k for _, k in pieces], np.int64), [len(p) for p, _ in pieces])
    bucket = ((h & np.uint64(0xFFFFFF)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    h, c, bucket = h[order], c[order], bucket[order]
    if short:
        h = ((h >> np.uint64(24)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist() + [len(bucket)]
    ends = list(zip(edges[:-1], edges[1:], strict=True))
    return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]]), pa.array([h[a:b].tobytes() for a, b in ends], pa.binary()),
                                       pa.array([c[a:b].tobytes() for a, b in ends], pa.binary())], ["bucket", "h", "c"])


def _shared(table: pa.Table, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket: the entries (hash, class) whose hash occurs in several classes, and the number of those classes."""
    h = np.concatenate([np.frombuffer(x, kind) for x in table["h"].to_pylist()])
    c = np.concatenate([np.frombuffer(x, np.int64) for x in table["c"].to_pylist()])
    order = np.lexsort((c, h))
    h, c = h[order], c[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]      # each class once
    h, c = h[new], c[new]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    df = np.repeat(np.diff(np.r_[first, len(h)]), np.diff(np.r_[first, len(h)]))
    return h[df > 1], c[df > 1], df[df > 1]


def _buckets(spark: SparkSession) -> int:
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def screen(docs: DataFrame, words: int, threshold: int) -> DataFrame:
    """cls and hits (fingerprints in its screened prefix that other classes have too)."""
    buckets = _buckets(docs.sparkSession)

    def run(batch):
        pieces = {}
        for s in shingle_sets(batch["text"].to_pylist(), words):
            n = len(s)
            if n:
                pieces.setdefault(set_digest(s), s[:n - least_overlap(n, threshold) + max(1, n // SCREEN)])
        if pieces:
            yield _packed([(p, k) for k, p in pieces.items()], buckets, True)

    def count(table):
        _, c, _ = _shared(table, np.uint32)
        cls, hits = np.unique(c, return_counts=True)
        return pa.table({"cls": pa.array(cls, pa.int64()), "hits": pa.array(hits, pa.int64())})

    packed = map_batches(binary_text(docs.where(F.col("doc_id").isNotNull())), run, "bucket int, h binary, c binary")
    return packed.groupBy("bucket").applyInArrow(count, "cls long, hits long").groupBy("cls").agg(F.sum("hits").alias("hits"))


def whole_sets(docs: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """cls, n and the whole set (sorted hashes as binary) of each representative (doc_id, cls)."""
    out = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("members", pa.binary())])
    side = small_side(reps.select(F.col("doc_id").alias("rep"), "cls"))
    texts = binary_text(docs).join(side, F.col("doc_id") == F.col("rep")).select("cls", "text")

    def run(batch):
        sets = shingle_sets(batch["text"].to_pylist(), words)
        rows = [(k, len(s), s.tobytes()) for k, s in zip(batch["cls"].to_pylist(), sets, strict=True) if set_digest(s) == k]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return map_batches(texts, run, "cls long, n long, members binary").dropDuplicates(["cls"])


def frequencies(sets: DataFrame) -> DataFrame:
    """cls, h, df of every shingle that several of the sets have."""
    buckets = _buckets(sets.sparkSession)

    def run(batch):
        yield _packed([(np.frombuffer(m, np.uint64), k) for k, m in zip(batch["cls"].to_pylist(), batch["members"].to_pylist(), strict=True)], buckets, False)

    def count(table):
        h, c, df = _shared(table, np.uint64)
        return pa.table({"cls": pa.array(c, pa.int64()), "h": pa.array(h.view(np.int64), pa.int64()), "df": pa.array(df, pa.int32())})

    return map_batches(sets.select("cls", "members"), run, "bucket int, h binary, c binary", text="members") \
        .groupBy("bucket").applyInArrow(count, "cls long, h long, df int")


def pivot_pairs(shared: DataFrame, sizes: DataFrame, threshold: int) -> DataFrame:
    """(cls, pivot) of every set and each of its lists' pivots. ``shared``: cls, h, df; ``sizes``: cls, n."""
    least = F.ceil(F.col("n") * threshold / 100)
    ordered = (shared.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("toks"))
               .join(sizes, "cls").where(F.size("toks") >= least)
               .withColumn("score", F.aggregate("toks", F.lit(0.0), lambda a, t: a + F.log(t["df"].cast("double"))) / F.col("n"))
               .withColumn("alone", F.col("n") - F.size("toks")))
    entries = ordered.select("cls", "n", "score", "alone", F.posexplode(
        F.slice("toks", F.lit(1), (F.size("toks") - least + 1).cast("int"))).alias("pos", "tok"))
    rest = F.col("n") - F.col("alone") - F.col("pos")                        # shingles from this one on
    partner = F.least(F.floor(rest * (100 + threshold) / threshold - F.col("n")), F.floor(F.col("n") * 100 / threshold))

    def block(n):
        return F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / threshold))).cast("int")

    entries = entries.select("cls", "score", F.col("tok.h").alias("h"),
                             F.explode(F.sequence(block(F.col("n")), F.greatest(block(F.col("n")), block(F.greatest(F.lit(1), partner))))).alias("block"))
    lists = (entries.groupBy("h", "block").agg(F.count(F.lit(1)).alias("m"), F.max(F.struct("score", "cls")).alias("p"))
             .where("m > 1").select(F.col("h").alias("lh"), F.col("block").alias("lb"), F.col("p.cls").alias("pivot")))
    return entries.join(lists, (F.col("h") == F.col("lh")) & (F.col("block") == F.col("lb"))).select("cls", "pivot").where("cls <> pivot").distinct()


def _dealt(members: DataFrame, block: int) -> DataFrame:
    """``members`` (pivot, cls, ...) with the number of blocks of the pivot and the block of each member."""
    counts = members.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    return members.join(counts, "pivot").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))


def _unpacked(table: pa.Table):
    return [np.frombuffer(m, np.uint64) for m in table["members"].to_pylist()]


def pivot_answers(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """pivot, cls, distance (1 - Jaccard) and linked of each pair."""
    dealt = _dealt(pairs, BLOCK)
    own = dealt.select("pivot", "block").distinct().withColumn("cls", F.col("pivot"))
    rows = dealt.select("pivot", "block", "cls").unionByName(own).join(sets.select("cls", "members"), "cls")
    out = pa.schema([("pivot", pa.int64()), ("cls", pa.int64()), ("distance", pa.float64()), ("linked", pa.bool_())])

    def answer(table):
        pivot, cls, sets_ = table["pivot"][0].as_py(), table["cls"].to_pylist(), _unpacked(table)
        base = sets_[cls.index(pivot)]
        found = []
        for k, s in zip(cls, sets_, strict=True):
            if k != pivot:
                both = _overlap(base, s)
                union = len(base) + len(s) - both
                found.append((pivot, k, 1 - both / union, 100 * both >= threshold * union))
        cols = list(zip(*found, strict=True)) or [[], [], [], []]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return rows.groupBy("pivot", "block").applyInArrow(answer, "pivot long, cls long, distance double, linked boolean")


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _matrix_overlap(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlaps of all left with all right arrays of distinct values, by 0/1 matrices over slices of the common values."""
    lv, rv = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(lv, rv)
    lr, rr = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    total = np.zeros((len(left), len(right)), np.float32)

    def held(values, rows):
        at = np.searchsorted(common, values)
        at[at == len(common)] = 0
        ok = common[at] == values
        order = np.argsort(at[ok], kind="stable")
        return at[ok][order], rows[ok][order]

    if len(common):
        lc, lr = held(lv, lr)
        rc, rr = held(rv, rr)
        for a in range(0, len(common), COLUMNS):
            sides = []
            for c, r, n in ((lc, lr, len(left)), (rc, rr, len(right))):
                i, j = np.searchsorted(c, (a, a + COLUMNS))
                m = np.zeros((n, min(COLUMNS, len(common) - a)), np.float32)
                m[r[i:j], c[i:j] - a] = 1
                sides.append(m)
            total += sides[0] @ sides[1].T
    return total


def derived_links(answers: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links (u, v) among the members of each pivot, beyond its own, as spanning forests by unit."""
    far = 1 - threshold / 100
    open_ = answers.groupBy("pivot").agg(F.min(F.when(~F.col("linked"), F.col("distance"))).alias("nearest"), F.count(F.lit(1)).alias("m")) \
        .where(F.col("nearest").isNotNull() & (F.col("m") > 1)).select(F.col("pivot").alias("p"), "nearest")
    # a linked member is wanted only if an unlinked one can be within reach of it
    wanted = answers.join(open_, F.col("pivot") == F.col("p")).where(~F.col("linked") | (F.col("distance") >= F.col("nearest") - far - 1e-9))
    dealt = _dealt(wanted.select("pivot", "cls", "distance", "linked"), BLOCK)
    units = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("pivot", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls", "distance", "linked")
    own = units.select("pivot", "i", "j").distinct().select("pivot", "i", "j", F.lit(-1).alias("block"), F.col("pivot").alias("cls"),
                                                            F.lit(0.0).alias("distance"), F.lit(True).alias("linked"))
    rows = units.unionByName(own).join(sets.select("cls", "members"), "cls")

    def derive(table):
        block, cls = table["block"].to_numpy(), table["cls"].to_numpy()
        dist, linked, sets_ = table["distance"].to_numpy(), table["linked"].to_numpy(zero_copy_only=False), _unpacked(table)
        p = int(np.flatnonzero(block == -1)[0])
        i = min(block[block >= 0])
        left = np.flatnonzero(block == i)
        right = np.flatnonzero(block > i) if (block > i).any() else left
        root = list(range(len(cls)))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for k in np.flatnonzero(linked):
            root[find(int(k))] = find(p)
        minus = [np.setdiff1d(sets_[p], s, assume_unique=True) for s in sets_]
        plus = [np.setdiff1d(s, sets_[p], assume_unique=True) for s in sets_]
        n, a, b = (np.array([len(x) for x in y]) for y in (sets_, minus, plus))
        need = -(-threshold * (n[left][:, None] + n[right][None]) // (100 + threshold))
        known = len(sets_[p]) - a[left][:, None] - a[right][None]
        most = np.minimum(a[left][:, None], a[right][None]) + np.minimum(b[left][:, None], b[right][None])
        look = (known + most >= need) & ~(linked[left][:, None] & linked[right][None]) \
            & (np.abs(dist[left][:, None] - dist[right][None]) <= far + 1e-9)
        edges = []
        r, c = look.any(axis=1), look.any(axis=0)
        if r.any():
            left, right, look = left[r], right[c], look[r][:, c]
            same = _matrix_overlap([minus[k] for k in left], [minus[k] for k in right]) + _matrix_overlap([plus[k] for k in left], [plus[k] for k in right])
            for x, y in np.argwhere(look & (known[r][:, c] + same >= need[r][:, c])).tolist():
                x, y = int(left[x]), int(right[y])
                u, v = find(x), find(y)
                if x != y and u != v:
                    root[u] = v
                    edges.append((int(cls[x]), int(cls[y])))
        return pa.table({"u": pa.array([e[0] for e in edges], pa.int64()), "v": pa.array([e[1] for e in edges], pa.int64())})

    return rows.groupBy("pivot", "i", "j").applyInArrow(derive, "u long, v long")


def jaccard_components(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    rows = stage(doc_sets(docs, words), "jaccard-docs")
    classes = rows.where("doc_id IS NOT NULL AND n > 0").groupBy("cls", "n").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    # the partner of a set may be smaller, and then asks for fewer shared shingles
    ask = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * threshold / 100) / SCREEN))
    stay = stage(classes.join(screen(docs, words, threshold), "cls").where(F.col("hits") >= ask).select("doc_id", "cls", "n"), "jaccard-stay")
    sets = stage(whole_sets(docs, stay, words), "jaccard-sets")
    pairs = stage(pivot_pairs(frequencies(sets), sets.select("cls", "n"), threshold), "jaccard-pairs")
    answers = stage(pivot_answers(pairs, sets, threshold), "jaccard-answers")
    links = answers.where("linked").select(F.col("cls").alias("u"), F.col("pivot").alias("v")).unionByName(derived_links(answers, sets, threshold))
    roots = components(links)
    joined = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    # a component's least doc_id, for the classes that are linked or have copies; other documents stand alone
    least = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.sum("copies").alias("size")).where("size > 1")
    known = stage(joined.join(least, "root").select(F.col("cls").alias("k"), F.col("n").alias("kn"), "component_id"), "jaccard-known")
    found = rows.join(small_side(known), (F.col("cls") == F.col("k")) & (F.col("n") == F.col("kn")) & F.col("doc_id").isNotNull(), "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


@register("op1_ngram_jaccard")
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


def brute_force(docs: list[tuple[int | None, bytes | None]], words: int = WORDS, threshold: int = THRESHOLD):
    """All pairs of a small fixture, with plain Python sets: rows of (doc_id, n_shingles, component_id)."""
    sets = []
    for _, raw in docs:
        w = (raw or b"").lower().split()
        sets.append({tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(docs):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if a is not None and docs[j][0] is not None and both and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (a, _) in enumerate(docs):
        if a is not None:
            least[find(i)] = min(a, least.get(find(i), a))
    return [(a, len(s), None if a is None else least[find(i)]) for i, ((a, _), s) in enumerate(zip(docs, sets, strict=True))]
