"""Approximate nearest neighbours by an inverted multi-index.

A vector gets one more part, which brings all vectors to the same norm (0 for a query), so the order of distances is that of
inner products, whatever the norms. Its two halves are quantised separately; a cell is a pair of centroids. A query first visits
the cells in the order of the summed distances of its halves to the two centroids, by a heap over the sorted halves, until the
visited cells hold a ``PROBE_SHARE`` of all vectors (and at least ``PROBE_LEAST``). The vectors of the visited cells are
then reranked by the exact inner product in double precision. Then it visits every other cell whose vectors could reach its k-th best score
so far, by a bound from the cell's centroids and radii; the cells left out hold no neighbour, so the result is that of brute force.

The centroids are fitted on at most ``TRAIN_ROWS`` vectors (the first by a hash of their id); every vector is indexed.
The search is a join of blocks: the vectors of a first-half centroid, in parts of about ``PART_ROWS``, meet
blocks of at most about ``QUERY_ROWS`` queries that visit it, so no task holds a whole list. Each meeting returns the
best ``k`` per query, and a window over those picks the final ones. The tests compare it with brute force.

Edge cases: vectors that are null, empty, zero or hold null or non-finite parts take no part, nor do rows without
id or of another length than the most common one; equal scores go to the smaller id; repeated rows are each candidates, and each
query row has a list of its own; with fewer candidates than k all are returned; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressline.llm.common import map_batches, read_table, stage
from pressline.llm.registry import register

CENTROIDS = 64
TRAIN_ROWS = 20_000
ROUNDS = 12
PROBE_SHARE = 0.5
PROBE_LEAST = 2000
PART_ROWS = 4096
QUERY_ROWS = 1024
K = 20


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """id, v (array<double>) of the vectors that take part."""
    v = F.col("v")
    ok = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")) \
        .where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)) \
        .where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0))
    return ok


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows; an empty centroid takes the row that lies farthest from its own."""
    centres = np.unique(x, axis=0)
    centres = centres[np.linspace(0, len(centres) - 1, min(k, len(centres))).astype(int)].copy()
    for _ in range(rounds):
        d = (centres ** 2).sum(1) - 2 * x @ centres.T
        own = d.argmin(1)
        size = np.bincount(own, minlength=len(centres))
        for c in range(len(centres)):
            centres[c] = x[own == c].mean(0) if size[c] else x[(d[np.arange(len(x)), own] + (x ** 2).sum(1)).argmax()]
    return centres


def level(x: np.ndarray, longest: float) -> np.ndarray:
    """The rows with one more part, which makes their squared norms ``longest``."""
    return np.c_[x, np.sqrt(np.maximum(longest - (x ** 2).sum(1), 0))]


def fit(vectors: DataFrame, centroids: int, train_rows: int, longest: float) -> tuple[np.ndarray, np.ndarray] | None:
    rows = vectors.orderBy(F.xxhash64("id"), "id", "v").limit(train_rows).select("v").toPandas()["v"]
    if not len(rows):
        return None
    x = np.array(rows.tolist())
    half = max(1, x.shape[1] // 2)
    x = level(x, longest)
    return kmeans(x[:, :half], centroids), kmeans(x[:, half:], centroids)


def _rows(column) -> np.ndarray:
    return np.stack([np.frombuffer(b, np.float64) for b in column.to_pylist()]) if len(column) else np.empty((0, 0))


def cells(vectors: DataFrame, books, longest: float) -> DataFrame:
    """row (a number of its own), id, i, j (nearest centroid of either half), a, b (distances of the vector's own parts to those of the two) and v as binary."""

    def run(batch):
        x = level(_rows(batch["v"]), longest)
        half = books[0].shape[1]
        i, j = (((c ** 2).sum(1) - 2 * h @ c.T).argmin(1).astype(np.int32) for c, h in zip(books, (x[:, :half], x[:, half:]), strict=True))
        a, b = np.linalg.norm(x[:, :half] - books[0][i], axis=1), np.linalg.norm((x[:, half:] - books[1][j])[:, :-1], axis=1)
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array(i), pa.array(j), pa.array(a), pa.array(b), batch["v"]], ["id", "i", "j", "a", "b", "v"])

    return map_batches(_packed(vectors), run, "id long, i int, j int, a double, b double, v binary", text="v").withColumn("row", F.monotonically_increasing_id())


def _packed(vectors: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            v = b["v"].flatten().to_numpy(zero_copy_only=False)
            n = np.diff(b["v"].offsets.to_numpy())
            at = np.r_[0, np.cumsum(n)]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array([v[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["id", "v"])

    return vectors.select("id", "v").mapInArrow(run, "id long, v binary")


def traverse(query: np.ndarray, books, held: dict[tuple[int, int], int], least: int) -> dict[int, list[int]]:
    """The cells visited, second centroids by first: pairs in the order of summed distance until they hold ``least`` vectors."""
    half = books[0].shape[1]
    near = [((c - q) ** 2).sum(1) for c, q in zip(books, (query[:half], query[half:]), strict=True)]
    order = [np.argsort(d, kind="stable") for d in near]
    a, b = (d[o].tolist() for d, o in zip(near, order, strict=True))
    heap, seen, found, total = [(a[0] + b[0], 0, 0)], {(0, 0)}, {}, 0
    while heap and total < least:
        _, x, y = heapq.heappop(heap)
        i, j = int(order[0][x]), int(order[1][y])
        if n := held.get((i, j)):
            found.setdefault(i, []).append(j)
            total += n
        for p in ((x + 1, y), (x, y + 1)):
            if p[0] < len(a) and p[1] < len(b) and p not in seen:
                seen.add(p)
                heapq.heappush(heap, (a[p[0]] + b[p[1]], *p))
    return found


def bounds(query: np.ndarray, books, radii) -> np.ndarray:
    """Of each cell, a bound on the inner products of its vectors with the query."""
    half = books[0].shape[1]
    a, b = query[:half], query[half:]
    return (books[0] @ a)[:, None] + (books[1][:, :-1] @ b)[None] + np.linalg.norm(a) * radii[0] + np.linalg.norm(b) * radii[1]


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of row pairs, summed in the order of the parts, so equal vectors have equal scores."""
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        total += q[:, d] * x[:, d]
    return total


def best(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, numbers: np.ndarray, allowed: np.ndarray, k: int):
    """Per query its k best allowed rows but its own, (query, row, score): a matrix product picks all that can be among
    them, with a margin above its rounding, and the exact sums decide. ``own`` and ``numbers`` are row numbers."""
    rough = np.where(allowed & (own[:, None] != numbers[None]), queries @ rows.T, -np.inf)
    if rough.shape[1] > k:
        floor = -np.partition(-rough, k - 1, axis=1)[:, k - 1:k]
        floor = floor - 1e-9 * (1 + np.abs(floor))
        floor[~np.isfinite(floor)] = np.finfo(float).min
        rough = np.where(rough >= floor, rough, -np.inf)
    q, r = np.nonzero(rough > -np.inf)
    score = inner(queries[q], rows[r])
    order = np.lexsort((numbers[r], row_ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    top = rank < k
    return q[top], r[top], score[top]


def search(vectors: DataFrame, is_query, key: str = "vec_id", column: str = "embedding", k: int = K, centroids: int = CENTROIDS,
           train_rows: int = TRAIN_ROWS, share: float = PROBE_SHARE, least: int = PROBE_LEAST) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row for which ``is_query(id)`` holds."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    valid = usable(vectors, key, column)
    norm = F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)
    length = valid.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("count"), F.max(norm).alias("longest")).orderBy(F.desc("count"), "n").first()
    if length is None:
        return spark.createDataFrame([], schema)
    valid = valid.where(F.size("v") == length.n)
    books = fit(valid, centroids, train_rows, length.longest)
    index = stage(cells(valid, books, length.longest), "ann-index")
    made = index.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.max("a").alias("a"), F.max("b").alias("b")).collect()  # at most centroids squared rows
    counts = {(r.i, r.j): r.n for r in made}
    full = np.zeros((len(books[0]), len(books[1])), bool)
    radii = np.zeros((2, *full.shape))
    for r in made:
        full[r.i, r.j], radii[:, r.i, r.j] = True, (r.a, r.b)
    total = sum(counts.values())
    want = max(least, int(share * total))
    lists = {}
    for (i, _), n in counts.items():
        lists[i] = lists.get(i, 0) + n
    parts = {i: -(-n // PART_ROWS) for i, n in lists.items()}
    queries = index.where(is_query(F.col("id"))).select("row", "id", "v")
    blocks = max(1, -(-queries.count() // QUERY_ROWS))

    def first(batch):
        seen = []
        for raw in batch["v"].to_pylist():
            found = np.zeros(full.shape, bool)
            for i, js in traverse(np.r_[np.frombuffer(raw, np.float64), 0.0], books, counts, want).items():
                found[i, js] = True
            seen.append(np.packbits(found).tobytes())
        yield pa.RecordBatch.from_arrays([batch["row"], batch["id"], pa.array(seen, pa.binary()), batch["v"]], ["row", "id", "seen", "v"])

    def others(batch):
        left = []
        for raw, seen, floor in zip(batch["v"].to_pylist(), batch["seen"].to_pylist(), batch["floor"].to_pylist(), strict=True):
            top = bounds(np.frombuffer(raw, np.float64), books, radii)
            # equal scores are wanted too; the margin lies above the rounding of the bound and of the score
            reach = full if floor is None else full & (top >= floor - 1e-9 * (1 + abs(floor) + np.abs(top) + length.longest))
            left.append(np.packbits(reach & ~np.unpackbits(np.frombuffer(seen, np.uint8), count=full.size).reshape(full.shape).astype(bool)).tobytes())
        yield pa.RecordBatch.from_arrays([batch["row"], batch["id"], pa.array(left, pa.binary()), batch["v"]], ["row", "id", "seen", "v"])

    def visit(batch):
        out = []
        for row, q, raw, seen in zip(batch["row"].to_pylist(), batch["id"].to_pylist(), batch["v"].to_pylist(), batch["seen"].to_pylist(), strict=True):
            open_ = np.unpackbits(np.frombuffer(seen, np.uint8), count=full.size).reshape(full.shape)
            for i in np.flatnonzero(open_.any(axis=1)).tolist():
                js = np.flatnonzero(open_[i]).astype(np.int32).tobytes()
                out += [(i, p, row, q, js, raw) for p in range(parts[i])]
        cols = list(zip(*out, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                                         ["i", "part", "row", "id", "js", "v"])

    part_of = F.element_at(F.create_map(*[F.lit(x) for pair in parts.items() for x in pair]), F.col("i"))
    laid = index.select("row", "id", "i", "j", "v", F.pmod(F.xxhash64("row"), part_of).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    names = ["query_row", "query_id", "vec_row", "vec_id", "score"]

    def meet(left, right):
        q, x = _rows(left["v"]), _rows(right["v"])
        if not len(q) or not len(x):
            return pa.table({c: pa.array([], t) for c, t in zip(names, (*[pa.int64()] * 4, pa.float64()), strict=True)})
        open_ = np.zeros((len(q), len(books[1])), bool)
        for n, js in enumerate(left["js"].to_pylist()):
            open_[n, np.frombuffer(js, np.int32)] = True
        a, b, s = best(q, left["row"].to_numpy(), x, right["id"].to_numpy(), right["row"].to_numpy(), open_[:, right["j"].to_numpy()], k)
        found = [left["row"].to_numpy()[a], left["id"].to_numpy()[a], right["row"].to_numpy()[b], right["id"].to_numpy()[b], s]
        return pa.table({c: pa.array(x) for c, x in zip(names, found, strict=True)})

    def reranked(visited):
        """``names``: the best of the cells that ``visited`` (row, id, seen, v) names."""
        visits = map_batches(visited, visit, "i int, part int, row long, id long, js binary, v binary", text="v") \
            .withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
        return visits.groupBy("i", "part", "block").cogroup(laid.groupBy("i", "part", "block")) \
            .applyInArrow(meet, "query_row long, query_id long, vec_row long, vec_id long, score double")

    def ranked(found):
        rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row"))
        return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("rank", *names)

    near = stage(map_batches(queries, first, "row long, id long, seen binary, v binary", text="v"), "ann-first")
    early = stage(ranked(reranked(near)), "ann-early")
    floors = early.where(F.col("rank") == k).select(F.col("query_row").alias("floor_row"), F.col("score").alias("floor"))
    asked = near.join(floors, F.col("row") == F.col("floor_row"), "left").select("row", "id", "seen", "floor", "v")
    far = stage(map_batches(asked, others, "row long, id long, seen binary, v binary", text="v"), "ann-others")
    return ranked(early.select(*names).unionByName(reranked(far))).select("query_id", "rank", "vec_id", "score")


@register("op8_inverted_multi_index")
def op8_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
