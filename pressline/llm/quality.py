"""Quality classifier by hierarchical empirical Bayes.

Document evidence: two logistic regressions (low quality, toxic) over surface shares and over a lexicon of words and word
beginnings that the labelled documents tie to toxicity. Site evidence: a host (``source``) has a rate of
bad documents, a path (source and language) has one of its own. Each is a Beta posterior whose prior is the level above it
(global rate, then host posterior); the priors' strengths come from the spread of the sites' rates by moments, so sparse sites shrink
towards their prior and large ones follow their own documents. A document's posterior log odds are its evidence plus the
log odds of its path, less the global log odds; it is rejected above one half.

The models are fitted on at most ``TRAIN_ROWS`` labelled documents (the first by a hash of their id), which is the
only sample; scores and site rates cover all documents.

Edge cases: null and empty texts get the features of an empty text; a null source or language is a site
of its own; unlabelled tables, or labels of one class, give evidence 0 for that target; repeated rows each get their row; rows
without id are scored like others; an empty table gives an empty result; further columns are ignored (``keep_good`` keeps
them).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline.llm.common import map_batches, read_table, small_side, stage
from pressline.llm.registry import register

TRAIN_ROWS = 20_000
#: A lexicon entry occurs in so many labelled documents, has so high log odds and z score; at most so many are kept.
LEXICON_DOCS, LEXICON_ODDS, LEXICON_Z, LEXICON_SIZE = 8, 2.5, 4.0, 4000
STEMS = (4, 5, 6)
RIDGE = 1e-2
LIMIT = 0.5

_UPPER = bytes(range(0x41, 0x5B))
_SYMBOLS = b"!#$%&*|<>{}[]^~=\\@"
_STRIP = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
SURFACE = ("log_words", "distinct", "top_word", "repeats", "upper", "symbols", "bars", "word_len", "line_ends", "digits")


def surface(raw: bytes) -> list[float]:
    words = raw.split()
    n = max(1, len(words))
    counts = Counter(words)
    size = max(1, len(raw))

    def share(chars: bytes) -> float:
        return (len(raw) - len(raw.translate(None, chars))) / size

    return [np.log1p(len(words)), len(counts) / n, max(counts.values(), default=0) / n,
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, share(_UPPER), share(_SYMBOLS),
            counts.get(b"|", 0) / n, min(40.0, size / n), raw.count(b"\n") / n, share(b"0123456789")]


def terms(raw: bytes) -> set[bytes]:
    """Distinct words of letters, and their beginnings (marked by a hyphen)."""
    words = set(raw.translate(_STRIP).split())
    return words | {w[:k] + b"-" for w in words for k in STEMS if len(w) > k}


def lexicon(labelled: DataFrame) -> dict[bytes, float]:
    """Terms whose presence speaks for toxicity, with their log odds. ``labelled``: text (binary), toxic."""
    totals = labelled.agg(F.sum("toxic"), F.count("toxic")).first()
    bad, every = int(totals[0] or 0), int(totals[1] or 0)
    if not bad or bad == every:
        return {}

    def run(batch):
        seen, hit = Counter(), Counter()
        for raw, y in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            t = terms(raw or b"")
            seen.update(t)
            if y:
                hit.update(t)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64()),
                                          pa.array([hit[t] for t in seen], pa.int64())], ["term", "seen", "hit"])

    counts = map_batches(labelled.where("toxic IS NOT NULL").select("text", "toxic"), run, "term binary, seen long, hit long") \
        .groupBy("term").agg(F.sum("seen").alias("seen"), F.sum("hit").alias("hit"))
    clean = F.col("seen") - F.col("hit")
    odds = F.log((F.col("hit") + 0.5) / (bad + 1 - F.col("hit") + 0.5)) - F.log((clean + 0.5) / (every - bad + 1 - clean + 0.5))
    z = odds / F.sqrt(1 / (F.col("hit") + 0.5) + 1 / (clean + 0.5))
    rows = (counts.where(F.col("hit") >= LEXICON_DOCS).select("term", odds.alias("odds"), z.alias("z"))
            .where((F.col("odds") >= LEXICON_ODDS) & (F.col("z") >= LEXICON_Z)).orderBy(F.desc("z"), "term").limit(LEXICON_SIZE).collect())
    return {bytes(r.term): float(r.odds) for r in rows}


def features(raw: bytes | None, known: dict[bytes, float]) -> list[float]:
    raw = raw or b""
    found = sorted((known[t] for t in terms(raw) & known.keys()), reverse=True) if known else []
    return [*surface(raw), float(bool(found)), min(10.0, len(found)), min(30.0, sum(found)), found[0] if found else 0.0]


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Ridge logistic regression by Newton steps over standardised columns: mean, scale, weights (constant last)."""
    if len(y) == 0 or y.min() == y.max():
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], RIDGE * len(y) ** 0.5)
    ridge[-1] = 0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge + 1e-9), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS):
    """The lexicon and the two regressions, from a bounded sample of labelled documents."""
    chosen = stage(labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
                   .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
                   .select(F.col("doc_id").alias("label_id"), "quality", "toxic"), "quality-labels")
    texts = stage(docs.select(F.col("doc_id").alias("label_id"), F.col("text").cast("binary").alias("text"))
                  .join(small_side(chosen), "label_id"), "quality-train")
    known = lexicon(texts)

    def run(batch):
        x = [features(raw, known) for raw in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch["quality"], batch["toxic"]], ["x", "quality", "toxic"])

    rows = map_batches(texts.select("text", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")), run,
                       "x array<double>, quality int, toxic int").limit(2 * train_rows).toPandas()
    models = []
    for y in (1 - rows["quality"], rows["toxic"]):
        use = y.notna().to_numpy()
        models.append(fit_logistic(np.array(rows["x"].tolist()).reshape(len(rows), -1)[use], y[use].to_numpy(float)) if use.any() else None)
    return known, models


def evidence(docs: DataFrame, model) -> DataFrame:
    """``row`` (all columns of docs) with p_low and p_toxic of the document alone."""
    known, models = model
    shared = docs.sparkSession.sparkContext.broadcast((known, models))  # at most LEXICON_SIZE terms

    def run(batch):
        words, fits = shared.value
        x = np.array([features(raw, words) for raw in batch["text"].to_pylist()])
        ps = []
        for m in fits:
            ps.append(np.zeros(len(x)) if m is None else 1 / (1 + np.exp(-np.clip(np.column_stack([(x - m[0]) / m[1], np.ones(len(x))]) @ m[2], -30, 30))))
        yield pa.RecordBatch.from_arrays([batch["row"], pa.array(ps[0]), pa.array(ps[1])], ["row", "p_low", "p_toxic"])

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].cast("binary").alias("text"))
    kind = f"row {rows.schema['row'].dataType.simpleString()}, p_low double, p_toxic double"
    return map_batches(rows, run, kind)


def _strength(rates: DataFrame, mean: str, n: str, rate: str):
    """Beta prior strength of a level by moments: what the sites' rates spread beyond chance."""
    spread = F.sum(F.col(n) * (F.col(rate) - F.col(mean)) ** 2)
    chance = F.sum(F.col(mean) * (1 - F.col(mean)))
    r = rates.agg(spread.alias("s"), chance.alias("c"), F.sum(F.col(n) * F.col(mean) * (1 - F.col(mean))).alias("b")).first()
    if not r.b:
        return 1e6
    between = max(1e-9, (r.s - r.c) / r.b)           # share of the variance that lies between sites
    return float(min(1e6, max(1.0, 1 / between - 1)))


def site_rates(scores: DataFrame) -> DataFrame:
    """host, path, host_rate, path_rate, base_rate per site. ``scores``: host, path, bad."""
    paths = stage(scores.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("s")), "quality-paths")
    all_ = paths.agg(F.sum("s"), F.sum("n")).first()
    base = min(1 - 1e-6, max(1e-6, (all_[0] or 0.0) / max(1, all_[1] or 0)))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("rate", F.col("s") / F.col("n")).withColumn("base", F.lit(base))
    k = _strength(hosts, "base", "n", "rate")
    hosts = stage(hosts.select(F.col("host").alias("h"), ((k * F.lit(base) + F.col("s")) / (k + F.col("n"))).alias("host_rate")), "quality-hosts")
    joined = stage(paths.join(small_side(hosts), F.col("host").eqNullSafe(F.col("h"))).withColumn("rate", F.col("s") / F.col("n")).drop("h"), "quality-sites")
    j = _strength(joined, "host_rate", "n", "rate")
    return joined.select("host", "path", "host_rate", ((j * F.col("host_rate") + F.col("s")) / (j + F.col("n"))).alias("path_rate"), F.lit(base).alias("base_rate"))


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", limit: float = LIMIT) -> DataFrame:
    """row (all columns of docs), p_low, p_toxic, host_rate, path_rate, posterior and keep."""
    model = fit(docs, labels)
    both = 1 - (1 - F.col("p_low")) * (1 - F.col("p_toxic"))
    narrow = docs.select("text", F.col(host).alias("host"), F.col(path).alias("path"))
    scores = evidence(narrow, model).select("row.host", "row.path", both.alias("bad"))
    sites = small_side(stage(site_rates(scores), "quality-rates"))

    def logit(p):
        p = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), p))
        return F.log(p / (1 - p))

    judged = evidence(docs, model).withColumn("bad", both)
    joined = judged.join(sites, F.col(f"row.{host}").eqNullSafe(F.col("host")) & F.col(f"row.{path}").eqNullSafe(F.col("path")), "left")
    odds = logit(F.col("bad")) + logit(F.col("path_rate")) - logit(F.col("base_rate"))
    return joined.withColumn("posterior", 1 / (1 + F.exp(-odds))).withColumn("keep", F.col("posterior") <= limit) \
        .select("row", "p_low", "p_toxic", "host_rate", "path_rate", "posterior", "keep")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with all their columns."""
    return judge(docs, labels).where("keep").select("row.*")


@register("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    judged = judge(docs, read_table(spark, sf_dir, "labels"))
    return judged.select("row.doc_id", *(F.round(c, 6).alias(c) for c in ("p_low", "p_toxic", "host_rate", "path_rate", "posterior")), "keep")
