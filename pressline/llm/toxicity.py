"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer maps each word to a symbol: learned insult terms by strength, further insults, threats, targets,
negations and verbs of reported speech. Four small transducers read the symbols of a clause: negation marks what follows
it closely, reported speech marks what follows a report or stands in quotes, target marks insults near a person, threat joins a threat to its
target. Their composition is one deterministic machine whose output symbols are the clause's events, such as
a directed, negated or reported insult. An event's weight adds the weights of its parts (strength, negated, reported, directed); a clause's
score adds its events' weights, and a document's probability is a logistic function of its matched clauses'
scores. Insult terms are words and word beginnings, so inflected and compound forms match.

Everything is learned from labelled rows that aren't held out (crc32 of the id's text mod 4 is not 2), at most ``TRAIN_ROWS`` of
them (the first by a hash of the id): terms and their strength by log odds over documents, parts by log odds over clauses, the
final function by ridge regression. Scores cover whole texts of all rows and use nothing but the text.

Edge cases: null and empty texts have no clauses and get the score of a text without any match; rows without id are never held
out and never train; several labels of one id count as toxic if one is; several texts of one id train as one of them (the smallest); without labels
of both classes the fixed lists score with fixed weights; repeated rows each get their row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Hashable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline.llm.common import map_batches, read_table, small_side, stage
from pressline.llm.registry import register

TRAIN_ROWS, HELD_OUT, FOLDS, LIMIT = 20_000, 2, 4, 0.3
#: A term occurs in so many toxic documents and has so high log odds and z score. Strength 1 begins at the last figure's log odds, 2 at the one before.
TERM_DOCS, TERM_ODDS, TERM_Z, STRENGTHS = 5, 2.0, 4.0, (3.5, 5.0)
STEMS = (4, 5, 6, 7, 8, 9)
RIDGE = 0.1
KNOWN_WORDS = 500_000

# FIXED VALUES: word lists of the grammar; a trailing hyphen marks a beginning.
INSULTS = ("idiot-", "moron-", "stupid-", "imbecil-", "loser", "losers", "scum", "scumbag-", "trash", "garbage", "pathetic", "worthless", "disgusting", "clown", "clowns",
           "dumbass-", "asshole-", "bastard-", "bitch-", "vermin", "subhuman-", "arschloch", "dummkopf", "abschaum", "wichser", "drecksau", "connard-", "connasse-", "salaud-", "abruti-",
           "ordure", "gilipollas", "cabrón", "cabron", "estúpid-", "estupid-", "escoria", "basura")
THREATS = ("kill", "killed", "killing", "murder", "murdered", "hurt", "destroy", "shoot", "stab", "strangle", "lynch", "töten", "umbringen", "erschießen", "tuer", "tuerai", "égorger", "matar", "mataré", "matarte")
TARGETS = ("you", "your", "youre", "yourself", "u", "he", "she", "him", "her", "they", "them", "these", "those", "du", "dich", "dir", "ihr", "euch", "tu", "toi", "vous", "ils", "elles", "tú", "ti", "usted", "ustedes", "ellos", "ellas")
NEGATIONS = ("not", "no", "never", "isnt", "arent", "dont", "neither", "nor", "nicht", "kein", "keine", "keiner", "nie", "pas", "jamais", "aucun", "nunca", "jamás", "ningún")
REPORTS = ("said", "says", "say", "called", "calls", "wrote", "writes", "claimed", "quoted", "quote", "reported", "sagte", "sagt", "nannte", "schrieb", "dit", "appelé", "écrit", "dijo", "dice", "llamó", "escribió")
LISTS = (("p", INSULTS), ("t", THREATS), ("y", TARGETS), ("n", NEGATIONS), ("r", REPORTS))

OTHER, QUOTE, END = "w", "q", "#"
LEARNED = ("i0", "i1", "i2")
MATCHED = (*LEARNED, "p", "t")
SYMBOLS = (OTHER, QUOTE, END, *MATCHED, "y", "n", "r")
NEGATED, REPORTED, DIRECTED = "~", '"', ">"
PARTS = (*MATCHED, NEGATED, REPORTED, DIRECTED)
REACH_NEGATION, REACH_TARGET = 3, 4
#: Weights of the parts before any label is seen.
FIXED_PARTS = np.array([1.0, 2.0, 3.0, 3.0, 2.0, -1.5, -1.0, 1.0])

_WORDS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_CLAUSE = re.compile(rb"[^.!?;\n]+")
_TOKEN = re.compile(rb"[a-z\x80-\xff]+|[\"]")


# ---- transducers

class Transducer:
    """A sequential transducer: ``step(state, symbol)`` gives the next state and the symbol it writes."""

    def __init__(self, start: Hashable, step: Callable):
        self.start, self.step = start, step

    def compose(self, after: Transducer) -> Transducer:
        """Reads what this one reads and writes what ``after`` makes of its output."""
        def step(state, symbol):
            here, between = self.step(state[0], symbol)
            there, out = after.step(state[1], between)
            return (here, there), out
        return Transducer((self.start, after.start), step)

    def compile(self, symbols) -> Machine:
        """The states that can be reached, as tables."""
        number, todo, table = {self.start: 0}, [self.start], []
        for state in todo:
            row = []
            for symbol in symbols:
                to, out = self.step(state, symbol)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append((number[to], out))
            table.append(row)
        return Machine({s: i for i, s in enumerate(symbols)}, [[to for to, _ in row] for row in table], [[out for _, out in row] for row in table])


class Machine:
    """next state and output per state and symbol."""

    def __init__(self, symbols, to, out):
        self.symbols, self.to, self.out = symbols, to, out

    def events(self, clause) -> list[str]:
        """Output symbols that tell of an insult, a threat or the target that follows one."""
        state, found, at = 0, [], self.symbols
        for symbol in (*clause, END):
            k = at[symbol]
            out, state = self.out[state][k], self.to[state][k]
            if out[0] in "ipt" or out == "y" + DIRECTED:
                found.append(out)
        return found


def hit(symbol: str) -> bool:
    return symbol[0] in "ipt"


def negation(reach: int = REACH_NEGATION) -> Transducer:
    """Marks insults and threats at most ``reach`` words after a negation."""
    def step(left, x):
        if x == END:
            return 0, x
        if x == "n":
            return reach, x
        return max(0, left - 1), x + NEGATED if hit(x) and left else x
    return Transducer(0, step)


def reported_speech() -> Transducer:
    """Marks insults and threats after a verb of reporting, or within quotes; quotes may run over clauses no further than one."""
    def step(state, x):
        said, quoted = state
        if x == END:
            return (False, False), x
        if x == QUOTE:
            return (said, not quoted), x
        if x == "r":
            return (True, quoted), x
        return state, x + REPORTED if hit(x) and (said or quoted) else x
    return Transducer((False, False), step)


def target(kinds: str, reach: int = REACH_TARGET) -> Transducer:
    """Marks symbols of ``kinds`` at most ``reach`` words after a target, and targets that follow such a symbol as closely."""
    def step(state, x):
        near, waits = state
        if x == END:
            return (0, 0), x
        if x[0] == "y":                                                     # another transducer may have marked it
            return (reach, 0), "y" + DIRECTED if waits else x
        if x[0] in kinds:
            return (max(0, near - 1), 0 if near else reach), x + DIRECTED if near else x
        return (max(0, near - 1), max(0, waits - 1)), x
    return Transducer((0, 0), step)


def grammar() -> Machine:
    """Negation, reported speech, insult targets and threat targets, composed."""
    return negation().compose(reported_speech()).compose(target("ip")).compose(target("t")).compile(SYMBOLS)


class Lexicon:
    """The lexical transducer: whole words first, then the longest known beginning; learned terms before fixed lists."""

    def __init__(self, learned: dict[bytes, float]):
        self.whole, self.stems, self.known = {}, {}, {}
        for kind, entries in LISTS:
            for entry in entries:
                raw = entry.encode()
                (self.stems if raw.endswith(b"-") else self.whole)[raw.rstrip(b"-")] = kind
        for term, odds in learned.items():
            kind = LEARNED[sum(odds >= least for least in STRENGTHS)]
            (self.stems if term.endswith(b"-") else self.whole)[term.rstrip(b"-")] = kind
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)

    def symbol(self, word: bytes) -> str:
        got = self.known.get(word)
        if got is None:
            got = self.whole.get(word) or next((self.stems[word[:k]] for k in self.lengths if word[:k] in self.stems), OTHER)
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            self.known[word] = got
        return got


def clauses(raw: bytes, words: Lexicon, machine: Machine):
    """Yields (start, end, events) in bytes of each clause with events; nothing for a text without insult or threat."""
    found = set(raw.translate(_WORDS).split())
    hits = {w for w in found if hit(words.symbol(w))}
    if not hits:
        return
    low = raw.translate(_LOWER)
    for m in _CLAUSE.finditer(low):
        tokens = _TOKEN.findall(m[0])
        if not hits.isdisjoint(tokens):
            events = machine.events([QUOTE if t == b'"' else words.symbol(t) for t in tokens])
            if events:
                yield m.start(), m.end(), events


def parts(events) -> np.ndarray:
    """How often each part occurs in the events."""
    seen = Counter()
    for e in events:
        kind = e.rstrip(NEGATED + REPORTED + DIRECTED)
        if kind in MATCHED:
            seen[kind] += 1
        seen.update(c for c in e[len(kind):])
    return np.array([seen[p] for p in PARTS], np.float64)


# ---- learning

def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def training(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """text, toxic of at most ``rows`` labelled documents that aren't held out; staged."""
    chosen = stage(labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
                   .where(~held_out("id")).orderBy(F.xxhash64("id"), "id").limit(rows), "toxicity-labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text")).join(small_side(chosen), "id")
    return stage(texts.groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "toxicity-train")


def learned_terms(train: DataFrame, toxic: int, every: int) -> dict[bytes, float]:
    """Words and beginnings that speak for toxicity, with their log odds; bounded by the bounded sample."""

    def run(batch):
        seen, bad = Counter(), Counter()
        for raw, y in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            words = set((raw or b"").translate(_WORDS).split())
            found = words | {w[:k] + b"-" for w in words for k in STEMS if len(w) > k}
            seen.update(found)
            if y:
                bad.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64()), pa.array([bad[t] for t in seen], pa.int64())],
                                         ["term", "seen", "bad"])

    counts = map_batches(train.select("text", "toxic"), run, "term binary, seen long, bad long").groupBy("term").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad"))
    clean = F.col("seen") - F.col("bad")
    odds = F.log((F.col("bad") + 0.5) / (toxic - F.col("bad") + 0.5)) - F.log((clean + 0.5) / (every - toxic - clean + 0.5))
    z = odds / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (clean + 0.5))
    kept = counts.where(F.col("bad") >= TERM_DOCS).select("term", odds.alias("odds"), z.alias("z")).where((F.col("odds") >= TERM_ODDS) & (F.col("z") >= TERM_Z))
    return {bytes(r.term): float(r.odds) for r in kept.collect()}


def part_weights(found: list[np.ndarray], n_clauses: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log odds of each part over clauses (of a mark, over matched clauses), shrunk towards the fixed weights.
    ``found``: per document a row of part counts per matched clause."""
    weight = np.zeros(len(PARTS))
    with_part = np.array([[(f[:, p] > 0).sum() if len(f) else 0 for p in range(len(PARTS))] for f in found], np.float64)
    matched = np.array([len(f) for f in found], np.float64)
    for p, fixed in enumerate(FIXED_PARTS):
        whole, trust = (n_clauses, 2.0) if PARTS[p] in MATCHED else (matched, 10.0)
        a, b = (with_part[y == k, p].sum() for k in (1, 0))
        n, m = (max(1.0, whole[y == k].sum()) for k in (1, 0))
        share, tilt = trust / (n + m), np.exp(fixed / 2)                    # pseudo-clauses whose log odds are the fixed weight
        weight[p] = np.log((a + share * n * tilt) / n) - np.log((b + share * m / tilt) / m)
    return weight


def summary(found: np.ndarray, n_words: int, n_clauses: int, weight: np.ndarray) -> list[float]:
    """What the final function sees of a document: its matched clauses' scores."""
    scores = np.maximum(0, found @ weight) if len(found) else np.zeros(0)
    total = float(scores.sum())
    learned = [float(np.log1p(found[:, p].sum())) if len(found) else 0.0 for p in range(len(MATCHED))]
    return [float(np.log1p(total)), float(scores.max(initial=0)), float(np.log1p((scores > 0).sum())), float(total / np.sqrt(1 + n_words)), 100 * total / (20 + n_words), *learned]


#: The final function without labels of both classes.
FIXED_FINAL = (np.zeros(5 + len(MATCHED)), np.ones(5 + len(MATCHED)), np.array([1.5, 0.4, 0.3, 0, 0, *[0.0] * len(MATCHED), -3.0]))


def fit_final(x: np.ndarray, y: np.ndarray):
    """Ridge logistic regression by Newton steps: mean, scale, weights (constant last)."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    ridge = np.r_[np.full(z.shape[1] - 1, RIDGE * len(y) ** 0.5), 1e-9]
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        move = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += move
        if np.abs(move).max() < 1e-6:
            break
    return mean, scale, w


class Model:
    """Learned terms, weights of the parts, final function."""

    def __init__(self, terms: dict[bytes, float], weight: np.ndarray, final):
        self.terms, self.weight, self.final = terms, weight, final
        self.words = self.machine = None

    def __getstate__(self):
        return self.terms, self.weight, self.final

    def __setstate__(self, state):
        self.__init__(*state)

    def read(self, raw: bytes | None):
        """Matched clauses (start, end, events), number of words and of clauses."""
        if self.words is None:
            self.words, self.machine = Lexicon(self.terms), grammar()
        raw = raw or b""
        return list(clauses(raw, self.words, self.machine)), len(raw.split()), 1 + len(_CLAUSE.findall(raw))

    def score(self, features: np.ndarray) -> np.ndarray:
        mean, scale, w = self.final
        return 1 / (1 + np.exp(-np.clip((features - mean) / scale @ w[:-1] + w[-1], -30, 30)))


def rows_of_parts(found) -> np.ndarray:
    return np.array([parts(events) for *_, events in found]).reshape(len(found), len(PARTS))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    train = training(docs, labels, rows)
    toxic, every = (int(v or 0) for v in train.agg(F.sum("toxic"), F.count("toxic")).first())
    if not toxic or toxic == every:
        return Model({}, FIXED_PARTS, FIXED_FINAL)
    terms = learned_terms(train, toxic, every)
    draft = Model(terms, FIXED_PARTS, FIXED_FINAL)

    def run(batch):
        read = [draft.read(raw) for raw in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([rows_of_parts(f).ravel().tolist() for f, *_ in read], pa.list_(pa.float64())), pa.array([n for _, n, _ in read], pa.int64()),
                                          pa.array([c for *_, c in read], pa.int64()), batch["id"], batch["toxic"]], ["found", "n_words", "n_clauses", "id", "toxic"])

    seen = map_batches(train.select("id", "text", "toxic"), run, "found array<double>, n_words long, n_clauses long, id long, toxic int").toPandas().sort_values("id")  # at most ``rows``
    found = [np.asarray(f, np.float64).reshape(-1, len(PARTS)) for f in seen["found"]]
    y = seen["toxic"].to_numpy(np.float64)
    weight = part_weights(found, seen["n_clauses"].to_numpy(), y)
    x = np.array([summary(f, n, c, weight) for f, n, c in zip(found, seen["n_words"], seen["n_clauses"], strict=True)])
    return Model(terms, weight, fit_final(x, y))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, clauses: array of (start, end, score, events) in code points, the end exclusive, for each matched clause."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # terms of the bounded sample
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("events", pa.string())]))

    def run(batch):
        m = shared.value
        features, spans = [], []
        for raw in batch["text"].to_pylist():
            found, n_words, n_clauses = m.read(raw)
            counts = rows_of_parts(found)
            features.append(summary(counts, n_words, n_clauses, m.weight))
            spans.append([])
            if found:
                points = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
                spans[-1] = [{"start": int(points[a]), "end": int(points[b]), "score": float(s), "events": " ".join(e)}
                             for (a, b, e), s in zip(found, counts @ m.weight, strict=True)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(m.score(np.array(features))), pa.array(spans, kind)], ["doc_id", "score", "clauses"])

    return map_batches(rows, run, "doc_id long, score double, clauses array<struct<start:long,end:long,score:double,events:string>>")


@register("op11_toxicity_grammar")
def op11_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"),
                                     F.size("clauses").cast("long").alias("n_clauses"))
