"""Personal data by a semi-Markov conditional random field.

Fixed patterns give the base spans (email, ip, card, phone). The field adds spans that the patterns miss, such as a phone number
without its plus sign. It works on regions: runs of neighbouring blank-parted tokens that hold a digit, an ``@`` or a leading plus, since no
other token can belong to an entity. A segment of up to ``MOST_TOKENS`` tokens has features of the whole span (its shape, digits, separators,
check sum, parts, the word before it); dynamic programming over segments of bounded length chooses boundaries and types together. The weights
maximise the conditional likelihood (forward sums over all segmentations) of the base spans in a bounded sample: the regions of the
documents whose hash comes first, at most ``TRAIN_REGIONS``. To learn what a pattern's marks only confirm, a part of the training phones is shown
without the plus sign, and the contexts of the first ``MADE_REGIONS`` regions also carry made entities in writings that the patterns miss (national
phone numbers, other separators, spelled-out signs) and made numbers that are none (dates, versions, amounts, identifiers, failing check sums).

A span of the field is added if it touches no base span and beats its reading as ordinary text by a margin that is calibrated on held-out
contexts (``PRECISION``).

Edge cases: a null text is empty and has no spans; offsets count code points, ends are exclusive; repeated rows each get their row; texts
and regions of any length are read whole; without training regions nothing is added; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline.llm.common import map_batches, read_table
from pressline.llm.registry import register

KINDS = ("email", "ip", "card", "phone")
# The base patterns.
PATTERNS = {
    "email": re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),      # from the sign on; see email_spans
    # a match takes whole runs of digits, so it begins where one does: the look-behind keeps long runs linear
    "ip": re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
TOKEN = re.compile(r"[^\x09-\x0D\x20]+")
HINT = re.compile(r"[0-9@]|[\[({](?:at|AT)[\])}]")
MOST_TOKENS = 5
TRAIN_REGIONS = 600
TRAIN_TOKENS = 24    # regions of more tokens aren't trained on, but read like others
EPOCHS = 12
RATE, DECAY = 0.15, 1e-3
#: Margin of a field without held-out samples; else the least one from ``LEAST_MARGIN`` on that keeps ``PRECISION`` of the held-out spans right.
MARGIN, LEAST_MARGIN, PRECISION, HELD_OUT = 4.0, 0.5, 0.98, 5
#: Made samples per sampled region: personal data in other writings, and numbers that are none.
MADE = (2, 3)
MADE_REGIONS = 300


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"


def email_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``: from each sign back over the run of
    characters before it, so every run is read once."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        before = text[floor:at]
        start = floor + len(before.rstrip(LOCAL))
        m = PATTERNS["email"].match(text, at) if start < at else None
        if m:
            found.append(("email", start, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in the order of start, then of the kinds."""
    found = []
    if "@" in text:
        found += email_spans(text)
    if "." in text:
        for m in PATTERNS["ip"].finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                found.append(("ip", *m.span()))
    for m in PATTERNS["card"].finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in PATTERNS["phone"].finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without the punctuation around it, as prose puts it."""
    while start < end and text[start] in "\"'<>[]{},;:!?":
        start += 1
    while end > start and text[end - 1] in "\"'<>[]{},;:!?.":
        end -= 1
    return start, end


def regions(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring tokens that can belong to an entity, as (start, end) of each token."""
    out, last = [], -2
    if not HINT.search(text):
        return out
    for k, m in enumerate(TOKEN.finditer(text)):
        if HINT.search(m[0]):
            if k == last + 1:
                out[-1].append(m.span())
            else:
                out.append([m.span()])
            last = k
    return out


def span_features(text: str, start: int, end: int, tokens: int) -> list[str]:
    """Features of a whole candidate span."""
    a, b = trimmed(text, start, end)
    s = text[a:b]
    digits = [c for c in s if "0" <= c <= "9"]
    letters = sum(c.isalpha() for c in s)
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "0", s)))[:16]
    before = TOKEN.findall(text[max(0, a - 40):a])[-1:]
    groups = "-".join(str(min(5, len(g))) for g in re.findall(r"[0-9]+", s))[:14]
    low = s.lower()
    out = [f"spelled={any(x in low for x in ('(at)', '[at]', '{at}'))}", f"zeros={len(s) - len(s.lstrip('0'))}", f"shape={shape}", f"groups={groups}", f"n={min(20, len(digits))}", f"tokens={tokens}", f"letters={min(3, letters)}",
           f"at={s.count('@')}", f"dots={min(4, s.count('.'))}", f"plus={s.startswith('+')}", f"luhn={len(digits) >= 14 and luhn(''.join(digits))}",
           f"parens={'(' in s and ')' in s}", f"octets={s.count('.') == 3 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in s.split('.'))}"]
    if before:
        out.append(f"before={before[0].lower()[:12]}")
    return out


class Field:
    """Weights by (kind, feature); ordinary text is a segment of one token without features, scored 0."""

    def __init__(self):
        self.weights: dict[str, np.ndarray] = {}      # feature -> one weight a kind
        self.margin = MARGIN

    def score(self, features: list[str]) -> np.ndarray:
        total = np.full(len(KINDS), -1.0)
        for f in features:
            w = self.weights.get(f)
            if w is not None:
                total = total + w
        return total

    def lattice(self, text: str, tokens) -> list[tuple[int, int, list[str]]]:
        """Segments (first token, token after the last, features)."""
        return [(i, j, span_features(text, tokens[i][0], tokens[j - 1][1], j - i))
                for i in range(len(tokens)) for j in range(i + 1, min(len(tokens), i + MOST_TOKENS) + 1)]

    def learn(self, samples: list[tuple[int, list[tuple[int, int, list[str]]], dict[tuple[int, int], int]]]):
        """Stochastic gradient steps on the log likelihood: the features of the gold segments less their expectation, which the
        forward and backward sums give. A sample: tokens, lattice, gold (segment -> kind)."""
        for epoch in range(EPOCHS):
            rate = RATE / (1 + epoch / 4)
            for n, lattice, gold in samples:
                scores = [self.score(f) for _, _, f in lattice]
                ahead, back = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
                ahead[0] = back[n] = 0.0
                sums = [np.logaddexp.reduce(s) for s in scores]
                for t in range(n):                    # segments are listed by their first token
                    ahead[t + 1] = np.logaddexp(ahead[t + 1], ahead[t])
                    for (i, j, _), s in zip(lattice, sums, strict=True):
                        if i == t:
                            ahead[j] = np.logaddexp(ahead[j], ahead[t] + s)
                for t in range(n - 1, -1, -1):
                    back[t] = np.logaddexp(back[t], back[t + 1])
                    for (i, j, _), s in zip(lattice, sums, strict=True):
                        if i == t:
                            back[t] = np.logaddexp(back[t], back[j] + s)
                for (i, j, features), s in zip(lattice, scores, strict=True):
                    step = -np.exp(ahead[i] + s + back[j] - ahead[n])
                    if (i, j) in gold:
                        step[gold[i, j]] += 1
                    if np.abs(step).max() > 1e-4:
                        for f in features:
                            w = self.weights.get(f)
                            self.weights[f] = (np.zeros(len(KINDS)) if w is None else w * (1 - rate * DECAY)) + rate * step

    def decode(self, text: str, tokens) -> list[tuple[str, int, int, float]]:
        """The best segmentation's entities: kind, start, end, and by how much the span beats ordinary text."""
        n = len(tokens)
        best, how = np.full(n + 1, -np.inf), [None] * (n + 1)
        best[0] = 0.0
        for t in range(n):
            if best[t] > best[t + 1]:
                best[t + 1], how[t + 1] = best[t], (t, -1, 0.0)
            for j in range(t + 1, min(n, t + MOST_TOKENS) + 1):
                scores = self.score(span_features(text, tokens[t][0], tokens[j - 1][1], j - t))
                k = int(scores.argmax())
                if best[t] + scores[k] > best[j]:
                    best[j], how[j] = best[t] + scores[k], (t, k, float(scores[k]))
        out, t = [], n
        while t:
            i, k, s = how[t]
            if k >= 0:
                out.append((KINDS[k], *trimmed(text, tokens[i][0], tokens[t - 1][1]), s))
            t = i
        return out[::-1]


def training_sample(text: str, base, tokens, plain: bool):
    """The sample of a region of the corpus."""
    return sample_of(text, base, tokens, plain)


def sample_of(text: str, base, tokens, plain: bool):
    """The sample of one region; ``plain`` takes the plus sign off its phones. None if a base span isn't a run of tokens."""
    gold = {}
    for kind, a, b in base:
        if a >= tokens[-1][1] or b <= tokens[0][0]:
            continue
        i = [k for k, t in enumerate(tokens) if t[0] <= a < t[1]]
        j = [k for k, t in enumerate(tokens) if t[0] < b <= t[1]]
        if not i or not j or trimmed(text, tokens[i[0]][0], tokens[j[0]][1]) != (a, b) or j[0] - i[0] >= MOST_TOKENS:
            return None
        gold[i[0], j[0] + 1] = KINDS.index(kind)
    spans = sorted(gold)
    if any(x[1] > y[0] for x, y in zip(spans, spans[1:], strict=False)):
        return None
    if plain:
        signs = {a for kind, a, _ in base if kind == "phone"}
        tokens = [(a + (a in signs), b) for a, b in tokens]
    return len(tokens), Field().lattice(text, tokens), gold


def plain_sample(key: str) -> bool:
    """A third of the samples, by the digest's last byte: the first ones follow from the order by key, the more the larger the input."""
    return int(key[-2:], 16) % 3 == 0


def digits(rng: random.Random, n: int) -> str:
    return str(rng.randrange(1, 10)) + "".join(str(rng.randrange(10)) for _ in range(n - 1))


def made_entity(rng: random.Random) -> tuple[str, str]:
    """(kind, text): personal data as the base patterns don't write it."""
    kind = rng.choice(["phone", "phone", "phone", "phone", "card", "email"])
    if kind == "phone":
        a, b, c = digits(rng, 3), digits(rng, 3), digits(rng, 4)
        return kind, rng.choice([f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"1 ({a}) {b}-{c}", f"({a}){b}-{c}",
                                 f"00{digits(rng, 2)} {digits(rng, 2)} {b} {digits(rng, 2)} {digits(rng, 2)}", f"00{digits(rng, 2)} {a} {b}{c}", f"0{digits(rng, 2)} {c} {digits(rng, 4)}"])
    if kind == "card":
        head = rng.choice("3456") + digits(rng, 14)
        whole = head + next(str(d) for d in range(10) if luhn(head + str(d)))
        return kind, rng.choice([".", "/", "_"]).join(whole[k:k + 4] for k in range(0, 16, 4))
    name = "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randrange(3, 9)))
    host = "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randrange(3, 9)))
    at, dot = rng.choice([("(at)", "."), ("[at]", "."), ("[at]", "[dot]"), ("(at)", "(dot)"), ("{at}", ".")])
    return kind, f"{name}{rng.choice(['', '.x', '7'])}{at}{host}{dot}{rng.choice(['com', 'org', 'net', 'de'])}"


def made_number(rng: random.Random) -> str:
    """Something with digits that is no personal data."""
    y, m, d = rng.randrange(1900, 2030), rng.randrange(1, 13), rng.randrange(1, 29)
    bad = digits(rng, 16)
    bad = bad[:-1] + str((int(bad[-1]) + 1) % 10) if luhn(bad) else bad
    return rng.choice([
        f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{m:02}/{d:02}/{y}", f"{y}-{y + rng.randrange(1, 9)}", f"{rng.randrange(24)}:{rng.randrange(60):02}", f"{rng.randrange(9)}.{rng.randrange(20)}.{rng.randrange(9)}",
        f"v{rng.randrange(9)}.{rng.randrange(9)}", f"{rng.randrange(1, 999)},{digits(rng, 3)},{digits(rng, 3)}", f"{rng.randrange(999)}.{rng.randrange(99):02}", f"978-{rng.randrange(9)}-{digits(rng, 2)}-{digits(rng, 6)}-{rng.randrange(9)}",
        digits(rng, rng.randrange(1, 10)), f"{rng.randrange(100)}%", f"${rng.randrange(1, 99)},{digits(rng, 3)}.50", f"{digits(rng, 5)}-{digits(rng, 4)}", f"#{digits(rng, 4)}-{digits(rng, 4)}",
        "-".join(bad[k:k + 4] for k in range(0, 16, 4)), ".".join(bad[k:k + 4] for k in range(0, 16, 4)), f"{rng.randrange(300, 999)}.{rng.randrange(9)}.{rng.randrange(9)}.{rng.randrange(9)}", f"{digits(rng, 2)} {digits(rng, 2)}",
        f"{digits(rng, 3)} {digits(rng, 2)}", f"{rng.randrange(9)}.{rng.randrange(9)}.", "%08x-%04x" % (rng.getrandbits(32), rng.getrandbits(16)), "%032x" % rng.getrandbits(128), "(at)", "look(at)this"])


# FIXED VALUES: words that stand before personal data, and before other numbers.
CUES = ("call", "tel", "tel.", "phone", "phone:", "fax", "mobile", "ring", "at", "contact", "card", "mail", "write", "or", "me", "on", "to")
OTHERS = ("order", "on", "version", "no.", "page", "room", "since", "about", "total", "isbn", "invoice", "ticket", "the", "in", "code")


def made_samples(key: str, before: str) -> list:
    """Samples in a context of the corpus, the same for the same key."""
    rng, out = random.Random(key), []
    for kind, text in [made_entity(rng) for _ in range(MADE[0])] + [(None, made_number(rng)) for _ in range(MADE[1])]:
        cue = rng.choice(CUES if kind or rng.random() < 0.3 else OTHERS)
        lead = f"{before[-30:].strip()} {cue} " if rng.random() < 0.8 else f"{before[-30:].strip()} "
        lead = re.sub(r"[0-9@+]", "", lead)                             # the context's own entities are no part of it
        line = lead + text + rng.choice(["", ".", ",", "!"]) + " now"
        found = [r for r in regions(line) if r[0][0] < len(lead) + len(text) and r[-1][1] > len(lead)]
        if found:
            out.append(sample_of(line, [(kind, len(lead), len(lead) + len(text))] if kind else [], found[-1], False))
            if out[-1] is not None:
                out[-1] = (*out[-1], line, found[-1])
    return [x for x in out if x]


def calibrated(field: Field, held: list) -> float:
    """The least margin that keeps PRECISION of the spans of held-out samples right; a span is right if it is a gold segment of its kind."""
    scored = []
    for _, _, gold, line, tokens in held:
        ends = {(trimmed(line, tokens[i][0], tokens[j - 1][1]), k) for (i, j), k in gold.items()}
        scored += [(margin, ((a, b), KINDS.index(kind)) in ends) for kind, a, b, margin in field.decode(line, tokens)]
    scored.sort(reverse=True)
    least, right = np.inf, 0
    for n, (margin, good) in enumerate(scored, 1):
        right += good
        if right >= PRECISION * n:
            least = margin
    return max(LEAST_MARGIN, float(least)) if np.isfinite(least) else MARGIN


def train(docs: DataFrame, most: int = TRAIN_REGIONS) -> Field:
    out = pa.schema([("key", pa.string()), ("sample", pa.string())])

    def run(batch):
        rows = []
        for raw in batch["text"].to_pylist():
            text = raw.decode() if raw else ""
            for tokens in regions(text):
                if len(tokens) <= TRAIN_TOKENS and tokens[-1][1] - tokens[0][0] <= 400:
                    a, b = max(0, tokens[0][0] - 40), tokens[-1][1]
                    rows.append((hashlib.md5(text[a:b].encode()).hexdigest(), text[a:b]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=out)

    texts = docs.where(F.col("text").rlike(HINT.pattern)).select(F.col("text").cast("binary").alias("text"))
    rows = map_batches(texts, run, "key string, sample string").distinct().orderBy("key", "sample").limit(most).collect()
    samples, made = [], []
    for n, r in enumerate(rows):
        text, base = r.sample, base_spans(r.sample)
        found = regions(text)
        if found:
            samples.append(training_sample(text, base, found[-1], plain_sample(r.key)))
            if n < MADE_REGIONS:
                made.append(made_samples(r.key, text[:found[-1][0][0]]))
    field = Field()
    if any(s and s[2] for s in samples):
        held = [x for k, group in enumerate(made) if k % HELD_OUT == 0 for x in group]
        shown = [x[:3] for k, group in enumerate(made) if k % HELD_OUT for x in group]
        field.learn([s for s in samples if s] + shown)
        field.margin = calibrated(field, held) if held else MARGIN
    return field


def all_spans(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and base and added spans together, either in order."""
    base = base_spans(text) if HINT.search(text) else []
    if not field.weights:
        return base, base
    added, ends = [], np.maximum.accumulate(np.array([e for _, _, e in base] or [0]))
    starts = np.array([s for _, s, _ in base])
    for tokens in regions(text):
        for kind, a, b, margin in field.decode(text, tokens):
            before = int(np.searchsorted(starts, b))              # base spans that begin before this one ends
            if margin >= field.margin and b > a and not (before and ends[before - 1] > a):
                added.append((kind, a, b))
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_personal(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans (of every kind)."""
    field = train(docs) if field is None else field
    shared = docs.sparkSession.sparkContext.broadcast(field)     # weights of at most the sample's features
    out = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())])

    def run(batch):
        model, rows = shared.value, []
        for i, raw in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            base, every = all_spans(raw.decode() if raw else "", model)
            rows.append((i, *(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return map_batches(texts, run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_spans long")


@register("op4_pii")
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_personal(read_table(spark, sf_dir, "documents"))
