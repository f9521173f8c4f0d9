"""Secret scans: all rules in one deterministic automaton, run over the bytes once.

Rules are small regular expressions over bytes (classes, sequences, alternatives, repeats). They are
compiled to one nondeterministic automaton, made deterministic by subset construction and minimised;
the result is one array ``next[state * 256 + byte]`` and one rule mask per state. The scan runs
the automaton over many lanes of a text buffer in step: lanes begin after two bytes that lead every
state back to the start, so lanes don't interact and each byte is read once.

The automaton tells where a rule's value begins; the value runs on to the end of its bytes. The start
comes from a second, equally compiled automaton of the reversed head, run backwards from the value. Matches of a rule
are leftmost and don't overlap; ones that fail a rule's length check are dropped without a retry.

Besides the base rules (assign, access, hex) the method adds spans of further rules (private key
blocks, source forge, chat and payment tokens, JSON web tokens), which never touch a base span.

Edge cases: null and empty texts have no spans; offsets count code points; repeated rows each give
their row; a text of any length is scanned whole; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pressline.llm.common import binary_text, map_batches, read_table
from pressline.llm.registry import register

LANES = 4096
FEW = 8


# ---- rules as trees: ("set", bytes) | ("seq", ...) | ("alt", ...) | ("rep", node, least, most or None)

def one(chars: bytes):
    return ("set", frozenset(chars))


def seq(*nodes):
    return ("seq", *nodes)


def alt(*nodes):
    return ("alt", *nodes)


def rep(node, least: int, most: int | None = None):
    return ("rep", node, least, most)


def word(text: str, any_case: bool = False):
    return seq(*(one(f"{c.lower()}{c.upper()}".encode() if any_case else c.encode()) for c in text))


def span(first: str, last: str) -> bytes:
    return bytes(range(ord(first), ord(last) + 1))


def flipped(node):
    if node[0] == "seq":
        return seq(*(flipped(x) for x in reversed(node[1:])))
    if node[0] == "alt":
        return alt(*(flipped(x) for x in node[1:]))
    return ("rep", flipped(node[1]), *node[2:]) if node[0] == "rep" else node


UPPER, LOWER, DIGIT = span("A", "Z"), span("a", "z"), span("0", "9")


@dataclass(frozen=True)
class Rule:
    """head, then one or more bytes of value; a match ends with the value's run. ``least``: bytes that
    the value (``whole``: the whole match) has at least."""
    kind: str
    head: tuple
    value: bytes
    least: int
    whole: bool = False


_QUOTE = rep(one(b"\"'"), 0, 1)
_BLANKS = rep(one(b" "), 0)
BASE = (
    Rule("assign", seq(alt(word("password", True), word("passwd", True), word("secret", True), word("token", True),
                           seq(word("api", True), rep(one(b"_"), 0, 1), word("key", True))),
                       _QUOTE, _BLANKS, one(b":="), _BLANKS, _QUOTE), UPPER + LOWER + DIGIT + b"+/_.=-", 8),
    Rule("access", word("AKIA"), UPPER + DIGIT, 16, True),
    Rule("hex", seq(), DIGIT + span("a", "f"), 32, True),
)
MORE = (
    Rule("forge", seq(word("gh"), one(b"pousr"), word("_")), UPPER + LOWER + DIGIT, 36),
    Rule("chat", seq(word("xox"), one(b"abprs"), word("-")), UPPER + LOWER + DIGIT + b"-", 20),
    Rule("payment", seq(one(b"sr"), word("k_"), alt(word("live"), word("test")), word("_")), UPPER + LOWER + DIGIT, 16),
    Rule("maps", word("AIza"), UPPER + LOWER + DIGIT + b"_-", 35),
    Rule("webtoken", seq(word("eyJ")), UPPER + LOWER + DIGIT + b"_.-", 40),
    Rule("pem", seq(word("-----BEGIN "), rep(one(UPPER + b" "), 0), word("PRIVATE KEY")), b"-", 5),
)


class Automaton:
    """The minimal deterministic automaton of several rules: ``next``, a flat transition array, and
    ``mask``, the rules that accept in each state. States that accept come last."""

    def __init__(self, nodes, unanchored: bool):
        self.edges, self.eps, self.goal = [], [], {}
        first = self._state()
        if unanchored:
            self.edges[first].append((frozenset(range(256)), first))
        for k, node in enumerate(nodes):
            start, end = self._build(node)
            self.eps[first].append(start)
            self.goal[end] = 1 << k
        self._minimise(*self._subsets(first))
        del self.edges, self.eps, self.goal

    def _state(self) -> int:
        self.edges.append([])
        self.eps.append([])
        return len(self.edges) - 1

    def _build(self, node) -> tuple[int, int]:
        kind = node[0]
        start = end = self._state()
        if kind == "set":
            end = self._state()
            self.edges[start].append((node[1], end))
        elif kind == "seq":
            for x in node[1:]:
                a, b = self._build(x)
                self.eps[end].append(a)
                end = b
        elif kind == "alt":
            end = self._state()
            for x in node[1:]:
                a, b = self._build(x)
                self.eps[start].append(a)
                self.eps[b].append(end)
        else:
            _, x, least, most = node
            for _ in range(least):
                a, b = self._build(x)
                self.eps[end].append(a)
                end = b
            stop = self._state()
            if most is None:
                a, b = self._build(x)
                self.eps[end] += [a, stop]
                self.eps[b] += [a, stop]
            else:
                for _ in range(most - least):
                    a, b = self._build(x)
                    self.eps[end] += [a, stop]
                    end = b
                self.eps[end].append(stop)
            end = stop
        return start, end

    def _closed(self, states) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for t in self.eps[todo.pop()]:
                if t not in found:
                    found.add(t)
                    todo.append(t)
        return frozenset(found)

    def _subsets(self, first):
        start = self._closed([first])
        number, table, masks, todo = {start: 0}, [], [], [start]
        while todo:
            now = todo.pop(0)
            masks.append(sum({self.goal[s] for s in now if s in self.goal}))
            row = [set() for _ in range(256)]
            for s in now:
                for chars, t in self.edges[s]:
                    for c in chars:
                        row[c].add(t)
            known, line = {}, []
            for targets in row:
                key = frozenset(targets)
                if key not in known:
                    closed = self._closed(key)
                    if closed not in number:
                        number[closed] = len(number)
                        todo.append(closed)
                    known[key] = number[closed]
                line.append(known[key])
            table.append(line)
        return np.array(table), np.array(masks)

    def _minimise(self, table, masks):
        """Partition refinement: states stay together while their masks and successors' classes agree."""
        part = np.unique(masks, return_inverse=True)[1]
        while True:
            refined = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].ravel()
            if refined.max() == part.max():
                break
            part = refined
        # the start keeps number 0 and accepting states come last
        firsts = np.array([np.flatnonzero(part == p)[0] for p in range(part.max() + 1)])
        order = sorted(range(len(firsts)), key=lambda p: (masks[firsts[p]] > 0, part[0] != p, firsts[p]))
        rank = np.argsort(order)
        self.mask = masks[firsts][order]
        self.next = rank[part[table[firsts]]][order].astype(np.int32).ravel()
        self.first_accepting = int(np.sum(self.mask == 0)) if self.mask[0] == 0 else 0


class Scanner:
    """One forward automaton for all rules and one backward automaton for each rule's head."""

    def __init__(self, rules=BASE + MORE):
        self.rules = rules
        # a rule accepts at the first byte of its value, a head-less one from its run's FEW-th byte on;
        # following every rule's value to its end here would multiply the states of all others
        least = [FEW if r.head == seq() else 1 for r in rules]
        self.forward = Automaton([seq(r.head, rep(one(r.value), n, n)) for r, n in zip(rules, least, strict=True)], True)
        self.back = [Automaton([flipped(r.head)], False) for r in rules]
        steps = self.forward.next.reshape(-1, 256)
        # pairs of bytes that lead every state back to the start
        self.resets = np.array([(steps[np.unique(steps[:, a])] == 0).all(axis=0) for a in range(256)])
        self.rows = self.forward.next * 256                    # where each next state's row begins

    def accepted(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which some rule accepts, with their masks: the one pass over all bytes."""
        resets = np.flatnonzero(self.resets[buf[:-1], buf[1:]]) + 2
        aim = np.linspace(0, len(buf), LANES, endpoint=False).astype(np.int64)[1:]
        cut = np.searchsorted(resets, aim)
        starts = np.unique(np.r_[0, resets[cut[cut < len(resets)]]])
        starts = starts[starts < len(buf)]
        ends = np.r_[starts[1:], len(buf)]
        order = np.argsort(starts - ends, kind="stable")       # the longest lanes first
        at, stop = starts[order], ends[order]
        lengths = stop - at
        state = np.zeros(len(at), np.int32)
        table, least = self.rows, self.forward.first_accepting * 256
        alive = len(at)
        where, what = [], []
        for step in range(int(lengths[0]) if len(lengths) else 0):
            while lengths[alive - 1] <= step:
                alive -= 1
            now = state[:alive]
            now += buf[at[:alive] + step]
            now[:] = table[now]
            if now.max() >= least:
                k = np.flatnonzero(now >= least)
                where.append(at[k] + step)
                what.append(self.forward.mask[now[k] >> 8])
        if not where:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        where, what = np.concatenate(where), np.concatenate(what)
        order = np.argsort(where)
        return where[order], what[order]

    def starts(self, rule: int, raw: bytes, end: int, floor: int) -> int | None:
        """The leftmost start, at ``floor`` or later, of a head of the rule that ends before ``end``."""
        auto, state, best, p = self.back[rule], 0, None, end
        if auto.mask[0]:
            best = end
        while p > floor:
            state = int(auto.next[state * 256 + raw[p - 1]])
            p -= 1
            if auto.mask[state]:
                best = p
            elif state == self._dead(rule):
                break
        return best

    def _dead(self, rule: int) -> int:
        auto = self.back[rule]
        if not hasattr(auto, "dead"):
            steps = auto.next.reshape(-1, 256)
            stuck = [s for s in range(len(steps)) if not auto.mask[s] and (steps[s] == s).all()]
            auto.dead = stuck[0] if stuck else -1
        return auto.dead

    def spans(self, raw: bytes, where: np.ndarray, what: np.ndarray) -> list[tuple[int, int, int]]:
        """(rule, start, end) in bytes of one text from the positions at which rules accept in it."""
        found = []
        for k, rule in enumerate(self.rules):
            at = where[(what >> k) & 1 == 1]
            if not len(at):
                continue
            done = 0
            for v in at.tolist():
                if v < done:           # inside the match before
                    continue
                start = max(v - FEW + 1, done) if rule.head == seq() else self.starts(k, raw, v, done)
                if start is None:      # an earlier match took the head
                    continue
                value = start if rule.head == seq() else v
                done = v + 1
                while done < len(raw) and raw[done] in rule.value:
                    done += 1
                if done - (start if rule.whole else value) >= rule.least:
                    found.append((k, start, done))
        return found


_SCANNER: list[Scanner] = []


def scanner() -> Scanner:
    if not _SCANNER:
        _SCANNER.append(Scanner())
    return _SCANNER[0]


def scan_texts(texts: list[bytes | None]) -> list[list[tuple[str, int, int]]]:
    """Base spans and further spans (kind, start, end in code points) of each text, in the order of
    start and then of the kinds."""
    scan = scanner()
    raws = [t or b"" for t in texts]
    buf = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    where, what = scan.accepted(buf)
    edges = np.cumsum([0, *(len(r) + 1 for r in raws)])
    cuts = np.searchsorted(where, edges)
    out = []
    for i, raw in enumerate(raws):
        a, b = cuts[i], cuts[i + 1]
        if a == b:
            out.append([])
            continue
        found = scan.spans(raw, where[a:b] - edges[i], what[a:b])
        base = sorted((s for s in found if s[0] < len(BASE)), key=lambda s: s[1])
        begins, ends = np.array([s for _, s, _ in base]), np.maximum.accumulate(np.array([e for _, _, e in base] or [0]))
        kept = list(base)
        for span in (s for s in found if s[0] >= len(BASE)):
            before = int(np.searchsorted(begins, span[2]))              # base spans that begin before this one ends
            if not before or ends[before - 1] <= span[1]:
                kept.append(span)
        kept.sort(key=lambda s: (s[1], s[0]))
        points = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)] if kept else ()        # bytes to code points
        out.append([(scan.rules[k].kind, int(points[s]), int(points[e])) for k, s, e in kept])
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    kinds = [r.kind for r in BASE]
    out = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in kinds), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batch):
        rows = []
        for i, spans in zip(batch["doc_id"].to_pylist(), scan_texts(batch["text"].to_pylist()), strict=True):
            base = [s for s in spans if s[0] in kinds]
            rows.append((i, *(sum(s[0] == k for s in base) for k in kinds),
                         hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in kinds) + ", base_sha256 string, spans string"
    return map_batches(binary_text(docs), run, schema)


@register("op10_secrets")
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))
