"""Toxicity through noisy-channel deobfuscation.

A character trigram model is counted over all documents. Spans that look disguised (look-alike signs inside a
word, letters repeated three times or more, single letters spaced out) become lattices: each position offers its
literal reading, the letters that it can stand for, and for a run of one letter one or two of it; separators
between spaced letters may vanish or be a word edge, and spans may have any length. A Viterbi pass finds the reading
of least cost under the model; words of the rules are readings too, at a cost of their own, so a rule word wins only
where the character model finds nothing cheaper. The restored text is scored by a rule list learned from the labelled sample: a word or word beginning that a text holds a number
of times, or at a rate. Rules are chosen greedily by how many toxic documents not yet explained they cover, each with
the lower confidence bound of its precision.

Defined results: a null text is scored as empty (the score of a document without evidence); rows with a null
doc_id are scored and not held out; repeated rows are scored each; without labels, or with labels of one kind
only, there are no rules; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import as_bytes, filter_texts, slices, table
from lattica.llm.labels import held_out, labelled_sample

CUT = 0.5
#: The rule list has this many rules at most: a parameter of the fit, like the sample.
RULES = 400
LEAST_COVER = 3.5
LEAST_PRECISION = 0.55
SURE = 0.95
COMMON = 0.12
PREFIXES = range(4, 9)
#: (times, words): a rule may ask for so many occurrences, and for one in so many words at least (0: at any rate).
DEMANDS = ((1, 0), (2, 0), (3, 0), (2, 400), (3, 200), (3, 100))
#: Symbols of the character model: word edge, a to z, any other letter, anything else.
EDGE, OTHER, SIGN = 0, 27, 28
SYMBOLS = 29
STAND_IN_COST = 1.2
DROP_COST = 0.3
#: What a known word costs, whatever its letters: the prior of a rule word against the model's text.
KNOWN_COST = 6.0
#: The letters that look-alike signs stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "¡": "i", "€": "e", "£": "l", "¥": "y", "µ": "u", "*": "aeiou",
}
_LETTER = r"[^\W\d_]"
WORD = re.compile(rf"{_LETTER}+")
#: Readings of spans up to this length are kept for the next time, so many of them at most.
LONGEST_KEPT = 64
MOST_KEPT = 200_000
SEPARATORS = " .-_*"
_IS_LETTER = np.array([chr(b).isalpha() and b < 128 or b >= 128 for b in range(256)])
_IS_SIGN = np.isin(np.arange(256), [ord(c) for c in STANDS_FOR if c.isascii()])
_IS_SEPARATOR = np.isin(np.arange(256), [ord(c) for c in SEPARATORS])
_IS_WHITE = np.arange(256) <= 32

_BYTE_SYMBOL = np.full(256, SIGN, np.uint8)
_BYTE_SYMBOL[:33] = EDGE
for _b in range(26):
    _BYTE_SYMBOL[65 + _b] = _BYTE_SYMBOL[97 + _b] = 1 + _b
_BYTE_SYMBOL[128:192] = 255  # a following byte belongs to the letter before it
_BYTE_SYMBOL[192:] = OTHER


def trigrams(text: bytes) -> np.ndarray:
    """Codes of the character trigrams of a text."""
    s = _BYTE_SYMBOL[np.frombuffer(text, np.uint8)]
    s = s[s != 255].astype(np.int32)
    s = np.concatenate([[EDGE], s, [EDGE]]).astype(np.int32)
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


def character_model(docs: DataFrame) -> np.ndarray:
    """Cost (negative log probability) of each symbol after each two, counted over every document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount(trigrams(b" ".join(as_bytes(part.column("text")))), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["code", "n"])

    n = np.zeros(SYMBOLS**3)
    for r in docs.select("text").mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():  # SYMBOLS ** 3 rows at most
        n[r["code"]] = r["n"]
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two = n.sum(0) + 0.5
    two /= two.sum(1, keepdims=True)
    return -np.log((n + 20 * two[None]) / (n.sum(2, keepdims=True) + 20))


def symbol(c: str) -> int:
    o = ord(c) - 96
    return o if 1 <= o <= 26 else OTHER if c.isalpha() else EDGE if c.isspace() else SIGN


def _runs(span: str) -> list[int]:
    """How often the character at each position stands from there on."""
    runs = [1] * len(span)
    for i in range(len(span) - 2, -1, -1):
        if span[i] == span[i + 1]:
            runs[i] = runs[i + 1] + 1
    return runs


def _arcs(span: str, spaced: bool, runs: list[int], i: int) -> list[tuple[str, float, int]]:
    c, run = span[i], runs[i]
    if spaced and c in SEPARATORS:
        return [("", DROP_COST, i + 1), (" ", DROP_COST, i + 1)]
    here = [(c, 0.0, i + 1)]
    here += [(x, STAND_IN_COST if c != "*" else 2 * STAND_IN_COST, i + 1) for x in STANDS_FOR.get(c, "")]
    if run > 2:
        here += [(c * k, DROP_COST, i + run) for k in (1, 2)]
        for x in STANDS_FOR.get(c, ""):
            here.append((x, STAND_IN_COST + DROP_COST, i + run))
    return here


def lattice(span: str, spaced: bool) -> list[list[tuple[str, float, int]]]:
    """From each position: (output, cost, next position)."""
    runs = _runs(span)
    return [_arcs(span, spaced, runs, i) for i in range(len(span))]


def _written(out: tuple | None) -> str:
    parts = []
    while out is not None:
        out, text = out
        parts.append(text)
    return "".join(reversed(parts))


def viterbi(span: str, cost: np.ndarray, spaced: bool, known: dict[str, float]) -> str:
    """The reading of least cost. A known word pays KNOWN_COST in place of the model's cost, where it is read from the
    whole span or, in a spaced one, stands between two edges."""
    runs, end = _runs(span), len(span)

    def words_from(start: int) -> Iterator[tuple[int, str, float]]:
        """Known words that can be read from a position: (next position, word, cost)."""
        beams: dict[int, dict[str, float]] = {start: {"": 0.0}}
        while beams:
            i = min(beams)
            for out, c0 in beams.pop(i).items():
                if known.get(out):
                    yield i, out, c0
                for text, c, j in _arcs(span, spaced, runs, i) if i < end else ():
                    if (grown := out + text) in known and c0 + c < (held := beams.setdefault(j, {})).get(grown, 1e9):
                        held[grown] = c0 + c

    # States (the last two symbols) of the positions ahead, with cost and the way there as a chain
    best: dict[int, dict[tuple[int, int], tuple[float, tuple | None]]] = {0: {(EDGE, EDGE): (0.0, None)}}
    done: list[str] = []

    def reach(j: int, state: tuple[int, int], total: float, out: tuple | None) -> None:
        held = best.setdefault(j, {})
        if state not in held or total < held[state][0]:
            held[state] = (total, out)

    for i in range(end):
        if i not in best:
            continue
        states = best.pop(i)
        if len(states) == 1 and not best:  # every reading goes through here
            ((state, (_, out)),) = states.items()
            done.append(_written(out))
            states = {state: (0.0, None)}
        arcs = _arcs(span, spaced, runs, i)
        for (a, b), (c0, out) in states.items():
            for text, c, j in arcs:
                x, y, total = a, b, c0 + c
                for ch in text:
                    z = symbol(ch)
                    total += cost[x, y, z]
                    x, y = y, z
                reach(j, (x, y), total, (out, text) if text else out)
        starts = [(c0, out) for (_, b), (c0, out) in states.items() if b == EDGE] if known and (spaced or not i) else []
        if starts:
            c0, out = min(starts, key=lambda x: x[0])
            for j, word, c in words_from(i):
                if j == end:
                    reach(j, (EDGE, EDGE), c0 + c + KNOWN_COST, (out, word))
                elif spaced and span[j] in SEPARATORS and not word.endswith(" "):
                    reach(j + 1, (symbol(word[-1]), EDGE), c0 + c + KNOWN_COST + DROP_COST, (out, word + " "))
    ends = [(c + (cost[a, b, EDGE] if b != EDGE else 0.0), out) for (a, b), (c, out) in best.get(end, {}).items()]
    return "".join(done) + _written(min(ends, key=lambda x: x[0])[1]) if ends else span


@dataclass
class Channel:
    """Restores disguised spans; readings are kept, up to a bound."""

    cost: np.ndarray
    words: tuple[str, ...] = ()
    known: dict[str, float] = field(default_factory=dict)  # beginnings of words; true for whole words
    memory: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        for w in self.words:
            for i in range(len(w) + 1):
                self.known.setdefault(w[:i], 0.0)
            self.known[w] = 1.0

    def read(self, span: str, spaced: bool) -> str:
        key = ("\1" if spaced else "\0") + span
        if (out := self.memory.get(key)) is None:
            out = viterbi(span, self.cost, spaced, self.known)
            if len(span) <= LONGEST_KEPT:
                if len(self.memory) >= MOST_KEPT:
                    self.memory.clear()
                self.memory[key] = out
        return out

    def token(self, token: str) -> str:
        """The reading of a token in which a sign touches a letter or a letter stands three times over."""
        return self.read(token.strip("\"'.,;:?#%&()[]{}-_~^=/\\<>").rstrip("!$*+|"), False)

    def restorations(self, texts: list[bytes]) -> list[str]:
        """For each text, the readings of its disguised spans, joined by lines."""
        joined = b"\n" + b"\n\n".join([*texts, b""])  # two signs apart, so that no run goes on into the next text
        raw = np.frombuffer(joined.lower(), np.uint8)
        letter, sign = _IS_LETTER[raw], _IS_SIGN[raw]
        touch = np.flatnonzero(letter[:-1] & sign[1:] | sign[:-1] & letter[1:])
        same = raw[:-1] == raw[1:]
        triple = np.flatnonzero(same[:-1] & same[1:] & letter[:-2] & (raw[:-2] < 128))
        white = np.flatnonzero(_IS_WHITE[raw])
        after = np.unique(np.searchsorted(white, np.concatenate([touch, triple])))
        spans = [(a, b, False) for a, b in zip((white[after - 1] + 1).tolist(), white[after].tolist(), strict=True)]
        # Runs of single letters (or signs) with one separator between: every second place from first to last
        apart = _IS_SEPARATOR[raw] | _IS_WHITE[raw]
        lone = np.zeros(len(raw), bool)
        lone[1:-1] = (letter | sign)[1:-1] & (raw[1:-1] < 128) & apart[:-2] & apart[2:] & ~_IS_SEPARATOR[raw[1:-1]]
        run = np.flatnonzero(lone[:-4] & lone[2:-2] & lone[4:])
        if len(run):
            cut = np.flatnonzero(np.diff(run) != 2) + 1
            spans += [(a, b + 5, True) for a, b in zip(run[np.concatenate([[0], cut])].tolist(), run[np.concatenate([cut - 1, [len(run) - 1]])].tolist(), strict=True)]
        ends = np.cumsum([len(t) + 2 for t in texts])
        out: list[list[str]] = [[] for _ in texts]
        for (a, b, spaced), i in zip(spans, np.searchsorted(ends, [x[0] - 1 for x in spans], "right").tolist(), strict=True):
            t = joined[a:b].decode("utf-8", "replace").lower()
            out[i] += [self.read(x, True) for x in (t, t[2:], t[:-2])] if spaced else [self.token(t)]
        return ["\n".join(x) for x in out]


def meets(demand: tuple[int, int], times: int, words: int) -> bool:
    return times >= demand[0] and times * demand[1] >= (words if demand[1] else 0)


def counts(text: str, restored: str) -> tuple[Counter, int]:
    """How often a text and its restored spans hold each word and (marked ^) each word beginning; its length in words."""
    out: Counter[str] = Counter()
    for w, n in Counter(WORD.findall(text) + WORD.findall(restored)).items():
        out[w] += n
        for k in PREFIXES:
            if len(w) >= k:
                out["^" + w[:k]] += n
    return out, len(text.split())


def bound(hit: float, miss: float, z: float = 1.64) -> float:
    """Lower end of Wilson's interval for hit / (hit + miss), z standard errors wide."""
    n = hit + miss
    if not n:
        return 0.0
    p = hit / n
    return (p + z * z / 2 / n - z * (p * (1 - p) / n + z * z / 4 / n**2) ** 0.5) / (1 + z * z / n)


Rule = tuple[str, tuple[int, int]]


def learn(sample: list[tuple[bytes, int]], total: dict[int, int], channel: Channel) -> tuple[dict[Rule, float], float]:
    """Rules with their scores, and the score of a document that none applies to."""
    toxic, clean = {t for t, y in sample if y}, {t for t, y in sample if not y}
    toxic, clean = sorted(toxic), sorted(clean - toxic)
    if not toxic or not clean:
        return {}, 0.0
    weight = (total.get(0, 1) / len(clean)) / max(total.get(1, 1) / len(toxic), 1e-9)

    def rules_of(texts: list[bytes], known=None):
        for i, (t, r) in enumerate(zip(texts, channel.restorations(texts), strict=True)):
            held, n = counts(t.decode().lower(), r)
            for f in held if known is None else known & held.keys():
                for d in DEMANDS if held[f] > 1 else DEMANDS[:1]:  # what stands once meets the first demand only
                    if meets(d, held[f], n):
                        yield i, (f, d)

    of: dict[Rule, list[int]] = defaultdict(list)
    for i, f in rules_of(toxic):
        of[f].append(i)
    of = {f: d for f, d in of.items() if len(d) >= LEAST_COVER}
    against: Counter[Rule] = Counter(f for _, f in rules_of(clean, {f for f, _ in of}))
    precision = {f: bound(len(d), weight * against[f]) for f, d in of.items()}
    open_, rules = np.ones(len(toxic)), {}  # a document counts a quarter for each rule that covers it
    # Most open documents for their precision; whole words before beginnings, longer beginnings before
    # shorter ones, stricter demands before looser ones
    rank = lambda f, n: (-n * precision[f] ** 4, f[0].startswith("^"), -len(f[0]), -f[1][1], -f[1][0], f, n)
    heap = [rank(f, float(len(d))) for f, d in of.items() if precision[f] >= LEAST_PRECISION]
    heapq.heapify(heap)
    while heap and len(rules) < RULES:
        *_, f, counted = heapq.heappop(heap)
        n = float(open_[of[f]].sum())
        common = precision[f] >= SURE or len(of[f]) >= COMMON * len(toxic)  # worth having though its documents are covered
        if n < counted:  # counted before others were chosen
            if n >= LEAST_COVER or common:
                heapq.heappush(heap, rank(f, n))
            continue
        stem, own = f[0].lstrip("^"), set(of[f])
        kin = [g for g in rules if g[0].lstrip("^").startswith(stem) or g[0].startswith("^") and stem.startswith(g[0][1:])]
        if any(len(own.difference(of[g])) < max(LEAST_COVER, 0.1 * len(own)) for g in kin):
            continue  # says what a rule of the same stem has said
        rules[f] = precision[f]
        open_[of[f]] /= 4
    missed = float((open_ == 1).sum())
    return rules, min(0.4, (missed + 1) * total.get(1, 1) / len(toxic) / max(sum(total.values()), 1))


@dataclass
class Scorer:
    channel: Channel
    rules: dict[Rule, float]
    base: float
    tree: object = None

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.tree is None:
            self.tree = ahocorasick.Automaton()
            for stem in {f.lstrip("^") for f, _ in self.rules}:
                self.tree.add_word(stem, stem)
            if self.rules:
                self.tree.make_automaton()
        return np.array([self.score(t.decode().lower(), r) for t, r in zip(texts, self.channel.restorations(texts), strict=True)], np.float64)

    def score(self, text: str, restored: str) -> float:
        """1 - product of (1 - precision) over stems, each by the best of its rules that apply: any one is enough."""
        if not self.rules:
            return self.base
        times: Counter[str] = Counter()
        for s in (text, restored):
            for end, stem in self.tree.iter(s):
                i = end - len(stem)
                if i >= 0 and s[i].isalpha():
                    continue
                times["^" + stem] += 1
                if end + 1 == len(s) or not s[end + 1].isalpha():
                    times[stem] += 1
        if not times:
            return self.base
        words, best = len(text.split()), defaultdict(float)
        for (f, d), p in self.rules.items():
            if meets(d, times[f], words):
                best[f.lstrip("^")] = max(best[f.lstrip("^")], p)
        miss = 1 - self.base
        for p in best.values():
            miss *= 1 - p
        return 1 - miss

    def __getstate__(self):
        return self.__dict__ | {"tree": None}


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    cost = character_model(docs)
    sample, total = labelled_sample(docs, labels, "toxic")
    rules, base = learn(sample, total, Channel(cost))
    return Scorer(Channel(cost, tuple(sorted({f for f, _ in rules if not f.startswith("^")}))), rules, base)


def score_toxicity(docs: DataFrame, train_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each document: one narrow map over the scan."""
    model = docs.sparkSession.sparkContext.broadcast(fit(train_docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                score = model.value.scores(as_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, train_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents not predicted to be toxic, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(train_docs, labels))
    return filter_texts(docs, lambda texts: model.value.scores(texts) < CUT)


def op5_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, docs, table(spark, sf_dir, "labels"))
