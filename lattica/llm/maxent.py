"""Log probabilities of texts under a hashed maximum-entropy language model.

A word's class follows from its last two bytes, its subclass within the class from a hash of it all. The model is

    P(w | h) = (1 - r(h)) P(class | h) (1 - u(class)) P(sub | class, h) P(w | class, sub) + r(h) [w is the word before]

for a word w that training documents hold, and (1 - r(h)) P(class | h) u(class) for an unseen one, so every class sums
to one over its known words and one unseen word. P(class | h) is a softmax over sums of weights of hashed features of
the words before: the last one, the last two, the one before the last alone (a skip), and the last two classes.
P(sub | class, h) is one over the class's subclasses that hold a known word: their share of its tokens, times weights
of features that join the class with the last word and with the skip. So features tell words apart down to CLASSES * SUBS leaves; within a leaf
P(w | leaf) comes from discounted counts over all training documents, and u(class) is the discounted share. r(h) is
the share of repeats, by whether the word before was itself one. What grows with the corpus are the word counts; the
table of feature weights has a fixed size.

Weights are trained by distributed gradient updates: every document is seen once, in ROUNDS passes over disjoint
parts; a task runs minibatch updates on its own documents from the broadcast weights (a fixed-size table), and
the next weights are the average of the tasks' weights, each feature weighted by how often a task met it.

The vocabulary grows with the corpus, so it is never broadcast or collected. Documents are dealt into blocks of
about BLOCK_BYTES; each block's distinct words are counted, the counts summed over blocks by word (a partial
aggregate), joined back to the words of each block, and a block is scored together with its own words' totals. Words are told apart by a 64-bit hash of their bytes.

Defined results: a null text is empty (its only token is the end); rows with a null doc_id are training rows;
repeated rows count and are scored each; without training rows every token is unknown; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import as_bytes, hash_runs, mix, slices, stage, table
from lattica.llm.labels import held_out

FOLDS = 10
BLOCK_BYTES = 32 << 20
BLOCKS_A_TASK = 1
CLASSES = SUBS = 32
BINS = 1024
FEATURES = 4
SUB_BINS = 4096
SUB_FEATURES = 2
ROWS = FEATURES * BINS + SUB_FEATURES * SUB_BINS
ROUNDS = 2
BATCH = 16384
RATE = 0.2
END_HASH = np.uint64(0x5EED_E17D_0F7E_7E17)
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


@dataclass
class Tokens:
    """The tokens of some texts, an end after each: hash, class, and where each text's begin (and the end)."""

    h: np.ndarray
    cls: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(texts: list[bytes]) -> Tokens:
        joined = b" ".join([*texts, b""]).lower()
        raw = np.frombuffer(joined, np.uint8)
        dark = np.zeros(len(raw) + 1, bool)
        np.logical_not(_WHITE[raw], out=dark[1:])
        edge = np.flatnonzero(dark[1:] != dark[:-1])
        begin, stop = edge[::2], edge[1::2]
        size = stop - begin
        h = hash_runs(joined, begin, size)
        tail = raw[stop - 1].astype(np.int64) * 257 + raw[np.maximum(stop - 2, begin)]
        words = np.searchsorted(begin, np.cumsum([len(t) + 1 for t in texts]))
        doc = np.searchsorted(words, np.arange(len(begin)), "right")
        first = np.concatenate([[0], words + np.arange(1, len(texts) + 1)])
        out = Tokens(np.full(first[-1], END_HASH, np.uint64), np.zeros(first[-1], np.uint8), first)
        at = np.arange(len(begin)) + doc
        out.h[at], out.cls[at] = h, 1 + (tail * 0x9E3779B1 >> 9) % (CLASSES - 1)
        return out

    def before(self, k: int) -> np.ndarray:
        """Index of the token k places before in the same text; -1 where there is none."""
        at = np.arange(len(self.h)) - k
        at[at < np.repeat(self.first[:-1], np.diff(self.first))] = -1
        return at

    def features(self) -> np.ndarray:
        """Rows of the weight table that hold for each token (tokens x FEATURES)."""
        one, two = self.before(1), self.before(2)
        h, c = np.append(self.h, np.uint64(1)), np.append(self.cls, np.uint8(0))
        h1, h2 = h[one], h[two]
        bins = np.uint64(BINS)
        out = np.empty((len(self.h), FEATURES), np.int32)
        out[:, 0] = h1 % bins
        out[:, 1] = BINS + (mix(h1 * np.uint64(3) + h2 * np.uint64(7)) % bins).astype(np.int32)
        out[:, 2] = 2 * BINS + (h2 >> np.uint64(20)) % bins
        out[:, 3] = 3 * BINS + (c[one].astype(np.int32) * CLASSES + c[two]) % BINS
        return out

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """Subclass within the class, and the leaf that both name."""
        sub = (self.h >> np.uint64(37)) % np.uint64(SUBS)
        return sub.astype(np.uint8), self.cls.astype(np.int32) * SUBS + sub.astype(np.int32)

    def sub_features(self) -> np.ndarray:
        """Rows of the weight table that choose each token's subclass (tokens x SUB_FEATURES)."""
        h, own = np.append(self.h, np.uint64(1)), self.cls.astype(np.uint64) + np.uint64(1)
        out = np.empty((len(self.h), SUB_FEATURES), np.int32)
        for k in range(SUB_FEATURES):
            row = mix(h[self.before(k + 1)] * np.uint64(5 + 2 * k) + own * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SUB_BINS)
            out[:, k] = FEATURES * BINS + k * SUB_BINS + row.astype(np.int32)
        return out

    def repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether a token repeats the one before, and its state: 0 no token before, 1 that one was no repeat, 2 it was."""
        one = self.before(1)
        same = (one >= 0) & (self.h == self.h[one])
        return same, np.where(one < 0, 0, 1 + same[one])


def sums(weights: np.ndarray, features: np.ndarray, prior: np.ndarray | None = None) -> np.ndarray:
    """Sums of weights for every class or subclass, less the greatest of each token, in sparse batches: only the rows
    that features name are read. prior (tokens x choices) is added; it is very negative where there is no such choice."""
    s = weights[features[:, 0]]
    for k in range(1, features.shape[1]):
        s += weights[features[:, k]]
    if prior is not None:
        s += prior
    s -= s.max(1, keepdims=True)
    return s


def log_of(weights: np.ndarray, features: np.ndarray, own: np.ndarray, prior: np.ndarray | None = None) -> np.ndarray:
    """log P(own choice | features) of each token."""
    s = sums(weights, features, prior)
    return np.take_along_axis(s, own[:, None].astype(np.intp), 1)[:, 0] - np.log(np.exp(s).sum(1))


def descend(weights: np.ndarray, squares: np.ndarray, met: np.ndarray, features: np.ndarray, cls: np.ndarray, prior: np.ndarray | None = None, of: np.ndarray | None = None) -> None:
    """Minibatch gradient updates (adaptive rates) over these tokens, in place, from the logs prior[of]."""
    for i in range(0, len(cls), BATCH):
        f, y = features[i : i + BATCH], cls[i : i + BATCH]
        g = sums(weights, f, None if prior is None else prior[of[i : i + BATCH]])
        np.exp(g, out=g)
        g /= g.sum(1, keepdims=True)
        g[np.arange(len(y)), y] -= 1
        for k in range(f.shape[1]):
            order = np.argsort(f[:, k].astype(np.uint16), kind="stable")  # ROWS < 65536: a radix sort
            rows = f[order, k]
            head = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            own = rows[head]
            step = np.add.reduceat(g[order], head, axis=0)
            held = squares[own]
            held += step * step
            squares[own] = held
            step *= RATE
            step /= np.sqrt(held)
            weights[own] -= step
            met[own] += np.diff(np.append(head, len(rows)))


@dataclass
class Counts:
    """What the training tokens of each leaf come to."""

    mass: np.ndarray  # tokens
    kinds: np.ndarray  # different words
    single: np.ndarray  # words that occur once

    def __post_init__(self):
        mass, kinds, single = (x.reshape(CLASSES, SUBS).sum(1) for x in (self.mass, self.kinds, self.single))
        self.discount = np.clip(np.maximum(single, 0.5) / np.maximum(kinds, 1), 0, 0.9)  # taken off each word, by class
        self.unseen = np.where(mass > 0, self.discount * kinds / np.maximum(mass, 1), 1.0)  # u(class)
        self.left = self.mass - np.repeat(self.discount, SUBS) * self.kinds
        share = self.mass.reshape(CLASSES, SUBS) / np.maximum(mass, 1)[:, None]
        self.prior = np.where(share > 0, np.log(np.maximum(share, 1e-30)), -1e9).astype(np.float32)  # of a subclass
        self.prior[mass == 0] = 0  # nothing is chosen there

    def within(self, count: np.ndarray, cls: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """(1 - u(class)) P(w | leaf) of known words, u(class) of unseen ones."""
        d = self.discount[cls]
        known = (1 - self.unseen[cls]) * (count - d) / np.where(self.left[leaf] > 0, self.left[leaf], 1)
        return np.where(count > 0, known, self.unseen[cls])


@dataclass
class Model:
    """Of fixed size, whatever the corpus."""

    weights: np.ndarray
    repeat: np.ndarray  # by state
    tokens: int
    counts: Counts

    def score(self, t: Tokens, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each token, under the base and under the model."""
        base = np.log10((count + 0.1) / (self.tokens + 0.1 * (self.counts.kinds.sum() + 1)))
        sub, leaf = t.leaves()
        f, sub_f = t.features(), t.sub_features()
        p = np.empty(len(t.h))
        for i in range(0, len(p), BATCH):
            part = slice(i, i + BATCH)
            p[part] = log_of(self.weights, f[part], t.cls[part])
            known = np.flatnonzero(count[part] > 0) + i
            p[known] += log_of(self.weights, sub_f[known], sub[known], self.counts.prior[t.cls[known]])
        p = np.exp(p)
        within = self.counts.within(count, t.cls, leaf)
        same, state = t.repeats()
        r = self.repeat[state]
        return base, np.log10((1 - r) * p * within + r * same)


def blocked(docs: DataFrame) -> DataFrame:
    """block, doc_id, held_out, text: runs of rows of a scan partition with about BLOCK_BYTES of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in slices(batch, "text"):
                if held > BLOCK_BYTES:
                    block, held = block + 1, 0
                held += part.column("text").nbytes
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, block)), *part.columns], names=["block", *part.schema.names])

    rows = docs.select("doc_id", held_out(folds=FOLDS).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return stage(rows.mapInArrow(run, f"block long, doc_id {kind}, held_out boolean, text string"), "blocked")


def _merge(keys: list[np.ndarray], leaf: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, first, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    return key, np.concatenate(leaf)[first], np.bincount(back.ravel(), np.concatenate(n), len(key)).astype(np.int64)


def block_words(blocks: DataFrame) -> DataFrame:
    """block, h, leaf, n: every word of a block and how often its training rows have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if parts:
                key, leaf, n = _merge(*(list(x) for x in zip(*parts, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), now)), pa.array(key.view(np.int64)), pa.array(leaf.astype(np.int32)), pa.array(n)], names=["block", "h", "leaf", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                block = part.column("block").to_numpy(zero_copy_only=False)
                cut = np.flatnonzero(np.diff(block)) + 1
                for a, b in zip([0, *cut], [*cut, len(block)], strict=True):
                    if block[a] != now:
                        yield from done()
                        now, parts = int(block[a]), []
                    rows = part.slice(a, b - a)
                    t = Tokens.of(as_bytes(rows.column("text")))
                    train = np.repeat(~rows.column("held_out").to_numpy(zero_copy_only=False), np.diff(t.first))
                    parts.append(_merge([t.h], [t.leaves()[1]], [train]))
                    if len(parts) == 8:
                        parts = [_merge(*(list(x) for x in zip(*parts, strict=True)))]
        yield from done()

    return blocks.select("block", "held_out", "text").mapInArrow(run, "block long, h long, leaf int, n long")


def train_round(blocks: DataFrame, weights: np.ndarray, which: int, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The averaged weights after one pass over the training rows of one part, and the counts of repeats."""
    spark = blocks.sparkSession
    start = spark.sparkContext.broadcast(weights)
    names = [f"w{k}" for k in range(CLASSES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = start.value.copy()
        squares, met, seen = np.full_like(w, 1.0), np.zeros(len(w)), np.zeros(CLASSES)
        for batch in batches:
            for part in slices(batch, "text"):
                t = Tokens.of(as_bytes(part.column("text")))
                descend(w, squares, met, t.features(), t.cls)
                descend(w, squares, met, t.sub_features(), t.leaves()[0], prior, t.cls)
                same, state = t.repeats()
                seen[:6] += np.bincount(state * 2 + same, minlength=6)
        own = np.flatnonzero(met)
        change = (w[own] - start.value[own]).astype(np.float64) * met[own, None]
        cols = [np.append(own, len(w)).astype(np.int32), np.append(met[own], 0), *np.concatenate([change, seen[None]]).T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["row", "met", *names])

    part = F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == which
    rows = blocks.where(~F.col("held_out") & part).select("text").mapInArrow(run, "row int, met double, " + ", ".join(f"{c} double" for c in names))
    found = rows.groupBy("row").agg(F.sum("met").alias("met"), *(F.sum(c).alias(c) for c in names)).toArrow()  # a row for each of the weight table
    out, seen = weights.copy(), np.zeros(6)
    if found.num_rows:
        row, met = found.column("row").to_numpy(), found.column("met").to_numpy()
        change = np.stack([found.column(c).to_numpy() for c in names], 1)
        real = row < len(weights)
        out[row[real]] += (change[real] / met[real, None]).astype(np.float32)
        seen = change[~real][0, :6]
    return out, seen


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    blocks = blocked(docs)
    own_words = stage(block_words(blocks), "block_words")
    totals = stage(own_words.groupBy("h", "leaf").agg(F.sum("n").alias("c")), "totals")
    known = totals.where("c > 0").groupBy("leaf").agg(F.sum("c").alias("mass"), F.count("*").alias("kinds"), F.count_if(F.col("c") == 1).alias("single"))
    mass, kinds, single = (np.zeros(CLASSES * SUBS) for _ in range(3))
    for r in known.collect():  # a row for each leaf
        mass[r["leaf"]], kinds[r["leaf"]], single[r["leaf"]] = r["mass"], r["kinds"], r["single"]
    counts = Counts(mass, kinds, single)
    weights, seen = np.zeros((ROWS, CLASSES), np.float32), np.zeros(6)
    for k in range(ROUNDS):
        weights, more = train_round(blocks, weights, k, counts.prior)
        seen += more
    repeat = np.where([False, True, True], (seen[1::2] + 0.5) / (seen[0::2] + seen[1::2] + 1), 0.0)
    model = spark.sparkContext.broadcast(Model(weights, repeat, int(mass.sum()), counts))

    def run(rows: pa.Table, own: pa.Table) -> pa.Table:
        m = model.value
        key = own.column("h").to_numpy().view(np.uint64)
        order = np.argsort(key)
        key, c = key[order], own.column("c").to_numpy()[order]
        out = []
        for batch in rows.to_batches():
            for part in slices(batch, "text"):
                t = Tokens.of(as_bytes(part.column("text")))
                count = c[np.searchsorted(key, t.h)]
                base, score = m.score(t, count)
                at = t.first[:-1]
                n = np.diff(t.first)
                out.append(
                    pa.table(
                        {
                            "doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "n_tokens": n, "n_known": np.add.reduceat(count > 0, at, dtype=np.int64),
                            "train_tokens": np.full(len(n), m.tokens), "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(score, at),
                        }
                    )
                )
        return pa.concat_tables(out)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    # A word of every block is a hot key of this join only by its block numbers; adaptive execution splits it
    words = own_words.select("block", "h").join(totals.select("h", "c"), "h")
    n = blocks.agg(F.count_distinct("block")).first()[0]
    tasks = max(1, -(-n // BLOCKS_A_TASK))
    return blocks.repartition(tasks, "block").groupBy("block").cogroup(words.repartition(tasks, "block").groupBy("block")).applyInArrow(run, schema)


def op6_class_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
