"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are the byte-class trigrams of a text, its hashed words, and how often its words repeat. TF-IDF rows of the
labelled sample give the latent axes (truncated SVD); the labelled vectors are broadcast (at most 2 * per_class
rows of `rank` numbers) and every document takes exact cosine products with all of them, block by block. Its
`neighbours` nearest, and those that tie with the last of them, vote with their similarity, each label weighted so
that the sample counts as the whole fold.

Defined results: a null text is scored as empty; rows with a null doc_id are scored and not held out; repeated rows
are scored each; with labels of one kind only, every score is that label, with none 0.5; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import as_bytes, filter_texts, hash_runs, slices, table
from lattica.llm.labels import held_out, labelled_sample

RANK = 64
NEIGHBOURS = 25
CUT = 0.3
WORD_BINS = 1024
REPEAT_BINS = 64
ROWS = 256


def _byte_classes() -> tuple[np.ndarray, int]:
    """Lower, upper, digit, space, newline, non-ASCII lead and follow, and each other printable byte of its own."""
    out, n = np.zeros(256, np.int32), 7
    for b in range(256):
        c = chr(b)
        if b >= 128:
            out[b] = 5 if b >= 192 else 6
        elif c.islower():
            out[b] = 0
        elif c.isupper():
            out[b] = 1
        elif c.isdigit():
            out[b] = 2
        elif c == "\n":
            out[b] = 4
        elif b <= 32:
            out[b] = 3
        else:
            out[b], n = n, n + 1
    return out, n


CLASSES, N_CLASSES = _byte_classes()
SHAPE_BINS = 2048
TERMS = SHAPE_BINS + WORD_BINS + REPEAT_BINS
SHAPES = (np.arange(N_CLASSES**3) * 0x9E3779B1 >> 7) % SHAPE_BINS


def term_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of every term in every text (texts x TERMS)."""
    n = len(texts)
    joined = b" \n".join([*texts, b""])
    raw = np.frombuffer(joined, np.uint8)
    size = np.array([len(t) + 2 for t in texts])
    c = CLASSES[raw]
    code = c[:-2] * np.int32(N_CLASSES)
    code += c[1:-1]
    code *= np.int32(N_CLASSES)
    code += c[2:]
    at = SHAPES[code]
    at += np.repeat(np.arange(n) * SHAPE_BINS, size)[:-2]
    out = np.zeros((n, TERMS), np.float32)
    out[:, :SHAPE_BINS] = np.bincount(at, minlength=n * SHAPE_BINS).reshape(n, -1)
    dark = np.zeros(len(raw) + 1, bool)
    np.greater(raw, 32, out=dark[1:])
    edge = np.flatnonzero(dark[1:] != dark[:-1])  # texts end with white space
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return out
    h = hash_runs(joined.lower(), begin, end - begin)
    h >>= np.uint64(24)  # 40 bits
    of_doc = np.searchsorted(np.cumsum(size), begin, "right")
    out[:, SHAPE_BINS : SHAPE_BINS + WORD_BINS] = np.bincount(of_doc * WORD_BINS + (h % np.uint64(WORD_BINS)).astype(np.int64), minlength=n * WORD_BINS).reshape(n, -1)
    # Repeats: of the words of a text, how many stand in a group of 2^k equal ones, by the length of the text
    key, times = np.unique(h | of_doc.astype(np.uint64) << np.uint64(40), return_counts=True)
    of = (key >> np.uint64(40)).astype(np.int64)
    total = np.bincount(of_doc, minlength=n)
    group = np.minimum(np.log2(times).astype(np.int64), 7) * 8 + np.minimum(np.log2(np.maximum(total[of], 1)).astype(np.int64) // 2, 7)
    out[:, SHAPE_BINS + WORD_BINS :] = np.bincount(of * REPEAT_BINS + group, weights=times, minlength=n * REPEAT_BINS).reshape(n, -1)
    return out


@dataclass
class Voter:
    """Everything that a worker needs; its size doesn't depend on the corpus."""

    idf: np.ndarray | None
    axes: np.ndarray | None
    vectors: np.ndarray | None
    labels: np.ndarray | None
    weights: tuple[float, float]
    constant: float
    neighbours: int

    def latent(self, counts: np.ndarray) -> np.ndarray:
        x = _tfidf(counts, self.idf) @ self.axes
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.vectors is None:
            return np.full(len(texts), self.constant)
        out = np.empty(len(texts))
        for i in range(0, len(texts), ROWS):
            near = self.latent(term_counts(texts[i : i + ROWS])) @ self.vectors.T
            k = min(self.neighbours, near.shape[1])
            row, top = np.nonzero(near >= np.partition(near, -k, axis=1)[:, -k, None])
            vote = np.maximum(near[row, top], 1e-6).astype(np.float64) ** 8 * np.array(self.weights)[self.labels[top]]
            out[i : i + len(near)] = np.bincount(row, vote * self.labels[top], len(near)) / np.bincount(row, vote, len(near))
        return np.clip(out, 0, 1)


def _tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    for part in (slice(0, SHAPE_BINS), slice(SHAPE_BINS, SHAPE_BINS + WORD_BINS), slice(SHAPE_BINS + WORD_BINS, TERMS)):
        x[:, part] /= np.maximum(np.linalg.norm(x[:, part], axis=1, keepdims=True), 1e-9)
    x[:, SHAPE_BINS : SHAPE_BINS + WORD_BINS] *= 0.5
    return x


def fit(sample: list[tuple[bytes, int]], total: dict[int, int], rank: int = RANK, neighbours: int = NEIGHBOURS) -> Voter:
    labels = np.array([y for _, y in sample], np.int8)
    if len(set(labels.tolist())) < 2:
        return Voter(None, None, None, None, (1, 1), float(labels[0]) if len(labels) else 0.5, neighbours)
    texts = [t for t, _ in sample]
    counts = np.concatenate([term_counts(texts[i : i + ROWS]) for i in range(0, len(texts), ROWS)])
    idf = (np.log((1 + len(texts)) / (1 + (counts > 0).sum(0))) + 0.1).astype(np.float32)
    x = _tfidf(counts, idf)
    del counts
    # Truncated SVD by subspace iteration
    q = np.random.default_rng(7).normal(size=(TERMS, min(rank + 8, len(texts)))).astype(np.float32)
    for _ in range(6):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, turn = np.linalg.svd(x @ q, full_matrices=False)
    axes = np.ascontiguousarray((q @ turn.T)[:, :rank])
    v = Voter(idf, axes, None, labels, tuple(total[k] / max((labels == k).sum(), 1) for k in (0, 1)), 0.0, neighbours)
    latent = x @ axes
    v.vectors = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    return v


def score_quality(docs: DataFrame, train_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each document: one narrow map over the scan."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(*labelled_sample(train_docs, labels, "quality")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                score = model.value.scores(as_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, train_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted to be of quality, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(*labelled_sample(train_docs, labels, "quality")))
    return filter_texts(docs, lambda texts: model.value.scores(texts) >= CUT)


def op7_neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, docs, table(spark, sf_dir, "labels"))
