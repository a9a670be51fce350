"""Order-preserving packing of documents into windows of at most `length` tokens.

The documents of a scan partition form one stream in scan order. Windows may end at document ends, at sentence
ends, and inside a run of more than `longest_run` tokens without either. A dynamic program picks the cuts that
minimise padding plus truncation penalties: with P the position of a candidate,

    best[k] = min over i with P[k] - P[i] <= length of (best[i] + P[i]) + length - P[k] + penalty[k],

whose minimum over the sliding window comes from a monotone queue, so a block of m candidates takes O(m). Blocks
of about `block` tokens are solved one after the other, each from the last cut of the one before; what remains
at the end of a partition is cut into powers of two, which need no padding. Each partition is packed by itself:
no shuffle, memory bounded by a block and the longest document, and a task that is run again gives the same rows.

Defined results: a null text packs as the lone end token; null ids stay null; repeated rows are packed each; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from lattica.llm.bpe import machine
from lattica.llm.common import as_bytes, slices, table

LENGTH = 1024
SENTENCE_PENALTY = 2
INNER_PENALTY = 12
LONGEST_RUN = 32
INNER_STEP = 8
BLOCK = 1 << 19
#: Bytes that end a sentence or a line.
SENTENCE_ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?\n"])


def candidates(sentence: np.ndarray, document: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions (0 first, `total` last) and their penalties, from the sorted ends of sentences and documents."""
    at = np.unique(np.concatenate([[0], sentence, document, [total]]))
    gap = np.diff(at)
    wide = np.flatnonzero(gap > LONGEST_RUN)
    if len(wide):
        n = (gap[wide] - 1) // INNER_STEP
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
        inner = np.repeat(at[wide], n) + k * INNER_STEP
    else:
        inner = np.empty(0, np.int64)
    every = np.union1d(at, inner)
    penalty = np.full(len(every), INNER_PENALTY, np.int64)
    penalty[np.searchsorted(every, sentence)] = SENTENCE_PENALTY
    penalty[np.searchsorted(every, document)] = 0
    return every, penalty


def best_cuts(at: np.ndarray, penalty: np.ndarray, length: int = LENGTH) -> list[int]:
    """Cuts of the cheapest windows up to the best start of a window that is still open at the end."""
    at, penalty = at.tolist(), penalty.tolist()
    m = len(at)
    value, back, queue, head = [0] * m, [0] * m, [0], 0  # value = best + position; queue: indices of rising value
    value[0] = at[0]
    for k in range(1, m):
        p = at[k]
        while at[queue[head]] < p - length:
            head += 1
        i = queue[head]
        back[k] = i
        v = value[k] = value[i] + length + penalty[k]  # best[k] + P[k]
        while len(queue) > head and value[queue[-1]] >= v:
            queue.pop()
        queue.append(k)
    while at[queue[head]] < at[-1] - length:
        head += 1
    cuts, k = [], queue[head]
    while k:
        cuts.append(at[k])
        k = back[k]
    return cuts[::-1]


class Packer:
    """Packs one stream; give() returns what is final, end() the rest."""

    def __init__(self, first_sequence: int, length: int = LENGTH, block: int = BLOCK):
        self.sequence, self.length, self.block = first_sequence, length, block
        self.ids: list[np.ndarray] = []
        self.sentences: list[np.ndarray] = []
        self.docs: list[tuple[object, int, int]] = []  # id, place of its first token (below 0 where a part is packed), tokens
        self.held = 0

    def give(self, doc_id: object, ids: np.ndarray, sentences: np.ndarray) -> None:
        self.docs.append((doc_id, self.held, len(ids)))
        self.ids.append(ids)
        self.sentences.append(sentences + self.held)
        self.held += len(ids)

    def full(self) -> bool:
        return self.held >= self.block

    def take(self, last: bool = False) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
        if not self.held:
            return out
        ids, total = np.concatenate(self.ids).astype("<u4"), self.held
        sentence = np.concatenate(self.sentences)
        begin, size = (np.array([d[i] for d in self.docs], np.int64) for i in (1, 2))
        at, penalty = candidates(sentence[(sentence > 0) & (sentence <= total)], begin + size, total)
        cuts = best_cuts(at, penalty, self.length)
        if last:
            p = cuts[-1] if cuts else 0
            while p < total:
                p += min(self.length, 1 << (total - p).bit_length() - 1)
                cuts.append(p)
        if not cuts:
            return out
        cut = np.array([0, *cuts])
        stop = cut[-1]
        edges = np.unique(np.concatenate([cut, np.clip(begin, 0, stop)]))
        low, high = edges[:-1], edges[1:]
        doc, seq = np.searchsorted(begin, low, "right") - 1, np.searchsorted(cut, low, "right") - 1
        raw = memoryview(ids).cast("B")
        out |= {
            "doc_id": [self.docs[d][0] for d in doc.tolist()],
            "start": low - begin[doc],
            "length": high - low,
            "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(low.tolist(), high.tolist(), strict=True)],
            "doc_tokens": size[doc],
            "sequence_id": self.sequence + seq,
            "offset": low - cut[seq],
        }
        self.sequence += len(cut) - 1
        self.ids, self.sentences = [ids[stop:]], [sentence[sentence > stop] - stop]
        self.docs = [(d, int(b - stop), int(n)) for (d, _, _), b, n in zip(self.docs, begin, size, strict=True) if b + n > stop]
        self.held = total - int(stop)
        return out


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = machine(vocabulary)
        packer = Packer(TaskContext.get().partitionId() << 40, length)
        kinds: list[pa.DataType] = []

        def batch_of(out: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, kinds[0] if k == "doc_id" else pa.int64()) for k, v in out.items()], names=list(out))

        for batch in batches:
            kinds[:] = [batch.schema.field("doc_id").type]
            for part in slices(batch, "text"):
                ids, counts, final, first = bpe.tokens_of(as_bytes(part.column("text")))
                n = np.concatenate([[0], np.cumsum(counts)])
                breaks = n[1:][SENTENCE_ENDS[final]]
                bounds = n[first]
                cut = np.searchsorted(breaks, bounds, "right")
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    a, b = bounds[i], bounds[i + 1]
                    packer.give(doc_id, np.append(ids[a:b], end_id), breaks[cut[i] : cut[i + 1]] - a)
                    if packer.full():
                        yield batch_of(packer.take())
        if kinds and packer.held:
            yield batch_of(packer.take(last=True))

    return rows.mapInArrow(run, schema)


def op1_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
