"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most four bits share at least
four of them, the guaranteed minimum. The index posts each distinct fingerprint under combinations of three
positional bytes, taken from a covering of all four-byte sets by twenty triples, so any pair that reaches the
minimum meets in some list; within a list the shared bytes of a pair are tallied, pairs below the minimum are
dropped and the rest verified bit by bit. Lists are 2^24 long spread, where single bytes would give 256.

A list emits a spanning forest of its links, never all pairs. A list above HOT entries is not worked through in
one task: a sample of the fingerprints shows which lists those are, and blocks of them are dealt out as tiles; one
that the sample missed is passed on and dealt out in a second pass. Either way gives the same links.

Defined results: no words (also null text) gives fingerprint zero, which links like any other; under four words
the whole sequence is the one shingle; rows link by their texts alone, so rows that share a doc_id but not a text may
lie in different components and each stays or goes by its own; repeated rows are one document; a null doc_id links
like any other and gets the component of its fingerprint (null if no row of the component has an id); a component
keeps the rows of its least id (of nulls, if it has no other) with the least fingerprint among them; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import as_bytes, slices, stage, table, without_rows
from lattica.llm.components import components

WORDS = 4
SEED = 42
MOST_BITS = 4
LEAST_BYTES = 8 - MOST_BITS
HOT = 16384
SMALL = 48
SAMPLE = 64


def covering() -> list[tuple[int, int, int]]:
    """Twenty triples of the eight byte positions such that any four positions contain one of them: with three
    classes in a ring, all triples inside a class and those with two in a class and one in the next."""
    ring = [(0, 1, 2), (3, 4, 5), (6, 7)]
    found = [t for c in ring for t in combinations(c, 3)]
    for c, after in zip(ring, ring[1:] + ring[:1], strict=True):
        found += [tuple(sorted((*two, x))) for two in combinations(c, 2) for x in after]
    return found


TRIPLES = covering()


def fingerprint(text: bytes) -> int:
    """Majority bits of the XXH64 of all word shingles of a text."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size + 1) - 1
    begin = (end - size)[: n - WORDS + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(begin, end[WORDS - 1 :].tolist(), strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (as a signed long) of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fp = np.array([fingerprint(t) for t in as_bytes(part.column("text"))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _close(x: np.ndarray) -> np.ndarray:
    """Which XORs pass the count filter and then the bit check."""
    ok = np.flatnonzero((x.view(np.uint8).reshape(-1, 8) == 0).sum(1) >= LEAST_BYTES)
    return ok[np.bitwise_count(x[ok]) <= MOST_BITS]


def forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (as indices) that span the components of one list: each entry, once reached, is held against those
    not reached yet."""
    a, b = [], []
    rest = np.arange(len(fp))
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            i = front.pop()
            hit = _close(fp[rest] ^ fp[i])
            if len(hit):
                got = rest[hit]
                a.append(np.full(len(got), i))
                b.append(got)
                front.extend(got.tolist())
                rest = np.delete(rest, hit)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64),) * 2


def _links(key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within whole lists (sorted by key, none above HOT)."""
    edge = np.flatnonzero(np.diff(key)) + 1
    begin, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
    size = end - begin
    small = np.repeat(size <= SMALL, size)
    left = np.repeat(end, size) - np.arange(len(key)) - 1  # entries that follow in the list
    for d in range(1, SMALL):
        i = np.flatnonzero(small & (left >= d))
        if not len(i):
            break
        i = i[_close(fp[i] ^ fp[i + d])]
        yield rep[i], rep[i + d]
    for k in np.flatnonzero(size > SMALL):
        i, j = forest(fp[begin[k] : end[k]])
        yield rep[begin[k] + i], rep[begin[k] + j]


def _batch(a, b, key=None, fp=None, block=None) -> pa.RecordBatch:
    n = len(a)
    empty = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64)) if b is not None else empty, *(pa.array(x) if x is not None else empty for x in (key, fp, block))], names=["a", "b", "key", "fp", "block"])


def _work_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted postings in; links out, and the rows of hot lists with their block."""
    held, n = [], 0
    hot_key, hot_seen = None, 0

    def done(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        key, fp, rep = rows
        found = list(_links(key, fp.view(np.uint64), rep))
        if a := [x for x, _ in found if len(x)]:
            yield _batch(np.concatenate(a), np.concatenate([y for _, y in found if len(y)]))

    def hot(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        nonlocal hot_key, hot_seen
        key, fp, rep = rows
        if hot_key != key[0]:
            hot_key, hot_seen = key[0], 0
        block = (hot_seen + np.arange(len(key))) // HOT
        hot_seen += len(key)
        return _batch(rep, None, key, fp, block)

    def cut(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, n
        rows = tuple(np.concatenate(x) for x in zip(*held, strict=True))
        key = rows[0]
        edge = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        begin, size = edge[:-1], np.diff(edge)
        heavy = (size > HOT) | (key[begin] == hot_key if hot_key is not None else False)
        open_list = not last and not heavy[-1]
        keep = np.repeat(~heavy, size)
        stop = begin[-1] if open_list else len(key)
        for k in np.flatnonzero(heavy):
            yield hot(tuple(x[begin[k] : begin[k] + size[k]] for x in rows))
        keep[stop:] = False
        if keep.any():
            yield from done(tuple(x[keep] for x in rows))
        held, n = ([tuple(x[stop:] for x in rows)], len(key) - stop) if open_list else ([], 0)

    for batch in batches:
        held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "rep")))
        n += batch.num_rows
        if n > 8 * HOT:
            yield from cut(False)
    if n:
        yield from cut(True)


def _work_tile(rows: pa.Table) -> pa.Table:
    fp, rep = rows.column("fp").to_numpy().view(np.uint64), rows.column("a").to_numpy()
    i, j = forest(fp)
    return pa.table({"a": rep[i], "b": rep[j]})


def links(distinct: DataFrame) -> DataFrame:
    """a, b: links between representatives that span all links of the distinct fingerprints (fp, rep)."""
    byte = lambda p: F.shiftright("fp", 8 * p).bitwiseAND(F.lit(255))
    keys = [F.shiftleft(F.lit(t).cast("long"), 24) + F.shiftleft(byte(i), 16) + F.shiftleft(byte(j), 8) + byte(k) for t, (i, j, k) in enumerate(TRIPLES)]
    posted = distinct.select(F.explode(F.array(*keys)).alias("key"), "fp", "rep")
    seen = F.count("*") * SAMPLE
    some = distinct.where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(SAMPLE)) == 0).select(F.explode(F.array(*keys)).alias("key"))
    crowded = stage(some.groupBy("key").agg(seen.alias("n")).where(F.col("n") > HOT), "crowded")
    parts = []
    if not crowded.isEmpty():
        blocks = F.ceil(F.col("n") / HOT)
        rows = posted.join(crowded, "key").select("key", F.pmod(F.xxhash64("fp"), blocks).alias("block"), (blocks - 1).alias("last"), "fp", F.col("rep").alias("a"))
        parts.append(_tiled(rows))
        posted = posted.join(crowded, "key", "left_anti")
    listed = posted.repartition("key").sortWithinPartitions("key")
    found = stage(listed.mapInArrow(_work_lists, "a long, b long, key long, fp long, block long"), "lists")
    missed = found.where("key is not null").select("key", "block", "fp", "a")
    parts.append(_tiled(missed.join(missed.groupBy("key").agg(F.max("block").alias("last")), "key")))
    return reduce(DataFrame.union, parts, found.where("key is null").select("a", "b"))


def _tiled(rows: DataFrame) -> DataFrame:
    """Links within lists whose rows (key, block, last block, fp, a) are compared block by block."""
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("other")
    tiles = rows.select("*", other).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp", "a")
    return tiles.groupBy("key", "i", "j").applyInArrow(_work_tile, "a long, b long")


def _named(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of each row, and (fp, component_id, kept): the least id of the component and the fingerprint
    that it keeps. Fingerprints are the nodes, so rows without an id link like any other."""
    rows = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    found = components(links(distinct.select("fp", F.col("fp").alias("rep"))))
    named = stage(distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("component")), "named")
    least = named.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "fp")).alias("x"))
    return rows, named.join(least, "component").select("fp", F.col("x.rep").alias("component_id"), F.col("x.fp").alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id of every row."""
    rows, named = _named(docs, id_col, text_col)
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: the rows of its least id with the fingerprint kept."""
    rows, named = _named(docs, "doc_id", "text")
    stays = (F.col("fp") == F.col("kept")) & F.col("doc_id").eqNullSafe(F.col("component_id"))
    return without_rows(docs, rows.join(named, "fp").select("doc_id", F.col("fp").alias("key"), stays.alias("stays")), fingerprint)


def op3_simhash_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
