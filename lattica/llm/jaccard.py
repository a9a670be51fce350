"""Near-duplicates by SimHash and the Jaccard similarity of word shingles.

Two documents are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more; linked
documents, also through others, are one component. Candidates come from the SimHash index of op3 (fingerprints of at
most four differing bits), and, as pairs at 0.8 mostly lie further apart, from MinHash: 50 bands of eight least values
each, so that a pair at 0.8 shares a band with a probability of 0.9999, and one above it almost surely. Every
entry of a band's list is tied to the least of the list, and the components of all ties are the groups within
which all pairs are held against each other by exact Jaccard. A group's shingles are shipped once; a group above
BLOCK shingles is dealt into blocks that are compared as tiles.

Defined results: texts without words (also null) are equal; under five words the whole sequence is the one
shingle, words being runs of bytes between ASCII whitespace, without case; rows link by their texts alone, so rows
that share a doc_id but not a text each stay or go by their own; repeated rows are one document; a null doc_id links
like any other and gets the component of its shingles (null if no row of the component has an id); a component keeps
the rows of its least id (of nulls, if it has no other) with the least set among them; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm import simhash
from lattica.llm.common import as_bytes, bloom, discard, passes, slices, stage, without_rows
from lattica.llm.components import components

WORDS = 5
SIMILARITY = 0.8
BANDS, DEPTH = 50, 8
BLOCK = 1 << 19
_RANDOM = np.random.default_rng(23)
_FACTORS = _RANDOM.integers(1, 1 << 63, (BANDS * DEPTH, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _RANDOM.integers(1, 1 << 63, (BANDS, DEPTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RANDOM.integers(1, 1 << 63, BANDS, dtype=np.uint64)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if n <= WORDS:
        return np.array([xxhash.xxh64_intdigest(joined)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size + 1) - 1
    begin = (end - size)[: n - WORDS + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(begin, end[WORDS - 1 :].tolist(), strict=True)], np.uint64))


def bands(h: np.ndarray) -> np.ndarray:
    """Keys of the lists that a set is entered in, one for each band."""
    if not len(h):
        return _BAND
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max)
    for i in range(0, len(h), 512):
        np.minimum(least, (h[None, i : i + 512] * _FACTORS).min(1), out=least)
    return (least.reshape(BANDS, DEPTH) * _FOLD).sum(1, dtype=np.uint64) ^ _BAND


def _digest(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes())


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).view(np.int64)))


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts = as_bytes(part.column("text"))
            sets, prints = [shingles(t) for t in texts], [simhash.fingerprint(t) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _signed([_digest(h) for h in sets]), _signed(prints), _lists([bands(h) for h in sets])], names=["doc_id", "node", "fp", "keys"])


def _sets(named: Broadcast) -> Callable:
    """Sets of the rows whose id (its hash is h) a Bloom filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                part = part.take(pa.array(passes(named.value, part.column("h").to_numpy().view(np.uint64))))
                if part.num_rows:
                    sets = [shingles(t) for t in as_bytes(part.column("text"))]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), _signed([_digest(h) for h in sets]), _lists(sets)], names=["doc_id", "node", "shingles"])

    return run


def forest(sets: list[np.ndarray], similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Links (as indices) that span the components of some sets: each set, once reached, is held against those
    not reached yet."""
    size = np.array([len(s) for s in sets], np.int64)
    a, b = [], []
    rest, front = np.arange(len(sets)), []
    while len(rest):
        # An index of the sets not reached yet, made anew whenever half of them are gone
        indexed = rest
        owner = np.repeat(np.arange(len(indexed)), size[indexed])
        value = np.concatenate([sets[i] for i in indexed])
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        open_ = np.ones(len(indexed), bool)
        left = len(indexed)
        while left and (left * 2 > len(indexed) or left < 16):
            if not front:
                first = int(np.argmax(open_))
                open_[first] = False
                left -= 1
                front = [int(indexed[first])]
                continue
            i = front.pop()
            low, high = np.searchsorted(value, sets[i], "left"), np.searchsorted(value, sets[i], "right")
            n = high - low
            at = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
            common = np.bincount(owner[at], minlength=len(indexed))
            hit = np.flatnonzero(open_ & (common >= similarity * (size[i] + size[indexed] - common) - 1e-9))
            if len(hit):
                got = indexed[hit]
                a.append(np.full(len(got), i))
                b.append(got)
                open_[hit] = False
                left -= len(hit)
                front.extend(got.tolist())
        rest = indexed[open_]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64),) * 2


def _compare(rows: pa.Table) -> pa.Table:
    node = rows.column("node").to_numpy()
    _, first = np.unique(node, return_index=True)
    lists = rows.column("shingles").combine_chunks()
    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    i, j = forest([values[ends[k] : ends[k + 1]] for k in first])
    return pa.table({"a": node[first][i], "b": node[first][j]})


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set once from a partition, so that a row repeated everywhere isn't shipped everywhere."""
    seen: set[int] = set()
    for batch in batches:
        node = batch.column("node").to_pylist()
        fresh = [i for i, x in enumerate(node) if not (x in seen or seen.add(x))]
        yield batch.take(pa.array(fresh, pa.int64()))


def _print_ties(prints: DataFrame) -> DataFrame:
    """a, b: ties that span what the SimHash index links, given the sets and their texts' fingerprints (node, fp)."""
    distinct = stage(prints.groupBy("fp").agg(F.min("node").alias("rep")), "distinct_prints")
    same = prints.join(distinct, "fp").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    return simhash.links(distinct).union(same)


def _band_ties(distinct: DataFrame) -> DataFrame:
    """a, b: each set of a band's list with the least of the list, given sets and their keys (node, keys)."""
    head = F.min("node").over(Window.partitionBy("key"))
    posted = distinct.select(F.explode("keys").alias("key"), "node").withColumn("head", head)
    return posted.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))


def _named(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of each row, and (node, component_id, kept): the least id of the component and the set that it
    keeps. Shingle sets are the nodes, so rows without an id link like any other."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    entries = stage(texts.mapInArrow(_entries, "doc_id long, node long, fp long, keys array<bigint>"), "shingle_bands")
    rows = stage(entries.select("doc_id", "node", "fp"), "document_sets")
    distinct = stage(entries.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")), "distinct_sets")
    discard(entries)
    ties = _print_ties(rows.select("node", "fp").distinct()).union(_band_ties(distinct))
    groups = stage(components(ties).select("node", F.col("component").alias("grp")).join(distinct.select("node", "rep"), "node"), "groups")
    # Of rows whose id no group names, no set is made; the join decides about the others
    named = docs.sparkSession.sparkContext.broadcast(bloom(groups.select(F.xxhash64("rep").alias("hash")), 64))
    sets = texts.withColumn("h", F.xxhash64("doc_id")).mapInArrow(_sets(named), "doc_id long, node long, shingles array<bigint>")
    same = (F.col("doc_id").eqNullSafe(F.col("rep"))) & (sets["node"] == groups["node"])
    shipped = sets.join(groups, same).select(sets["node"].alias("node"), "grp", "shingles")
    # One row gives each set; only rows repeated with their id give more, and those alone are made distinct
    repeated = stage(rows.groupBy("doc_id", "node").agg(F.count("*").alias("n")).where("n > 1").select("node").distinct(), "repeated_rows")
    if not repeated.isEmpty():
        again = shipped.join(repeated, "node", "left_semi").select("node", "grp", "shingles")
        again = again.mapInArrow(_once, "node long, grp long, shingles array<bigint>").dropDuplicates(["node"])
        shipped = shipped.join(repeated, "node", "left_anti").select("node", "grp", "shingles").union(again)
    members = stage(shipped, "group_sets")
    discard(repeated)
    blocks = F.ceil(F.sum(F.size("shingles")) / BLOCK)
    dealt = members.join(members.groupBy("grp").agg(F.greatest(blocks, F.lit(1)).alias("blocks")), "grp")
    dealt = dealt.select("grp", F.pmod(F.xxhash64("node"), "blocks").alias("block"), (F.col("blocks") - 1).alias("last"), "node", "shingles")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("other")
    tiles = dealt.select("*", other).select("grp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "shingles")
    linked = stage(components(tiles.groupBy("grp", "i", "j").applyInArrow(_compare, "a long, b long")), "linked_sets")
    discard(groups, members)
    named = stage(distinct.join(linked, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component")), "named_sets")
    discard(distinct, linked)
    least = named.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node")).alias("x"))
    return rows.select("doc_id", "node"), stage(named.join(least, "component").select("node", F.col("x.rep").alias("component_id"), F.col("x.node").alias("kept")), "named")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id (as a long), component_id of every row."""
    rows, named = _named(docs)
    return rows.join(named, "node").select("doc_id", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: the rows of its least id with the set kept."""
    rows, named = _named(docs)
    stays = (F.col("node") == F.col("kept")) & F.col("doc_id").eqNullSafe(F.col("component_id"))
    return without_rows(docs, rows.join(named, "node").select("doc_id", F.col("node").alias("key"), stays.alias("stays")), lambda t: _digest(shingles(t)))
