"""Benchmark decontamination by spaced-seed hashing.

Four fixed masks over at most nine tokens each look at five of them and ignore the rest. Every window of WINDOW
tokens that agrees with a benchmark window in all but MISSES places holds a hit of one of the masks at least
(tests enumerate this), so the hash join of document and benchmark seeds loses nothing. Executors hash every
window of every document against a Bloom filter of fixed greatest size; what passes is written with the tokens
around it, joined with the benchmark's seeds on the exact hash, and each alignment found is verified token by token.

A document is contaminated by an item if some alignment without gaps has WINDOW consecutive tokens of which all
but MISSES agree; for an item of fewer tokens (but at least SHORTEST), all of its tokens must agree. Tokens are
runs of letters and digits without case.

Defined results: null texts have no tokens; rows with a null doc_id or items with a null item_id are not
compared; rows sharing an id are one document; an empty table on either side gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import as_bytes, bloom, hash_runs, mix, passes, slices, split_rows, stage, table

#: Token positions that each seed looks at.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 5, 6), (0, 2, 3, 4, 5), (0, 1, 2, 7, 8))
WINDOW = 13
MISSES = 2
SHORTEST = 5
AROUND = WINDOW + max(map(max, MASKS))
_FACTORS = np.random.default_rng(11).integers(1, 1 << 63, (len(MASKS), 5), dtype=np.uint64) | np.uint64(1)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, and where each text's begin in them (and the end)."""
    low = [t.decode().lower().encode() for t in texts]
    joined = b" ".join([*low, b""])
    raw = np.frombuffer(joined, np.uint8)
    word = (raw >= 97) & (raw <= 122) | (raw >= 48) & (raw <= 57) | (raw >= 128)
    for first, seconds, n in ((0xE2, (0x80, 0x81), 3), (0xC2, (0xA0, 0xA1, 0xAB, 0xBB, 0xBF), 2)):  # quotes, dashes, wide spaces
        at = np.flatnonzero((raw[:-1] == first) & np.isin(raw[1:], seconds))
        for k in range(n):
            word[at + k] = False
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]])))
    begin, size = edge[::2], edge[1::2] - edge[::2]
    h = hash_runs(joined, begin, size)
    return h, np.searchsorted(begin, np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])]))


def seeds(h: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask: token index of each window inside one text, and its hash."""
    end = np.repeat(first[1:], np.diff(first))
    for factors, mask in zip(_FACTORS, MASKS, strict=True):
        n = len(h) - mask[-1]
        if n <= 0:
            continue
        s = np.full(n, factors[0] >> np.uint64(7), np.uint64)
        for f, o in zip(factors, mask, strict=True):
            s += h[o : o + n] * f
        at = np.flatnonzero(np.arange(n) + mask[-1] < end[:n])
        yield at, mix(s[at])


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))


def seed_table(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hash, item_id, at) of the benchmark's seeds, and (item_id, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, first = tokens(as_bytes(part.column("text")))
                of = np.repeat(np.arange(len(first) - 1), np.diff(first))
                found = list(seeds(h, first))
                at, hashes = np.concatenate([np.empty(0, np.int64), *(x for x, _ in found)]), np.concatenate([np.empty(0, np.uint64), *(x for _, x in found)])
                order = np.argsort(of[at], kind="stable")
                at, hashes = at[order], hashes[order]
                ends = np.searchsorted(of[at], np.arange(len(first) - 1), "right")
                yield pa.RecordBatch.from_arrays([part.column("item_id"), _lists(h.view(np.int64), first[1:]), _lists(at - first[of[at]], ends), _lists(hashes.view(np.int64), ends)], names=["item_id", "tokens", "at", "hash"])

    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.where("item_id is not null").select("item_id", "text").mapInArrow(run, f"item_id {kind}, tokens array<bigint>, at array<bigint>, hash array<bigint>")
    rows = stage(rows.where(F.size("tokens") >= SHORTEST), "items")
    flat = rows.select("item_id", F.explode(F.arrays_zip("hash", "at")).alias("x")).select(F.col("x.hash").alias("hash"), "item_id", F.col("x.at").alias("at"))
    return stage(flat, "seeds"), rows.select("item_id", "tokens")


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, doc_start, item_start, overlap_tokens, matched_tokens: the best alignment of each pair that
    is contaminated. doc_start and item_start count tokens to where the alignment's overlap begins."""
    spark = docs.sparkSession
    seed_rows, item_tokens = seed_table(items)
    filt = spark.sparkContext.broadcast(bloom(seed_rows))
    # Wide enough for every alignment that a hit can belong to, so that only the document's ends cut one
    around = max(AROUND, item_tokens.agg(F.max(F.size("tokens"))).first()[0] or 0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                h, first = tokens(as_bytes(part.column("text")))
                hits = [(at[ok], s[ok]) for at, s in seeds(h, first) if len(ok := passes(filt.value, s))]
                if not hits:
                    continue
                at, s = (np.concatenate(x) for x in zip(*hits, strict=True))
                order = np.argsort(at, kind="stable")
                at, s = at[order], s[order]
                doc = np.searchsorted(first, at, "right") - 1
                # Hits of one document whose surroundings meet are one region
                new = np.concatenate([[True], (np.diff(at) > 2 * around) | (np.diff(doc) > 0)])
                head = np.flatnonzero(new)
                tail = np.append(head[1:], len(at)) - 1
                low, high = np.maximum(at[head] - around, first[doc[head]]), np.minimum(at[tail] + around, first[doc[head] + 1])
                size = high - low
                ends = np.cumsum(size)
                held = np.arange(size.sum()) + np.repeat(low - (ends - size), size)
                own = np.cumsum(new) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(region + np.arange(len(head))), part.column("doc_id").take(pa.array(doc[head])), pa.array(low - first[doc[head]]),
                        _lists(h[held].view(np.int64), ends), _lists(at - low[own], tail + 1), _lists(s.view(np.int64), tail + 1),
                    ],
                    names=["region", "doc_id", "low", "tokens", "at", "hash"],
                )
                region += len(head)

    kind = docs.schema["doc_id"].dataType.simpleString()
    regions = stage(docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(scan, f"region long, doc_id {kind}, low long, tokens array<bigint>, at array<bigint>, hash array<bigint>"), "regions")
    hits = regions.select("region", F.explode(F.arrays_zip("hash", "at")).alias("x")).select("region", F.col("x.hash").alias("hash"), F.col("x.at").alias("p"))
    lines = hits.join(seed_rows, "hash").select("region", "item_id", (F.col("p") - F.col("at")).alias("shift")).distinct()
    lines = stage(lines, "alignments")
    both = lines.join(regions.select("region", "doc_id", "low", "tokens"), "region").join(item_tokens.withColumnRenamed("tokens", "item_tokens"), "item_id")
    # Only what the alignment covers goes on: its length is bounded by the item, whatever the region
    start = F.greatest("shift", F.lit(0)).cast("int")
    n = F.least(F.col("shift") + F.size("item_tokens"), F.size("tokens")).cast("int") - start
    both = both.withColumn("start", start).withColumn("n", n).where("n > 0").select(
        "doc_id", "item_id", (F.col("low") + F.col("start")).alias("doc_start"), (F.col("start") - F.col("shift")).alias("item_start"), F.size("item_tokens").alias("item_size"),
        F.slice("tokens", F.col("start") + 1, F.col("n")).alias("doc_part"), F.slice("item_tokens", (F.col("start") - F.col("shift") + 1).cast("int"), F.col("n")).alias("item_part"),
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            own = [batch.column(c).to_pylist() for c in ("doc_id", "item_id", "doc_start", "item_start", "item_size")]
            parts = [[np.array(x) for x in batch.column(c).to_pylist()] for c in ("doc_part", "item_part")]
            for d, i, doc_start, item_start, size, doc, item in zip(*own, *parts, strict=True):
                if (same := matched(doc, item, size)) is not None:
                    out.append((d, i, doc_start, item_start, len(doc), same))
            if out:
                cols = list(zip(*out, strict=True))
                kinds = [batch.schema.field(c).type for c in ("doc_id", "item_id")] + [pa.int64()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "doc_start", "item_start", "overlap_tokens", "matched_tokens"])

    item_kind = items.schema["item_id"].dataType.simpleString()
    checked = both.mapInArrow(verify, f"doc_id {kind}, item_id {item_kind}, doc_start long, item_start long, overlap_tokens long, matched_tokens long")
    best = F.max(F.struct("matched_tokens", (-F.col("doc_start")).alias("a"), (-F.col("item_start")).alias("b"), "overlap_tokens")).alias("m")
    return checked.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("m.a")).alias("doc_start"), (-F.col("m.b")).alias("item_start"), "m.overlap_tokens", "m.matched_tokens")


def matched(doc: np.ndarray, item: np.ndarray, item_size: int) -> int | None:
    """Equal tokens of an overlap (the parts of document and item that lie on each other), if it is contaminated."""
    need = min(WINDOW, item_size)
    if len(doc) < need:
        return None
    total = np.concatenate([[0], np.cumsum(doc == item)])
    if (total[need:] - total[:-need]).max() < (need - MISSES if item_size >= WINDOW else need):
        return None
    return int(total[-1])


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that no benchmark item contaminates, with all their columns."""
    found = stage(overlaps(docs, items).select("doc_id").distinct(), "contaminated")
    clean, some = split_rows(docs, F.xxhash64("doc_id"), found.select(F.xxhash64("doc_id").alias("hash")))
    return clean.union(some.join(found, "doc_id", "left_anti").select(docs.columns))


def op4_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle() -> str:
    """DuckDB SQL: a tolerated window holds four equal tokens in a row, so alignments come from shared runs of four."""
    word = r"[a-z0-9\x{80}-\x{9F}\x{A2}-\x{AA}\x{AC}-\x{BA}\x{BC}-\x{BE}\x{C0}-\x{1FFF}\x{2080}-\x{10FFFF}]+"
    return rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{word}') AS w FROM documents WHERE doc_id IS NOT NULL),
    i AS (SELECT * FROM (SELECT item_id, regexp_extract_all(lower(text), '{word}') AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) >= {SHORTEST}),
    dp AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 3, 0)::BIGINT)) AS p FROM d), ip AS (SELECT item_id, w, unnest(range(0, len(w)::BIGINT - 3)) AS p FROM i),
    dg AS (SELECT doc_id, p, array_to_string(w[p + 1:p + 4], ' ') AS g FROM dp), ig AS (SELECT item_id, p, array_to_string(w[p + 1:p + 4], ' ') AS g FROM ip),
    lines AS (SELECT DISTINCT doc_id, item_id, dg.p - ig.p AS shift FROM dg JOIN ig USING (g)),
    spans AS (SELECT doc_id, item_id, shift, greatest(shift, 0) AS start, least(shift + len(i.w), len(d.w)) AS stop, d.w AS dw, i.w AS iw FROM lines JOIN d USING (doc_id) JOIN i USING (item_id)),
    same AS (SELECT doc_id, item_id, shift, start, least({WINDOW}, len(iw)) AS need, CASE WHEN len(iw) >= {WINDOW} THEN {WINDOW - MISSES} ELSE len(iw) END AS least_equal, list_transform(range(start, stop), lambda k: (dw[k + 1] = iw[k - shift + 1])::INT) AS eq FROM spans),
    found AS (SELECT *, list_sum(eq)::BIGINT AS matched FROM same WHERE len(eq) >= need AND list_max(list_transform(range(0, len(eq)::BIGINT - need + 1), lambda k: list_sum(eq[k + 1:k + need]))) >= least_equal)
    SELECT doc_id, item_id, start AS doc_start, start - shift AS item_start, len(eq)::BIGINT AS overlap_tokens, matched AS matched_tokens
    FROM found QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, start, start - shift) = 1
    """
