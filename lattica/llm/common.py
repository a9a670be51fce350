"""What the training-data operators share: table access, staged tables, Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.sources.tables import discard
from lattica.sources.tables import shared_folder as shared_dir
from lattica.sources.tables import staged as stage

__all__ = ["as_bytes", "bloom", "discard", "filter_texts", "hash_runs", "mix", "passes", "shared_dir", "slices", "split_rows", "stage", "table", "without_rows"]

MOST_FILTER_BITS = 27

_BYTE_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about `most` bytes of text each (one row at least)."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(size):
        if held and held + n > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(n)
    if begin < batch.num_rows:
        yield batch.slice(begin)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_runs(joined: bytes, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of bytes, from all of their bytes: eight at a time, all runs in lockstep."""
    eights = np.ndarray((len(joined) + 1,), "<u8", joined + bytes(8), strides=(1,))
    h = size.astype(np.uint64)
    live, done = np.flatnonzero(size > 0), 0
    while len(live):
        n = np.minimum(size[live] - done, 8)
        h[live] = mix(h[live] * np.uint64(0x9E3779B97F4A7C15) + (eights[begin[live] + done] & _BYTE_MASK[n]))
        done += 8
        live = live[size[live] > done]
    return h


def filter_texts(docs: DataFrame, keep: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """The rows whose text `keep` accepts, with all their columns: a narrow map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(keep(as_bytes(part.column("text")))))

    return docs.mapInArrow(run, docs.schema)


def bloom(rows: DataFrame, per_row: int = 1024) -> np.ndarray:
    """Bits of a two-hash Bloom filter of the column `hash`: about `per_row` bits a row, 2^27 at most (16 MB)."""
    n = rows.count()
    bits = min(max(22, (per_row * max(n, 1)).bit_length()), MOST_FILTER_BITS)
    place = F.explode(F.array(F.col("hash"), F.shiftrightunsigned("hash", 32))).alias("p")
    p = F.col("p").bitwiseAND(F.lit((1 << bits) - 1))
    words = rows.select(place).groupBy(F.shiftright(p, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    out = np.zeros(1 << (bits - 6), np.int64)
    found = words.toArrow()  # at most 2^21 rows
    out[found.column("w").to_numpy()] = found.column("b").to_numpy()
    return out.view(np.uint64)


def passes(filt: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes a Bloom filter may hold."""
    mask = np.uint64(len(filt) * 64 - 1)

    def bit(p: np.ndarray) -> np.ndarray:
        return filt[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)

    some = np.flatnonzero(bit(h & mask))
    return some[bit(h[some] >> np.uint64(32) & mask) > 0]


def split_rows(docs: DataFrame, key: Column, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose key (a hash as a long) surely isn't among `hashes` (column hash), and the others, which an exact
    join must decide: so that a join with few ids doesn't shuffle every text."""
    filt = docs.sparkSession.sparkContext.broadcast(bloom(hashes, 64))
    columns, name = docs.columns, "key"
    while name in columns:
        name += "_"

    def those(among: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    held = np.zeros(part.num_rows, bool)
                    held[passes(filt.value, part.column(name).to_numpy().view(np.uint64))] = True
                    if (held == among).any():
                        yield part.select(columns).filter(pa.array(held == among))

        return run

    return tuple(docs.withColumn(name, key).mapInArrow(those(x), docs.schema) for x in (False, True))


def without_rows(docs: DataFrame, rows: DataFrame, key_of: Callable[[bytes], int]) -> DataFrame:
    """The rows of docs (doc_id, text, others) that stay, given (doc_id, key, stays) of each, `key_of` giving the key
    of a text. Nulls in doc_id are equal. Only rows of ids with a text that goes are shuffled, and only ids with both
    kinds of text are looked at row by row."""
    ids = stage(rows.groupBy("doc_id").agg(F.min("stays").alias("all"), F.max("stays").alias("any")).where("not all"), "leaving")
    sure, docs = split_rows(docs, F.xxhash64(docs["doc_id"].cast("long")), ids.select(F.xxhash64("doc_id").alias("hash")))
    rest = sure.union(docs.join(ids, docs["doc_id"].cast("long").eqNullSafe(ids["doc_id"]), "left_anti"))
    mixed = ids.where("any")
    if mixed.isEmpty():
        return rest
    name = "key"
    while name in docs.columns:
        name += "_"

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                key = np.array([key_of(t) for t in as_bytes(part.column("text"))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(key)], names=[*part.schema.names, name])

    some = docs.join(mixed, docs["doc_id"].cast("long").eqNullSafe(mixed["doc_id"]), "left_semi").mapInArrow(tag, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))
    stay = rows.where("stays").select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).distinct()
    kept = some.join(stay, some["doc_id"].cast("long").eqNullSafe(stay["_d"]) & (some[name] == stay["_k"]), "left_semi")
    return rest.select(docs.columns).union(kept.select(docs.columns))
