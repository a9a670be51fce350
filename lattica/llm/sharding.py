"""Sharding by fixed virtual slots.

Every record hashes into one of `slots` virtual slots. Bytes and rows are aggregated per slot, and a versioned
slot-to-shard map, edited only as far as balance needs, decides the shard. The newest stored map is loaded, and an
edit that lightens the heaviest shard is stored as the next version; otherwise the map stays as it is. Records never
move between slots, so an edit moves whole slots and nothing else.

Copies of one record (same id and text) share a slot, unless together they outweigh a quarter of an even slot by
bytes or rows: then they are dealt over as many slots as that takes, for copies are interchangeable. There can be
8 * slots such records at most, which bounds what is broadcast. So no slot is hot, whatever is repeated.

All work on records is DataFrame code. The driver sees only the fixed-size slot table.

Defined results: a null text has 0 bytes and the CRC-32 of the empty string; a null id hashes by its text;
repeated rows get positions of their own; an empty table gives an empty result; further columns of the input are
ignored. A single text that outweighs an even shard fills one shard alone.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm.common import discard, shared_dir, stage, table
from lattica.sources.tables import exists

SLOTS = 4096
#: Buckets of the hash in which heavy records are looked for; a multiple of the slots.
BUCKETS = 16


@dataclass(frozen=True)
class SlotMap:
    """owner[s] is the shard of virtual slot s."""

    version: int
    shards: int
    owner: tuple[int, ...]

    @staticmethod
    def initial(slots: int, shards: int) -> SlotMap:
        return SlotMap(0, shards, tuple(s % shards for s in range(slots)))

    def loads(self, weight: list[int]) -> list[int]:
        out = [0] * self.shards
        for s, k in enumerate(self.owner):
            out[k] += weight[s]
        return out

    def edited(self, weight: list[int]) -> SlotMap:
        """The next version, if it lightens the heaviest shard; else this one."""
        after = self.rebalanced(weight)
        return after if max(after.loads(weight)) < max(self.loads(weight)) else self

    def rebalanced(self, weight: list[int], shards: int | None = None) -> SlotMap:
        """The next version: a shard keeps its heaviest slots while they fit under the mean load; the others go,
        heaviest first, to the shard with the least load."""
        shards = shards or self.shards
        mean = sum(weight) / shards
        load = [0] * shards
        owner = list(self.owner)
        loose = []
        for s in sorted(range(len(owner)), key=lambda s: (-weight[s], s)):
            k = owner[s]
            if k < shards and load[k] + weight[s] <= mean:
                load[k] += weight[s]
            else:
                loose.append(s)
        heap = [(load[k], k) for k in range(shards)]
        heapq.heapify(heap)
        for s in loose:
            n, k = heapq.heappop(heap)
            owner[s] = k
            heapq.heappush(heap, (n + weight[s], k))
        return SlotMap(self.version + 1, shards, tuple(owner))

    def lookup(self, slot: Column) -> Column:
        return constant_lookup(self.owner, slot, "int")

    def save(self, spark: SparkSession, path: str) -> None:
        """One folder for each version, so that earlier maps stay readable."""
        (
            spark.range(len(self.owner))
            .select(F.col("id").cast("int").alias("slot"), self.lookup(F.col("id").cast("int")).alias("shard"), F.lit(self.shards).alias("shards"))
            .coalesce(1)
            .write.mode("overwrite")
            .parquet(f"{path}/version={self.version}")
        )

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        rows = spark.read.parquet(path)
        version = rows.agg(F.max("version")).first()[0] if version is None else version
        found = rows.where(F.col("version") == version).orderBy("slot").collect()
        return SlotMap(version, found[0]["shards"], tuple(r["shard"] for r in found))


def constant_lookup(values, index: Column, kind: str) -> Column:
    """values[index] as a folded array constant: no join, no UDF."""
    return F.get(F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>"), index)


def records_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 of each record, a hash that its copies share, and a number of its own."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    crc = F.crc32(F.encode(text, "utf-8"))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        crc.alias("text_crc32"),
        F.xxhash64(F.col(id_col), crc, F.octet_length(text)).alias("h"),
        F.monotonically_increasing_id().alias("pos"),
    )


def slotted(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The records with their virtual_slot. One aggregate over a fixed number of buckets finds where heavy records can
    be; only the records of those buckets are counted one by one."""
    sums = (F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    bucket = F.pmod("h", F.lit(slots * BUCKETS))
    whole = stage(records.groupBy(bucket.alias("bucket")).agg(*sums), "buckets")  # slots * BUCKETS rows at most
    total = whole.agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).first()
    quarters = F.greatest(*(F.col(c) * 4 * slots / max(total[c] or 0, 1) for c in ("bytes", "rows")))  # of an even slot
    crowded = whole.where(quarters > 1).select("bucket")
    heavy = records.withColumn("bucket", bucket).join(F.broadcast(crowded), "bucket").groupBy("h").agg(*sums).where((quarters > 1) & (F.col("rows") > 1))
    heavy = stage(heavy.select("h", F.ceil(quarters).alias("parts")), "heavy")  # 8 * slots rows at most
    discard(whole)
    spread = F.when(F.col("parts").isNull(), F.col("h")).otherwise(F.xxhash64("h", F.pmod(F.xxhash64("pos"), "parts")))
    return records.join(F.broadcast(heavy), "h", "left").withColumn("virtual_slot", F.pmod(spread, F.lit(slots)).cast("int")).drop("parts")


def newest_map(spark: SparkSession, store: str, slots: int, shards: int) -> SlotMap:
    """The stored map (its slots are fixed for good), or the first one."""
    if not exists(spark, store):
        return SlotMap.initial(slots, shards)
    found = SlotMap.load(spark, store)
    if len(found.owner) != slots:
        raise ValueError(f"{store} maps {len(found.owner)} slots, not {slots}")
    return found


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = SLOTS, store: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (position in the shard), grown_shard, virtual_slot, map_version."""
    spark = docs.sparkSession
    store = store or f"{shared_dir(spark)}/slot-map"
    records = stage(records_of(docs, id_col, text_col), "records")
    records = stage(slotted(records, slots), "slotted")
    counts = stage(records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "slot-counts")
    size = [0] * slots
    for r in counts.select("virtual_slot", "bytes").collect():  # at most `slots` rows
        size[r["virtual_slot"]] = r["bytes"]
    before_edit = newest_map(spark, store, slots, shards)
    slot_map = before_edit.edited(size) if before_edit.shards == shards else before_edit.rebalanced(size, shards)
    if slot_map is not before_edit or not slot_map.version:
        slot_map.save(spark, store)
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("shard", slot_map.lookup(F.col("virtual_slot"))).select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "pos"))
    return records.withColumn("place", place).join(F.broadcast(base), "virtual_slot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.col("place") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(slot_map.version).alias("map_version"),
    )


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = f"{shared_dir(spark)}/slot-map-{zlib.crc32(sf_dir.encode()):08x}"  # each folder of tables has a map of its own
    return shard_documents(table(spark, sf_dir, "documents"), store=own)
