"""The bounded labelled sample that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import stage

FOLDS = 5
PER_CLASS = 3000
MOST_BYTES = 10 << 20


def held_out(id_col: str = "doc_id", folds: int = FOLDS) -> Column:
    """True for the rows that no model sees the label of."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")), F.lit(folds)) == 0, F.lit(False))


def within(sizes: list[int], most: int) -> list[int]:
    """Which of these, taken in order, fit into `most` bytes together: what doesn't fit is passed over for what
    follows, so one huge text can't crowd out the rest. If none fits, the smallest alone."""
    out, held = [], 0
    for i, n in enumerate(sizes):
        if held + n <= most:
            out.append(i)
            held += n
    return out or ([min(range(len(sizes)), key=lambda i: (sizes[i], i))] if sizes else [])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple[bytes, int]], dict[int, int]]:
    """(text, label) of at most `per_class` rows of either label, chosen by the hash of their id outside the held-out
    fold; and how many ids of that fold have each label.

    Texts are whole: each class takes them in the order of the hash while they fit into its half of `most_bytes`.
    An id with several labels has the greatest, one with several texts the shortest (then the least); null texts
    are empty. Ids are chosen from the labels alone, so that texts are read for the chosen rows only.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & ~held_out(id_col)).groupBy(id_col).agg(F.max(label).cast("int").alias("_label"))
    total = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    chosen = [known.where(F.col("_label") == k).orderBy(F.xxhash64(id_col), id_col).limit(per_class) for k in (0, 1)]
    ids = chosen[0].union(chosen[1]).select(F.col(id_col).alias("_id"), "_label")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text")).join(F.broadcast(ids), "_id")  # 2 * per_class ids
    one = rows.groupBy("_id", "_label").agg(F.min(F.struct(F.octet_length("_text").alias("n"), F.col("_text").alias("text"))).alias("x"))
    found = stage(one.select("_id", "_label", "x.n", "x.text", F.xxhash64("_id").alias("h")), "labelled")
    taken: list = []
    sizes = found.select("_id", "_label", "n", "h").collect()  # at most 2 * per_class rows
    for k in (0, 1):
        own = sorted((r for r in sizes if r["_label"] == k), key=lambda r: (r["h"], r["_id"]))
        taken += [own[i]["_id"] for i in within([r["n"] for r in own], most_bytes // 2)]
    if len(taken) < len(sizes):
        found = found.where(F.col("_id").isin(taken))
    texts = found.select("_id", "text", "_label").collect()  # most_bytes at most, or one text of each label
    return [(r["text"].encode(), r["_label"]) for r in sorted(texts, key=lambda r: r["_id"])], total
