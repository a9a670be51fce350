"""Connected components of a links table, by alternating stars.

Each round turns the links around the smallest neighbour (large star, then small star) until nothing changes;
rounds grow with the logarithm of a component's size. Links never leave the executors: each half round is a
partial aggregate and a join that Spark may split where a hub is hot, written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import discard, stage


def _mark(links: DataFrame) -> tuple[int, int]:
    r = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return r[0], int(r[1] or 0)


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    least = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    out = stage(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
    discard(least)
    return out


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stage(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    out = stage(moved.union(least.select("a", "m")).distinct(), "small")
    discard(least)
    return out


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of the long columns a and b; nulls and loops don't link."""
    links = stage(links.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a <> b").select("a", "b").distinct(), "links")
    mark = _mark(links)
    while mark[0]:
        before, large = links, _large(links)
        links = _small(large)
        discard(before, large)
        if (now := _mark(links)) == mark:
            break
        mark = now
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
