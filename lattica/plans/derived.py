"""A scholarly graph derived from the order tables: papers are orders, entities are parts, suppliers, nations and
regions; an order cites its customer's order before it and mentions its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def cites(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = t.orders.select(F.col("o_orderkey").alias("src"), F.lag("o_orderkey").over(w).alias("dst"))
    return o.where("dst is not null")


def mentions(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


def triples(t: Tables) -> DataFrame:
    """subject, predicate, object, mode (l_returnflag), ord."""
    supply = t.lineitem.groupBy("l_partkey", "l_suppkey", "l_returnflag").agg(F.min("l_orderkey").alias("ord"))
    parts = supply.select(F.concat(F.lit("part "), "l_partkey").alias("subject"), F.lit("supplied_by").alias("predicate"), F.concat(F.lit("supplier "), "l_suppkey").alias("object"), F.col("l_returnflag").alias("mode"), F.expr("ord * 1000000000 + l_partkey * 1000 + l_suppkey % 1000").alias("ord"))
    modes = F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("mode")
    sup = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    located = sup.select(F.concat(F.lit("supplier "), "s_suppkey").alias("subject"), F.lit("located_in").alias("predicate"), F.lower("n_name").alias("object"), modes, F.col("s_suppkey").alias("ord"))
    nat = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    part_of = nat.select(F.lower("n_name").alias("subject"), F.lit("part_of").alias("predicate"), F.lower("r_name").alias("object"), modes, F.col("n_nationkey").cast("long").alias("ord"))
    return parts.union(located).union(part_of)


#: The same tables in SQL, as WITH clauses.
SQL = {
    "cites": "cites AS (SELECT * FROM (SELECT o_orderkey AS src, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL)",
    "mentions": "mentions AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem)",
    "triples": """supply AS (SELECT l_partkey, l_suppkey, l_returnflag, min(l_orderkey) AS ord FROM lineitem GROUP BY ALL),
    modes AS (SELECT unnest(['A', 'N', 'R']) AS mode),
    triples AS (
      SELECT 'part ' || l_partkey AS subject, 'supplied_by' AS predicate, 'supplier ' || l_suppkey AS object, l_returnflag AS mode, ord * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS ord FROM supply
      UNION ALL SELECT 'supplier ' || s_suppkey, 'located_in', lower(n_name), mode, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey, modes
      UNION ALL SELECT lower(n_name), 'part_of', lower(r_name), mode, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey, modes)""",
}


def with_sql(*names: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in names)
