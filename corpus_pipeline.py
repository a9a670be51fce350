"""Documents to packed training sequences: filter, deduplicate, decontaminate, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
docs of the next. Both classifiers learn from the labels and documents tables of sf_dir, whatever the stage
before has kept, so that a stage's decisions don't depend on where it stands.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lattica.llm import quality, toxicity
from lattica.llm.common import stage, table
from lattica.llm.decontaminate import decontaminated
from lattica.llm.jaccard import deduplicated
from lattica.llm.packing import pack
from lattica.sources.tables import discard, drop_staged, staged_mark


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """By the SimHash index and, beyond its four bits, MinHash bands; exact Jaccard decides about what they find."""
    return deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The classifiers, the components and the packing are not SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        mark = staged_mark()
        kept = stage(step(spark, docs, sf_dir), name)
        drop_staged(spark, mark, keep=kept)  # what the stage wrote on its way
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
