"""Interfaces of what lies outside the engine (models, web services, page layout), with offline stand-ins.

A provider is an object that workers can unpickle; it is built once for each Python worker and sees batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from lattica.functions import text as T


class Generator(Protocol):
    """Answers prompts: language models, judges, refiners."""

    name: str

    def generate(self, prompts: list[str]) -> list[str]: ...


class LayoutReader(Protocol):
    """Turns a PDF's bytes into blocks (page, x, y, text)."""

    def blocks(self, pdf: bytes) -> list[tuple[int, float, float, str]]: ...


class CitationSource(Protocol):
    """A citation service: what papers (external_id) cite and are cited by, as (external_id, other, title, year, citing)."""

    def related(self, papers: DataFrame, limit: int) -> DataFrame: ...


class TableCitations:
    """The offline service: a table of citations (source, target) and one of papers (external_id, title, year)."""

    def __init__(self, edges: DataFrame, papers: DataFrame):
        self.edges, self.papers = edges, papers

    def related(self, papers: DataFrame, limit: int = 10) -> DataFrame:
        """References and citing papers, up to `limit` of each by id; one that is both comes twice."""
        asked = papers.select("external_id").distinct()
        out = self.edges.select(F.col("source").alias("external_id"), F.col("target").alias("other"), F.lit(False).alias("citing"))
        back = self.edges.select(F.col("target").alias("external_id"), F.col("source").alias("other"), F.lit(True).alias("citing"))
        both = out.union(back).join(asked, "external_id", "left_semi")
        both = both.withColumn("_r", F.row_number().over(Window.partitionBy("external_id", "citing").orderBy("other"))).where(F.col("_r") <= limit)
        return both.join(self.papers.withColumnRenamed("external_id", "other"), "other", "left").select("external_id", "other", "title", "year", "citing")


def networks_from(source: CitationSource, papers: DataFrame, limit: int = 10) -> DataFrame:
    """Citation networks (paper_id, external_id, title, year, root_concepts, nodes, edges) of papers (paper_id,
    external_id, title, year), built from a service: references first, then citing papers."""
    found = source.related(papers, limit)
    node = F.struct("title", "year", F.lit(None).cast("string").alias("abstract"), F.lit(None).cast("int").alias("citation_count"), F.when(F.col("citing"), "cited_by").otherwise("references").alias("relation"), F.array().cast("array<string>").alias("concepts"))
    edge = F.struct(F.when(F.col("citing"), F.col("other")).otherwise(F.col("external_id")).alias("source"), F.when(F.col("citing"), F.col("external_id")).otherwise(F.col("other")).alias("target"), F.lit("cites").alias("type"))
    nodes = found.groupBy("external_id", "other").agg(F.min_by(node, "citing").alias("n")).groupBy("external_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("other", "n")))).alias("nodes"))
    edges = found.groupBy("external_id").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    concepts = F.slice(F.array_distinct(T.concept_words(F.coalesce("title", F.lit("")))), 1, 15)
    return papers.join(nodes, "external_id", "left").join(edges, "external_id", "left").select("paper_id", "external_id", "title", "year", concepts.alias("root_concepts"), "nodes", F.coalesce("edges", F.array().cast("array<struct<source:string,target:string,type:string>>")).alias("edges"))


class EchoGenerator:
    """The offline stand-in: gives the text back, as a refiner that changes nothing."""

    name = "echo"

    def generate(self, prompts: list[str]) -> list[str]:
        return prompts


class PatternExtractor:
    """The offline stand-in of an extractor: '<known name> <verb> <rest>' sentences as JSON triples."""

    name = "pattern"

    def __init__(self, names: list[str], relations: list[str]):
        self.names, self.relations = sorted(names, key=len, reverse=True), relations

    def generate(self, prompts: list[str]) -> list[str]:
        import json
        import re

        out = []
        for s in prompts:
            found = []
            for n in self.names:
                for r in self.relations:
                    if m := re.search(rf"\b{re.escape(n)}\b\s+{re.escape(r)}\s+([^.;]+)", s, re.I):
                        found.append({"subject": n, "predicate": r, "object": m[1].strip(), "source_sentence": s})
            out.append(json.dumps({"triples": found}))
        return out


def generated(prompts: DataFrame, provider: Generator, batch: int = 8, prompt_col: str = "prompt") -> DataFrame:
    """Adds raw: the provider's answers. Filter before this: it is the expensive step."""
    schema = StructType([*prompts.schema, StructField("raw", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(prompt_col).to_pylist()
            answers = [a for i in range(0, len(text), batch) for a in provider.generate(text[i : i + batch])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(answers, pa.string())], names=[*b.schema.names, "raw"])

    return prompts.mapInArrow(run, schema)


def refined(blocks: DataFrame, provider: Generator) -> DataFrame:
    """Blocks (type, text, needs_llm) with repaired texts; a rewrite that isn't safe is not taken."""
    ask = F.col("needs_llm") & (F.col("type") != "table") & T.needs_repair(F.col("text"))
    answers = generated(blocks.where(ask).withColumn("prompt", F.col("text")), provider).withColumn("_new", T.clean_model_output(F.col("raw"))).drop("raw", "prompt")
    kept = answers.withColumn("text", F.when(T.is_safe_rewrite(F.col("text"), F.col("_new")), F.col("_new")).otherwise(F.col("text"))).drop("_new")
    return kept.unionByName(blocks.where(~F.coalesce(ask, F.lit(False))))


def is_scanned(blocks: DataFrame, pages: int = 3, least_chars: int = 50) -> DataFrame:
    """doc_id, scanned: documents whose first pages (numbered from 1) hold fewer than `least_chars` characters."""
    chars = F.sum(F.when(F.col("page") <= pages, F.length("text")).otherwise(0))
    return blocks.groupBy("doc_id").agg((F.coalesce(chars, F.lit(0)) < least_chars).alias("scanned"))


def pdf_blocks(spark, paths: str, reader: LayoutReader) -> DataFrame:
    """doc_id (file name), ord, page, x, y, text of PDFs through a layout reader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = [(path.rsplit("/", 1)[-1].removesuffix(".pdf"), i, *x) for i, x in enumerate(reader.blocks(content))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["doc_id", "ord", "page", "x", "y", "text"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, "doc_id string, ord long, page long, x double, y double, text string")
