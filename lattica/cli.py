"""The flows from a shell: python -m lattica.cli <command> --help. Tables are Parquet folders, results go to --out."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica import session
from lattica.operators import dictionary, graph, kge, ranking
from lattica.plans import flows
from lattica.sources import providers, readers, tables, writers
from lattica.streaming import merge


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _write(df: DataFrame, out: str) -> None:
    df.write.mode("overwrite").parquet(out)


def parse(spark: SparkSession, a: argparse.Namespace) -> None:
    """Blocks and tables of pages to structured content, and HTML documents if asked for."""
    content = flows.parse_corpus(_read(spark, a.blocks), _read(spark, a.tables))
    _write(content, a.out)


def entities(spark: SparkSession, a: argparse.Namespace) -> None:
    """Entity dictionaries of pages, from a gazetteer and entity files."""
    seeds = readers.entity_csv(spark, a.seeds).select(F.lit(None).cast("string").alias("paper_id"), "entity", "abbreviation", F.col("ner_type").alias("raw_type"), "ceo_type") if a.seeds else spark.createDataFrame([], "paper_id string, entity string, abbreviation string, raw_type string, ceo_type string")
    _write(flows.enrich(_read(spark, a.pages), _read(spark, a.gazetteer), seeds, a.min_count, a.max_entities), a.out)


def extract(spark: SparkSession, a: argparse.Namespace) -> None:
    """Validated triples of pages, by the offline pattern extractor over the names of an entity file."""
    e = readers.entity_csv(spark, a.entities)
    forms = tables.staged(dictionary.surface_forms(e), "forms")
    names = [r["form"] for r in forms.select("form").limit(a.max_names + 1).collect()]
    if len(names) > a.max_names:
        raise SystemExit(f"more than {a.max_names} names; a pattern extractor is for small dictionaries")
    relations = [r["name"] for r in readers.ontology_relations(spark, a.ontology).collect()] if a.ontology else ["uses", "achieves", "addresses"]
    _write(flows.extract(_read(spark, a.pages), forms, e, providers.PatternExtractor(names, relations)), a.out)


def merge_graph(spark: SparkSession, a: argparse.Namespace) -> None:
    """Triple files of a folder into the versioned graph; run again, it takes what is new."""
    store = tables.VersionedTables(spark, a.store)
    networks = readers.citation_networks(spark, a.networks)
    merge.stream_merge(spark, a.triples, store, networks, f"{a.store}/_progress", a.files_per_batch).awaitTermination()
    writers.write_report({"stats": graph.graph_stats(store.read("nodes"), store.read("edges")), "relations": graph.edge_breakdown(store.read("edges"))}, f"{a.out}/report")


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Train on (h, r, t), rank papers by cosine and evaluate against held-out (query, candidate) pairs."""
    s = kge.Settings(model=a.kge, dim=a.dim, margin=a.margin, rate=a.lr, epochs=a.epochs, batch=a.batch_size, negatives=a.neg_ratio, loss=a.loss, gamma=a.gamma, temperature=a.adv_temp)
    runs = [(s, seed) for seed in a.seeds]
    result = tables.staged(flows.link_prediction(spark, _read(spark, a.train), _read(spark, a.papers), _read(spark, a.truth), runs), "evaluation")
    _write(result, a.out)
    ranking.seed_summary(result, ["model"], "mrr").show(truncate=False)


def compare(spark: SparkSession, a: argparse.Namespace) -> None:
    """Two extraction modes: overlap of triples and distribution of relations, as a report."""
    from lattica.operators import triples as TR

    one, two = _read(spark, a.fixed), _read(spark, a.free)
    sides = TR.overlap(one, two).groupBy("side").agg(F.count("*").alias("n"))
    writers.write_report({"overlap": sides, "relations": TR.relation_distribution(one, two)}, a.out)


def registry(spark: SparkSession, a: argparse.Namespace) -> None:
    """Papers of a registry file that fit."""
    readers.search_registry(readers.paper_registry(spark, a.file), a.text, a.domain, a.processed).show(a.limit, truncate=False)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lattica", description=__doc__)
    top.add_argument("--master", help="Spark master; the cluster's own if left out")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, **options) -> None:
        c = sub.add_parser(name, help=run.__doc__, description=run.__doc__)
        c.set_defaults(run=run)
        for o, kw in options.items():
            c.add_argument("--" + o.replace("_", "-"), **kw)

    need, text = {"required": True}, {}
    number = lambda n, kind=int: {"type": kind, "default": n}
    command("parse", parse, blocks=need, tables=need, out=need)
    command("entities", entities, pages=need, gazetteer=need, out=need, seeds=text, min_count=number(1), max_entities=number(None))
    command("extract", extract, pages=need, entities=need, out=need, ontology=text, max_names=number(2000))
    command("merge", merge_graph, triples=need, networks=need, store=need, out=need, files_per_batch=number(25))
    command(
        "evaluate", evaluate, train=need, papers=need, truth=need, out=need, kge={"choices": sorted(kge.MODELS), "default": "transe"}, dim=number(128), margin=number(1.0, float), lr=number(0.01, float), epochs=number(1000), batch_size=number(256),
        neg_ratio=number(10), loss={"choices": ["margin", "self_adversarial"], "default": "margin"}, gamma=number(9.0, float), adv_temp=number(1.0, float), seeds={"type": int, "nargs": "+", "default": [1]},
    )
    command("compare", compare, fixed=need, free=need, out=need)
    command("registry", registry, file=need, text=text, domain=text, processed={"type": lambda x: x == "true", "default": None}, limit=number(50))
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = session.build("lattica", a.master)
    try:
        a.run(spark, a)
    finally:
        tables.drop_staged(spark)


if __name__ == "__main__":
    main()
