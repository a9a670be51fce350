"""End-to-end flows: from pages to triples, from triples to a graph, from a graph to evaluated rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.operators import dictionary, documents, graph, kge, layout, ranking, triples
from lattica.sources.providers import Generator, generated
from lattica.sources.tables import staged


def parse_corpus(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Structured content (doc_id, section_ord, heading, ord, type, text) of placed blocks and extracted tables."""
    noise = T.is_page_noise(F.col("text")) | T.is_layout_noise(F.col("text"), F.col("y"))
    kept = layout.detect_columns(blocks.where(~noise), ["doc_id"])
    return layout.merged_paragraphs(layout.structured_blocks(kept, layout.distinct_tables(tables, ["doc_id"])))


def enrich(pages: DataFrame, gazetteer: DataFrame, seeds: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """Each page's entity dictionary: its seeds and the gazetteer entries that its text holds."""
    sections = documents.html_sections(pages)
    text = sections.groupBy("id", "title").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_ord", "text"))), lambda x: x["text"]), " ").alias("body"))
    whole = text.select(F.col("id").cast("string").alias("paper_id"), F.concat_ws(" ", "title", "body").alias("text"))
    hits = dictionary.match_gazetteer(whole, gazetteer, "paper_id", "text").join(gazetteer, "key")
    body = hits.select("paper_id", F.col("surface").alias("name"), F.col("ceo_type").alias("raw_type"), F.col("hits").alias("cnt"), F.xxhash64("key").alias("ord"))
    return dictionary.entity_rows(seeds, body, None, least, most)


def extract(pages: DataFrame, forms: DataFrame, entities: DataFrame, provider: Generator, most_chars: int = 1500) -> DataFrame:
    """Validated triples of pages: sections to sentences to packed paragraphs; only paragraphs that mention an entity
    go to the provider."""
    s = documents.section_sentences(documents.html_sections(pages))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("sent_ord", "sentence"))), lambda x: x["sentence"])
    packed = s.groupBy("id", "section_ord", "section").agg(T.packed_paragraphs(ordered, most_chars).alias("p")).select("id", "section_ord", "section", F.posexplode("p").alias("par", "prompt"))
    packed = staged(packed.withColumn("row", F.xxhash64("id", "section_ord", "par")), "paragraphs")
    named = dictionary.mentioned(packed.select(F.col("row").alias("id"), F.col("prompt").alias("text")), forms).select(F.col("id").alias("row")).distinct()
    raw = generated(packed.join(named, "row", "left_semi"), provider)
    rows = triples.parsed_output(raw.select(F.col("id").cast("string").alias("paper_id"), "section", "row", "raw"))
    return triples.valid_fixed(rows.withColumn("row_id", F.xxhash64("row", "ord")), forms, entities)


def link_prediction(spark: SparkSession, train: DataFrame, papers: DataFrame, truth: DataFrame, runs: list[tuple[kge.Settings, int]]) -> DataFrame:
    """model, n, metric means over seeds: train, rank papers by cosine, evaluate against held-out citations.
    train is (h, r, t) by name, papers (node), truth (query, candidate) by name."""
    ids, ents, rels = graph.indexed(train, papers.select(F.col("node").alias("name")))
    ids, ents = staged(ids, "triples"), staged(ents, "entities")
    vectors = staged(kge.train_runs(ids, ents.count(), rels.count(), runs), "vectors")
    big = papers.join(ents, papers["node"] == ents["name"]).select("id", "node")
    named = lambda c: big.select(F.col("id").alias(f"{c}_id"), F.col("node").alias(c))
    t = truth.join(named("query"), "query").join(named("candidate"), "candidate").select(F.col("query_id").alias("query"), F.col("candidate_id").alias("candidate"))
    t = staged(t, "truth")
    out = None
    for s, seed in runs:
        v = vectors.where((F.col("model") == s.model) & (F.col("seed") == seed)).join(big, "id").select("id", "v")
        scores = ranking.cosine_pairs(v.join(t.select(F.col("query").alias("id")).distinct(), "id", "left_semi"), v)
        one = ranking.evaluate(scores, t).select(F.lit(s.model).alias("model"), F.lit(seed).alias("seed"), "*")
        out = one if out is None else out.unionByName(one)
    return out
