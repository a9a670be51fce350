"""Readers, writers, triples and providers on small files."""

import gzip
import json

from pyspark.sql import functions as F

from lattica.operators import dictionary as D
from lattica.operators import triples as TR
from lattica.plans import flows
from lattica.sources import providers, readers, writers
from lattica.streaming import events as E


def test_entity_csv(spark, tmp_path):
    (tmp_path / "e.csv").write_text('﻿Entity,Abbreviation,Aliases,TP,Note\n"Deep\nNet",DN,"deep nets, DNN",1,x\n,A,,1,\nOther,O,,0,\nAttention,,,1,\n', encoding="utf-8")
    (tmp_path / "f.csv").write_text("Entity,Abbreviation,Aliases,TP\nAttention,ATT,,1\n", encoding="utf-8")
    a, b = (readers.entity_csv(spark, f"file://{tmp_path}/{x}.csv") for x in "ef")
    assert [(r.entity, r.abbreviation, r.aliases) for r in a.collect()] == [("Deep\nNet", "DN", ["deep nets", "DNN"]), ("Attention", "", [])]
    got = {r.entity: r for r in readers.merged_entities(a, b).collect()}
    assert got["Attention"].abbreviation == "ATT" and got["Deep\nNet"].aliases == ["deep nets", "DNN"]


def test_bioes_file(spark, tmp_path):
    (tmp_path / "x.data").write_text("# c\nDeep\tB-METHOD\nnets\tE-METHOD\nwork\tO\n\nNLP S-TASK\nalone\n", encoding="utf-8")
    got = [(r.rec_no, r.tok_no, r.token, r.tag) for r in readers.bioes_lines(spark, f"file://{tmp_path}/x.data").orderBy("rec_no", "tok_no").collect()]
    assert got == [(0, 0, "Deep", "B-METHOD"), (0, 1, "nets", "E-METHOD"), (0, 2, "work", "O"), (1, 0, "NLP", "S-TASK"), (1, 1, "alone", "O")]


def test_triples_and_networks(spark, tmp_path):
    for p, title in (("P18-1", "A Real Title"), ("P18-2", "P18-2")):
        (tmp_path / p / "kg" / "rebel").mkdir(parents=True)
        (tmp_path / p / "kg" / "rebel" / "triples.json").write_text(json.dumps([{"subject": " BERT ", "predicate": "uses", "object": "data"}, {"subject": "", "predicate": "x", "object": "y"}]))
        (tmp_path / p / "citation_network.json").write_text(json.dumps({"paper_id": "s" + p, "title": title, "year": 2018, "root_concepts": ["alpha"], "nodes": {"n1": {"title": "Parsing Sentences", "concepts": []}, "n2": {"title": "t", "concepts": ["graph"]}}, "edges": [{"source": "s" + p, "target": "n1"}, {"source": "", "target": "n2"}]}))
    t = readers.triples_json(spark, f"file://{tmp_path}/*/kg/rebel/triples.json").collect()
    assert sorted((r.paper_id, r.subject) for r in t) == [("P18-1", "BERT"), ("P18-2", "BERT")]
    n = readers.citation_networks(spark, f"file://{tmp_path}/*/citation_network.json")
    assert {r.paper_id: r.valid for r in n.collect()} == {"P18-1": True, "P18-2": False}
    assert [tuple(r) for r in readers.citation_edges(n).collect()] == [("sP18-1", "n1", "P18-1")]
    ids = n.select("external_id", "paper_id")
    c = {(r.paper_id, r.concept) for r in readers.node_concepts(n, ids).collect()}
    assert {("n1", "parsing"), ("n1", "sentences"), ("n2", "graph"), ("P18-1", "alpha")} <= c


def test_indexes_and_registry(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        json.dump({"P18-1001": {"title": "Deep Nets"}, "P18-1002": {"title": ""}}, f)
    assert [(r.paper_id, r.title) for r in readers.title_index_json(spark, f"file://{tmp_path}/a.json.gz").collect()] == [("P18-1001", "Deep Nets")]
    for name in ("P18", "2020.acl"):
        (tmp_path / f"{name}.xml").write_text('<collection><volume id="1"><paper id="18"><title>T one</title></paper><paper id="x"><title>bad</title></paper></volume><volume id="31"><paper id="5"><title>T two</title></paper></volume></collection>')
    got = {r.paper_id for r in readers.title_index_xml(spark, [f"file://{tmp_path}/P18.xml", f"file://{tmp_path}/2020.acl.xml"]).collect()}
    assert got == {"P18-1018", "P18-3105", "2020.acl-1.18", "2020.acl-31.5"}
    assert readers.collection_file_names(spark, "PD", ["acl"], ["acl"], ["long"], 3, (2020, 2021)).count() == 2 * 3 + 2 + 2
    (tmp_path / "papers.json").write_text(json.dumps({"papers": [{"id": "a", "domain": "nlp", "title": "X", "processed": True}, {"id": "b", "domain": "ml", "title": "Parsing", "processed": False}]}))
    r = readers.paper_registry(spark, f"file://{tmp_path}/papers.json")
    assert [x.id for x in readers.search_registry(r, "pars").collect()] == ["b"] and readers.search_registry(r, domain="nlp", processed=False).count() == 0
    assert {x.id: x.processed for x in readers.synced_registry(r, spark.createDataFrame([("b",)], "id string")).collect()} == {"a": False, "b": True}


TTL = """@prefix : <http://x#> . @prefix owl: <http://o#> . @prefix rdfs: <http://r#> .
# a comment
:uses rdf:type owl:ObjectProperty ;
  rdfs:domain [ a owl:Class ; owl:unionOf ( :Model :Method ) ] ;
  rdfs:range :Tool ; rdfs:comment "Consumes it. More text." .
:partOf a owl:ObjectProperty ,
  owl:TransitiveProperty ; rdfs:domain :Place .
:year a owl:DatatypeProperty .
"""


def test_ontology():
    assert readers.read_ontology(TTL) == [("partOf", ["Place"], [], ""), ("uses", ["Model", "Method"], ["Tool"], "Consumes it")]
    assert readers.relation_hints(readers.read_ontology(TTL)) == {"partOf": "Place → ?", "uses": "Model/Method → Tool  |  Consumes it"}
    try:
        readers.read_ontology("@prefix : <x> .")
        raise AssertionError
    except ValueError:
        pass


def test_graphml_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a & b", "paper", None), ("c", "entity", "C <1>")], "node string, type string, label string")
    edges = spark.createDataFrame([("a & b", "c", "mentions"), ("a & b", "c", "cites")], "src string, dst string, relation string")
    writers.write_graphml(nodes, edges, f"file://{tmp_path}/g")
    n, e = writers.read_graphml(spark, f"file://{tmp_path}/g")
    assert {r.node: r.attributes for r in n.collect()} == {"a & b": {"type": "paper"}, "c": {"type": "entity", "label": "C <1>"}}
    assert sorted((r.src, r.dst, r.attributes["relation"]) for r in e.collect()) == [("a & b", "c", "cites"), ("a & b", "c", "mentions")]
    assert "a &amp; b" in writers.graph_page(nodes, edges)


def test_html_and_logs(spark):
    c = spark.createDataFrame([("d", 1, "S1", "1 Intro", 0, "paragraph", "A deep net & more"), ("d", 1, "S1", "1 Intro", 1, "figure", "Figure 1")], "doc_id string, section_ord int, sec_id string, heading string, ord int, type string, text string")
    html = writers.html_documents(c, spark.createDataFrame([("d", "T<1>")], "doc_id string, title string"), ["net", "deep net"]).first().html
    assert '<mark class="concept">deep ' in html and "&amp; more" in html and 'id="S1.p1"' in html and "T&lt;1&gt;" in html
    log = spark.createDataFrame([("a", 1, False, "failed"), ("a", 2, True, "ok"), ("b", 1, False, "failed")], "paper_id string, ran_at int, success boolean, status string")
    papers = spark.createDataFrame([("a",), ("b",), ("c",)], "paper_id string")
    done = spark.createDataFrame([("a",)], "paper_id string")
    assert [r.paper_id for r in writers.to_run(papers, log, done).collect()] == ["c"]
    assert sorted(r.paper_id for r in writers.to_run(papers, log, done, True).collect()) == ["b", "c"]
    assert {r.status: r.n for r in writers.outcome_counts(log).collect()} == {"ok": 1, "failed": 1}
    assert writers.bars(spark.createDataFrame([("x", 4), ("y", 2)], "k string, n int"), "k", "n", 4).orderBy("k").first().bar == "████"


def entities(spark):
    return spark.createDataFrame([(0, "Bidirectional Encoder", "BERT", []), (1, "Wikipedia", "", [])], "ord long, entity string, abbreviation string, aliases array<string>")


def test_constrained_triples(spark):
    say = lambda s, p, o, src: {"subject": s, "predicate": p, "object": o, "source_sentence": src}
    found = [
        say("BERT", "trained_on", "Wikipedia", "We train BERT on the Wikipedia corpus of text"),
        say("BERT_base", "uses", "masked language model", "BERT uses a masked language model for its training"),
        say("BERT", "uses", "missing thing", "We train BERT on the corpus of many books"),
        say("GPT", "uses", "data", "GPT uses data from the large web corpus here"),
        say("BERT", "comprises", "encoder", "BERT is an encoder which has many stacked layers"),
        say("BERT", "designedFor", "parsing", "BERT works well on parsing and many other tasks"),
        say("BERT", "designedFor", "parsing", "BERT was designed for parsing and many other tasks"),
        say("BERT", "uses", "x", "too short"),
        say("BERT", "flies", "sky high up", "BERT flies sky high up in the air always"),
    ]
    raw = "<think>hm</think>```json\n" + json.dumps({"triples": found}) + "\n```"
    rows = TR.parsed_output(spark.createDataFrame([("p", raw), ("q", "<think>cut off"), ("r", "no json")], "paper_id string, raw string")).withColumn("row_id", F.xxhash64("paper_id", "ord"))
    got = sorted((r.subject, r.predicate, r.object) for r in TR.valid_fixed(rows, D.surface_forms(entities(spark)), entities(spark)).collect())
    assert got == [("Bidirectional Encoder", "designedfor", "parsing"), ("Bidirectional Encoder", "trainedon", "Wikipedia"), ("Bidirectional Encoder", "uses", "masked language model")]


def test_verdicts(spark):
    raw = ['{"verdict": "partial", "reason": "x"}', "I think this is INCORRECT.", "Correct indeed", "unclear"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string")
    v, _ = TR.verdict(F.col("x"))
    assert [r[0] for r in df.orderBy("i").select(v).collect()] == ["PARTIAL", "INCORRECT", "CORRECT", "UNVERIFIABLE"]


def test_extraction_flow(spark):
    page = "<h1>T</h1><h2>1 Model</h2><p>We show that BERT uses masked language modeling for pretraining. Nothing else stands in this sentence at all.</p>"
    pages = spark.createDataFrame([(1, page)], "page_id long, html string")
    e = entities(spark)
    got = flows.extract(pages, D.surface_forms(e), e, providers.PatternExtractor(["BERT"], ["uses"])).collect()
    assert [(r.paper_id, r.subject, r.predicate) for r in got] == [("1", "Bidirectional Encoder", "uses")]
    gaz = spark.createDataFrame([("masked language modeling", "Masked Language Modeling", "Method")], "key string, surface string, ceo_type string")
    seeds = spark.createDataFrame([("1", "BERT", "", "x", "Model")], "paper_id string, entity string, abbreviation string, raw_type string, ceo_type string")
    assert [(r.entity, r["rank"]) for r in flows.enrich(pages, gaz, seeds).orderBy("rank").collect()] == [("BERT", 1), ("Masked Language Modeling", 2)]


def test_refiner_keeps_unsafe_rewrites_out(spark):
    class Shout:
        name = "shout"

        def generate(self, prompts):
            return ["something entirely else than before was written here instead"] * len(prompts)

    text = "a line\n" + "word " * 40
    b = spark.createDataFrame([("paragraph", text, True), ("table", text, True), ("paragraph", "short", True)], "type string, text string, needs_llm boolean")
    assert sorted(r.text for r in providers.refined(b, Shout()).collect()) == sorted([text, text, "short"])
    fixed = providers.refined(b, providers.EchoGenerator()).where("type = 'paragraph'").collect()
    assert any(r.text == "a line " + ("word " * 40).strip() for r in fixed)


def test_event_streams(spark):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = spark.readStream.schema(schema).parquet("/root/testdata/sf0.001/events.parquet*")
    for name, f in (("w", E.windowed), ("s", E.sessions), ("d", E.deduplicated)):
        q = f(src).writeStream.outputMode("append").format("memory").queryName(f"ev_{name}").start()
        q.processAllAvailable()
        q.stop()
    windows = spark.table("ev_w").selectExpr("sum(n) AS n").first().n
    assert 0 < windows <= rows.count() and spark.table("ev_d").count() == rows.count() and spark.table("ev_s").count() > 0


def test_annotated_sources(spark):
    rows = spark.createDataFrame([("Bidirectional Encoder", "We train BERT on text"), ("Wikipedia", "Wikipedia is large"), ("Bidirectional Encoder", "No name here")], "subject string, source_sentence string")
    got = [r.annotated for r in TR.annotated_source(rows, D.surface_forms(entities(spark))).collect()]
    assert sorted(got) == sorted(["We train BERT (Bidirectional Encoder) on text", "Wikipedia is large", "No name here"])
