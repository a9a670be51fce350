"""Graph building, the merge scenario, streaming replay and walks."""

import json

from lattica.operators import dictionary as D
from lattica.operators import graph as G
from lattica.sources.tables import VersionedTables, staged
from lattica.streaming.merge import backfill, stream_merge

TRIPLE = "paper_id string, subject string, predicate string, object string, section string, source_sentence string, ord long"
NET = "paper_id string, external_id string, title string, year int, nodes map<string,struct<title:string,year:int>>, edges array<struct<source:string,target:string>>"


def triples(spark, rows):
    return spark.createDataFrame([(p, s, r, o, "1", "", i) for i, (p, s, r, o) in enumerate(rows)], TRIPLE)


def networks(spark):
    return spark.createDataFrame([("A", "s2a", "Paper A", 2020, {"s2b": ("Paper B", 2019)}, [("s2a", "s2b")]), ("B", "s2b", "Paper B full", 2019, {}, [])], NET)


def papers(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "paper_id string")


def facts(state):
    return {r.node: r for r in state["nodes"].collect()}, {(r.src, r.dst, r.key) for r in state["edges"].collect()}


def test_merge_scenario(spark):
    t1 = triples(spark, [("A", "BERT", "uses", "Attention"), ("A", "BERT", "uses", "Attention"), ("B", "GPT", "uses", "Attention")])
    keep = lambda s: {k: staged(v, k) for k, v in s.items()}
    one = keep(G.merge_papers(G.empty_state(spark), t1, networks(spark), papers(spark, "A")))
    nodes, edges = facts(one)
    assert nodes["paper:s2b"].type == "paper_stub" and nodes["paper:s2b"].title == "Paper B" and nodes["paper:A"].title == "Paper A"
    assert ("paper:A", "paper:s2b", "cites") in edges and sum(e[:2] == ("bert", "attention") for e in edges) == 1
    again = G.merge_papers(one, t1, networks(spark), papers(spark, "A"))
    assert facts(again) == (nodes, edges)
    two = keep(G.merge_papers(one, t1, networks(spark), papers(spark, "B")))
    nodes, edges = facts(two)
    assert "paper:s2b" not in nodes and nodes["paper:B"].type == "paper" and nodes["paper:B"].title == "Paper B full"
    assert ("paper:A", "paper:B", "cites") in edges
    report = {r.paper_id: r for r in G.connectivity(papers(spark, "A", "B", "Z"), two["nodes"], two["edges"]).collect()}
    assert (report["A"].cites_edges, report["A"].shared_entity_neighbors, report["A"].isolated) == (1, 1, False) and not report["Z"].present
    more = triples(spark, [("A", "BERT", "uses", "Attention"), ("A", "BERT", "uses", "Attention"), ("A", "BERT", "trained on", "Books")])
    three = G.merge_papers(two, more, networks(spark), papers(spark, "A"))
    assert ("bert", "books", "trained on||1") in facts(three)[1] and {r.paper_id: r.n_triples for r in three["merged"].collect()} == {"A": 3, "B": 1}


def test_stub_stays_where_the_paper_is_known(spark):
    base = G.empty_state(spark)
    base["nodes"] = spark.createDataFrame([("paper:s2b", "paper_stub", None, None, None), ("paper:B", "paper", "x", None, None)], G.EMPTY["nodes"])
    nodes, _ = facts(G.merge_papers(base, triples(spark, [("B", "GPT", "uses", "Attention")]), networks(spark), papers(spark, "B")))
    assert {"paper:s2b", "paper:B"} <= nodes.keys()


def test_stream_equals_batch_and_replay_changes_nothing(spark, tmp_path):
    rows = [("A", "BERT", "uses", "Attention"), ("B", "GPT", "uses", "Attention"), ("C", "ELMo", "uses", "LSTM cells")]
    src = tmp_path / "in"
    src.mkdir()
    for i, (p, s, r, o) in enumerate(rows):
        (src / f"{i}.json").write_text(json.dumps({"paper_id": p, "subject": s, "predicate": r, "object": o, "section": "1", "source_sentence": "", "ord": i}))
    store = VersionedTables(spark, f"file://{tmp_path}/store")
    run = lambda: stream_merge(spark, f"file://{src}", store, networks(spark), f"file://{tmp_path}/ck", 1).awaitTermination()
    run()
    batch = facts(G.merge_papers(G.empty_state(spark), triples(spark, rows), networks(spark), papers(spark, "A", "B", "C")))
    assert facts({k: store.read(k) for k in G.EMPTY}) == batch
    v = store.version()
    run()
    assert store.version() == v
    left = backfill(spark.createDataFrame([("A", 1), ("D", 2)], "paper_id string, n_triples long"), store)
    assert [r.paper_id for r in left.collect()] == ["D"]


def test_build_graph_resolves_names(spark):
    e = spark.createDataFrame([(0, "Bidirectional Encoder", "BERT", ["bert model"]), (1, "Attention", "", [])], "ord long, entity string, abbreviation string, aliases array<string>")
    forms = D.surface_forms(e)
    by = {r.form: r.canonical for r in forms.collect()}
    assert by["bert"] == by["google bert"] == by["bert-large"] == "Bidirectional Encoder" and "bertlarge" not in by
    nodes, edges = G.build_graph(triples(spark, [("A", "BERT_base", "is_based on", "attention"), ("A", "this paper", "uses", "BERT"), ("A", "BERT", "is_based on", "attention")]), forms)
    assert {(r.node, r.label) for r in nodes.collect()} == {("bidirectional encoder", "Bidirectional Encoder"), ("attention", "Attention")}
    assert [(r.src, r.dst, r.relation) for r in edges.collect()] == [("bidirectional encoder", "attention", "is based on")] * 2
    stats = G.graph_stats(nodes, edges).first()
    assert (stats.nodes, stats.edges) == (2, 2) and sum(r.degree for r in G.degrees(edges).collect()) == 4


def test_flattened_modes(spark):
    nodes = spark.createDataFrame([("p1", "paper"), ("p2", "paper_stub"), ("e1", "entity"), ("e2", "entity")], "node string, type string")
    edges = spark.createDataFrame([("p1", "p2", "cites"), ("p1", "gone", "cites"), ("p1", "e1", "mentions"), ("e1", "e2", "uses"), ("e1", "p1", "odd")], "src string, dst string, relation string")
    assert sorted(map(tuple, G.flattened(nodes, edges, "citation").collect())) == [("p1", "cites", "p2")]
    assert sorted(r.r for r in G.flattened(nodes, edges, "augmented").collect()) == ["cites", "mentions", "uses"]
    assert [r.node for r in G.eligible_papers(nodes, edges.where("relation = 'cites'")).collect()] == ["p1"]
    view = {r.node: r.colour for r in G.view_projection(nodes.withColumn("label", nodes.node), edges).collect()}
    assert view["p1"] == "mid" and view["e2"] == "low"


def test_vocabulary_numbers_names_in_order(spark):
    names = [f"n{i:04d}" for i in range(500)]
    got = {r.name: r.id for r in G.vocabulary(spark.createDataFrame([(n,) for n in names * 2], "name string").repartition(7), "name").collect()}
    assert got == {n: i for i, n in enumerate(sorted(names))}


def test_staged_tables_can_be_dropped(spark):
    from lattica.sources import tables

    df = staged(spark.range(5), "five")
    assert df.count() == 5 and tables.drop_staged(spark) > 0
    assert tables.drop_staged(spark) == 0
