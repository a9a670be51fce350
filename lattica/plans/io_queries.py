"""Registered queries of readers, sinks, providers, streams and model training.

Driver tables are written in each format to the shared folder and read back through the library's readers, so that
the SQL over the same tables says what must come out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.operators import documents as H
from lattica.operators import graph as G
from lattica.operators import kge
from lattica.operators import ranking as R
from lattica.plans import derived
from lattica.plans.derived import Tables, with_sql
from lattica.plans.queries import EDGES, SQL, _batches, _edges, query
from lattica.plans.rule_queries import case_sql
from lattica.sources import providers as P
from lattica.sources import readers as RD
from lattica.sources import tables as TB
from lattica.sources import writers as WR
from lattica.streaming import events as E
from lattica.streaming import merge as M

# Entity files


def _entity_file(t: Tables, kind: int) -> DataFrame:
    k = F.col("p_partkey")
    path = TB.scratch(t.spark, "entities")
    name = F.when(k % 9 == 0, F.lit("  ")).when(k % 4 == 1, F.concat("p_name", F.lit("\n"), k)).otherwise(F.concat("p_name", F.lit(' "q" '), k))
    rows = t.part.where(k % 2 == kind % 2) if kind < 2 else t.part
    rows.select(
        name.alias("Entity"), F.when(k % 3 == 0, F.concat(F.lit(" A"), k)).otherwise("").alias("Abbreviation"), F.when(k % 5 == 0, F.concat_ws(" , ", "p_brand", F.lit(""), "p_type")).otherwise("").alias("Aliases"),
        F.when(k % 7 == 0, "x").otherwise((k % 6 != 5).cast("int").cast("string")).alias("TP"), F.lit("n").alias("NER_Type"), F.col("p_type").alias("CEO_Type"), F.lit("extra").alias("Note"),
    ).write.option("header", True).option("escape", '"').csv(path)
    return RD.entity_csv(t.spark, path)


_ENTITY_FILE = """f AS (SELECT p_partkey, trim(CASE WHEN p_partkey % 9 = 0 THEN '  ' WHEN p_partkey % 4 = 1 THEN p_name || chr(10) || p_partkey ELSE p_name || ' "q" ' || p_partkey END) AS entity, CASE WHEN p_partkey % 3 = 0 THEN 'A' || p_partkey ELSE '' END AS abbreviation,
CASE WHEN p_partkey % 5 = 0 THEN p_brand || '|' || p_type ELSE '' END AS aliases, p_type AS ceo_type FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 6 <> 5 AND p_partkey % 9 <> 0)"""


@query(f"WITH {_ENTITY_FILE} SELECT entity, abbreviation, aliases, ceo_type FROM f")
def entity_file_read(t: Tables) -> DataFrame:
    return _entity_file(t, 2).select("entity", "abbreviation", F.array_join("aliases", "|").alias("aliases"), "ceo_type")


@query("SELECT p_name AS entity, max('A' || lpad(p_partkey::VARCHAR, 12, '0')) AS abbreviation, count(*) > 0 AS found FROM part GROUP BY p_name")
def entity_files_merged(t: Tables) -> DataFrame:
    """Files of parts in order of their keys: the last abbreviation of a name stands."""
    names = t.part.select("p_name", F.concat(F.lit("A"), F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("abbr"), "p_partkey")
    cut = t.part.agg((F.max("p_partkey") / 2).alias("m")).first()["m"]
    files = [names.where(F.col("p_partkey") <= cut), names.where(F.col("p_partkey") > cut)]
    rows = [f.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("entity"), F.col("abbr").alias("abbreviation"), F.array().cast("array<string>").alias("aliases"), F.lit("").alias("ner_type"), F.lit("").alias("ceo_type")) for f in files]
    return RD.merged_entities(*rows).select("entity", "abbreviation", (F.col("ord") >= 0).alias("found"))


# Annotated token files: five patterns of tags by key, a record for each part

_FIRST, _SECOND = "split_part(p_name, ' ', 1) || '_' || p_partkey", "split_part(p_name, ' ', 2)"


def _token_file(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    a, b, c = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("_"), k), F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_brand")
    line = lambda token, tag: F.concat(token, F.lit("\t" + tag))
    body = (
        F.when(k % 5 == 0, F.concat_ws("\n", line(a, "S-METHOD"), line(b, "O")))
        .when(k % 5 == 1, F.concat_ws("\n", line(a, "B-METHOD"), line(b, "I-METHOD"), line(c, "E-METHOD")))
        .when(k % 5 == 2, F.concat_ws("\n", line(a, "B-METHOD"), line(b, "O"), line(c, "E-METHOD")))
        .when(k % 5 == 3, F.concat_ws("\n", line(a, "B-METHOD"), line(b, "I-TASK")))
        .otherwise(F.concat_ws("\n", line(a, "B-METHOD"), line(b, "I-METHOD")))
    )
    path = TB.scratch(t.spark, "tokens")
    t.part.select(F.concat(F.lit("# a comment\nPaper O\n"), body, F.lit("\n")).alias("value")).write.text(path)
    return RD.bioes_lines(t.spark, path)


_ENTITY_OF = case_sql("p_partkey", [_FIRST, f"{_FIRST} || ' ' || {_SECOND} || ' ' || p_brand", _FIRST, "{lax}", f"{_FIRST} || ' ' || {_SECOND}"])


@query(
    f"SELECT mode, text, 'method' AS type, 1::BIGINT AS start FROM (SELECT 'strict' AS mode, {_ENTITY_OF.replace('{lax}', _FIRST)} AS text FROM part UNION ALL SELECT 'lax', {_ENTITY_OF.replace('{lax}', _FIRST + chr(32) + '|| chr(32) || ' + _SECOND)} FROM part)"
)
def annotated_entities(t: Tables) -> DataFrame:
    lines = TB.staged(_token_file(t), "lines")
    both = [H.decode_bioes(lines, strict).withColumn("mode", F.lit(mode)) for strict, mode in ((True, "strict"), (False, "lax"))]
    return both[0].union(both[1]).select("mode", "text", "type", "start")


_TITLE = f"'Paper ' || {_FIRST} || ' ' || {_SECOND} || CASE WHEN p_partkey % 5 IN (1, 2) THEN ' ' || p_brand ELSE '' END"


@query(f"SELECT {_TITLE} AS title, {_ENTITY_OF.replace('{lax}', _FIRST)} AS entity FROM part")
def annotated_titles(t: Tables) -> DataFrame:
    p = H.annotated_papers(TB.staged(_token_file(t), "lines"))
    return p.select("title", F.explode("entities").alias("e")).select("title", F.col("e.text").alias("entity"))


@query(f"SELECT regexp_replace(substr({_TITLE}, 1, 50), '[^\\p{{L}}\\p{{N}}_\\-]', '_', 'g') AS paper, {_ENTITY_OF.replace('{lax}', _FIRST)} AS entity, 'Method' AS ceo_type FROM part")
def entity_files_written(t: Tables) -> DataFrame:
    p = H.annotated_papers(TB.staged(_token_file(t), "lines")).withColumn("paper_id", F.lit(None).cast("string"))
    rows = H.entity_csv_rows(p)
    path = TB.scratch(t.spark, "entity-folders")
    WR.write_entity_csv(rows, path)
    back = t.spark.read.option("header", True).csv(path)
    return back.select("paper", F.col("Entity").alias("entity"), F.col("CEO_Type").alias("ceo_type"))


# JSON and XML files


@query("SELECT 'n' || n_nationkey AS paper_id, trim(n_name) AS subject, 'in' AS predicate, r_name AS object, 'llm' AS mode FROM nation JOIN region ON n_regionkey = r_regionkey")
def triple_files_read(t: Tables) -> DataFrame:
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    one = F.struct(F.concat(F.lit(" "), "n_name", F.lit(" ")).alias("subject"), F.lit("in").alias("predicate"), F.col("r_name").alias("object"), F.lit("llm").alias("extraction_mode"))
    empty = F.struct(F.lit("").alias("subject"), F.lit("in").alias("predicate"), F.col("r_name").alias("object"), F.lit("llm").alias("extraction_mode"))
    path = TB.scratch(t.spark, "triples")
    n.select(F.concat(F.lit("n"), "n_nationkey").alias("paper"), F.to_json(F.array(one, empty)).alias("value")).repartition("paper").write.option("maxRecordsPerFile", 1).partitionBy("paper").text(path)
    x = RD.triples_json(t.spark, path, r".*/paper=([^/]+)/.*")
    return x.select("paper_id", "subject", "predicate", "object", F.col("extraction_mode").alias("mode"))


def _network_files(t: Tables) -> DataFrame:
    """A network for each supplier: it cites the next two; one in four has its id for a title."""
    k = F.col("s_suppkey")
    ext = lambda x: F.concat(F.lit("x"), x.cast("string"))
    value = lambda title, concepts: F.struct(title.alias("title"), F.lit(2001).alias("year"), F.lit(None).cast("string").alias("abstract"), F.lit(3).alias("citation_count"), F.lit("references").alias("relation"), concepts.alias("concepts"))
    none, some = F.array().cast("array<string>"), F.array(F.lit("stated"))
    nodes = F.map_from_arrays(F.array(ext(k + 1), ext(k + 2)), F.array(value(F.concat(F.lit("Parsing Supplies "), k), none), value(F.lit("x"), some)))
    edge = lambda a, b: F.struct(a.alias("source"), b.alias("target"), F.lit("cites").alias("type"))
    edges = F.array(edge(ext(k), ext(k + 1)), edge(ext(k), ext(k + 2)), edge(F.lit(""), ext(k)))
    rows = t.supplier.select(F.concat(F.lit("P"), k).alias("paper_id"), ext(k).alias("external_id"), F.when(k % 4 == 0, F.concat(F.lit("P"), k)).otherwise(F.concat(F.lit("On "), "s_name", F.lit(" at length"))).alias("title"), F.lit(2000).alias("year"), F.array(F.lit("rooted"), F.lit("stated")).alias("root_concepts"), nodes.alias("nodes"), edges.alias("edges"))
    path = TB.scratch(t.spark, "networks")
    WR.write_networks(rows, path)
    return TB.staged(RD.citation_networks(t.spark, path), "read-networks")


@query("SELECT 'P' || s_suppkey AS paper_id, 'x' || s_suppkey AS external_id, CASE WHEN s_suppkey % 4 = 0 THEN 'P' || s_suppkey ELSE 'On ' || s_name || ' at length' END AS title, 2000::INT AS year, 2::BIGINT AS nodes, s_suppkey % 4 <> 0 AS valid FROM supplier")
def network_files_read(t: Tables) -> DataFrame:
    return _network_files(t).select("paper_id", "external_id", "title", "year", F.size("nodes").cast("long").alias("nodes"), "valid")


@query("SELECT 'x' || s_suppkey AS source, 'x' || s_suppkey + d AS target, 'P' || s_suppkey AS paper_id FROM supplier, (SELECT unnest([1, 2]) AS d) WHERE s_suppkey % 4 <> 0")
def network_edges(t: Tables) -> DataFrame:
    return RD.citation_edges(_network_files(t))


@query(
    """WITH ids AS (SELECT 'x' || s_suppkey AS x, 'P' || s_suppkey AS p FROM supplier), n AS (SELECT 'x' || s_suppkey + 1 AS x, unnest(['parsing', 'supplies']) AS concept FROM supplier UNION ALL SELECT 'x' || s_suppkey + 2, 'stated' FROM supplier)
    SELECT coalesce(p, n.x) AS paper_id, concept FROM n LEFT JOIN ids ON n.x = ids.x UNION SELECT 'P' || s_suppkey, unnest(['rooted', 'stated']) FROM supplier"""
)
def network_concepts(t: Tables) -> DataFrame:
    n = _network_files(t)
    return RD.node_concepts(n, n.select("external_id", "paper_id"))


@query(
    """WITH c AS (SELECT s_suppkey AS k, s_suppkey + d AS o, false AS citing FROM supplier, (SELECT unnest([1, 2, 3]) AS d) UNION ALL SELECT s_suppkey + d, s_suppkey, true FROM supplier, (SELECT unnest([1, 2, 3]) AS d)),
    r AS (SELECT c.*, row_number() OVER (PARTITION BY k, citing ORDER BY 'x' || o) AS r FROM c JOIN supplier ON s_suppkey = k), e AS (SELECT k, count(*) AS edges, count(DISTINCT o) AS nodes FROM r WHERE r <= 2 GROUP BY k)
    SELECT 'P' || s_suppkey AS paper_id, coalesce(edges, 0) AS edges, coalesce(nodes, 0) AS nodes, 1::BIGINT AS concepts FROM supplier LEFT JOIN e ON k = s_suppkey"""
)
def provider_networks(t: Tables) -> DataFrame:
    """Networks built through the offline citation service."""
    ext = lambda x: F.concat(F.lit("x"), x.cast("string"))
    k = F.col("s_suppkey")
    edges = t.supplier.select(ext(k).alias("source"), F.explode(F.array(*(ext(k + d) for d in (1, 2, 3)))).alias("target"))
    papers = t.supplier.select(F.concat(F.lit("P"), k).alias("paper_id"), ext(k).alias("external_id"), F.lit("the supplier").alias("title"), F.lit(2000).alias("year"))
    n = P.networks_from(P.TableCitations(edges, papers.select("external_id", "title", "year")), papers, 2)
    return n.select("paper_id", F.size("edges").cast("long").alias("edges"), F.coalesce(F.size("nodes"), F.lit(0)).cast("long").alias("nodes"), F.size("root_concepts").cast("long").alias("concepts"))


@query("SELECT 'paper' AS section, doc_id::VARCHAR AS id, (length(text) + (NOT contains(text, ' '))::INT)::BIGINT AS n FROM documents")
def full_texts(t: Tables) -> DataFrame:
    """Documents as sections of blocks, read back as one text."""
    block = lambda x: F.struct(x.alias("text"))
    words = F.split("text", " ")
    sections = F.array(F.struct(F.get(words, 0).alias("heading"), F.transform(F.slice(words, 2, F.lit(1 << 30)), block).alias("content")))
    x = RD.full_text(t.documents.select("doc_id", sections.alias("sections")), "doc_id")
    return x.select(F.lit("paper").alias("section"), F.col("doc_id").cast("string").alias("id"), (F.length("text")).cast("long").alias("n"))


@query("SELECT s_suppkey::VARCHAR AS id, n_name AS domain, s_name AS title, s_acctbal > 0 AS processed FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def registry_file(t: Tables) -> DataFrame:
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("string").alias("id"), F.col("n_name").alias("domain"), F.col("s_name").alias("title"), (F.col("s_acctbal") > 0).alias("processed"))
    path = TB.scratch(t.spark, "registry")
    rows.agg(F.to_json(F.struct(F.collect_list(F.struct("*")).alias("papers"))).alias("value")).write.text(path)
    return RD.paper_registry(t.spark, path)


@query("SELECT 'N' || n_nationkey AS paper_id, trim(n_name) AS title FROM nation WHERE n_nationkey % 5 <> 0")
def title_index_file(t: Tables) -> DataFrame:
    value = F.struct(F.when(F.col("n_nationkey") % 5 == 0, " ").otherwise(F.concat(F.lit(" "), "n_name")).alias("title"))
    path = TB.scratch(t.spark, "titles")
    m = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("N"), "n_nationkey"), value)))
    t.nation.agg(F.to_json(m).alias("value")).write.option("compression", "gzip").text(path)
    return RD.title_index_json(t.spark, path).select("paper_id", "title")


@query("SELECT '2020.acl-' || n_regionkey + 1 || '.' || n_nationkey AS paper_id, n_name AS title FROM nation")
def title_index_volumes(t: Tables) -> DataFrame:
    rows = t.nation.orderBy("n_regionkey", "n_nationkey").collect()  # 25 rows
    volumes = {k: "".join(f'<paper id="{r.n_nationkey}"><title> {r.n_name} </title></paper>' for r in rows if r.n_regionkey == k) for k in {r.n_regionkey for r in rows}}
    path = TB.scratch(t.spark, "volumes") + "/2020.acl.xml"
    TB.write_text(t.spark, path, "<collection>" + "".join(f'<volume id="{k + 1}">{v}<paper id="front"><title>no</title></paper></volume>' for k, v in sorted(volumes.items())) + "</collection>")
    return RD.title_index_xml(t.spark, path).select("paper_id", "title")


@query("SELECT 'in' || n_nationkey AS name, 'Nation' || n_nationkey AS domain, 'Region' || n_regionkey || '|World' AS range, 'It lies in ' || r_name AS hint FROM nation JOIN region ON n_regionkey = r_regionkey")
def ontology_file(t: Tables) -> DataFrame:
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).collect()  # 25 rows
    head = "@prefix : <http://x#> .\n@prefix owl: <http://o#> .\n@prefix rdfs: <http://r#> .\n# a comment\n:World a owl:Class .\n"
    body = "".join(
        f':in{r.n_nationkey} a owl:ObjectProperty ;\n  rdfs:domain :Nation{r.n_nationkey} ;\n  rdfs:range [ a owl:Class ; owl:unionOf ( :Region{r.n_regionkey} :World ) ] ;\n  rdfs:comment "It lies in {r.r_name}. More; of it." .\n' for r in rows
    )
    path = TB.scratch(t.spark, "ontology") + "/o.ttl"
    TB.write_text(t.spark, path, head + body)
    o = RD.ontology_relations(t.spark, path)
    return o.select("name", F.array_join("domain", "|").alias("domain"), F.array_join("range", "|").alias("range"), "hint")


# Sinks


@query("SELECT 'node' AS kind, 'n' || n_nationkey AS id, n_name || ' & \"<x>\"' AS value FROM nation UNION ALL SELECT 'edge', 'n' || n_nationkey || '>r' || n_regionkey, 'in' FROM nation")
def graphml_round_trip(t: Tables) -> DataFrame:
    node = F.concat(F.lit("n"), "n_nationkey")
    nodes = t.nation.select(node.alias("node"), F.concat("n_name", F.lit(' & "<x>"')).alias("label"))
    edges = t.nation.select(node.alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), F.lit("in").alias("relation"))
    path = TB.scratch(t.spark, "graphml")
    WR.write_graphml(nodes, edges, path)
    n, e = WR.read_graphml(t.spark, path)
    of = lambda k: F.try_element_at("attributes", F.lit(k))
    return n.select(F.lit("node").alias("kind"), F.col("node").alias("id"), of("label").alias("value")).union(e.select(F.lit("edge"), F.concat("src", F.lit(">"), "dst"), of("relation")))


@query(EDGES + " SELECT relation, count(*) AS n, (SELECT count(*) FROM edges) AS total FROM edges GROUP BY relation")
def report_round_trip(t: Tables) -> DataFrame:
    e = TB.staged(_edges(t), "edges")
    path = TB.scratch(t.spark, "report")
    WR.write_report({"stats": e.agg(F.count("*").alias("total")), "relations": G.edge_breakdown(e)}, path)
    one = WR.read_report(t.spark, path, "stats", "total long")
    return WR.read_report(t.spark, path, "relations", "relation string, n long").crossJoin(one)  # one row


@query(
    """SELECT p_partkey AS doc_id, '<!DOCTYPE html><html><head><title>On ' || p_name || '</title></head><body><article id="main"><h1>On ' || p_name || '</h1>' || chr(10) || '<section id="S1"><h2>1 Start &amp; go</h2>' || chr(10) || '<p id="S1.p1">We like <mark class="concept">' || p_name || '</mark> &lt;much&gt;</p>' || chr(10)
    || '<figure id="S1.F1"><figcaption>Figure 1</figcaption></figure></section>' || chr(10) || '<section id="S2"><h2>2 End</h2>' || chr(10) || '<p id="S2.p1">first</p>' || chr(10) || '<p id="S2.p2">second</p></section></article></body></html>' AS html FROM part WHERE contains(p_name, 'blue') UNION ALL
    SELECT p_partkey, '<!DOCTYPE html><html><head><title>On ' || p_name || '</title></head><body><article id="main"><h1>On ' || p_name || '</h1>' || chr(10) || '<section id="S1"><h2>1 Start &amp; go</h2>' || chr(10) || '<p id="S1.p1">We like ' || p_name || ' &lt;much&gt;</p>' || chr(10)
    || '<figure id="S1.F1"><figcaption>Figure 1</figcaption></figure></section>' || chr(10) || '<section id="S2"><h2>2 End</h2>' || chr(10) || '<p id="S2.p1">first</p>' || chr(10) || '<p id="S2.p2">second</p></section></article></body></html>' FROM part WHERE NOT contains(p_name, 'blue')"""
)
def html_documents(t: Tables) -> DataFrame:
    block = lambda s, sec, head, o, kind, *text: F.struct(F.lit(s).alias("section_ord"), F.lit(sec).alias("sec_id"), F.lit(head).alias("heading"), F.lit(o).alias("ord"), F.lit(kind).alias("type"), F.concat(*text).alias("text"))
    rows = F.array(block(1, "S1", "1 Start & go", 1, "paragraph", F.lit("We like "), "p_name", F.lit(" <much>")), block(1, "S1", "1 Start & go", 2, "figure", F.lit("Figure 1")), block(2, "S2", "2 End", 3, "paragraph", F.lit("first")), block(2, "S2", "2 End", 4, "paragraph", F.lit("second")))
    content = t.part.select(F.col("p_partkey").alias("doc_id"), F.explode(rows).alias("x")).select("doc_id", "x.*")
    names = [r["p_name"] for r in t.part.where(F.contains("p_name", F.lit("blue"))).select("p_name").distinct().orderBy("p_name").collect()]  # two-word names, a few dozen
    return WR.html_documents(content, t.part.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("On "), "p_name").alias("title")), names)


@query(SQL["graph_trim"].replace("SELECT src, dst, relation FROM edges WHERE", "SELECT src, relation, dst FROM edges WHERE"))
def graph_page(t: Tables) -> DataFrame:
    """The drawn edges, read off the page again."""
    page = WR.graph_page(_edges(t).select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("label", F.col("node")), _edges(t))
    path = TB.scratch(t.spark, "page") + "/page.html"
    TB.write_text(t.spark, path, page)
    line = r"^<li>(.*) <b>(.*)</b> (.*)</li>$"
    rows = t.spark.read.text(path).where(F.col("value").rlike(line))
    return rows.select(*(F.regexp_extract("value", line, k).alias(c) for k, c in ((1, "src"), (2, "relation"), (3, "dst"))))


@query("SELECT 'first' AS turn, sum(s_acctbal > 0)::BIGINT AS n FROM supplier UNION ALL SELECT 'second', sum(s_acctbal > 0)::BIGINT FROM supplier")
def cached_tables(t: Tables) -> DataFrame:
    """The second call finds what the first built, though its own builder would give nothing."""
    path = TB.scratch(t.spark, "cache")
    build = lambda rows: lambda: rows.select("s_suppkey")
    first = TB.get_or_build(t.spark, path, build(t.supplier.where("s_acctbal > 0")))
    second = TB.get_or_build(t.spark, path, build(t.supplier.limit(0)))
    return first.agg(F.lit("first").alias("turn"), F.count("*").alias("n")).union(second.agg(F.lit("second"), F.count("*")))


# Providers


@query(r"SELECT conv_id, turn, true AS right FROM conversations")
def refined_blocks(t: Tables) -> DataFrame:
    """Texts that need no repair stay, and so do those that got an answer with invented words; the other answers are
    the texts themselves, with their blanks collapsed."""
    b = t.conversations.select("conv_id", "turn", F.lit("paragraph").alias("type"), "text", F.lit(True).alias("needs_llm"), F.col("text").alias("was"))
    stays = ~T.needs_repair(F.col("was")) | (F.length("was") % 2 == 1)
    squeezed = F.regexp_replace("was", r"\s+", " ")
    right = F.when(stays, F.col("text") == F.col("was")).otherwise((F.col("text") == F.col("was")) | F.contains(squeezed, F.substring("text", 1, 30)))
    return P.refined(b, Inventing()).select("conv_id", "turn", right.alias("right"))


class Inventing:
    """Adds words to every other prompt."""

    name = "inventing"

    def generate(self, prompts: list[str]) -> list[str]:
        return [p + " wholly invented additional sentences follow" * 5 if len(p) % 2 else p for p in prompts]


@query("SELECT n_nationkey, lower(n_name) AS subject, 'lies in' AS predicate, lower(r_name) AS object FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0")
def pattern_extraction(t: Tables) -> DataFrame:
    from lattica.operators.triples import parsed_output

    names = sorted(r["n"] for r in t.nation.select(F.lower("n_name").alias("n")).collect())  # 25 rows
    verb = F.when(F.col("n_nationkey") % 2 == 0, "lies in").otherwise("borders on")
    x = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat(F.lit("We know "), F.lower("n_name"), F.lit(" "), verb, F.lit(" "), F.lower("r_name"), F.lit(". So.")).alias("prompt"))
    return parsed_output(P.generated(x, P.PatternExtractor(names, ["lies in"])).drop("prompt")).select("n_nationkey", "subject", "predicate", "object")


class TabLayout:
    """Reads lines 'page<TAB>y<TAB>text' as the blocks of a file."""

    def blocks(self, pdf: bytes) -> list[tuple[int, float, float, str]]:
        parts = [x.split("\t") for x in pdf.decode().splitlines()]
        return [(int(p), 0.0, float(y), text) for p, y, text in parts]


def _pdf_files(t: Tables) -> DataFrame:
    base = TB.scratch(t.spark, "pdfs")
    for r in t.nation.orderBy("n_nationkey").collect():  # 25 rows
        TB.write_text(t.spark, f"{base}/d{r.n_nationkey}.pdf", f"1\t9.5\t{r.n_name}\n4\t7\t{'x' * 60}\n" + (f"2\t1\t{'y' * 45}\n" if r.n_nationkey % 3 == 0 else ""))
    return P.pdf_blocks(t.spark, base, TabLayout())


@query("SELECT 'd' || n_nationkey AS doc_id, k AS ord, [1, 4, 2][k + 1]::BIGINT AS page, [9.5, 7.0, 1.0][k + 1]::DOUBLE AS y, CASE k WHEN 0 THEN n_name WHEN 1 THEN repeat('x', 60) ELSE repeat('y', 45) END AS text FROM nation, (SELECT unnest(range(3)) AS k) WHERE k < 2 OR n_nationkey % 3 = 0")
def pdf_blocks_read(t: Tables) -> DataFrame:
    return _pdf_files(t).select("doc_id", "ord", "page", "y", "text")


@query("SELECT 'd' || n_nationkey AS doc_id, length(n_name) + CASE WHEN n_nationkey % 3 = 0 THEN 45 ELSE 0 END < 50 AS scanned FROM nation")
def scanned_files(t: Tables) -> DataFrame:
    return P.is_scanned(_pdf_files(t))


# Streams: the tables arrive in files, a few at a time


def _stream(t: Tables, table: str, ts: str | None = None) -> DataFrame:
    source = getattr(t, table)
    path = TB.scratch(t.spark, "arriving")
    (source.repartitionByRange(4, ts) if ts else source.repartition(4)).write.parquet(path)
    return t.spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 2).parquet(path)


def _drained(t: Tables, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what has arrived to its end and gives what it wrote."""
    out, mark = TB.scratch(t.spark, "streamed"), TB.scratch(t.spark, "mark")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(out)


_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query(f"SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL HAVING time_bucket(INTERVAL 1 HOUR, min(ts)) + INTERVAL 1 HOUR <= {_CLOSED}")
def stream_windows(t: Tables) -> DataFrame:
    """Closed windows of a stream in order of time: those that the watermark has passed."""
    x = _drained(t, E.windowed(_stream(t, "events", "ts")).select("event_type", F.col("window.start").cast("timestamp_ntz").alias("hour"), "n", F.round("total", 4).alias("total")))
    return x


@query(
    f"""WITH g AS (SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE)::INT, 0) AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
    SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= {_CLOSED}"""
)
def stream_sessions(t: Tables) -> DataFrame:
    return _drained(t, E.sessions(_stream(t, "events", "ts")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("started"), "n"))


@query("SELECT DISTINCT event_id FROM events")
def stream_dedup(t: Tables) -> DataFrame:
    """Every event arrives twice in the same file."""
    path = TB.scratch(t.spark, "arriving")
    t.events.union(t.events).repartitionByRange(4, "ts").write.parquet(path)
    s = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 2).parquet(path)
    return _drained(t, E.deduplicated(s).select("event_id"))


def _merged(t: Tables) -> tuple[M.VersionedTables, DataFrame, str]:
    """The graph store after a stream of triple files, with the arrivals' folder."""
    tr, nets, _ = _batches(t)
    nets = TB.staged(nets.join(tr.select("paper_id").distinct(), "paper_id", "left_semi"), "networks")
    path = TB.scratch(t.spark, "arriving")
    rows = tr.select("paper_id", "subject", "predicate", "object", F.lit("").alias("section"), F.lit("").alias("source_sentence"), "ord")
    rows.repartition(3, "paper_id").write.json(path)
    store = M.VersionedTables(t.spark, TB.scratch(t.spark, "store"))
    M.stream_merge(t.spark, path, store, nets, TB.scratch(t.spark, "mark"), 2).awaitTermination()
    return store, tr, path


@query(
    with_sql("cites")
    + """, m AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p, l_suppkey AS s FROM lineitem), c AS (SELECT * FROM cites WHERE src IN (SELECT o FROM m)), stubs AS (SELECT DISTINCT dst FROM c WHERE dst NOT IN (SELECT o FROM m))
    SELECT 'paper' AS kind, count(DISTINCT o) AS n FROM m UNION ALL SELECT 'entity', count(DISTINCT p) + count(DISTINCT s) FROM m UNION ALL SELECT 'cites', count(*) FROM c UNION ALL SELECT 'supplied by', count(*) FROM (SELECT DISTINCT p, s, o FROM m)
    UNION ALL SELECT 'mentions', (SELECT count(*) FROM (SELECT DISTINCT o, p FROM m)) + (SELECT count(*) FROM (SELECT DISTINCT o, s FROM m)) UNION ALL SELECT 'paper_stub', n FROM (SELECT count(*) AS n FROM stubs) WHERE n > 0"""
)
def stream_graph_merge(t: Tables) -> DataFrame:
    """Micro-batches of triple files merged into the versioned graph; a second run over the same files adds nothing."""
    store, tr, _ = _merged(t)
    n, e = store.read("nodes"), store.read("edges")
    # In _batches all papers share one (paper, section) = ('', ''), so typed edges are one for each pair of names
    edges = e.where("relation <> 'supplied by'").groupBy("relation").agg(F.count("*").alias("n"))
    typed = tr.select("subject", "object", "paper_id").distinct().agg(F.lit("supplied by").alias("relation"), F.count("*").alias("n"))
    return n.groupBy(F.col("type").alias("kind")).agg(F.count("*").alias("n")).union(edges).union(typed)


@query("SELECT l_orderkey::VARCHAR AS paper_id, count(DISTINCT (l_partkey, l_suppkey)) + 1 AS n_triples FROM lineitem WHERE l_orderkey % 10 = 0 GROUP BY 1")
def stream_backfill(t: Tables) -> DataFrame:
    """Papers whose triples have grown since the merge are left to do; the others are not."""
    store, tr, _ = _merged(t)
    n = tr.groupBy("paper_id").agg(F.count("*").alias("n_triples"))
    asked = n.withColumn("n_triples", F.col("n_triples") + (F.col("paper_id").cast("long") % 10 == 0).cast("long"))
    return M.backfill(asked, store)


# Models


def _indexed(t: Tables) -> tuple[DataFrame, int]:
    return derived.cites(t).select(F.col("src").alias("h"), F.lit(0).cast("long").alias("r"), F.col("dst").alias("t")), t.orders.agg(F.max("o_orderkey")).first()[0] + 1


@query("SELECT model, seed, (SELECT max(o_orderkey) + 1 FROM orders) AS entities, width, true AS finite FROM (SELECT unnest(['transe', 'transe', 'complex', 'rotate']) AS model, unnest([1, 2, 1, 1])::BIGINT AS seed, unnest([8, 8, 16, 16])::BIGINT AS width)")
def kge_training(t: Tables) -> DataFrame:
    """Every model and seed on all citations: a vector for each entity, all of them finite."""
    triples, n = _indexed(t)
    runs = [(kge.Settings(model=m, dim=8, epochs=1, negatives=2, batch=4096), seed) for m, seed in (("transe", 1), ("transe", 2), ("complex", 1), ("rotate", 1))]
    v = kge.train_runs(triples, n, 1, runs)
    sound = F.forall("v", lambda x: ~F.isnan(x) & (F.abs(x) < 1e9))
    return v.groupBy("model", "seed").agg(F.count("*").alias("entities"), F.max(F.size("v")).cast("long").alias("width"), F.bool_and(sound).alias("finite"))


@query("SELECT vec_id AS id, round(embedding[1]::DOUBLE, 6) + 0.0 AS first, 'v' || vec_id AS name, 'rotate' AS model, 64::BIGINT AS dim FROM embeddings")
def kge_checkpoint(t: Tables) -> DataFrame:
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    path = TB.scratch(t.spark, "checkpoint")
    kge.save(v, v.select("id", F.concat(F.lit("v"), "id").alias("name")), kge.Settings(model="rotate", dim=64), path)
    vectors, names, s = kge.load(t.spark, path)
    return vectors.join(names, "id").select("id", (F.round(F.get("v", 0), 6) + 0.0).alias("first"), "name", F.lit(s.model).alias("model"), F.lit(s.dim).cast("long").alias("dim"))


@query(with_sql("cites") + " SELECT src AS h, dst AS t, 3::BIGINT AS n, true AS one_end, true AS in_range FROM cites")
def kge_corruptions(t: Tables) -> DataFrame:
    """Three corruptions of each citation: one end stays and the other is some entity."""
    triples, n = _indexed(t)

    def run(batches):
        rng = np.random.default_rng(3)
        for b in batches:
            x = np.stack([b.column(c).to_numpy() for c in ("h", "r", "t")], 1)
            neg = kge.corrupt(x, n, 3, rng)
            same = np.repeat(x, 3, axis=0)
            kept = (neg[:, 0] == same[:, 0]) | (neg[:, 2] == same[:, 2])
            inside = (neg[:, [0, 2]] >= 0).all(1) & (neg[:, [0, 2]] < n).all(1)
            yield pa.RecordBatch.from_arrays([pa.array(same[:, 0]), pa.array(same[:, 2]), pa.array(kept), pa.array(inside)], names=["h", "t", "kept", "inside"])

    x = triples.mapInArrow(run, "h long, t long, kept boolean, inside boolean")
    return x.groupBy("h", "t").agg(F.count("*").alias("n"), F.bool_and("kept").alias("one_end"), F.bool_and("inside").alias("in_range"))


@query("SELECT (SELECT count(*) FROM orders) AS n, round((SELECT count(*) FROM orders) * 0.25)::DOUBLE AS val, true AS disjoint")
def exact_split(t: Tables) -> DataFrame:
    """The seeded shuffle of all ids: sizes and disjointness; tests hold the members against the generator."""
    parts = R.exact_split_rows(t.orders.select("o_orderkey"), "o_orderkey", 0.25, 42)
    per = parts.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.count_if("first").alias("val"), F.countDistinct("first").alias("parts"))
    return per.agg(F.sum("n").alias("n"), F.sum("val").cast("double").alias("val"), (F.max("parts") == 1).alias("disjoint"))
