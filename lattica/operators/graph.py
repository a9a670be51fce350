"""Knowledge graphs as node and edge tables: building, unifying, merging, masking, walking."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions import text as T
from lattica.operators.dictionary import match_names, resolve_names
from lattica.sources.tables import staged

PAPER = "paper:"
#: Papers of a list that an entity ships.
LISTED = 4096


def build_graph(triples: DataFrame, forms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (paper_id, node, label) and edges (paper_id, src, dst, relation, paper, section, sentence, ord) of each
    paper's triples. Ends must be valid; known names become their canonical form; the first label of a node wins;
    parallel edges stay."""
    # Names repeat far more often than they differ: rules run once for each name
    names = triples.select(F.explode(F.array("subject", "object")).alias("name")).distinct().where(T.is_valid_entity(F.col("name")))
    if forms is None:
        names = names.select("name", T.normal_entity(F.col("name")).alias("node"), T.display_label(F.col("name")).alias("label"))
    else:
        names = match_names(resolve_names(names, "name", forms, "node"), "name", forms).select("name", "node", T.display_label(F.coalesce("canonical", "name")).alias("label"))
    names = staged(names, "names")
    t = triples
    for end, out in (("subject", "src"), ("object", "dst")):
        t = t.join(names.select(F.col("name").alias(end), F.col("node").alias(out), F.col("label").alias(f"{out}_label")), end)
    t = t.withColumn("relation", F.replace(F.trim(F.lower("predicate")), F.lit("_"), F.lit(" "))).where("src <> '' and dst <> '' and relation <> ''")
    ends = t.select("paper_id", F.posexplode(F.array(F.struct(F.col("src").alias("node"), F.col("src_label").alias("label")), F.struct(F.col("dst").alias("node"), F.col("dst_label").alias("label")))).alias("k", "e"), "ord")
    nodes = ends.groupBy("paper_id", F.col("e.node").alias("node")).agg(F.min_by("e.label", F.struct("ord", "k")).alias("label"))
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in t.columns else F.lit("")
    return nodes, t.select("paper_id", "src", "dst", "relation", text("paper").alias("paper"), text("section").alias("section"), text("source_sentence").alias("sentence"), "ord")


def degrees(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """node, degree: in and out edges, a loop counting twice."""
    by = by or []
    return edges.select(*by, F.explode(F.array("src", "dst")).alias("node")).groupBy(*by, "node").agg(F.count("*").alias("degree"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, relations."""
    n = nodes.agg(F.count("*").alias("nodes"))
    return n.crossJoin(edges.agg(F.count("*").alias("edges"), F.countDistinct("relation").alias("relations")))  # one row each


def top_degree(edges: DataFrame, n: int) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "node").limit(n)


def edge_breakdown(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(F.count("*").alias("n"))


def trimmed(edges: DataFrame, nodes: int = 200, most_edges: int = 500) -> DataFrame:
    """Edges among the nodes of highest degree, for drawing."""
    top = top_degree(edges, nodes).select("node")
    keep = edges.join(top.withColumnRenamed("node", "src"), "src", "left_semi").join(top.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return keep.orderBy("src", "dst", "relation").limit(most_edges)


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both exist."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")


def paper_node(pid: Column) -> Column:
    return F.concat(F.lit(PAPER), pid)


def corpus_id(ids: DataFrame, col: str, id_map: DataFrame, out: str) -> DataFrame:
    """Adds out: the corpus id of an external id, or the external id itself."""
    m = id_map.select(F.col("external_id").alias("_x"), F.col("paper_id").alias("_p"))
    return ids.join(m, F.col(col) == F.col("_x"), "left").withColumn(out, F.coalesce("_p", col)).drop("_x", "_p")


def training_triples(triples: DataFrame, concepts: DataFrame, papers: DataFrame) -> DataFrame:
    """h, r, t, ord of the unified graph: entity triples, then mentions of each paper's entities, then mentions of
    concepts (paper_id, concept) of three characters or more. Citations stay out: they are what evaluation holds back.
    papers (paper_id) only adds nodes, see vocabulary()."""
    s, o = T.entity_key(F.col("subject")), T.entity_key(F.col("object"))
    own = triples.select(s.alias("h"), F.col("predicate").alias("r"), o.alias("t"))
    named = triples.select("paper_id", F.explode(F.array(s, o)).alias("t")).distinct().select(paper_node(F.col("paper_id")).alias("h"), F.lit("mentions").alias("r"), "t")
    c = concepts.withColumn("t", T.entity_key(F.col("concept"))).where(F.length("t") > 2).select(paper_node(F.col("paper_id")).alias("h"), F.lit("mentions").alias("r"), "t")
    return reduce(DataFrame.unionByName, [own, named, c.distinct()])


def vocabulary(names: DataFrame, name: str) -> DataFrame:
    """id (from 0, in order of name), name. Ids come from a range partitioning and each partition's offset, so that
    no task has to number all names."""
    v = names.select(name).distinct()
    ordered = v.repartitionByRange(name).sortWithinPartitions(name).withColumn("_p", F.spark_partition_id())
    ordered = staged(ordered, "vocabulary")
    counts = {r["_p"]: r["n"] for r in ordered.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # one row for each partition
    offset, offsets = 0, []
    for p in range(max(counts, default=-1) + 1):
        offsets.append(offset)
        offset += counts.get(p, 0)
    table = F.split(F.lit(",".join(map(str, offsets or [0]))), ",").cast("array<bigint>")
    place = F.row_number().over(Window.partitionBy("_p").orderBy(name))
    return ordered.select((F.get(table, F.col("_p")) + place - 1).alias("id"), name)


def indexed(triples: DataFrame, extra_nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct (h, r, t) ids, and the vocabularies of nodes and relations (every extra node has an id, too)."""
    nodes = triples.select(F.explode(F.array("h", "t")).alias("name")).union(extra_nodes.select("name"))
    ents = vocabulary(nodes, "name")
    rels = vocabulary(triples.select(F.col("r").alias("name")), "name")
    ids = lambda v, c: v.select(F.col("id").alias(f"{c}_id"), F.col("name").alias(c))
    out = triples.select("h", "r", "t").distinct().join(ids(ents, "h"), "h").join(ids(ents, "t"), "t").join(ids(rels, "r"), "r")
    return out.select(F.col("h_id").alias("h"), F.col("r_id").alias("r"), F.col("t_id").alias("t")), ents, rels


def fuse(nodes: DataFrame, edges: DataFrame, network: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph joined with citation networks (paper_id, title, nodes map, edges array): paper nodes, cites edges
    whose ends exist, and a mentions edge from each root paper to each of its entities."""
    root = network.select("paper_id", F.concat(F.lit("paper::"), "paper_id").alias("node"), F.col("title").alias("label"))
    other = network.select("paper_id", F.explode("nodes").alias("k", "v")).select("paper_id", F.concat(F.lit("paper::"), "k").alias("node"), F.coalesce("v.title", "k").alias("label"))
    papers = root.union(other).groupBy("node").agg(F.min("label").alias("label")).withColumn("kind", F.lit("paper"))
    entities = nodes.select("node", "label").groupBy("node").agg(F.min("label").alias("label")).withColumn("kind", F.lit("entity"))
    cites = network.select(F.explode("edges").alias("e")).select(F.concat(F.lit("paper::"), "e.source").alias("src"), F.concat(F.lit("paper::"), "e.target").alias("dst"), F.lit("cites").alias("relation"))
    bridge = nodes.join(root.select("paper_id", F.col("node").alias("src")), "paper_id").select("src", F.col("node").alias("dst"), F.lit("mentions").alias("relation"))
    return papers.unionByName(entities), edges.select("src", "dst", "relation").unionByName(with_endpoints(cites, papers)).unionByName(bridge)


def shared_entity_papers(mentions: DataFrame) -> DataFrame:
    """src, neighbours: how many other papers mention an entity that a paper mentions.

    An entity ships its papers as lists of at most LISTED to each of them, so no pair is ever a row; entities that very
    many papers mention still make that quadratic in them, which is what the count asks for.
    """
    m = mentions.select("src", "dst").distinct()
    block = F.floor((F.row_number().over(Window.partitionBy("dst").orderBy("src")) - 1) / LISTED)
    lists = m.withColumn("_b", block).groupBy("dst", "_b").agg(F.array_sort(F.collect_list("src")).alias("_l"))
    met = m.join(lists, "dst").groupBy("src").agg(F.array_distinct(F.flatten(F.collect_list("_l"))).alias("_all"))
    # The paper itself is in each of its lists
    return met.select("src", (F.size("_all") - 1).cast("long").alias("neighbours")).where("neighbours > 0")


def connectivity(papers: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """paper_id, present, cites_edges, shared_entity_neighbors, isolated."""
    p = papers.select("paper_id", paper_node(F.col("paper_id")).alias("node"))
    present = p.join(nodes.select("node", F.lit(True).alias("present")).distinct(), "node", "left")
    cites = degrees(edges.where("relation = 'cites'")).withColumnRenamed("degree", "cites_edges")
    asked = edges.where("relation = 'mentions'").join(p.select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst").distinct()
    every = edges.where("relation = 'mentions'").where(F.startswith("src", F.lit(PAPER))).select(F.col("src").alias("src2"), "dst").distinct()
    shared = asked.join(every, "dst").where("src <> src2").groupBy(F.col("src").alias("node")).agg(F.countDistinct("src2").alias("shared_entity_neighbors"))
    out = present.join(cites, "node", "left").join(shared, "node", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = out.select("paper_id", F.coalesce("present", F.lit(False)).alias("present"), zero("cites_edges"), zero("shared_entity_neighbors"))
    return out.withColumn("isolated", F.col("present") & (F.col("cites_edges") == 0) & (F.col("shared_entity_neighbors") == 0))


def masked(cites: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training citations without those at a test node, and (query, candidate) truth for the test nodes."""
    t = test.select("node").distinct()
    train = cites.join(t.withColumnRenamed("node", "src"), "src", "left_anti").join(t.withColumnRenamed("node", "dst"), "dst", "left_anti")
    out = cites.join(t.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("src").alias("query"), F.col("dst").alias("candidate"))
    back = cites.join(t.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("dst").alias("query"), F.col("src").alias("candidate"))
    return train, out.union(back).distinct()


def eligible_papers(nodes: DataFrame, cites: DataFrame) -> DataFrame:
    """Corpus papers (no stubs) with a citation."""
    return nodes.where("type = 'paper'").join(degrees(cites).select("node"), "node", "left_semi").select("node")


def flattened(nodes: DataFrame, edges: DataFrame, mode: str) -> DataFrame:
    """h, r, t of the citation or the augmented version of a global graph."""
    papers, entities = nodes.where("type <> 'entity'"), nodes.where("type = 'entity'")
    cites = with_endpoints(edges.where("relation = 'cites'"), papers)
    if mode == "citation":
        parts = [cites]
    elif mode == "augmented":
        own = with_endpoints(edges.where("relation not in ('cites', 'mentions') and relation <> ''"), entities)
        parts = [cites, edges.where("relation = 'mentions'"), own]
    else:
        raise ValueError(f"no such mode: {mode}")
    return reduce(DataFrame.union, [p.select(F.col("src").alias("h"), F.col("relation").alias("r"), F.col("dst").alias("t")) for p in parts])


def breadth_first(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """node, hop of all nodes within depth of the seeds, edges taken both ways. One join for each hop; the nodes seen
    are written out between hops, so plans stay short."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    seen = staged(seeds.select("node").distinct().withColumn("hop", F.lit(0)), "seen")
    for hop in range(1, depth + 1):
        front = seen.where(F.col("hop") == hop - 1).select(F.col("node").alias("src"))
        new = both.join(front, "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hop", F.lit(hop))
        seen = staged(seen.union(new), "seen")
    return seen


def snowball(fetch: Callable[[DataFrame], DataFrame], seeds: DataFrame, depth: int, most_new: int) -> DataFrame:
    """node, hop of a crawl: each hop fetches what the nodes of the one before cite (node) and goes on with the first
    `most_new` of those not seen yet. fetch may be a join with a citation table or a provider's read."""
    seen = staged(seeds.select("node").distinct().withColumn("hop", F.lit(0)), "seen")
    for hop in range(1, depth + 1):
        new = fetch(seen.where(F.col("hop") == hop - 1).select("node")).distinct().join(seen, "node", "left_anti").orderBy("node").limit(most_new)
        seen = staged(seen.union(new.withColumn("hop", F.lit(hop))), "seen")
    return seen


def view_projection(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label, degree, colour class and size class for drawing."""
    d = nodes.join(degrees(edges), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return d.withColumn("colour", F.when(F.col("degree") <= 2, "low").when(F.col("degree") <= 6, "mid").otherwise("high")).withColumn("size", F.least(F.lit(10) + 2 * F.col("degree"), F.lit(40)))


# The global graph


EMPTY = {
    "nodes": "node string, type string, title string, year int, label string",
    "edges": "src string, dst string, key string, relation string, paper string, section string, sentence string",
    "merged": "paper_id string, n_triples long",
    "ids": "external_id string, paper_id string",
}


def empty_state(spark) -> dict[str, DataFrame]:
    return {k: spark.createDataFrame([], s) for k, s in EMPTY.items()}


def merge_papers(state: dict[str, DataFrame], triples: DataFrame, networks: DataFrame, papers: DataFrame, forms: DataFrame | None = None) -> dict[str, DataFrame]:
    """The next state after a batch of papers (paper_id): their triples and citation networks (paper_id, external_id,
    title, year, nodes map, edges array).

    A paper already merged with as many triples is left out. A stub of a batch paper takes its corpus id, unless that
    node exists. Nodes, mentions, typed edges (once for each relation, paper and section) and citations (once for each
    pair) are added where they are missing; nothing is ever removed.
    """
    n = papers.select("paper_id").distinct().join(triples.groupBy("paper_id").agg(F.count("*").alias("n_triples")), "paper_id", "left").withColumn("n_triples", F.coalesce("n_triples", F.lit(0)).cast("long"))
    batch = staged(n.join(state["merged"], ["paper_id", "n_triples"], "left_anti"), "batch")
    if batch.isEmpty():
        return state
    nets = staged(networks.join(batch.select("paper_id"), "paper_id", "left_semi"), "networks")
    t = triples.join(batch.select("paper_id"), "paper_id", "left_semi")

    # 1. Names: stubs of batch papers become the papers
    fresh_ids = nets.where("external_id is not null and external_id <> ''").select("external_id", "paper_id").distinct()
    ids = state["ids"].join(fresh_ids, "external_id", "left_anti").union(fresh_ids)
    known = state["nodes"].select("node")
    moves = fresh_ids.select(paper_node(F.col("external_id")).alias("old"), paper_node(F.col("paper_id")).alias("new")).where("old <> new")
    moves = staged(moves.join(known.withColumnRenamed("node", "old"), "old", "left_semi").join(known.withColumnRenamed("node", "new"), "new", "left_anti"), "moves")

    def moved(df: DataFrame, col: str) -> DataFrame:
        m = moves.select(F.col("old").alias(col), F.col("new").alias("_new"))
        return df.join(m, col, "left").withColumn(col, F.coalesce("_new", col)).drop("_new")

    old_nodes = moved(state["nodes"], "node")
    old_edges = moved(moved(state["edges"], "src"), "dst")

    # 2. Papers, entities, mentions and typed edges
    title = nets.groupBy("paper_id").agg(F.max(F.nullif("title", F.lit(""))).alias("title"), F.max("year").alias("year"))
    paper_nodes = batch.join(title, "paper_id", "left").select(paper_node(F.col("paper_id")).alias("node"), F.lit("paper").alias("type"), "title", "year", F.lit(None).cast("string").alias("label"), F.lit(0).alias("_pri"))
    gn, ge = (staged(x, "built") for x in build_graph(t, forms))
    entity_nodes = gn.groupBy("node").agg(F.max_by("label", "paper_id").alias("label")).select("node", F.lit("entity").alias("type"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("year"), "label", F.lit(0).alias("_pri"))
    none = F.lit(None).cast("string")
    mentions = gn.select(paper_node(F.col("paper_id")).alias("src"), F.col("node").alias("dst"), F.lit("mentions").alias("key"), F.lit("mentions").alias("relation"), none.alias("paper"), none.alias("section"), none.alias("sentence"), F.lit(0).alias("ord"))
    typed = ge.select("src", "dst", F.concat_ws("|", "relation", "paper", "section").alias("key"), "relation", "paper", "section", "sentence", "ord")

    # 3. Citations; ids that are no corpus paper's become stubs
    e = nets.select(F.explode("edges").alias("e")).select(F.col("e.source").alias("a"), F.col("e.target").alias("b")).where("a <> '' and b <> ''")
    e = staged(corpus_id(corpus_id(e, "a", ids, "a2"), "b", ids, "b2"), "citations")
    cites = e.select(paper_node(F.col("a2")).alias("src"), paper_node(F.col("b2")).alias("dst"), F.lit("cites").alias("key"), F.lit("cites").alias("relation"), none.alias("paper"), none.alias("section"), none.alias("sentence"), F.lit(0).alias("ord"))
    info = nets.select(F.explode("nodes").alias("x", "v")).groupBy("x").agg(F.max("v.title").alias("title"), F.max("v.year").alias("year"))
    ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("a2").alias("y")), F.struct(F.col("b").alias("x"), F.col("b2").alias("y")))).alias("z")).select("z.*").distinct()
    stubs = ends.join(info, "x", "left").groupBy(paper_node(F.col("y")).alias("node")).agg(F.max(F.col("x") != F.col("y")).alias("corpus"), F.max("title").alias("title"), F.max("year").alias("year"))
    stub_nodes = stubs.select("node", F.when(F.col("corpus"), "paper").otherwise("paper_stub").alias("type"), "title", "year", none.alias("label"), F.lit(2).alias("_pri"))

    rows = paper_nodes.unionByName(entity_nodes).unionByName(old_nodes.withColumn("_pri", F.lit(1))).unionByName(stub_nodes)
    pick = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_pri")).otherwise(9)).alias(c)
    nodes = rows.groupBy("node").agg(F.min_by("type", "_pri").alias("type"), pick("title"), pick("year"), pick("label"))
    new_edges = mentions.unionByName(typed).unionByName(cites).groupBy("src", "dst", "key").agg(F.min_by(F.struct("relation", "paper", "section", "sentence"), "ord").alias("m")).select("src", "dst", "key", "m.*")
    edges = old_edges.unionByName(new_edges.join(old_edges, ["src", "dst", "key"], "left_anti"))
    merged = state["merged"].join(batch, "paper_id", "left_anti").unionByName(batch)
    return {"nodes": nodes, "edges": edges, "merged": merged, "ids": ids}
