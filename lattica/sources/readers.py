"""Readers of the file formats that corpora come in. Each gives a DataFrame with a stated schema."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions import text as T

NODE = "struct<title:string,year:int,abstract:string,citation_count:int,relation:string,concepts:array<string>>"
NETWORK = f"paper_id string, title string, year int, abstract string, citation_count int, root_concepts array<string>, nodes map<string,{NODE}>, edges array<struct<source:string,target:string,type:string>>"
TRIPLES = "subject string, predicate string, object string, subject_type string, object_type string, source_sentence string, extraction_mode string, paper string, title string, section string"
TOKEN_PATH = r".*/(?:paper_id=)?([^/]+)/[^/]*$"


def entity_csv(spark: SparkSession, paths: str | list[str], true_only: bool = True) -> DataFrame:
    """paper-level entity files: ord, entity, abbreviation, aliases, ner_type, ceo_type. Blank names go; with
    true_only, so do rows not marked 1. Quoted cells may span lines; a byte-order mark is tolerated."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(paths)
    raw = raw.toDF(*[c.lstrip("\ufeff") for c in raw.columns])
    col = lambda c: F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")) if c in raw.columns else F.lit("")
    rows = raw.select(F.monotonically_increasing_id().alias("ord"), col("Entity").alias("entity"), col("Abbreviation").alias("abbreviation"), col("Aliases").alias("a"), col("TP").try_cast("int").alias("tp"), col("NER_Type").alias("ner_type"), col("CEO_Type").alias("ceo_type"))
    rows = rows.where("entity <> ''").where("tp = 1" if true_only else "true")
    aliases = F.filter(F.transform(F.split("a", ","), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select("ord", "entity", "abbreviation", aliases.alias("aliases"), "ner_type", "ceo_type")


def merged_entities(*files: DataFrame) -> DataFrame:
    """Entity files in order as one: each entity once, the last stated abbreviation and aliases winning."""
    rows = None
    for k, f in enumerate(files):
        part = f.withColumn("_k", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    place = F.struct("_k", "ord")
    last = lambda c, full: F.max_by(c, F.when(full, place))
    return rows.groupBy("entity").agg(
        F.min(place).alias("_p"), last("abbreviation", F.col("abbreviation") != "").alias("abbreviation"), last("aliases", F.size("aliases") > 0).alias("aliases"), F.min_by("ner_type", place).alias("ner_type"), F.min_by("ceo_type", place).alias("ceo_type")
    ).select((F.col("_p._k") * F.lit(1 << 40) + F.col("_p.ord")).alias("ord"), "entity", F.coalesce("abbreviation", F.lit("")).alias("abbreviation"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "ner_type", "ceo_type")


def bioes_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, rec_no, tok_no, token, tag of annotated token files; a blank line ends a record, # starts a comment."""
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    records = whole.select("file", F.posexplode(F.split(F.regexp_replace("value", "\r", ""), r"\n[ \t]*\n")).alias("rec_no", "r"))
    lines = records.select("file", "rec_no", F.explode(F.array_compact(F.transform(F.split("r", "\n"), lambda s, i: F.when((F.trim(s) != "") & ~F.startswith(F.trim(s), F.lit("#")), F.struct(i.alias("i"), F.trim(s).alias("s")))))).alias("x"))
    parts = F.split("x.s", r"\t|\s+")
    tok = F.row_number().over(Window.partitionBy("file", "rec_no").orderBy("x.i")) - 1
    return lines.select("file", "rec_no", tok.cast("long").alias("tok_no"), F.get(parts, 0).alias("token"), F.coalesce(F.get(parts, 1), F.lit("O")).alias("tag"))


def triples_json(spark: SparkSession, paths: str | list[str], paper_pattern: str = r".*/([^/]+)/kg/.*") -> DataFrame:
    """paper_id (from the path), ord and the fields of triples files; triples with an empty part go."""
    raw = spark.read.schema(TRIPLES).option("multiLine", True).json(paths)
    rows = raw.select(F.regexp_extract(F.col("_metadata.file_path"), paper_pattern, 1).alias("paper_id"), F.monotonically_increasing_id().alias("ord"), *raw.columns)
    for c in ("subject", "predicate", "object"):
        rows = rows.withColumn(c, F.trim(F.coalesce(c, F.lit(""))))
    return rows.where("subject <> '' and predicate <> '' and object <> ''")


def citation_networks(spark: SparkSession, paths: str | list[str], paper_pattern: str = TOKEN_PATH) -> DataFrame:
    """paper_id (from the path), external_id, title, year, root_concepts, nodes, edges, valid (a title that isn't the id)."""
    raw = spark.read.schema(NETWORK).option("multiLine", True).option("recursiveFileLookup", True).json(paths)
    pid = F.regexp_extract(F.col("_metadata.file_path"), paper_pattern, 1)
    rows = raw.select(pid.alias("pid"), F.col("paper_id").alias("external_id"), "title", "year", "root_concepts", "nodes", "edges")
    return rows.withColumnRenamed("pid", "paper_id").withColumn("valid", T.is_valid_citation_title(F.col("title"), F.col("paper_id")))


def citation_edges(networks: DataFrame) -> DataFrame:
    """source, target, paper_id of valid networks; edges without an end go."""
    e = networks.where("valid").select("paper_id", F.explode("edges").alias("e")).select("e.source", "e.target", "paper_id")
    return e.where("source <> '' and target <> ''")


def node_concepts(networks: DataFrame, id_map: DataFrame) -> DataFrame:
    """paper_id, concept of every network node (its own, else those of its title) and root concepts of the root."""
    own = networks.select(F.explode("nodes").alias("x", "v"))
    mined = F.array_distinct(T.concept_words(F.coalesce("v.title", F.lit(""))))
    c = own.select("x", F.explode(F.when(F.coalesce(F.size("v.concepts"), F.lit(0)) > 0, F.col("v.concepts")).otherwise(F.slice(mined, 1, 15))).alias("concept"))
    m = id_map.select(F.col("external_id").alias("x"), F.col("paper_id").alias("p"))
    named = c.join(m, "x", "left").select(F.coalesce("p", "x").alias("paper_id"), "concept")
    return named.union(networks.select("paper_id", F.explode("root_concepts"))).distinct()


def full_text(documents: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """id, text of structured documents (sections array of heading and content blocks with text)."""
    body = F.transform("sections", lambda s: F.concat_ws(" ", s["heading"], F.array_join(F.transform(s["content"], lambda b: F.coalesce(b["text"], F.lit(""))), " ")))
    return documents.select(id_col, F.array_join(body, " ").alias("text"))


def paper_registry(spark: SparkSession, path: str) -> DataFrame:
    """id, domain, title, processed of a registry file."""
    raw = spark.read.schema("papers array<struct<id:string,domain:string,title:string,processed:boolean>>").option("multiLine", True).json(path)
    return raw.select(F.explode("papers").alias("p")).select("p.*")


def search_registry(registry: DataFrame, text: str | None = None, domain: str | None = None, processed: bool | None = None) -> DataFrame:
    out = registry
    if domain is not None:
        out = out.where(F.col("domain") == domain)
    if processed is not None:
        out = out.where(F.coalesce("processed", F.lit(False)) == processed)
    if text:
        hit = F.lit(False)
        for c in ("id", "title", "domain"):
            hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower()))
        out = out.where(hit)
    return out


def synced_registry(registry: DataFrame, outputs: DataFrame) -> DataFrame:
    """processed becomes true where an output (id) exists."""
    done = outputs.select("id", F.lit(True).alias("_d")).distinct()
    return registry.join(done, "id", "left").withColumn("processed", F.coalesce("_d", F.lit(False))).drop("_d")


def keep_ids(parsed: DataFrame, known: DataFrame) -> DataFrame:
    """Parsed papers (title) take the id that an earlier run gave their title."""
    k = known.where("paper_id is not null").groupBy(F.lower(F.trim("title")).alias("_t")).agg(F.max("paper_id").alias("_id"))
    return parsed.join(k, F.lower(F.trim("title")) == F.col("_t"), "left").withColumn("paper_id", F.coalesce("paper_id", "_id")).drop("_t", "_id")


def title_index_json(spark: SparkSession, path: str) -> DataFrame:
    """ord, paper_id, title of an index file {id: {title}} (gzip is read as such)."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,struct<title:string>>").alias("m"))
    return raw.select(F.posexplode(F.map_entries("m")).alias("ord", "e")).select("ord", F.col("e.key").alias("paper_id"), F.trim("e.value.title").alias("title")).where("title <> '' and paper_id <> ''")


def collection_id(collection, volume, number):
    """Column: paper id from a collection, volume and paper number, by the new form with a dot or the old one of four digits."""
    old = F.concat(collection, F.lit("-"), volume, F.lpad(number, F.greatest(F.lit(1), F.lit(4) - F.length(volume), F.length(number)), "0"))
    return F.when(F.contains(collection, F.lit(".")), F.concat(collection, F.lit("-"), volume, F.lit("."), number)).otherwise(old)


def title_index_xml(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """ord, paper_id, title of collection files (volume > paper > title)."""
    schema = "_id string, paper array<struct<_id:string,title:string>>"
    raw = spark.read.format("xml").option("rowTag", "volume").schema(schema).load(paths)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.xml$", 1)
    rows = raw.select(name.alias("c"), F.col("_id").alias("v"), F.explode("paper").alias("p"))
    rows = rows.where(F.col("p._id").rlike(r"^\d+$") & (F.trim("p.title") != ""))
    return rows.select(F.monotonically_increasing_id().alias("ord"), collection_id(F.col("c"), F.coalesce("v", F.lit("1")), F.col("p._id")).alias("paper_id"), F.trim("p.title").alias("title"))


def collection_file_names(spark: SparkSession, letters: Iterable[str], venues: Iterable[str], conferences: Iterable[str], tracks: Iterable[str], last_year: int = 25, years: tuple[int, int] = (2020, 2025)) -> DataFrame:
    """name of every collection file that may exist: letters by two-digit year; years by venue; years by conference and track."""
    each = lambda xs: F.explode(F.array(*(F.lit(x) for x in xs)))
    old = spark.range(last_year).select(each(letters).alias("a"), F.lpad(F.col("id").cast("string"), 2, "0").alias("y")).select(F.concat("a", "y", F.lit(".xml")).alias("name"))
    year = spark.range(years[0], years[1] + 1).select(F.col("id").cast("string").alias("y"))
    new = year.select("y", each(venues).alias("v")).select(F.concat_ws(".", "y", "v", F.lit("xml")).alias("name"))
    tracked = year.select("y", each(conferences).alias("v")).select("y", "v", each(tracks).alias("t")).select(F.concat("y", F.lit("."), "v", F.lit("-"), "t", F.lit(".xml")).alias("name"))
    return old.union(new).union(tracked).distinct()


def newest_output(files: DataFrame, by: list[str]) -> DataFrame:
    """by, path with the latest modification time."""
    return files.groupBy(*by).agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def first_existing(candidates: DataFrame, existing: DataFrame, by: list[str]) -> DataFrame:
    """by, path: of the candidates (priority, path) that exist, the one of least priority."""
    return candidates.join(existing.select("path"), "path", "left_semi").groupBy(*by).agg(F.min_by("path", "priority").alias("path"))


# Ontologies in Turtle: small files, read on the driver


def _statements(text: str) -> list[str]:
    text = re.sub(r"(?m)^\s*#.*$", "", text)
    parts, now = [], []
    for token in re.findall(r'"""(?:.|\n)*?"""|"(?:\\.|[^"\\])*"|<[^>]*>|[;.,\[\]()]|[^\s;,\[\]()<>"]+', text):
        if token == "." or (token.endswith(".") and len(token) > 1 and not token.startswith(('"', "<"))):
            if token != ".":
                now.append(token[:-1])
            parts.append(" ".join(now))
            now = []
        else:
            now.append(token)
    return parts


def _local(uri: str) -> str:
    return re.split(r"[#/:]", uri.strip("<>"))[-1]


def read_ontology(text: str, most: int = 220) -> list[tuple[str, list[str], list[str], str]]:
    """(name, domain, range, hint) of the object properties of a Turtle ontology, sorted; unions are spread out, and
    the hint is the first sentence of the comment."""
    out = []
    for s in _statements(text):
        head = s.split(" ", 1)[0]
        if not re.search(r"\b(?:a|rdf:type)\b[^;]*owl:ObjectProperty", s):
            continue

        def classes(p: str, s: str = s) -> list[str]:
            m = re.search(rf"rdfs:{p}\s+(\[[^\]]*\]|[^;]+)", s)
            if not m:
                return []
            names = re.findall(r"<[^>]+>|[\w\-]*:[\w\-]+", m[1])
            return [_local(n) for n in names if not n.startswith(("owl:", "rdf:", "rdfs:"))]

        m = re.search(r'rdfs:comment\s+("""(?:.|\n)*?"""|"(?:\\.|[^"\\])*")', s)
        hint = m[1].strip('"').split(". ")[0].strip() if m else ""
        out.append((_local(head), classes("domain"), classes("range"), hint if len(hint) <= most else hint[: most - 3] + "..."))
    if not out:
        raise ValueError("no object property in the ontology")
    return sorted(out)


def relation_hints(relations: list[tuple[str, list[str], list[str], str]]) -> dict[str, str]:
    """name: 'Domain → Range  |  hint', with ? for an open end: what a constrained extractor is told."""
    return {n: f"{'/'.join(d) or '?'} → {'/'.join(r) or '?'}" + (f"  |  {h}" if h else "") for n, d, r, h in relations}


def ontology_relations(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True).first()[0]
    return spark.createDataFrame(read_ontology(text), "name string, domain array<string>, range array<string>, hint string")
