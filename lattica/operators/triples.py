"""Triples from model output: parsing, validation, analysis and comparison of extraction modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica import vocab as V
from lattica.functions import text as T
from lattica.functions.python_udfs import json_object, snap_relations
from lattica.operators.dictionary import resolve_subjects

TRIPLE = "struct<triples:array<struct<subject:string,predicate:string,object:string,subject_type:string,object_type:string,source_sentence:string>>>"


def parsed_output(outputs: DataFrame, raw_col: str = "raw") -> DataFrame:
    """One row for each triple of each model output, with its ord in the output and trimmed fields."""
    clean = outputs.withColumn("_json", json_object(T.strip_thinking(F.col(raw_col))))
    rows = clean.withColumn("_t", F.from_json("_json", TRIPLE)["triples"]).drop("_json", raw_col)
    rows = rows.select(*[c for c in rows.columns if c != "_t"], F.posexplode("_t").alias("ord", "t"))
    fields = [F.trim(F.coalesce(F.col(f"t.{f}"), F.lit(""))).alias(f) for f in ("subject", "predicate", "object", "subject_type", "object_type", "source_sentence")]
    return rows.select(*[c for c in rows.columns if c != "t"], *fields).where("subject <> '' and predicate <> '' and object <> ''")


def valid_free(rows: DataFrame) -> DataFrame:
    """Open triples: every part of two characters or more."""
    return rows.where((F.length("subject") >= 2) & (F.length("predicate") >= 2) & (F.length("object") >= 2))


def valid_pairs(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """Pair triples: both ends listed (paper_id, canonical), different, and the relation of five words or fewer."""
    names = listed.select("paper_id", F.lower("canonical").alias("_n")).distinct()
    out = rows.where((F.lower("subject") != F.lower("object")) & (T.n_words(F.col("predicate")) <= 5))
    for end in ("subject", "object"):
        out = out.withColumn("_n", F.lower(end)).join(names, ["paper_id", "_n"], "left_semi").drop("_n")
    return out


def guard(canonical: Column, predicate: Column, obj: Column, source: Column) -> Column:
    """Whether the predicate's own conditions hold. Squashed predicates are compared."""
    p = F.replace(F.replace(F.lower(predicate), F.lit(" "), F.lit("")), F.lit("-"), F.lit(""))
    s, c = F.lower(source), F.lower(canonical)
    needs_object = F.lit(False)
    for x in V.OBJECT_REQUIRED:
        needs_object = needs_object | F.contains(p, F.lit(x))
    defined = F.contains(s, c) & T._any(s, V.DEFINING_PHRASES)
    narrow = F.lower(F.trim(obj)).isin(V.BROAD_DOMAINS) & ~F.trim(c).isin(V.BROAD_DOMAINS)
    return (
        (~needs_object | T.object_in_sentence(obj, source))
        & ((p != "addresses") | ~defined)
        & (~p.isin("comprises", "encompasses") | ~T.is_isa_sentence(source))
        & ((p != "designedfor") | T._any(s, V.DESIGN_PHRASES))
        & ((p != "encompasses") | ~narrow)
    )


def valid_fixed(rows: DataFrame, forms: DataFrame, entities: DataFrame, relations: list[str] = V.RELATIONS) -> DataFrame:
    """Triples of the constrained mode: subjects of the entity set, present in a sound source sentence, predicates of
    the ontology (snapped where close), each predicate's guard kept, objects of 2 characters and 8 words at most.
    Rows need a unique row_id."""
    found = resolve_subjects(rows, "subject", forms, entities).where("canonical is not null").where(~T.is_low_quality_source(F.col("source_sentence")))
    f = forms.select("canonical", "form")
    text = F.lower("source_sentence")
    escape = F.regexp_replace("form", r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    present = found.select("row_id", "canonical", "source_sentence").join(f, "canonical").where(F.contains(text, F.col("form")) & F.regexp_like(text, F.concat(F.lit(r"(?U)\b"), escape, F.lit(r"\b"))))
    kept = found.join(present.select("row_id").distinct(), "row_id", "left_semi").where(guard(F.col("canonical"), F.col("predicate"), F.col("object"), F.col("source_sentence")))
    snapped = kept.withColumn("predicate", snap_relations(relations)(F.col("predicate"))).where("predicate is not null")
    snapped = snapped.where((F.length("object") >= 2) & (T.n_words(F.col("object")) <= 8))
    kind = F.coalesce(F.nullif("object_type", F.lit("")), F.lit("Other"))
    return snapped.withColumn("subject", F.col("canonical")).withColumn("predicate", F.lower("predicate")).withColumn("object_type", kind).drop("canonical")


def entity_mentions_of_triples(triples: DataFrame) -> DataFrame:
    """name, raw_type, cnt of subjects and objects, cleaned and without noise."""
    both = triples.select(F.explode(F.array(F.struct(F.col("subject").alias("name"), F.col("subject_type").alias("raw_type")), F.struct(F.col("object").alias("name"), F.col("object_type").alias("raw_type")))).alias("e")).select("e.*")
    both = both.withColumn("name", T.strip_punctuation(F.col("name")))
    return both.where(~T.is_noise_name(F.col("name"))).groupBy("name", F.coalesce("raw_type", F.lit("")).alias("raw_type")).agg(F.count("*").alias("cnt"))


def triple_stats(triples: DataFrame, by: list[str]) -> DataFrame:
    """Counts, distinct subjects, objects, predicates and entities, and mean lengths in words, by group."""
    one = triples.groupBy(*by).agg(
        F.count("*").alias("n"), F.countDistinct("subject").alias("subjects"), F.countDistinct("object").alias("objects"), F.countDistinct("predicate").alias("predicates"),
        F.avg(T.n_words(F.col("subject"))).alias("avg_subject_words"), F.avg(T.n_words(F.col("object"))).alias("avg_object_words"),
    )
    both = triples.select(*by, F.explode(F.array("subject", "object")).alias("e")).groupBy(*by).agg(F.countDistinct("e").alias("entities"))
    return one.join(both, by)


def top_values(triples: DataFrame, by: list[str], columns: list[str], n: int) -> DataFrame:
    """by, value, cnt, rank: the most frequent values of the columns together, ties by first place (ord)."""
    rows = triples.select(*by, "ord", F.posexplode(F.array(*columns)).alias("_k", "value")).withColumn("_place", F.struct("_k", "ord"))
    c = rows.groupBy(*by, "value").agg(F.count("*").alias("cnt"), F.min("_place").alias("_first"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("cnt"), "_first"))).where(F.col("rank") <= n).drop("_first")


def diverse_samples(triples: DataFrame, by: list[str], n: int = 5) -> DataFrame:
    """The first triple of each predicate, n at most for each group."""
    first = triples.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "predicate").orderBy("ord"))).where("_r = 1").drop("_r")
    return first.withColumn("sample", F.row_number().over(Window.partitionBy(*by).orderBy("ord", "predicate"))).where(F.col("sample") <= n)


def keyed(triples: DataFrame) -> DataFrame:
    """One triple for each lower-case (subject, object); the last wins."""
    k = triples.withColumn("s", F.lower(F.trim("subject"))).withColumn("o", F.lower(F.trim("object")))
    return k.groupBy("s", "o").agg(F.max_by("predicate", "ord").alias("predicate"))


def overlap(fixed: DataFrame, free: DataFrame) -> DataFrame:
    """s, o, side ('both', 'fixed' or 'free'), predicates of either side."""
    a = keyed(fixed).withColumnRenamed("predicate", "fixed_predicate")
    b = keyed(free).withColumnRenamed("predicate", "free_predicate")
    side = F.when(F.col("free_predicate").isNull(), "fixed").when(F.col("fixed_predicate").isNull(), "free").otherwise("both")
    return a.join(b, ["s", "o"], "full").withColumn("side", side)


def entity_coverage(entities: DataFrame, fixed: DataFrame, free: DataFrame) -> DataFrame:
    """entity, in_fixed, in_free: whether it is a subject of either mode (subjects lower-cased, not trimmed)."""
    flag = lambda t, name: t.select(F.lower("subject").alias("_s"), F.lit(True).alias(name)).distinct()
    e = entities.withColumn("_s", F.lower("entity"))
    out = e.join(flag(fixed, "in_fixed"), "_s", "left").join(flag(free, "in_free"), "_s", "left")
    return out.select("entity", F.coalesce("in_fixed", F.lit(False)).alias("in_fixed"), F.coalesce("in_free", F.lit(False)).alias("in_free"))


def relation_distribution(fixed: DataFrame, free: DataFrame) -> DataFrame:
    """predicate, fixed_n, free_n over the union of both modes' predicates."""
    a = fixed.groupBy("predicate").agg(F.count("*").alias("fixed_n"))
    b = free.groupBy("predicate").agg(F.count("*").alias("free_n"))
    return a.join(b, "predicate", "full").select("predicate", F.coalesce("fixed_n", F.lit(0)).alias("fixed_n"), F.coalesce("free_n", F.lit(0)).alias("free_n"))


def verdict(raw: Column) -> tuple[Column, Column]:
    """Verdict and reason of a judge's answer: the first flat object, else the first keyword found."""
    flat = F.regexp_extract(T.strip_thinking(raw), r"(?s)(\{[^{}]*\})", 1)
    j = F.from_json(flat, "struct<verdict:string,reason:string>")
    up = F.upper(raw)
    word = F.when(F.contains(up, F.lit("INCORRECT")), "INCORRECT").when(F.contains(up, F.lit("PARTIAL")), "PARTIAL").when(F.contains(up, F.lit("CORRECT")), "CORRECT").otherwise("UNVERIFIABLE")
    stated = F.upper(F.trim(j["verdict"]))
    return F.when(stated.isin("CORRECT", "PARTIAL", "INCORRECT", "UNVERIFIABLE"), stated).otherwise(word), F.coalesce(j["reason"], F.lit(""))


def verdict_summary(judged: DataFrame, by: list[str]) -> DataFrame:
    """Counts of verdicts and, over those that can be judged, strict and lenient precision, partial and error rate."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    out = judged.groupBy(*by).agg(F.count("*").alias("total"), n("CORRECT").alias("correct"), n("PARTIAL").alias("partial"), n("INCORRECT").alias("incorrect"), n("UNVERIFIABLE").alias("unverifiable"))
    base = F.nullif(F.col("correct") + F.col("partial") + F.col("incorrect"), F.lit(0))
    rate = lambda x: F.round(F.coalesce(x / base, F.lit(0.0)), 3)
    return out.select(
        "*", rate(F.col("correct")).alias("precision"), rate(F.col("partial")).alias("partial_rate"), rate(F.col("incorrect")).alias("error_rate"), rate(F.col("correct") + 0.5 * F.col("partial")).alias("lenient_precision")
    )


def annotated_source(rows: DataFrame, forms: DataFrame, most: int = 5) -> DataFrame:
    """Adds annotated: the source sentence with the subject's first surface form followed by its canonical name, and
    forms: up to `most` forms in order of priority. What a judge is shown, so that it knows a name by its aliases."""
    f = forms.select("canonical", "form", "priority").where(F.lower("canonical") != F.col("form"))
    listed = f.groupBy(F.lower("canonical").alias("_k")).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("priority", (-F.length("form")).alias("n"), "form"))), lambda x: x["form"]), 1, most).alias("forms"), F.first("canonical").alias("_c"))
    out = rows.join(listed, F.lower("subject") == F.col("_k"), "left")
    low = F.lower("source_sentence")
    hit = F.get(F.filter("forms", lambda x: F.contains(low, x)), 0)
    place = F.position(hit, low)
    note = F.concat(F.substr("source_sentence", F.lit(1), place - 1 + F.length(hit)), F.lit(" ("), "_c", F.lit(")"), F.substr("source_sentence", place + F.length(hit)))
    return out.withColumn("annotated", F.when(hit.isNotNull() & ~F.contains(low, F.col("_k")), note).otherwise(F.col("source_sentence"))).drop("_k", "_c")
