"""Licence scans by canonical digest lookup.

A text is brought to a canonical form (lower case, no copyright lines, punctuation as single spaces, equivalent
spellings as one) and its SHA-256 joined with the digests of known licence texts. The form is made once for each
text, with the ends of lines and paragraphs still in it, so that the same lookup runs over single lines and over runs
of paragraphs, which finds the notices and short licences that documents carry; only those as long as a known text
are digested. Everything is built-in SQL: one pass over the documents, one hash join with the table of known
digests, no shuffle of texts.

Long licences are known by the digests of their whole texts alone (licence_texts.LICENCE_DIGESTS).

Defined results: a null text counts as empty and matches nothing; null ids stay null; repeated rows each get a
row; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import table
from lattica.llm.licence_texts import EQUIVALENT, LICENCE_DIGESTS, LICENCE_TEXTS

COPYRIGHT_LINE = r"(^|\n)[ \t/#*;>-]*(copyright |©|\(c\))[ ,:]*(copyright |\(c\)|©)?[ ,:]*([0-9]{4}|[<\[{]|by )[^\n]*"
RESERVED = r"all rights reserved\.?"
BETWEEN_WORDS = r"[^\p{L}\p{N}\n]+"
BETWEEN_PARAGRAPHS = r" *\n[ \n]*\n *"
MARK = "¶"  # no word holds it
OF_TWO_WORDS = [(a, b) for a, b in EQUIVALENT if " " in a.strip()]


def lines_form(text: Column) -> Column:
    """The canonical words with spaces around each, and the ends of lines."""
    x = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "\n"), RESERVED, " ")
    x = F.concat(F.lit(" "), F.replace(F.regexp_replace(x, BETWEEN_WORDS, " "), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for a, b in EQUIVALENT:
        x = F.replace(x, F.lit(f" {a}"), F.lit(f" {b}"))
    return x


def paragraphs_form(lines: Column) -> Column:
    """The same with the ends of paragraphs alone."""
    y = F.regexp_replace(F.regexp_replace(lines, BETWEEN_PARAGRAPHS, f" {MARK} "), r"[ \n]+", " ")
    for a, b in OF_TWO_WORDS:
        y = F.replace(y, F.lit(f" {a}"), F.lit(f" {b}"))
    return y


def whole_form(paragraphs: Column) -> Column:
    return F.trim(F.regexp_replace(paragraphs, f"[{MARK} ]+", " "))


def known_digests(spark: SparkSession, texts: list[tuple[str, str]], digests: list[tuple[str, str]]) -> DataFrame:
    """digest, license_id, size and paragraphs (null for what is known by its digest): one row for each canonical form."""
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("license_id"), F.lit(t).alias("text")) for k, t in texts)))
    y = spark.range(1).select(rows.alias("x")).select("x.license_id", paragraphs_form(lines_form(F.col("x.text"))).alias("y"))
    known = y.select(F.sha2(whole_form(F.col("y")), 256).alias("digest"), "license_id", F.length(whole_form(F.col("y"))).alias("size"), F.size(F.split("y", MARK)).alias("paragraphs"))
    if digests:
        more = F.explode(F.array(*(F.struct(F.lit(k).alias("license_id"), F.lit(d).alias("digest")) for k, d in digests)))
        none = F.lit(None).cast("int")
        known = known.union(spark.range(1).select(more.alias("x")).select("x.digest", "x.license_id", none, none))
    return known.groupBy("digest").agg(F.min("license_id").alias("license_id"), F.min("size").alias("size"), F.max("paragraphs").alias("paragraphs"))


def scan_licences(docs: DataFrame, texts: list[tuple[str, str]] = LICENCE_TEXTS, digests: list[tuple[str, str]] = LICENCE_DIGESTS) -> DataFrame:
    """doc_id, digest, license_id (of the whole text, null if not known), notices (licences of single lines and of runs
    of paragraphs, by name)."""
    spark = docs.sparkSession
    known = known_digests(spark, texts, digests)
    short = known.where("size is not null").collect()  # at most len(texts) rows
    lookup = F.map_from_entries(F.array(*(F.struct(F.lit(r["digest"]), F.lit(r["license_id"])) for r in short)))
    sizes, longest = sorted({r["size"] for r in short}), max(r["paragraphs"] for r in short)
    found = lambda part: F.when(F.length(part).isin(sizes), F.try_element_at(lookup, F.sha2(part, 256)))
    forms = docs.select("doc_id", lines_form(F.coalesce("text", F.lit(""))).alias("_x")).select("doc_id", "_x", paragraphs_form(F.col("_x")).alias("_y"))
    paragraphs = F.filter(F.transform(F.split("_y", MARK), lambda p: F.trim(p)), lambda p: p != "")
    forms = forms.select("doc_id", F.sha2(whole_form(F.col("_y")), 256).alias("digest"), F.split("_x", "\n").alias("_lines"), paragraphs.alias("_paragraphs"))
    lines = F.transform("_lines", lambda line: found(F.trim(line)))
    starts = F.sequence(F.lit(1), F.size("_paragraphs"))

    def runs_of(k: int) -> Column:
        return F.transform(F.slice(starts, 1, F.greatest(F.size("_paragraphs") - (k - 1), F.lit(0))), lambda i: found(F.array_join(F.slice("_paragraphs", i, k), " ")))

    runs = [runs_of(k) for k in range(1, longest + 1)]
    named = F.when(F.size("_paragraphs") > 0, F.concat(lines, *runs)).otherwise(F.array().cast("array<string>"))
    notices = F.array_join(F.array_sort(F.array_distinct(F.filter(named, lambda x: x.isNotNull()))), ",")
    rows = forms.select("doc_id", "digest", notices.alias("notices"))
    return rows.join(known.select("digest", "license_id"), "digest", "left").select("doc_id", "digest", "license_id", "notices")


def op10_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def oracle() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def lines(x: str) -> str:
        x = f"regexp_replace(regexp_replace(lower({x}), {q(COPYRIGHT_LINE)}, chr(10), 'g'), {q(RESERVED)}, ' ', 'g')"
        x = f"' ' || replace(regexp_replace({x}, {q(BETWEEN_WORDS)}, ' ', 'g'), chr(10), ' ' || chr(10) || ' ') || ' '"
        for a, b in EQUIVALENT:
            x = f"replace({x}, {q(' ' + a)}, {q(' ' + b)})"
        return x

    def paragraphs(x: str) -> str:
        y = f"regexp_replace(regexp_replace({x}, {q(BETWEEN_PARAGRAPHS)}, {q(f' {MARK} ')}, 'g'), {q('[ ' + chr(92) + 'n]+')}, ' ', 'g')"
        for a, b in OF_TWO_WORDS:
            y = f"replace({y}, {q(' ' + a)}, {q(' ' + b)})"
        return y

    def whole(y: str) -> str:
        return f"trim(regexp_replace({y}, {q(f'[{MARK} ]+')}, ' ', 'g'))"

    texts = ", ".join(f"({q(k)}, {q(t)})" for k, t in LICENCE_TEXTS)
    digests = "".join(f" UNION ALL SELECT {q(d)}, {q(k)}, NULL" for k, d in LICENCE_DIGESTS)
    return f"""
    WITH texts AS (SELECT k, {paragraphs('x')} AS y FROM (SELECT k, {lines('t')} AS x FROM (VALUES {texts}) v(k, t))),
    known AS (SELECT digest, min(k) AS license_id, max(n) AS n FROM (SELECT sha256({whole('y')}) AS digest, k, len(string_split(y, {q(MARK)})) AS n FROM texts{digests}) GROUP BY 1),
    docs AS (SELECT row_number() OVER () AS r, doc_id, {lines("coalesce(text, '')")} AS x FROM documents),
    forms AS (SELECT r, doc_id, x, {paragraphs('x')} AS y FROM docs),
    parts AS (SELECT r, list_filter(list_transform(string_split(y, {q(MARK)}), lambda p: trim(p)), lambda p: p <> '') AS p FROM forms),
    runs AS (SELECT r, p, k, unnest(range(1, len(p) - k + 2)) AS i FROM parts, (SELECT unnest(range(1, (SELECT max(n) FROM known) + 1)) AS k)),
    pieces AS (SELECT r, trim(unnest(string_split(x, chr(10)))) AS piece FROM forms UNION ALL SELECT r, array_to_string(p[i:i + k - 1], ' ') FROM runs),
    notices AS (SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM pieces JOIN known ON sha256(piece) = digest AND n IS NOT NULL GROUP BY r),
    whole AS (SELECT r, doc_id, sha256({whole('y')}) AS digest FROM forms)
    SELECT doc_id, digest, license_id, coalesce(notices, '') AS notices
    FROM whole LEFT JOIN known USING (digest) LEFT JOIN notices USING (r)
    """
