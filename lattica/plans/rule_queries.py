"""Registered queries of text rules, triple checks, tables, sections and scores, each with its SQL twin.

Inputs are whole driver tables. Where a rule needs texts that they don't hold, the texts are patterns filled with
each row's name, dealt by the row's key; the SQL states the rule anew or, for parsers, what each pattern must give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica import vocab as V
from lattica.functions import text as T
from lattica.functions import vectors as X
from lattica.functions.python_udfs import snap_relations
from lattica.operators import concepts as C
from lattica.operators import dictionary as D
from lattica.operators import documents as H
from lattica.operators import graph as G
from lattica.operators import layout as L
from lattica.operators import ranking as R
from lattica.operators import triples as TR
from lattica.plans import derived
from lattica.plans.derived import Tables, with_sql
from lattica.plans.queries import _FORMS, _entities, query, quoted
from lattica.sources import readers as RD
from lattica.sources import writers as WR


def dealt(key: str, patterns: list[str], fill: str = "p_name") -> Column:
    """The pattern of a row by its key, {} filled with its name."""
    return F.replace(F.get(F.array(*(F.lit(p) for p in patterns)), F.pmod(F.col(key), F.lit(len(patterns))).cast("int")), F.lit("{}"), F.col(fill))


def dealt_sql(key: str, patterns: list[str], fill: str = "p_name") -> str:
    return f"replace([{quoted(patterns)}][({key} % {len(patterns)} + 1)::INT], '{{}}', {fill})"


def case_sql(key: str, values: list[str]) -> str:
    """The SQL value of a row by its key."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


WORDS = r"list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '')"

# Row rules

_NOISE = ["", "12", "ab", "  7 ", "{}", "Figure of {}"]


@query(f"SELECT p_partkey, length(trim(t)) < 3 OR regexp_full_match(trim(t), '\\d+') OR y < 40 OR y > 780 AS noise FROM (SELECT p_partkey, {dealt_sql('p_partkey', _NOISE)} AS t, p_size * 17.0::DOUBLE AS y FROM part)")
def layout_noise_flags(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.is_layout_noise(dealt("p_partkey", _NOISE), F.col("p_size") * 17.0).alias("noise"))


_CITED = ["short", "A long title on {}", "P19-1001", "as P 19-1001 says of {}", "{}"]


@query(f"SELECT p_partkey, coalesce(length(t) > 8 AND lower(t) <> 'p19-1001' AND NOT contains(replace(lower(t), ' ', ''), 'p19-1001'), false) AS valid FROM (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE {dealt_sql('p_partkey', _CITED)} END AS t FROM part)")
def citation_title_flags(t: Tables) -> DataFrame:
    title = F.when(F.col("p_partkey") % 11 != 0, dealt("p_partkey", _CITED))
    return t.part.select("p_partkey", T.is_valid_citation_title(title, F.lit("P19-1001")).alias("valid"))


_LEADS = ["", "References ", "Figure 1 ", "fig. 2 ", "Table 3: ", "• ", "- ", "TABLE  ", "table of ", "* ", "reference "]


@query(
    f"""WITH l AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS ord FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)), x AS (SELECT doc_id, ord, [{quoted(_LEADS)}][(ord + doc_id) % {len(_LEADS)} + 1] || line AS t FROM l)
    SELECT doc_id, ord, starts_with(lower(t), 'references') AS refs, regexp_matches(lower(trim(t)), '^(figure|fig\\.|table)') AS figure, regexp_matches(trim(t), '(?i)^table\\s*\\d+') AS tab, regexp_matches(trim(t), '^[•\\-*]') AS bullet, regexp_matches(t, '[.?!:]$') AS ends FROM x"""
)
def line_kind_flags(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    lead = F.get(F.array(*(F.lit(x) for x in _LEADS)), ((F.col("ord") + F.col("doc_id")) % len(_LEADS)).cast("int"))
    x = lines.select("doc_id", F.col("ord").cast("long").alias("ord"), F.concat(lead, "line").alias("t"))
    c = F.col("t")
    return x.select("doc_id", "ord", T.is_references(c).alias("refs"), T.is_figure_caption(c).alias("figure"), T.is_table_caption(c).alias("tab"), T.is_bullet(c).alias("bullet"), T.is_sentence_end(c).alias("ends"))


_SECTIONS = ["Introduction", "E[CLS] {}", "Figure 3", "figure {}", "Fig. 12", "References", "Bibliography", "Acknowledgements", "Appendix", "Appendix {}", "E1 E2", "[unused7] {}", "Table 1", "Results on {}", "E_1"]


@query(f"SELECT p_partkey, regexp_matches(h, {quoted([V.GARBLED_SECTION])}) AS garbled, " + " OR ".join(f"contains(lower(trim(h)), '{x}')" for x in V.SKIPPED_SECTIONS) + f" AS skipped FROM (SELECT p_partkey, {dealt_sql('p_partkey', _SECTIONS)} AS h FROM part)")
def section_flags(t: Tables) -> DataFrame:
    h = dealt("p_partkey", _SECTIONS)
    return t.part.select("p_partkey", T.is_garbled_section(h).alias("garbled"), T.is_skipped_section(h).alias("skipped"))


_OBJECTS = ["{}", "unrelated thing here", "the of an", "{} unrelated", "SMALL things of the {}", "of"]


@query(
    f"""WITH x AS (SELECT p_partkey, lower(trim({dealt_sql('p_partkey', _OBJECTS)})) AS o, lower('We use the ' || p_name || ' of ' || p_type) AS s FROM part),
    c AS (SELECT *, list_filter(string_split_regex(o, '\\s+'), lambda w: w NOT IN ({quoted(V.OBJECT_STOPWORDS)}) AND length(w) > 2) AS c FROM x)
    SELECT p_partkey, contains(s, o) OR len(c) = 0 OR len(list_filter(c, lambda w: contains(s, w))) >= greatest(1, len(c) // 2) AS held FROM c"""
)
def object_in_sentence_flags(t: Tables) -> DataFrame:
    sentence = F.concat(F.lit("We use the "), "p_name", F.lit(" of "), "p_type")
    return t.part.select("p_partkey", T.object_in_sentence(dealt("p_partkey", _OBJECTS), sentence).alias("held"))


_ISA = ["{} is a part", "{} was a part", "these are fine-tuning steps", "{} is one of many", "this are examples of {}", "thesis another {}", "{} is an item", "{} are both examples of it", "such {} is used"]


@query(f"SELECT p_partkey, regexp_matches(lower(s), {quoted([V.IS_A])}) AS isa FROM (SELECT p_partkey, {dealt_sql('p_partkey', _ISA)} AS s FROM part)")
def isa_sentence_flags(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.is_isa_sentence(dealt("p_partkey", _ISA)).alias("isa"))


_AUTHORS = ["{}", "Ann Lee1 Bo Li2", "Ann Lee* of {}", "1a", "a 1", "† {}"]


@query(f"SELECT p_partkey, regexp_matches(x, '[A-Za-z]\\d|[∗†‡§*]') AS authors FROM (SELECT p_partkey, {dealt_sql('p_partkey', _AUTHORS)} AS x FROM part)")
def author_line_flags(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.looks_like_authors(dealt("p_partkey", _AUTHORS)).alias("authors"))


# Triples: parsing, guards, validation

_PREDICATES = ["uses", "trained on", "addresses", "comprises", "encompasses", "designed-for", "reports", "Compares Against"]
_SENTENCES = ["We say that {} is a strong tool made for nothing else here", "The authors apply {} and it was designed for large models today", "Something else altogether happens in this long enough sentence"]
_TARGETS = ["large models", "nlp", "{}", "strange words"]


def _guarded(t: Tables) -> DataFrame:
    k = "p_partkey"
    n = len(_PREDICATES)
    rows = t.part.withColumn("k2", F.floor(F.col(k) / n)).withColumn("k3", F.floor(F.col(k) / (n * len(_SENTENCES))))
    return rows.select(k, "p_name", dealt(k, _PREDICATES).alias("predicate"), dealt("k2", _SENTENCES).alias("source"), dealt("k3", _TARGETS).alias("object"))


_GUARDED = f"x AS (SELECT p_partkey, lower(p_name) AS c, replace(replace(lower({dealt_sql('p_partkey', _PREDICATES)}), ' ', ''), '-', '') AS p, lower({dealt_sql(f'(p_partkey // {len(_PREDICATES)})', _SENTENCES)}) AS s, lower(trim({dealt_sql(f'(p_partkey // {len(_PREDICATES) * len(_SENTENCES)})', _TARGETS)})) AS o FROM part)"


@query(
    f"""WITH {_GUARDED}, w AS (SELECT *, list_filter(string_split_regex(o, '\\s+'), lambda w: w NOT IN ({quoted(V.OBJECT_STOPWORDS)}) AND length(w) > 2) AS w FROM x)
    SELECT p_partkey, (NOT ({" OR ".join(f"contains(p, '{x}')" for x in V.OBJECT_REQUIRED)}) OR contains(s, o) OR len(w) = 0 OR len(list_filter(w, lambda x: contains(s, x))) >= greatest(1, len(w) // 2))
    AND (p <> 'addresses' OR NOT (contains(s, c) AND ({" OR ".join(f"contains(s, '{x}')" for x in V.DEFINING_PHRASES)})))
    AND (p NOT IN ('comprises', 'encompasses') OR NOT regexp_matches(s, {quoted([V.IS_A])})) AND (p <> 'designedfor' OR {" OR ".join(f"contains(s, '{x}')" for x in V.DESIGN_PHRASES)})
    AND (p <> 'encompasses' OR NOT (o IN ({quoted(V.BROAD_DOMAINS)}) AND c NOT IN ({quoted(V.BROAD_DOMAINS)}))) AS kept FROM w"""
)
def predicate_guards(t: Tables) -> DataFrame:
    g = _guarded(t)
    return g.select("p_partkey", TR.guard(F.col("p_name"), F.col("predicate"), F.col("object"), F.col("source")).alias("kept"))


_RAW = [
    '{"triples": [{"subject": "{}", "predicate": "uses", "object": "brass"}, {"subject": " ", "predicate": "uses", "object": "x"}]}',
    'Here: ```json\n{"triples": [{"subject": "{}", "predicate": "reports", "object": "a b", "object_type": "Tool"}]}\n```',
    '<think>{"triples": []} hm</think>\n{"triples": [{"subject": " {} ", "predicate": " is ", "object": "x"}]} trailing',
    '<think>never closed {"triples": [{"subject": "a", "predicate": "b", "object": "c"}]}',
    "no object at all on {}",
    '{"triples": [{"subject": "one", "predicate": "has", "object": "} of {}"}, {"subject": "two", "predicate": "has", "object": "three"}]}',
]
_PARSED = [
    "[{'o': 0, 's': p_name, 'p': 'uses', 'b': 'brass', 't': ''}]",
    "[{'o': 0, 's': p_name, 'p': 'reports', 'b': 'a b', 't': 'Tool'}]",
    "[{'o': 0, 's': p_name, 'p': 'is', 'b': 'x', 't': ''}]",
    "[]",
    "[]",
    "[{'o': 0, 's': 'one', 'p': 'has', 'b': '} of ' || p_name, 't': ''}, {'o': 1, 's': 'two', 'p': 'has', 'b': 'three', 't': ''}]",
]
_PARSED_SQL = f"parsed AS (SELECT p_partkey, u.o::BIGINT AS ord, u.s AS subject, u.p AS predicate, u.b AS object, u.t AS object_type FROM (SELECT p_partkey, unnest({case_sql('p_partkey', _PARSED)}) AS u FROM part))"


def _parsed(t: Tables) -> DataFrame:
    return TR.parsed_output(t.part.select("p_partkey", dealt("p_partkey", _RAW).alias("raw"))).withColumn("ord", F.col("ord").cast("long"))


@query(f"WITH {_PARSED_SQL} SELECT * FROM parsed")
def model_output_triples(t: Tables) -> DataFrame:
    return _parsed(t).select("p_partkey", "ord", "subject", "predicate", "object", "object_type")


@query(f"WITH {_PARSED_SQL} SELECT p_partkey, ord, subject FROM parsed WHERE length(subject) >= 2 AND length(predicate) >= 2 AND length(object) >= 2")
def valid_free_triples(t: Tables) -> DataFrame:
    return TR.valid_free(_parsed(t)).select("p_partkey", "ord", "subject")


_ENDS = ["{}", "not listed {}", "SAME", "{}"]
_RELATIONS = ["goes with", "a relation of far too many words", "uses", "is"]


@query(
    f"""WITH x AS (SELECT p_partkey, 'b' || p_size AS paper_id, p_name AS subject, {dealt_sql('(p_partkey // 4)', _RELATIONS)} AS predicate, CASE WHEN p_partkey % 4 = 2 THEN upper(p_name) ELSE {dealt_sql('p_partkey', _ENDS, 'p_type')} END AS object FROM part),
    l AS (SELECT DISTINCT 'b' || p_size AS paper_id, lower(x) AS n FROM (SELECT p_size, unnest([p_name, p_type]) AS x FROM part))
    SELECT p_partkey FROM x WHERE lower(subject) <> lower(object) AND len({WORDS.format('predicate')}) <= 5 AND EXISTS (SELECT 1 FROM l WHERE l.paper_id = x.paper_id AND n = lower(subject)) AND EXISTS (SELECT 1 FROM l WHERE l.paper_id = x.paper_id AND n = lower(object))"""
)
def valid_pair_triples(t: Tables) -> DataFrame:
    paper = F.concat(F.lit("b"), "p_size").alias("paper_id")
    rows = t.part.withColumn("k2", F.floor(F.col("p_partkey") / 4)).select("p_partkey", paper, F.col("p_name").alias("subject"), dealt("k2", _RELATIONS).alias("predicate"), F.when(F.col("p_partkey") % 4 == 2, F.upper("p_name")).otherwise(dealt("p_partkey", _ENDS, "p_type")).alias("object"))
    listed = t.part.select(paper, F.explode(F.array("p_name", "p_type")).alias("canonical"))
    return TR.valid_pairs(rows, listed).select("p_partkey")


_SNAPPED = {"used": "uses", "trained_on": "trainedOn", "evaluetedOn": "evaluatedOn", "zzzz": None, "CITES": "cites", "comparesAgains": "comparesAgainst", "motivation": "motivates", "qqqq wwww": None}


@query(f"SELECT p_partkey, {case_sql('p_partkey', [quoted([v]) if v else 'NULL' for v in _SNAPPED.values()])} AS relation FROM part")
def closest_relations(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", snap_relations(V.RELATIONS)(dealt("p_partkey", list(_SNAPPED))).alias("relation"))


_SUBJECTS = ["{}", "{} land", "nobody", "google {}"]
_SOURCES = ["We train {} land and report strong results for all of them", "We train something else and report strong results for all of them", "see table 3"]


@query(
    f"""WITH {_FORMS}, x AS (SELECT s_suppkey AS row_id, replace([{quoted(_SUBJECTS)}][(s_suppkey % 4 + 1)::INT], '{{}}', CASE WHEN s_suppkey % 4 = 3 THEN lower(substr(n_name, 1, 3)) ELSE n_name END) AS subject, {dealt_sql('(s_suppkey // 4)', _SOURCES, 'lower(n_name)')} AS src, CASE WHEN s_suppkey % 7 = 0 THEN 'zz zz' ELSE 'reports' END AS predicate FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    r AS (SELECT x.*, coalesce(f.canonical, (SELECT arg_min(n_name, n_nationkey) FROM nation WHERE contains(lower(subject), lower(n_name)) OR contains(lower(n_name), lower(subject)))) AS canonical FROM x LEFT JOIN forms f ON lower(trim(subject)) = f.form)
    SELECT row_id, lower(canonical) AS subject, predicate FROM r WHERE canonical IS NOT NULL AND predicate = 'reports' AND (s_src.n >= 6) AND EXISTS (SELECT 1 FROM forms WHERE lower(forms.canonical) = lower(r.canonical) AND contains(' ' || src || ' ', ' ' || form || ' '))""".replace("(s_src.n >= 6)", f"len({WORDS.format('src')}) >= 6 AND NOT regexp_matches(src, '^see table')")
)
def valid_fixed_triples(t: Tables) -> DataFrame:
    n = F.col("n_name")
    k = F.col("s_suppkey")
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("low", F.lower(n)).withColumn("own", F.when(k % 4 == 3, F.lower(F.substring(n, 1, 3))).otherwise(n)).withColumn("k2", F.floor(k / 4))
    rows = rows.select(k.alias("row_id"), k.alias("ord"), dealt("s_suppkey", _SUBJECTS, "own").alias("subject"), F.when(k % 7 == 0, "zz zz").otherwise("reports").alias("predicate"), F.lit("strong results").alias("object"), F.lit("").alias("object_type"), dealt("k2", _SOURCES, "low").alias("source_sentence"))
    e = _entities(t)
    return TR.valid_fixed(rows, D.surface_forms(e), e).select("row_id", F.lower("subject").alias("subject"), "predicate")


_REBEL = ["<s><triplet> {} <subj> brass <obj> made of</s>", "<triplet> {} <subj> x <obj> made of", "<triplet> {} <subj> tin <obj> has <triplet> two <subj> three <obj> four<pad>", "nothing {}", "<triplet> 12 <subj> 34 <obj> 56"]


@query(
    "SELECT p_partkey, u.s AS subject, u.p AS predicate, u.o AS object FROM (SELECT p_partkey, unnest("
    + case_sql("p_partkey", ["[{'s': p_name, 'p': 'made of', 'o': 'brass'}]", "[]", "[{'s': p_name, 'p': 'has', 'o': 'tin'}, {'s': 'two', 'p': 'four', 'o': 'three'}]", "[]", "[]"])
    + ") AS u FROM part)"
)
def sequence_model_triples(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.explode(T.rebel_triples(dealt("p_partkey", _REBEL))).alias("x")).select("p_partkey", "x.subject", "x.predicate", "x.object")


_JUDGED = ['{"verdict": "correct", "reason": "{}"}', "I say INCORRECT because {}", '<think>CORRECT?</think> {"verdict": "Partial", "reason": ""}', "no idea", '{"verdict": "maybe"} it is PARTIAL', "CORRECT"]


@query("SELECT p_partkey, " + case_sql("p_partkey", ["'CORRECT'", "'INCORRECT'", "'PARTIAL'", "'UNVERIFIABLE'", "'PARTIAL'", "'CORRECT'"]) + " AS verdict, " + case_sql("p_partkey", ["p_name", "''", "''", "''", "''", "''"]) + " AS reason FROM part")
def judge_answers(t: Tables) -> DataFrame:
    v, r = TR.verdict(dealt("p_partkey", _JUDGED))
    return t.part.select("p_partkey", v.alias("verdict"), r.alias("reason"))


@query(
    with_sql("triples")
    + f", b AS (SELECT unnest([subject, object]) AS name FROM triples) SELECT name, '' AS raw_type, count(*) AS cnt FROM b WHERE NOT (length(name) < 3 OR lower(name) IN ({quoted(V.NOISE_NAMES)}) OR string_split(lower(name), ' ')[1] IN ({quoted(V.GENERIC_LEADING)})) GROUP BY name"
)
def triple_entities(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    return TR.entity_mentions_of_triples(derived.triples(t).withColumn("subject_type", none).withColumn("object_type", none))


_NOTED = ["We met {} land there", "We met {} there", "We met nobody", "the {} land and {}"]


@query(
    f"SELECT s_suppkey, {case_sql('s_suppkey', [repr('We met ') + ' || lower(n_name) || ' + repr(' land there'), repr('We met ') + ' || lower(n_name) || ' + repr(' there'), repr('We met nobody'), repr('the ') + ' || lower(n_name) || ' + repr(' land and ') + ' || lower(n_name)'])} AS annotated FROM supplier JOIN nation ON s_nationkey = n_nationkey"
)
def annotated_sources(t: Tables) -> DataFrame:
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("low", F.lower("n_name")).select("s_suppkey", F.col("n_name").alias("subject"), dealt("s_suppkey", _NOTED, "low").alias("source_sentence"))
    forms = D.surface_forms(_entities(t)).where("priority = 0")
    return TR.annotated_source(rows, forms).select("s_suppkey", "annotated")


_ALIASED = ["We met {}-x there", "in {} we trust", "nothing here"]


@query(f"SELECT n_nationkey, {case_sql('n_nationkey', [repr('We met ') + ' || a || ' + repr(' (') + ' || e || ' + repr(')-x there'), repr('in ') + ' || a || ' + repr(' (') + ' || e || ' + repr(') we trust'), repr('nothing here')])} AS annotated FROM (SELECT n_nationkey, 'q' || n_nationkey || 'q' AS a, upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) || ' Republic' AS e FROM nation)")
def annotated_aliases(t: Tables) -> DataFrame:
    """The first form of a name is followed by the canonical one."""
    alias, full = F.concat(F.lit("q"), "n_nationkey", F.lit("q")), F.concat(F.upper(F.substring("n_name", 1, 1)), F.lower(F.substr("n_name", F.lit(2))), F.lit(" Republic"))
    n = t.nation.select("n_nationkey", alias.alias("a"), full.alias("e"))
    forms = D.surface_forms(n.select(F.col("n_nationkey").cast("long").alias("ord"), F.col("e").alias("entity"), F.lit("").alias("abbreviation"), F.array("a").alias("aliases")))
    return TR.annotated_source(n.select("n_nationkey", F.col("e").alias("subject"), dealt("n_nationkey", _ALIASED, "a").alias("source_sentence")), forms).select("n_nationkey", "annotated")


# Text functions


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(trim(replace(replace(text, chr(173), ''), chr(10), ' ')), '\s+', ' ', 'g'), '\s+([.,;:])', '\1', 'g'))) AS paragraph, md5(trim(replace(replace(text, chr(173), ''), chr(10), ' '))) AS normal FROM documents")
def paragraph_clean(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(T.clean_paragraph(F.col("text"))).alias("paragraph"), F.md5(T.normal_text(F.col("text"))).alias("normal"))


_HEADS = {
    "1 Introduction": (1, "ltx_section", "1 Introduction"), "Abstract": (0, "ltx_abstract", "Abstract"), "2.1 Data of {}": (2, "ltx_subsection", "2.1 Data of {}"), "3.2.1  Deep {}": (3, "ltx_subsubsection", "3.2.1 Deep {}"),
    "iv. Results": (1, "ltx_section", "IV Results"), "A Proofs": (1, "ltx_appendix", "A Proofs"), "A.1 More {}": (2, "ltx_subsection", "A.1 More {}"), "{}": (1, "ltx_section", "{}"), "II. Method": (1, "ltx_section", "II Method"),
}


@query(
    f"SELECT p_partkey, {case_sql('p_partkey', [str(d) for d, _, _ in _HEADS.values()])}::INT AS depth, {case_sql('p_partkey', [quoted([c]) for _, c, _ in _HEADS.values()])} AS class, {dealt_sql('p_partkey', [x for _, _, x in _HEADS.values()])} AS cleaned FROM part"
)
def heading_forms(t: Tables) -> DataFrame:
    h = dealt("p_partkey", list(_HEADS))
    return t.part.select("p_partkey", T.heading_depth(h).alias("depth"), T.heading_class(h).alias("class"), T.clean_heading(h).alias("cleaned"))


_ESCAPED = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(f"SELECT doc_id, md5({_ESCAPED}) AS digest FROM documents")
def html_escape(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(T.escaped(F.col("text"))).alias("digest"))


_MARKED = ["The {} net & neural nets", "neural net of {}", "NEURAL NETWORK <b>", "networked"]


@query(
    "SELECT p_partkey, replace("
    + case_sql("p_partkey", ["'The {} <mark class=\"concept\">net</mark> &amp; neural nets'", "'<mark class=\"concept\">neural <mark class=\"concept\">net</mark></mark> of {}'", "'<mark class=\"concept\">NEURAL NETWORK</mark> &lt;b&gt;'", "'networked'"])
    + ", '{}', p_name) AS html FROM part"
)
def concept_highlights(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.highlighted(dealt("p_partkey", _MARKED), ["neural network", "net", "neural net"]).alias("html"))


_THOUGHT = ["<think>a\nb</think>\n{}", "{} <think>open {}", "```json\n{}\n```", "```\n{}```", " {} ", "<think>x</think>```json {} ```"]


@query(f"SELECT p_partkey, {case_sql('p_partkey', ['p_name', 'p_name', 'p_name', 'p_name', 'p_name', 'p_name'])} AS kept FROM part")
def thinking_stripped(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.strip_thinking(dealt("p_partkey", _THOUGHT)).alias("kept"))


_CLEANED = ["Cleaned text: One {}. One {}. Two.", "<b>{}</b>   x", "A. B. A.", "cleaned TEXT:{}"]


@query("SELECT p_partkey, replace(" + case_sql("p_partkey", ["'One {}. Two.'", "'{} x'", "'A. B. A.'", "'{}'"]) + ", '{}', p_name) AS cleaned FROM part")
def model_output_clean(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.clean_model_output(dealt("p_partkey", _CLEANED)).alias("cleaned"))


_TURNED = ["", " and more words of the model here", " of", "!"]


@query(
    r"""WITH x AS (SELECT conv_id, turn, text AS a, [""" + quoted(_TURNED) + r"""][((conv_id + turn) % 4 + 1)::INT] AS tail FROM conversations), y AS (SELECT *, a || tail AS b FROM x),
    z AS (SELECT *, length(trim(regexp_replace(regexp_replace(a, '-\s+', '', 'g'), '\s+', ' ', 'g'))) AS la, length(trim(regexp_replace(b, '\s+', ' ', 'g'))) AS lb,
    list_filter(regexp_extract_all(lower(b), '[a-zA-Z'']+'), lambda w: length(w) > 3 AND NOT list_contains(regexp_extract_all(lower(a), '[a-zA-Z'']+'), w)) AS novel, regexp_extract_all(lower(b), '[a-zA-Z'']+') AS o,
    length(b)::DOUBLE / greatest(length(array_to_string(list_filter(string_split_regex(a, '\s+'), lambda w: w <> ''), ' ')), 1) AS ratio FROM y),
    k AS (SELECT *, CASE WHEN la = 0 THEN lb = 0 ELSE lb >= 0.9 * la AND lb <= 1.1 * la END AS kept FROM z)
    SELECT conv_id, turn, kept, NOT (len(novel) > 0.03 * greatest(len(o), 1) AND len(novel) > 2) AND kept AND ratio BETWEEN 0.7 AND 1.5 AS safe FROM k"""
)
def rewrite_guards(t: Tables) -> DataFrame:
    tail = F.get(F.array(*(F.lit(x) for x in _TURNED)), ((F.col("conv_id") + F.col("turn")) % 4).cast("int"))
    a, b = F.col("text"), F.concat("text", tail)
    return t.conversations.select("conv_id", "turn", T.length_kept(a, b).alias("kept"), T.is_safe_rewrite(a, b).alias("safe"))


_TAGS = ["B-Method", "I-method", "O", " s-Data-Set ", "E-", "b-task"]


@query(
    f"SELECT p_partkey, {case_sql('p_partkey', [repr('B'), repr('I'), 'NULL', repr('S'), repr('E'), repr('B')])} AS prefix, {case_sql('p_partkey', [repr('method'), repr('method'), 'NULL', repr('data-set'), repr(''), repr('task')])} AS kind FROM part"
)
def bioes_tags(t: Tables) -> DataFrame:
    prefix, kind = T.bioes_tag(dealt("p_partkey", _TAGS))
    return t.part.select("p_partkey", prefix.alias("prefix"), kind.alias("kind"))


_TITLES = ["A Study - of {} , part : one", "It 's {}", "  {}  ;", "x  y"]


@query(
    "SELECT p_partkey, replace(" + case_sql("p_partkey", ["'A Study-of {}, part: one'", "'It ''s {}'", "'{};'", "'x y'"]) + ", '{}', p_name) AS title, substr(regexp_replace(regexp_replace(substr(p_name || ' / (' || p_type || ')', 1, 50), '[^\\p{L}\\p{N}_\\-]', '_', 'g'), '^_+|_+$', '', 'g'), 1) AS slug FROM part"
)
def title_forms(t: Tables) -> DataFrame:
    own = F.concat("p_name", F.lit(" / ("), "p_type", F.lit(")"))
    return t.part.select("p_partkey", T.detokenised_title(dealt("p_partkey", _TITLES)).alias("title"), T.slug(own).alias("slug"))


_ROWS = ["a b   c d   12", "a b  c d", "alpha 12 3.5 beta", "", "plain words", "x\ty\tz 1", "O ( n ) 12 x"]
_SPLIT = ["['a b', 'c d', '12']", "['a b', 'c d']", "['alpha', '12', '3.5', 'beta']", "[]", "['plain', 'words']", "['x', 'y', 'z', '1']", "['O', 'n', '12', 'x']"]
_COLUMNS = ["['a b', 'c d', '12']", "['a b', 'c d']", "['alpha', '12', '3.5', 'beta']", "[]", "['plain words']", "['x', 'y', 'z 1']", "['O ( n ) 12 x']"]
_IS_ROW = ["true", "false", "true", "false", "false", "true", "false"]


@query(
    f"SELECT p_partkey, array_to_string({case_sql('p_partkey', _SPLIT)}, '|') AS smart, array_to_string({case_sql('p_partkey', _COLUMNS)}, '|') AS cols, {case_sql('p_partkey', _IS_ROW)} AS is_row, trim(regexp_replace(p_name || '  ' || p_type || ' ', '\\s+', ' ', 'g')) AS cell FROM part"
)
def table_line_forms(t: Tables) -> DataFrame:
    x = dealt("p_partkey", _ROWS)
    return t.part.select("p_partkey", F.array_join(T.split_row(x), "|").alias("smart"), F.array_join(T.split_columns(x), "|").alias("cols"), T.is_table_row(x).alias("is_row"), T.clean_cell(F.concat("p_name", F.lit("  "), "p_type", F.lit(" "))).alias("cell"))


# Tables: every part is a small one


def _tables(t: Tables) -> DataFrame:
    """p_partkey, ord, page, headers, rows, quality, source; tables of one size of part are a document."""
    k = F.col("p_partkey")
    head = F.get(F.array(*(F.lit(x) for x in ("name", "Table 7 of it", "References", "[1]"))), (k % 4).cast("int"))
    headers = F.array(head, F.lit("size"), F.lit("price"))
    one = F.array(F.col("p_name"), F.col("p_size").cast("string"), F.lit(""))
    two = F.array(F.when(k % 4 == 3, F.lit("[2]")).otherwise(F.col("p_type")), F.when(k % 5 == 0, F.lit("")).otherwise(F.lit("7.5")), F.col("p_brand"))
    return t.part.select("p_partkey", F.floor(k / 6).alias("doc_id"), k.alias("ord"), (k % 3).cast("int").alias("page"), headers.alias("headers"), F.array(one, two).alias("rows"), (k % 10 / 10.0).alias("quality"), F.lit("grid").alias("source"))


_TABLES = """tables AS (SELECT p_partkey, p_partkey // 6 AS doc_id, p_partkey AS ord, p_partkey % 3 AS page, [['name', 'Table 7 of it', 'References', '[1]'][(p_partkey % 4 + 1)::INT], 'size', 'price'] AS headers,
[[p_name, p_size::VARCHAR, ''], [CASE WHEN p_partkey % 4 = 3 THEN '[2]' ELSE p_type END, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '7.5' END, p_brand]] AS rows, p_partkey % 10 / 10.0::DOUBLE AS quality FROM part),
cells AS (SELECT *, list_concat(headers, flatten(rows)) AS cells FROM tables),
flags AS (SELECT *, regexp_matches(lower(trim(headers[1])), '^table\\s*\\d+') AS cap, len(list_filter(string_split_regex(array_to_string(cells, ' '), '\\s+'), lambda w: w <> '')) AS nw,
  len(regexp_extract_all(array_to_string(cells, ' '), '\\[\\d[\\d,\\s]*\\]')) AS cites, len(list_filter(rows, lambda r: regexp_full_match(trim(r[1]), '\\[\\d[\\d,\\s]*\\]'))) AS numbered FROM cells),
refs AS (SELECT *, (contains(lower(headers[1]), 'references') OR (nw > 0 AND (cites > 0.10 * nw OR numbered > 0.4 * len(rows)))) AS reference FROM flags)"""


@query(
    f"""WITH {_TABLES} SELECT p_partkey, round(len(list_filter(cells, lambda c: trim(c) <> ''))::DOUBLE / len(cells), 9) AS fill, reference, cap AS caption_header,
    nw > 0 AND len(list_filter(string_split_regex(array_to_string(cells, ' '), '\\s+'), lambda w: w <> '' AND length(w) <= 2)) <= 0.6 * nw AS valid,
    len(list_distinct(list_filter(string_split_regex(lower(array_to_string(cells, ' ')), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> ''))) AS words FROM refs"""
)
def table_measures(t: Tables) -> DataFrame:
    h, r = F.col("headers"), F.col("rows")
    return _tables(t).select(
        "p_partkey", F.round(T.fill_quality(h, r), 9).alias("fill"), T.is_reference_table(h, r).alias("reference"), T.has_caption_header(h).alias("caption_header"), T.is_valid_table(h, r).alias("valid"), F.size(T.table_words(h, r)).cast("long").alias("words")
    )


@query(
    f"""WITH {_TABLES} SELECT p_partkey, array_to_string(CASE WHEN cap THEN rows[1] ELSE headers END, '|') AS headers, (CASE WHEN cap THEN len(rows) - 1 ELSE len(rows) END)::BIGINT AS n_rows, CASE WHEN cap THEN greatest(quality, 0.6) ELSE quality END AS quality FROM refs"""
)
def caption_header_repair(t: Tables) -> DataFrame:
    x = L.repair_caption_headers(_tables(t))
    return x.select("p_partkey", F.array_join("headers", "|").alias("headers"), F.size("rows").cast("long").alias("n_rows"), "quality")


@query(
    f"""WITH RECURSIVE {_TABLES}, kept AS (SELECT doc_id, ord, page, CASE WHEN cap THEN greatest(quality, 0.6) ELSE quality END AS quality, CASE WHEN cap THEN rows[1] ELSE headers END AS headers, CASE WHEN cap THEN rows[2:] ELSE rows END AS rows FROM refs WHERE NOT reference),
    placed AS (SELECT *, regexp_matches(lower(trim(headers[1])), '^table\\s*\\d+') AS c, list_distinct(list_filter(string_split_regex(lower(array_to_string(list_concat(headers, flatten(rows)), ' ')), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY quality DESC, regexp_matches(lower(trim(headers[1])), '^table\\s*\\d+')::INT, ord) AS place FROM kept),
    pairs AS (SELECT a.doc_id, a.place AS p, b.place AS q FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND a.place < b.place WHERE len(a.headers) = len(b.headers) AND (len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) > 0.65 OR (b.c AND abs(a.page - b.page) <= 1))),
    walk AS (SELECT doc_id, 0 AS k, []::BIGINT[] AS keep FROM (SELECT DISTINCT doc_id FROM placed) UNION ALL
      SELECT w.doc_id, k + 1, CASE WHEN EXISTS (SELECT 1 FROM pairs x WHERE x.doc_id = w.doc_id AND x.q = w.k + 1 AND list_contains(w.keep, x.p)) THEN keep ELSE list_append(keep, k + 1) END FROM walk w WHERE k < (SELECT max(place) FROM placed y WHERE y.doc_id = w.doc_id)),
    last AS (SELECT doc_id, arg_max(keep, k) AS keep FROM walk GROUP BY doc_id)
    SELECT p.doc_id, p.ord FROM placed p JOIN last l ON p.doc_id = l.doc_id AND list_contains(keep, p.place)"""
)
def table_dedup(t: Tables) -> DataFrame:
    return L.distinct_tables(_tables(t), ["doc_id"]).select("doc_id", "ord")


_BORDERLESS = f"""WITH {_TABLES}, g AS (SELECT *, p_partkey % 5 AS kind FROM tables)"""


@query(
    f"""{_BORDERLESS}, covered AS (SELECT DISTINCT doc_id, page FROM g WHERE kind = 1)
    SELECT p_partkey FROM g WHERE kind <= 1 OR (kind >= 2 AND quality >= 0.78 AND len(list_filter(headers, lambda h: trim(h) <> '')) >= 2 AND len(list_filter(headers, lambda h: length(h) > 25)) = 0 AND (doc_id, page) NOT IN (SELECT (doc_id, page) FROM covered))"""
)
def table_union(t: Tables) -> DataFrame:
    x = _tables(t)
    kind = F.col("p_partkey") % 5
    return L.union_tables(x.where(kind == 0), x.where(kind == 1), x.where(kind >= 2)).select("p_partkey")


@query(
    f"""WITH {_TABLES}, f AS (SELECT *, list_filter(flatten(rows), lambda c: trim(c) <> '') AS own FROM cells)
    SELECT p_partkey, (len(list_filter(cells, lambda c: trim(c) <> ''))::DOUBLE / len(cells) < 0.25) OR len(list_filter(headers, lambda h: length(h) > 10 AND NOT contains(h, ' '))) >= 0.5 * 3 OR list_sum(list_transform(headers, lambda h: len(string_split(h, ' ')))) > 15
    OR list_sum(list_transform(own, lambda c: len(string_split(c, ' ')))) > 7 * len(own) OR len(list_filter(own, lambda c: regexp_matches(c, '\\d'))) = 0 AS rejected FROM f"""
)
def borderless_rejects(t: Tables) -> DataFrame:
    return _tables(t).select("p_partkey", T.is_rejected_borderless(F.col("headers"), F.col("rows")).alias("rejected"))


@query(
    r"""WITH c AS (SELECT p_partkey, unnest([p_name, p_type, 'x', 'a=1', 'tin', p_name || ' and ' || p_type || ' and more words yet', 'unwieldy']) AS v, unnest(range(7)) AS k FROM part), s AS (SELECT *, trim(lower(v)) AS s FROM c)
    SELECT p_partkey, k, CASE WHEN length(s) BETWEEN 4 AND 80 AND len(string_split_regex(s, '\s+')) <= 6 AND NOT (len(string_split_regex(s, '\s+')) = 1 AND NOT regexp_matches(s, '\d|[%=+\-/]') AND length(s) < 8) THEN s END AS cell FROM s"""
)
def table_fingerprints(t: Tables) -> DataFrame:
    v = F.array("p_name", "p_type", F.lit("x"), F.lit("a=1"), F.lit("tin"), F.concat("p_name", F.lit(" and "), "p_type", F.lit(" and more words yet")), F.lit("unwieldy"))
    return t.part.select("p_partkey", F.posexplode(v).alias("k", "v")).select("p_partkey", F.col("k").cast("long").alias("k"), T.kept_cell(F.col("v")).alias("cell"))


@query(
    """WITH n AS (SELECT list(lower(n_name)) AS c FROM nation), x AS (SELECT item_id, c, CASE WHEN item_id % 2 = 0 THEN text ELSE array_to_string(c[1:(item_id % 7)::INT], ' ') || ' ' || substr(text, 1, 40 * (item_id % 7)) END AS t FROM benchmark, n), h AS (SELECT item_id, t, len(list_filter(c, lambda x: contains(lower(trim(replace(t, chr(10), ' '))), x))) AS hits FROM x)
    SELECT item_id, length(t) >= 20 AND hits >= 4 AND (length(t) <= 200 OR length(t) <= 60 * hits) AS table_data FROM h"""
)
def table_data_paragraphs(t: Tables) -> DataFrame:
    cells = t.nation.orderBy("n_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", F.lower("n_name").alias("c")))), lambda x: x["c"]).alias("c"))
    k = (F.col("item_id") % 7).cast("int")
    text = F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(F.concat(F.array_join(F.slice("c", F.lit(1), k), " "), F.lit(" "), F.substr("text", F.lit(1), 40 * k)))
    return t.benchmark.crossJoin(F.broadcast(cells)).select("item_id", T.is_table_data(text, F.col("c")).alias("table_data"))  # one row of 25 names


_SCAN = "Intro words\nTable {k}: on {n}\nname  size  price\n{n}  {s}  1.5\nx\nzeta  2  3.5\nloose words here\nomega  4  5\n\n\nAfter that comes prose"


@query(
    """SELECT p_partkey AS doc_id, p_size % 9 AS num, 'Table ' || p_size % 9 || ': on ' || p_name AS caption, p_name || '|' || p_size || '|1.5x' AS headers, 'omega' AS last_name, 3::BIGINT AS n_rows, 'zeta|2|3.5' AS first_row FROM part"""
)
def caption_anchored_tables(t: Tables) -> DataFrame:
    text = F.replace(F.replace(F.replace(F.lit(_SCAN), F.lit("{k}"), (F.col("p_size") % 9).cast("string")), F.lit("{n}"), F.col("p_name")), F.lit("{s}"), F.col("p_size").cast("string"))
    x = L.caption_tables(t.part.select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page"), text.alias("text")))
    cells = lambda r: F.array_join(F.filter(r, lambda c: c != ""), "|")
    return x.select("doc_id", "num", "caption", cells(F.element_at("rows", 1)).alias("first_row"), F.get(F.element_at("rows", -1), 0).alias("last_name"), F.size("rows").cast("long").alias("n_rows"), cells(F.col("headers")).alias("headers"))


@query("WITH c AS (SELECT s_suppkey // 4 AS doc_id, s_suppkey AS ord, s_suppkey % 2 AS page, 'Table ' || s_suppkey % 4 || ': of ' || s_name AS text FROM supplier) SELECT doc_id, (ord % 4)::INT AS num, page::INT AS page, text FROM c WHERE ord % 4 > 0 OR true")
def page_captions(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    b = t.supplier.select(F.floor(k / 4).alias("doc_id"), k.alias("ord"), (k % 2).cast("int").alias("page"), F.lit(1.0).alias("y"), F.concat(F.lit("Table "), k % 4, F.lit(": of "), "s_name").alias("text"))
    return L.page_captions(b, ["doc_id"]).select("doc_id", "num", "page", "text")


@query(
    """WITH RECURSIVE g AS (SELECT s_suppkey // 4 AS doc_id, s_suppkey AS ord, s_suppkey % 2 AS page FROM supplier), c AS (SELECT s_suppkey // 4 AS doc_id, s_suppkey % 4 AS num, (s_suppkey // 2) % 2 AS page, s_name AS text FROM supplier WHERE s_suppkey % 4 < 3),
    t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM g),
    walk AS (SELECT doc_id, 0 AS k, []::BIGINT[] AS used, NULL::BIGINT AS got FROM (SELECT DISTINCT doc_id FROM t) UNION ALL
      SELECT doc_id, k, list_append(used, coalesce(got, -1)), got FROM (SELECT w.doc_id, t.k, w.used, (SELECT arg_min(c.num, (c.page <> t.page)::INT * 1000 + c.page * 100 + c.num) FROM c WHERE c.doc_id = w.doc_id AND NOT list_contains(w.used, c.num)) AS got FROM walk w JOIN t ON t.doc_id = w.doc_id AND t.k = w.k + 1))
    SELECT t.doc_id, t.ord, c.text AS caption FROM walk w JOIN t ON t.doc_id = w.doc_id AND t.k = w.k LEFT JOIN c ON c.doc_id = w.doc_id AND c.num = w.got"""
)
def table_captions(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    doc = F.floor(k / 4).alias("doc_id")
    tables = t.supplier.select(doc, k.alias("ord"), (k % 2).cast("int").alias("page"))
    captions = t.supplier.where(k % 4 < 3).select(doc, (k % 4).cast("int").alias("num"), (F.floor(k / 2) % 2).cast("int").alias("page"), F.lit(1.0).alias("y"), F.col("s_name").alias("text"))
    return L.assign_captions(tables, captions, ["doc_id"]).select("doc_id", "ord", "caption")


@query("SELECT p_partkey AS doc, 0::BIGINT AS first, 'name|size' AS headers, p_name AS cell FROM part WHERE p_partkey % 3 <> 2")
def text_block_tables(t: Tables) -> DataFrame:
    """Two blocks with numbers in a row are a table; one alone isn't."""
    k = F.col("p_partkey")
    wide = F.array(F.lit("name   size   1 2 3"), F.concat("p_name", F.lit("   7   2 3 4")), F.lit("only words"))
    alone = F.array(F.lit("name   size   1 2 3"), F.lit("only words"), F.lit("only words"))
    b = t.part.select(k.alias("doc"), F.posexplode(F.when(k % 3 == 2, alone).otherwise(wide)).alias("ord", "text"))
    x = L.text_tables(b.withColumn("ord", F.col("ord").cast("long")), ["doc"])
    return x.select("doc", "first", F.array_join(F.slice("headers", 1, 2), "|").alias("headers"), F.element_at(F.element_at("rows", 1), 1).alias("cell"))


@query("SELECT p_partkey AS page, (k % 2)::BIGINT AS c, (k // 2)::BIGINT AS r, p_name || CASE k WHEN 0 THEN '' ELSE ' ' || k END AS text FROM part, (SELECT unnest(range(4)) AS k)")
def word_grids(t: Tables) -> DataFrame:
    k = F.col("k")
    w = t.part.select(F.col("p_partkey").alias("page"), "p_name", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    words = w.select("page", (k + 0).alias("ord"), (100.0 * (k % 2) + F.col("page") % 3).alias("x0"), (50.0 * F.floor(k / 2) + F.col("page") % 2).alias("top"), F.when(k == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" "), k)).alias("text"))
    return L.word_grid(words, ["page"]).select("page", F.col("c").cast("long").alias("c"), F.col("r").cast("long").alias("r"), "text")


@query("SELECT s_suppkey AS page, k, (k % (1 + s_suppkey % 3))::INT AS col FROM supplier, (SELECT unnest(range(12)) AS k)")
def detected_columns(t: Tables) -> DataFrame:
    """One, two or three well separated columns."""
    n = 1 + F.col("s_suppkey") % 3
    b = t.supplier.select(F.lit(1).alias("doc"), F.col("s_suppkey").alias("page"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k"), n.alias("n"))
    b = b.select("doc", "page", F.col("k").cast("long").alias("k"), (200.0 * (F.col("k") % F.col("n")) + F.when(F.col("n") == 1, 0).otherwise(F.col("k") % 5)).alias("x"))
    return L.detect_columns(b, ["doc"]).select("page", "k", "col")


# Sections and documents

_TREE = ["Overview", "Abstract", "1 Introduction", "1.1 Data", "1.1.1 Deep", "1.2 More", "II. Method", "2.1 Parts", "B Proofs", "B.1 Lemma", "Closing"]
_TREE_IDS = ["S1", "abstract", "S2", "S2.SS1", "S2.SS1.SSS1", "S2.SS2", "S3", "S3.SS1", "AB", "AB.SS1", "S4"]


@query(f"SELECT n_nationkey AS doc_id, k AS ord, [{quoted(_TREE_IDS)}][k + 1] AS sec_id FROM nation, (SELECT unnest(range({len(_TREE)})) AS k)")
def section_tree_ids(t: Tables) -> DataFrame:
    s = t.nation.select(F.col("n_nationkey").alias("doc_id"), F.posexplode(F.array(*(F.lit(x) for x in _TREE))).alias("ord", "heading"))
    return H.section_tree(s.withColumn("ord", F.col("ord").cast("long"))).select("doc_id", "ord", "sec_id")


@query(
    """SELECT p_partkey AS doc_id, ord::INT AS ord, type, text FROM (SELECT p_partkey, 0 AS ord, 'paragraph' AS type, 'It begins with ' || p_name || ' and goes on.' AS text FROM part UNION ALL SELECT p_partkey, 1, 'paragraph', '• a point' FROM part UNION ALL SELECT p_partkey, 2, 'figure', 'Figure 1: ' || p_name FROM part UNION ALL SELECT p_partkey, 3, 'paragraph', 'The end, all of it.' FROM part)"""
)
def paragraph_merge(t: Tables) -> DataFrame:
    line = lambda k, kind, *text: F.struct(F.lit(k).alias("ord"), F.lit(kind).alias("type"), F.concat(*text).alias("text"))
    name = F.col("p_name")
    rows = F.array(
        line(0, "paragraph", F.lit("It begins with")), line(1, "paragraph", name), line(2, "paragraph", F.lit("  and goes on .")), line(3, "paragraph", F.lit("• a point")), line(4, "figure", F.lit("Figure 1: "), name),
        line(5, "paragraph", F.lit("The end ,")), line(6, "paragraph", F.lit("all of it ."))
    )
    content = t.part.select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("section_ord"), F.lit("1 One").alias("heading"), F.explode(rows).alias("x")).select("doc_id", "section_ord", "heading", "x.*")
    return L.merged_paragraphs(content).select("doc_id", "ord", "type", "text")


@query(
    """SELECT p_partkey AS doc_id, section_ord::BIGINT AS section_ord, heading, type, text, caption FROM (SELECT p_partkey, 1 AS section_ord, '1 Introduction' AS heading, 'paragraph' AS type, 'We write at some length about ' || p_name || ' and what it is good for.' AS text, NULL AS caption FROM part
    UNION ALL SELECT p_partkey, 2, '2 Results', 'table', NULL, 'Table 1: on ' || p_name FROM part UNION ALL SELECT p_partkey, 2, '2 Results', 'figure', 'Figure 4: a picture of something quite large and grey, seen here.', NULL FROM part)"""
)
def structured_documents(t: Tables) -> DataFrame:
    """Title, headings, paragraph, figure and a table with its caption; what repeats the table's cells goes."""
    name = F.col("p_name")
    texts = [
        F.concat(F.lit("On the nature of "), name), F.lit("1 Introduction"), F.concat(F.lit("We write at some length about "), name, F.lit(" and what it is good for.")), F.lit("2 Results"), F.concat(F.lit("Table 1: on "), name),
        F.lit("alpha one 1, beta two 2, gamma three 3, delta four 4 and that is all."), F.lit("Figure 4: a picture of something quite large and grey, seen here."),
    ]
    b = t.part.select(F.col("p_partkey").alias("doc_id"), F.posexplode(F.array(*texts)).alias("k", "text"))
    b = b.select("doc_id", F.col("k").cast("long").alias("ord"), F.lit(1).alias("page"), F.lit(10.0).alias("x"), (50.0 * F.col("k") + 100).alias("y"), F.lit(None).cast("int").alias("col"), "text")
    rows = F.array(*(F.array(F.lit(a), F.lit(x)) for a, x in (("beta two 2", "x"), ("gamma three 3", "y"), ("delta four 4", "z"))))
    tables = t.part.select(F.col("p_partkey").alias("doc_id"), F.lit(0).cast("long").alias("ord"), F.lit(1).alias("page"), F.array(F.lit("alpha one 1"), F.lit("v")).alias("headers"), rows.alias("rows"))
    return L.structured_blocks(b, tables).select("doc_id", "section_ord", "heading", "type", "text", "caption")


@query(
    r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '') AS w FROM documents), n AS (SELECT doc_id, unnest(w) AS w, (len(w) + 499) // 500 AS chunks FROM w WHERE len(w) > 0)
    SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS d, round(count(*)::DOUBLE / any_value(chunks), 9) AS x FROM n GROUP BY 1, 2"""
)
def hashed_document_vectors(t: Tables) -> DataFrame:
    v = H.hashed_vectors(t.documents, "doc_id", "text")
    return v.select(F.col("id").alias("doc_id"), F.posexplode("v").alias("d", "x")).where("x > 0").select("doc_id", F.col("d").cast("long").alias("d"), F.round("x", 9).alias("x"))


@query("SELECT vec_id, round(0.6 * embedding[1]::DOUBLE + 0.2 * embedding[2]::DOUBLE + 0.2 * embedding[3]::DOUBLE, 6) AS combined FROM embeddings")
def combined_scores(t: Tables) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    s = t.embeddings.select("vec_id", F.get(e, 0).alias("cosine"), F.get(e, 1).alias("edit"), F.get(e, 2).alias("structure"))
    return H.combined_similarity(s).select("vec_id", F.round("combined", 6).alias("combined"))


@query("SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))), 9) AS jaccard FROM (SELECT item_id, list_distinct(string_split(text, ' ')) AS w FROM benchmark) a JOIN (SELECT item_id, list_distinct(string_split(text, ' ')) AS w FROM benchmark) b ON b.item_id = a.item_id + 1")
def word_jaccard(t: Tables) -> DataFrame:
    b = t.benchmark.select("item_id", F.split("text", " ").alias("w"))
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("b"), F.col("w").alias("w2"))
    return b.join(other, "item_id").select(F.col("item_id").alias("a"), "b", F.round(T.jaccard(F.col("w"), F.col("w2")), 9).alias("jaccard"))


# Scores


@query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM e), o AS (SELECT e FROM e WHERE vec_id = 0)
    SELECT vec_id, round(n.n, 6) AS norm, round(list_cosine_similarity(n.e, o.e), 6) + 0.0 AS cosine, round(n.e[1] / n.n, 6) + 0.0 AS first FROM n, o"""
)
def vector_norms(t: Tables) -> DataFrame:
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    one = e.where("vec_id = 0").select(F.col("v").alias("o"))
    x = e.crossJoin(F.broadcast(one))  # one row
    return x.select("vec_id", F.round(X.norm(F.col("v")), 6).alias("norm"), (F.round(X.cosine(F.col("v"), F.col("o")), 6) + 0.0).alias("cosine"), (F.round(F.get(X.unit(F.col("v")), 0), 6) + 0.0).alias("first"))


_NEGATIVES = "SELECT vec_id, embedding[1]::DOUBLE * 9 AS p, list_transform(embedding[2:9]::DOUBLE[], lambda x: x * 9) AS q FROM embeddings"


@query(f"SELECT vec_id, round(list_avg(list_transform(q, lambda x: greatest(0, 1.0 - p + x))), 6) AS loss FROM ({_NEGATIVES})")
def margin_losses(t: Tables) -> DataFrame:
    e = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 9)
    x = t.embeddings.select("vec_id", F.get(e, 0).alias("p"), F.explode(F.slice(e, 2, 8)).alias("q"))
    return x.groupBy("vec_id").agg(F.round(F.avg(X.margin_loss(F.col("p"), F.col("q"))), 6).alias("loss"))


@query(
    f"""WITH x AS ({_NEGATIVES}), w AS (SELECT *, list_transform(q, lambda s: exp(0.5 * s)) AS w FROM x)
    SELECT vec_id, round((ln(1 + exp(-(9.0 + p))) + list_dot_product(w, list_transform(q, lambda s: ln(1 + exp(9.0 + s)))) / list_sum(w)) / 2, 6) AS loss, round((ln(1 + exp(-(9.0 + p))) + list_avg(list_transform(q, lambda s: ln(1 + exp(9.0 + s))))) / 2, 6) AS uniform FROM w"""
)
def adversarial_losses(t: Tables) -> DataFrame:
    e = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 9)
    p, q = F.get(e, 0), F.slice(e, 2, 8)
    return t.embeddings.select("vec_id", F.round(X.adversarial_loss(p, q, 9.0, 0.5), 6).alias("loss"), F.round(X.adversarial_loss(p, q, 9.0, 0.0), 6).alias("uniform"))


@query(
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity, [l_quantity, l_tax * 100, l_quantity + 10, l_tax * 100 + 5] AS a, [20.0, 2.0, 35.0, 6.0] AS b FROM lineitem), i AS (SELECT *, greatest(least(a[3], b[3]) - greatest(a[1], b[1]), 0) * greatest(least(a[4], b[4]) - greatest(a[2], b[2]), 0) AS i FROM b)
    SELECT l_orderkey, l_linenumber, l_quantity, round(i / (50 + 60 - i), 6) AS iou, CASE WHEN i > 0 THEN round(greatest(a[1], b[1]), 6) END AS crop_x0 FROM i"""
)
def box_overlaps(t: Tables) -> DataFrame:
    q, y = F.col("l_quantity"), F.col("l_tax") * 100
    a, b = F.array(q, y, q + 10, y + 5), F.array(*(F.lit(x) for x in (20.0, 2.0, 35.0, 6.0)))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", F.round(X.box_iou(a, b), 6).alias("iou"), F.round(F.get(X.box_crop(a, b), 0), 6).alias("crop_x0"))


@query("SELECT part, count(*) AS n, sum(hit)::BIGINT AS hits FROM (SELECT CASE WHEN ('0x' || substr(md5('7:' || vec_id), 1, 8))::BIGINT % 1000000 < 300000 THEN 'val' ELSE 'test' END AS part, (label % 2)::BIGINT AS hit FROM embeddings) GROUP BY part")
def hashed_splits(t: Tables) -> DataFrame:
    part = F.when(R.hashed_split(F.col("vec_id"), 0.3, 7), "val").otherwise("test")
    return t.embeddings.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum((F.col("label") % 2).cast("long")).alias("hits"))


@query("WITH h AS (SELECT doc_id, source, ('0x' || substr(md5('3:' || doc_id), 1, 8))::BIGINT AS h FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS r FROM h) SELECT doc_id, source FROM r WHERE r <= 4 ORDER BY h, doc_id LIMIT 30")
def stratified_sample(t: Tables) -> DataFrame:
    return R.sampled_by_stratum(t.documents.select("doc_id", "source"), "source", "doc_id", 4, 30, 3)


@query(with_sql("cites") + ", d AS (SELECT x, count(*) AS n FROM (SELECT src AS x FROM cites UNION ALL SELECT dst FROM cites) GROUP BY x) SELECT 'paper:' || o_orderkey AS node FROM orders JOIN d ON x = o_orderkey WHERE o_orderstatus <> 'P'")
def eligible_papers(t: Tables) -> DataFrame:
    nodes, cites = _graph(t)
    return G.eligible_papers(nodes, cites.where("relation = 'cites'"))


def _graph(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Papers (of status P: stubs), part entities; citations, mentions and supply edges."""
    paper = lambda c: F.concat(F.lit("paper:"), c)
    part = lambda c: F.concat(F.lit("part "), c)
    nodes = t.orders.select(paper("o_orderkey").alias("node"), F.when(F.col("o_orderstatus") == "P", "paper_stub").otherwise("paper").alias("type"), F.lit(None).cast("string").alias("label"))
    nodes = nodes.union(t.part.select(part("p_partkey"), F.lit("entity"), F.col("p_name")))
    c = derived.cites(t).select(paper("src").alias("src"), paper("dst").alias("dst"), F.lit("cites").alias("relation"))
    m = derived.mentions(t).select(paper("src").alias("src"), part("dst").alias("dst"), F.lit("mentions").alias("relation"))
    near = t.part.select(part("p_partkey").alias("src"), part(F.col("p_partkey") + 1).alias("dst"), F.lit("next to").alias("relation"))
    return nodes, c.union(m).union(near)


_NEXT = "near AS (SELECT 'part ' || p_partkey AS h, 'part ' || p_partkey + 1 AS t FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part))"


@query(with_sql("cites", "mentions") + f", {_NEXT} SELECT mode, r, count(*) AS n, md5(string_agg(h || t, ',' ORDER BY h, t)) AS digest FROM (SELECT 'citation' AS mode, 'paper:' || src AS h, 'cites' AS r, 'paper:' || dst AS t FROM cites UNION ALL SELECT 'augmented', 'paper:' || src, 'cites', 'paper:' || dst FROM cites UNION ALL SELECT 'augmented', 'paper:' || src, 'mentions', 'part ' || dst FROM mentions UNION ALL SELECT 'augmented', h, 'next to', t FROM near) WHERE r <> 'mentions' OR h LIKE '%7' GROUP BY mode, r")
def flattened_graphs(t: Tables) -> DataFrame:
    nodes, edges = _graph(t)
    both = [G.flattened(nodes, edges, m).select(F.lit(m).alias("mode"), "h", "r", "t") for m in ("citation", "augmented")]
    x = both[0].union(both[1]).where("r <> 'mentions' or h like '%7'")
    return x.groupBy("mode", "r").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h", "t"))), lambda z: F.concat(z["h"], z["t"])), ",")).alias("digest"))


@query(with_sql("cites") + ", d AS (SELECT x, count(*) AS degree FROM (SELECT src AS x FROM cites UNION ALL SELECT dst FROM cites) GROUP BY x) SELECT 'paper:' || o_orderkey AS node, coalesce(degree, 0) AS degree, CASE WHEN coalesce(degree, 0) <= 2 THEN 'low' WHEN degree <= 6 THEN 'mid' ELSE 'high' END AS colour, least(10 + 2 * coalesce(degree, 0), 40) AS size FROM orders LEFT JOIN d ON x = o_orderkey")
def graph_view(t: Tables) -> DataFrame:
    nodes, edges = _graph(t)
    return G.view_projection(nodes.where("type <> 'entity'"), edges.where("relation = 'cites'")).select("node", "degree", "colour", "size")


@query(
    with_sql("cites")
    + """, walk AS (SELECT o_orderkey AS node, 0 AS hop, 1::BIGINT AS seen FROM orders WHERE o_orderkey % 500 = 0),
    one AS (SELECT dst AS node, min(src) AS via FROM cites WHERE src IN (SELECT node FROM walk) AND dst NOT IN (SELECT node FROM walk) GROUP BY dst ORDER BY node LIMIT 20),
    two AS (SELECT dst AS node FROM cites WHERE src IN (SELECT node FROM one) AND dst NOT IN (SELECT node FROM walk) AND dst NOT IN (SELECT node FROM one) GROUP BY dst ORDER BY node LIMIT 20)
    SELECT node, 0::INT AS hop FROM walk UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two"""
)
def snowball_crawl(t: Tables) -> DataFrame:
    c = derived.cites(t)
    seeds = t.orders.where("o_orderkey % 500 = 0").select(F.col("o_orderkey").alias("node"))
    return G.snowball(lambda front: c.join(front.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")), seeds, depth=2, most_new=20)


@query("SELECT l_orderkey AS paper_id, count(*) AS citation_count FROM lineitem GROUP BY 1 ORDER BY citation_count DESC, paper_id LIMIT 25")
def most_cited_papers(t: Tables) -> DataFrame:
    return C.most_cited(t.lineitem.groupBy(F.col("l_orderkey").alias("paper_id")).agg(F.count("*").alias("citation_count")), 25)


# Names and ids


@query(f"WITH {_FORMS}, x AS (SELECT s_suppkey AS id, 'made in ' || lower(n_name) || ' by ' || lower(s_name) || ' of ' || lower(substr(n_name, 1, 3)) || '-base' AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT DISTINCT id, lower(canonical) AS canonical FROM x JOIN forms ON contains(' ' || text || ' ', ' ' || form || ' ') OR (contains(' ' || text, ' ' || form || '-'))")
def names_in_texts(t: Tables) -> DataFrame:
    low = F.lower("n_name")
    x = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.concat(F.lit("made in "), low, F.lit(" by "), F.lower("s_name"), F.lit(" of "), F.substring(low, 1, 3), F.lit("-base")).alias("text"))
    return D.mentioned(x, D.surface_forms(_entities(t))).select("id", F.lower("canonical").alias("canonical")).distinct()


@query("SELECT p_partkey AS title_id, CASE WHEN p_partkey % 2 = 0 THEN 'a' || p_partkey WHEN p_partkey % 3 = 0 THEN 'b' || p_partkey WHEN p_partkey % 5 = 0 THEN 'c' || p_partkey END AS paper_id FROM part")
def tiered_ids(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    tier = lambda n, letter: t.part.where(k % n == 0).select(k.alias("title_id"), F.concat(F.lit(letter), k).alias("paper_id"))
    return D.resolve_ids(t.part.select(k.alias("title_id")), tier(2, "a"), tier(3, "b"), tier(5, "c"))


@query(
    f"""WITH e AS (SELECT p_partkey AS ord, p_name AS name, p_type AS raw_type, 'p' || (p_partkey % 7) AS paper_id FROM part), seeds AS (SELECT 'p' || (p_partkey % 7) AS paper_id, min(upper(p_name)) AS entity FROM part WHERE p_size = 7 GROUP BY ALL),
    totals AS (SELECT paper_id, name, count(*) AS total, arg_max(raw_type, -ord) AS first_type FROM e GROUP BY 1, 2), own AS (SELECT paper_id, lower(entity) AS key, 1000000 AS total, 'seed' AS src FROM seeds)
    SELECT * FROM own UNION ALL SELECT paper_id, lower(name), total, 'body' FROM totals t WHERE (paper_id, lower(name)) NOT IN (SELECT (paper_id, key) FROM own) AND string_split(lower(name), ' ')[1] NOT IN ({quoted(V.GENERIC_LEADING)})"""
)
def seeds_win(t: Tables) -> DataFrame:
    paper = F.concat(F.lit("p"), F.col("p_partkey") % 7).alias("paper_id")
    body = t.part.groupBy(paper, F.col("p_name").alias("name"), F.col("p_type").alias("raw_type")).agg(F.count("*").alias("cnt"), F.min("p_partkey").alias("ord"))
    seeds = t.part.where("p_size = 7").groupBy(paper).agg(F.min(F.upper("p_name")).alias("entity")).select("paper_id", "entity", F.lit("").alias("abbreviation"), F.lit("seed").alias("raw_type"), F.lit("Model").alias("ceo_type"))
    x = D.entity_rows(seeds, body, None, hard_only=False)
    return x.select("paper_id", "key", "total", F.when(F.col("raw_type") == "seed", "seed").otherwise("body").alias("src"))


_KINDS = ["Method", "Generic", "Metric", "Unheard", "", "Material"]


@query("SELECT p_partkey, " + case_sql("p_partkey", ["'Method'", "NULL", "'EvaluationMetric'", "'Unheard'", "'Other'", "'Resource'"]) + " AS ceo_type FROM part WHERE p_partkey % 6 <> 1")
def mapped_types(t: Tables) -> DataFrame:
    body = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("paper_id"), F.concat(F.lit("name "), "p_partkey").alias("name"), dealt("p_partkey", _KINDS).alias("raw_type"), F.lit(1).cast("long").alias("cnt"), F.col("p_partkey").alias("ord"))
    seeds = t.spark.createDataFrame([], "paper_id string, entity string, abbreviation string, raw_type string, ceo_type string")
    x = D.entity_rows(seeds, body, V.SCIERC_TYPES, hard_only=False)
    return x.select(F.substr("paper_id", F.lit(2)).cast("long").alias("p_partkey"), "ceo_type")


# Registers and logs


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'a') AND p_type = (SELECT min(p_type) FROM part) AND p_size % 2 = 1 OR false")
def registry_filters(t: Tables) -> DataFrame:
    r = t.part.select("p_partkey", F.lit(None).cast("string").alias("id"), F.col("p_type").alias("domain"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 2 == 1, True).alias("processed"))
    first = t.part.agg(F.min("p_type")).first()[0]  # one row
    return RD.search_registry(r, "A", first, True).where(F.contains(F.lower("title"), F.lit("a"))).select("p_partkey")


@query("SELECT p_partkey AS id, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AS processed FROM part")
def registry_sync(t: Tables) -> DataFrame:
    r = t.part.select(F.col("p_partkey").alias("id"), F.lit(None).cast("boolean").alias("processed"))
    return RD.synced_registry(r, t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("id")))


@query("WITH k AS (SELECT lower(trim(p_name)) AS t, max(p_partkey) AS i FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_partkey ELSE i END AS paper_id FROM part LEFT JOIN k ON t = lower(trim(p_name))")
def kept_ids(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    parsed = t.part.select("p_partkey", F.when(k % 5 == 0, k).alias("paper_id"), F.upper("p_name").alias("title"))
    return RD.keep_ids(parsed, t.part.where(k % 2 == 0).select(k.alias("paper_id"), F.concat(F.lit(" "), "p_name").alias("title"))).select("p_partkey", "paper_id")


_LOG = "log AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)"


def _log(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("paper_id"), F.col("event_id").alias("ran_at"), (F.col("event_type") != "click").alias("success"), F.col("event_type").alias("status"))


@query(f"WITH {_LOG} SELECT user_id AS paper_id, event_id AS ran_at, event_type AS status FROM log WHERE r = 1")
def latest_runs(t: Tables) -> DataFrame:
    return WR.latest_runs(_log(t)).select("paper_id", "ran_at", "status")


@query(f"WITH {_LOG} SELECT event_type AS status, count(*) AS n FROM log WHERE r = 1 GROUP BY 1")
def outcome_counts(t: Tables) -> DataFrame:
    return WR.outcome_counts(_log(t))


@query(f"WITH {_LOG}, p AS (SELECT DISTINCT user_id FROM events UNION SELECT -c_custkey FROM customer) SELECT user_id AS paper_id, again FROM p, (SELECT unnest([true, false]) AS again) WHERE user_id % 4 <> 0 AND (again OR user_id NOT IN (SELECT user_id FROM log WHERE r = 1 AND event_type = 'click'))")
def papers_to_run(t: Tables) -> DataFrame:
    papers = t.events.select(F.col("user_id").alias("paper_id")).union(t.customer.select(-F.col("c_custkey"))).distinct()
    done = papers.where("paper_id % 4 = 0")
    runs = [WR.to_run(papers, _log(t), done, again).withColumn("again", F.lit(again)) for again in (True, False)]
    return runs[0].union(runs[1])


@query("SELECT event_type, n, repeat('█', floor(n / (SELECT max(n) FROM (SELECT count(*) AS n FROM events GROUP BY event_type))::DOUBLE * 40)::INT) AS bar FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)")
def report_bars(t: Tables) -> DataFrame:
    return WR.bars(t.events.groupBy("event_type").agg(F.count("*").alias("n")), "event_type", "n")


@query("SELECT p_brand AS kind, 'f' || arg_max(p_partkey, p_size::BIGINT * 100000000 + p_partkey) AS path FROM (SELECT *, 'f' || p_partkey AS path FROM part) GROUP BY 1")
def newest_outputs(t: Tables) -> DataFrame:
    f = t.part.select(F.col("p_brand").alias("kind"), F.concat(F.lit("f"), F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("path"), F.col("p_size").alias("modified"))
    return RD.newest_output(f, ["kind"]).select("kind", F.concat(F.lit("f"), F.substr("path", F.lit(2)).cast("long")).alias("path"))


@query("SELECT l_orderkey, 's' || arg_min(l_suppkey, l_linenumber::BIGINT * 1000000 + l_suppkey) AS path FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY 1")
def first_existing_paths(t: Tables) -> DataFrame:
    c = t.lineitem.select("l_orderkey", F.concat(F.lit("s"), "l_suppkey").alias("path"), (F.col("l_linenumber") * 1000000 + F.col("l_suppkey")).alias("priority"))
    there = t.supplier.where("s_suppkey % 3 <> 0").select(F.concat(F.lit("s"), "s_suppkey").alias("path"))
    return RD.first_existing(c, there, ["l_orderkey"])


@query("SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN '2020.acl-' || p_size || '.' || p_partkey ELSE 'P' || lpad((p_size % 30)::VARCHAR, 2, '0') || '-' || p_size || lpad(p_partkey::VARCHAR, greatest(1, 4 - length(p_size::VARCHAR), length(p_partkey::VARCHAR))::INT, '0') END AS id FROM part")
def collection_ids(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("string")
    c = F.when(F.col("p_partkey") % 2 == 0, F.lit("2020.acl")).otherwise(F.concat(F.lit("P"), F.lpad((F.col("p_size") % 30).cast("string"), 2, "0")))
    return t.part.select("p_partkey", RD.collection_id(c, size, F.col("p_partkey").cast("string")).alias("id"))


@query(
    "WITH y AS (SELECT unnest(range(2020, 2026)) AS y) SELECT l || lpad(k::VARCHAR, 2, '0') || '.xml' AS name FROM (SELECT unnest(['P', 'N']) AS l), (SELECT unnest(range(25)) AS k) UNION SELECT y || '.' || lower(r_name) || '.xml' FROM y, region UNION SELECT y || '.acl-' || t || '.xml' FROM y, (SELECT unnest(['long', 'short']) AS t)"
)
def collection_files(t: Tables) -> DataFrame:
    venues = [r["r"] for r in t.region.select(F.lower("r_name").alias("r")).orderBy("r").collect()]  # five rows
    return RD.collection_file_names(t.spark, ["P", "N"], venues, ["acl"], ["long", "short"])
