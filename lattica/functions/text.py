"""Text rules as Column expressions. Each takes and returns Columns, so that Catalyst can push, prune and fuse them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica import vocab as V

WORD = r"[^\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    """Runs of non-blanks; an empty array for a blank text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text))


def _any(text: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return out


def replaced(text: Column, pairs: dict[str, str]) -> Column:
    for a, b in pairs.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


# Cleaning


def clean_text(text: Column) -> Column:
    """Repairs extraction artefacts: soft hyphens, ligatures, broken lines, invisible signs, spacing."""
    x = replaced(text, {"­": ""} | V.LIGATURES)
    for pattern, by in ((r"-\s*\n\s*", ""), (r"[\n\t]+", " "), ("[​‌‍﻿�]", ""), ("[‐‑]", "-"), (r" {2,}", " "), (r" ([,.;:!?])", "$1")):
        x = F.regexp_replace(x, pattern, by)
    return F.trim(x)


def clean_html_text(text: Column) -> Column:
    """Drops citation brackets, footnote digits and line-end numbers; collapses blanks."""
    x = F.regexp_replace(text, r"\([A-Z][^)]{0,60}\d{4}[a-z]?\)", "")
    x = F.regexp_replace(x, r"(?m)[¹²³⁴⁵⁶⁷⁸⁹]|\d+$", "")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def normal_text(text: Column) -> Column:
    return F.trim(replaced(text, {"­": "", "\n": " "}))


def clean_paragraph(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(normal_text(text), r"\s+", " "), r"\s+([.,;:])", "$1"))


def clean_cell(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def strip_markup(html: Column) -> Column:
    """All text of a page without scripts and styles."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", " "), r"\s+", " "))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends (trim() takes blanks alone)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_thinking(text: Column) -> Column:
    """Drops closed, then unclosed thinking blocks, then a code fence around what is left."""
    x = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    x = stripped(F.regexp_replace(x, r"(?s)<think>.*", ""))
    return stripped(F.regexp_replace(F.regexp_replace(x, r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def clean_model_output(text: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(text, r"(?i)cleaned text:\s*", ""), r"<[^>]+>", "")
    x = F.regexp_replace(x, r"\s+", " ")
    return F.trim(F.array_join(drop_repeated(F.split(x, r"(?<=[.!?])\s+")), " "))


def drop_repeated(sentences: Column) -> Column:
    """Sentences without those equal to the one kept before."""
    last = lambda acc: F.trim(F.element_at(acc, -1))
    start = F.slice(sentences, 1, 1)
    return F.aggregate(F.slice(sentences, 2, F.greatest(F.size(sentences), F.lit(1))), start, lambda acc, s: F.when(last(acc) == F.trim(s), acc).otherwise(F.concat(acc, F.array(s))))


# Names and keys


def normal_title(title: Column) -> Column:
    x = F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def lower_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), r"\s+", " "))


def entity_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def normal_entity(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.replace(F.trim(name), F.lit("_"), F.lit(" ")), r"\s+", " ")))


def display_label(name: Column) -> Column:
    x = F.trim(F.regexp_replace(F.replace(name, F.lit("_"), F.lit(" ")), r"\s+", " "))
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))


def gazetteer_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9][a-z0-9\-/+.]*"), F.lit(0))


def gazetteer_key(text: Column) -> Column:
    return F.array_join(gazetteer_tokens(text), " ")


def abbreviation(text: Column, pattern: str = r"^(.*?)\s*\(([A-Za-z0-9\-]{2,10})\)\s*$") -> tuple[Column, Column]:
    """'Full Name (ABBR)' to its name and abbreviation; else the text and an empty string."""
    hit = text.rlike(pattern)
    name = F.when(hit, F.trim(F.regexp_extract(text, pattern, 1))).otherwise(text)
    return name, F.when(hit, F.trim(F.regexp_extract(text, pattern, 2))).otherwise(F.lit(""))


STRICT_ABBREVIATION = r"^(.+?)\s*\(([A-Z][A-Z0-9\-]{1,8})\)\s*$"


def strip_punctuation(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(text), r"^[()\[\]{}\"'`:,;.!?]+|[()\[\]{}\"'`:,;.!?]+$", ""))


def detokenised_title(title: Column) -> Column:
    x = title
    for pattern, by in ((r"\s+-\s+", "-"), (r"\s+'\s+", "'"), (r"\s+([,:;])", "$1"), (r"\s{2,}", " ")):
        x = F.regexp_replace(x, pattern, by)
    return F.trim(x)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.substring(text, 1, 50), r"[^\p{L}\p{N}_\-]", "_"), r"^_+|_+$", "")


# Headings, captions, garbage


def is_references(text: Column) -> Column:
    return F.startswith(F.lower(text), F.lit("references"))


def is_figure_caption(text: Column) -> Column:
    return F.lower(F.trim(text)).rlike(r"^(figure|fig\.|table)")


def is_table_caption(text: Column) -> Column:
    return F.trim(text).rlike(r"(?i)^table\s*\d+")


def is_bullet(text: Column) -> Column:
    return F.trim(text).rlike(r"^[•\-*]")


def is_sentence_end(text: Column) -> Column:
    return text.rlike(r"[.?!:]$")


def is_heading(text: Column) -> Column:
    fits = F.length(F.trim(text)).between(5, 120)
    t = F.when(fits, F.trim(text)).otherwise("")  # no pattern runs over a long line
    w, n = words(t), n_words(t)
    first = F.get(w, 0)  # null where there is no word, as in a line of tabs
    rest = F.trim(F.regexp_extract(t, r"^\d+(?:\.\d+)*\.\s+([A-Z].*)$", 1))
    dotted = t.rlike(r"^\d+(\.\d+)*\.\s+[A-Z]") & (n_words(rest) <= 8) & ~rest.rlike(r"[.?!:;,]$")
    roman = t.rlike(r"^X{0,2}(?:IX|IV|V?I{0,3})\.?\s+[A-Z]") & (n >= 2) & first.rlike(r"^[IVXivx]{1,4}\.?$")
    appendix = t.rlike(r"^[A-Z](\.[0-9]+)*\s+[A-Z][a-z]") & F.regexp_replace(first, r"\.+$", "").rlike(r"^[A-Z](\.[0-9]+)*$") & (n <= 12)
    capitals = t.rlike(r"\p{Lu}") & (t == F.upper(t)) & ~t.rlike(r"[=+*×∗→←↔≤≥≠±∑∏∫|{}\\%@]|\d")
    shouted = capitals & (n > 1) & (n < 10) & F.exists(w, lambda x: F.length(x) > 3) & F.forall(w, lambda x: x.rlike(r"^\p{L}+$"))
    return fits & (t.rlike(r"^\d+(\.\d+)*\s+[A-Z]") | dotted | F.coalesce(roman, F.lit(False)) | F.coalesce(appendix, F.lit(False)) | shouted)


def clean_heading(text: Column) -> Column:
    t = normal_text(text)
    numbered, roman = r"^(\d+(?:\.\d+)*)\s+(.*)", r"^([IVXivx]{1,4})\.?\s+(.*)"
    return (
        F.when(t.rlike(numbered), F.concat_ws(" ", F.regexp_extract(t, numbered, 1), F.regexp_extract(t, numbered, 2)))
        .when(t.rlike(roman), F.concat_ws(" ", F.upper(F.regexp_extract(t, roman, 1)), F.regexp_extract(t, roman, 2)))
        .otherwise(t)
    )


def heading_depth(heading: Column) -> Column:
    """0 abstract, 1 section or appendix, 2 subsection, 3 below."""
    h = F.trim(heading)
    return (
        F.when(h.rlike(r"(?i)^abstract$"), 0)
        .when(h.rlike(r"^\d+\.\d+\.\d+\s+"), 3)
        .when(h.rlike(r"^\d+\.\d+\s+"), 2)
        .when(h.rlike(r"^\d+\s+") | h.rlike(r"^[IVX]{1,4}\.?\s+[A-Z]"), 1)
        .when(h.rlike(r"^[A-Z]\.\d+\s+[A-Z]"), 2)
        .otherwise(1)
    )


def heading_class(heading: Column) -> Column:
    h, depth = F.trim(heading), heading_depth(heading)
    appendix = ~h.rlike(r"^\d+\s+") & ~h.rlike(r"^[IVX]{1,4}\.?\s+[A-Z]") & h.rlike(r"^[A-Z]\s+[A-Z]")
    return F.when(depth == 0, "ltx_abstract").when(depth == 3, "ltx_subsubsection").when(depth == 2, "ltx_subsection").when(appendix, "ltx_appendix").otherwise("ltx_section")


def is_garbage(text: Column, known_share: Column | None = None) -> Column:
    """Debris rather than prose. known_share: share of known words, for texts of over 30 words."""
    t = F.trim(text)
    w, n = words(t), n_words(t)
    labels = F.forall(w, lambda x: F.regexp_replace(x, r"^[.,;:()\[\]{}]+|[.,;:()\[\]{}]+$", "").rlike(r"^[A-Z]{1,3}$"))
    stub = (n <= 7) & ~t.rlike(r"[.!?:]$")
    diagram = F.startswith(t, F.lit("Input ")) & F.contains(t, F.lit(" AE ")) & F.contains(t, F.lit(" AS "))
    digits = F.regexp_count(t, F.lit(r"\d")) > F.length(t) * 0.4
    unknown = (n > 30) & (F.coalesce(known_share, F.lit(1.0)) < 0.4) if known_share is not None else F.lit(False)
    return ~(is_heading(t) | is_references(t)) & ((n < 3) | labels | stub | diagram | digits | unknown)


def paragraph_quality(text: Column) -> Column:
    """1 less 0.3 for a broken hyphen, 0.3 for capitals, 0.2 for double blanks, 0.2 for over 80 words; 0 at least."""
    w, n = words(text), n_words(text)
    capitals = F.size(F.filter(w, lambda x: x.rlike(r"\p{Lu}") & (x == F.upper(x))))
    tenths = (
        F.lit(10)
        - F.when(text.rlike(r"[\p{L}\p{N}_]-\s+[\p{L}\p{N}_]"), 3).otherwise(0)
        - F.when(capitals > 0.3 * F.greatest(n, F.lit(1)), 3).otherwise(0)
        - F.when(F.contains(text, F.lit("  ")), 2).otherwise(0)
        - F.when(n > 80, 2).otherwise(0)
    )
    return F.greatest(tenths, F.lit(0)) / 10.0


def needs_repair(text: Column) -> Column:
    return (F.length(F.trim(text)) >= 120) & text.rlike(r"\n|[ \t]{2,}|[\p{L}\p{N}_]-[ \t]+[\p{L}\p{N}_]")


def is_layout_noise(text: Column, y: Column) -> Column:
    t = F.trim(text)
    return (F.length(t) < 3) | t.rlike(r"^\d+$") | (y < 40) | (y > 780)


def is_page_noise(text: Column) -> Column:
    t = F.trim(text)
    return (F.length(t) < 3) | t.rlike(r"^\d+(\s*/\s*\d+)?$") | F.lower(t).rlike(r"^(page|copyright)")


def is_skipped_section(heading: Column) -> Column:
    return _any(F.lower(F.trim(heading)), V.SKIPPED_SECTIONS)


def is_garbled_section(heading: Column) -> Column:
    return heading.rlike(V.GARBLED_SECTION)


# Entities and sources


def is_valid_entity(name: Column) -> Column:
    t = F.trim(name)
    bad = (
        (t.rlike(r"[=+|]") & t.rlike(r"[0-9{}()\[\]]"))
        | t.rlike(r"^\[[\p{L}\p{N}_,\s]+\]$")
        | t.rlike(r"(?i)^(theorem|lemma|proposition|corollary|assumption|definition|remark)\s*[\d.]+")
        | F.lower(t).isin(V.VAGUE_ENTITIES)
    )
    return (F.length(t) >= 3) & (n_words(t) <= 8) & ~bad & t.rlike(r"[a-zA-Z]{2,}")


def is_noise_name(name: Column, most_words: int | None = None) -> Column:
    low = F.lower(name)
    w = words(low)
    out = (F.length(name) < 3) | low.isin(V.NOISE_NAMES) | name.rlike(r"^[\d\P{L}]+$") | F.coalesce(F.get(w, 0).isin(V.GENERIC_LEADING), F.lit(False))
    return out | (F.size(w) > most_words) if most_words else out


def keeps_gazetteer_entry(key: Column, count: Column) -> Column:
    return (F.length(key) >= 3) & (F.contains(key, F.lit(" ")) | (~key.isin(V.FUNCTION_WORDS) & (count >= 2)))


def is_valid_span(text: Column) -> Column:
    """A field of a sequence model's triple: 2 to 99 characters with a letter."""
    return F.length(F.trim(text)).between(2, 99) & text.rlike("[A-Za-z]")


def is_low_quality_source(sentence: Column) -> Column:
    s = F.coalesce(sentence, F.lit(""))
    w, n = words(s), n_words(s)
    capital = F.size(F.filter(w, lambda x: x.rlike(r"^\p{Lu}")))
    commas = F.length(s) - F.length(F.replace(s, F.lit(","), F.lit("")))
    names = (capital > 0.7 * n) & (commas > 0.25 * n) & (n < 20)
    shown = s.rlike(r"(?i)^(the\s+)?(results?\s+are\s+)?(presented|shown|reported|listed)\s+in\s+(table|figure|fig\.)") | s.rlike(r"(?i)^(see\s+)?(table|figure|fig\.)\s+\d+")
    return (n < 6) | s.rlike(r"(?i)https?://|www\.|github\.com|arxiv\.org") | shown | names


def is_isa_sentence(sentence: Column) -> Column:
    return F.lower(sentence).rlike(V.IS_A)


def object_in_sentence(obj: Column, sentence: Column) -> Column:
    s, o = F.lower(sentence), F.lower(F.trim(obj))
    content = F.filter(words(o), lambda w: ~w.isin(V.OBJECT_STOPWORDS) & (F.length(w) > 2))
    found = F.size(F.filter(content, lambda w: F.contains(s, w)))
    return F.contains(s, o) | (F.size(content) == 0) | (found >= F.greatest(F.lit(1), F.floor(F.size(content) / 2)))


def looks_like_authors(text: Column) -> Column:
    return text.rlike(r"[A-Za-z]\d|[∗†‡§*]")


def paper_url(paper_id: Column) -> Column:
    """Landing page by the form of an id, first that fits."""
    return (
        F.when(paper_id.rlike(r"^\d{4}\.\d{4,5}(v\d+)?$"), F.concat(F.lit("https://arxiv.org/abs/"), paper_id))
        .when(paper_id.rlike(r"^[A-Z]\d{2}-\d{4}$") | paper_id.rlike(r"^\d{4}\.[a-z0-9\-]+-[a-z0-9]+\.\d+$"), F.concat(F.lit("https://aclanthology.org/"), paper_id))
        .when(paper_id.rlike(r"(?i)^peerj-cs-\d+$"), F.concat(F.lit("https://peerj.com/articles/"), F.lower(paper_id)))
    )


def is_valid_citation_title(title: Column, paper_id: Column) -> Column:
    low, pid = F.lower(title), F.lower(paper_id)
    return F.coalesce((F.length(title) > 8) & (low != pid) & ~F.contains(F.replace(low, F.lit(" "), F.lit("")), pid), F.lit(False))


# Extraction from text


def concept_words(text: Column, stopwords: list[str] = V.CONCEPT_STOPWORDS) -> Column:
    """Lower-case ASCII words of five letters or more that are no stopwords, in order, repeats kept."""
    return F.filter(F.split(F.lower(text), WORD), lambda w: w.rlike("^[a-z]{5,}$") & ~w.isin(stopwords))


def sentences(text: Column, least_words: int = 5, most_words: int = 80) -> Column:
    """Sentences of least_words or more; longer than most_words are cut into runs of that many."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: n_words(s) >= least_words)

    def cut(s: Column) -> Column:
        w = words(s)
        starts = F.sequence(F.lit(1), F.size(w), F.lit(most_words))
        return F.when(F.size(w) <= most_words, F.array(s)).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(most_words)), " ")))

    return F.flatten(F.transform(parts, cut))


def packed_paragraphs(parts: Column, most_chars: int = 1500) -> Column:
    """Greedy runs of sentences: a new one starts where the summed lengths would pass most_chars."""
    kind = "array<string>"
    start = F.struct(F.array().cast(kind).alias("done"), F.array().cast(kind).alias("open"), F.lit(0).alias("held"))

    def step(acc: Column, s: Column) -> Column:
        over = (F.size(acc["open"]) > 0) & (acc["held"] + F.length(s) > most_chars)
        return F.when(over, F.struct(F.concat(acc["done"], F.array(F.array_join(acc["open"], " "))).alias("done"), F.array(s).alias("open"), F.length(s).alias("held"))).otherwise(
            F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.array(s)).alias("open"), (acc["held"] + F.length(s)).alias("held"))
        )

    finish = lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["open"], " ")))).otherwise(acc["done"])
    return F.aggregate(parts, start, step, finish)


def word_chunks(text: Column, size: int = 500) -> Column:
    w = words(text)
    return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(w), F.lit(size)), lambda i: F.array_join(F.slice(w, i, F.lit(size)), " ")))


METRIC_PATTERNS = [("BLEU", r"(?i)BLEU[^0-9]{0,10}(\d+(?:\.\d+)?)"), ("accuracy", r"(?i)accuracy[^0-9]{0,10}(\d+(?:\.\d+)?)"), ("F1", r"(?i)F1[^0-9]{0,10}(\d+(?:\.\d+)?)"), ("percentage", r"(\d+(?:\.\d+)?)\s*%")]


def metric_mentions(text: Column) -> Column:
    """Array of (metric, value) found in a text."""

    def named(metric: str):
        return lambda v: F.struct(F.lit(metric).alias("metric"), v.cast("double").alias("value"))

    return F.concat(*(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), named(m)) for m, p in METRIC_PATTERNS))


def named_entities(text: Column, known: Column) -> Column:
    """Known (lower-case) names that occur, then capitalised words of three letters or more, lower-cased."""
    caps = F.transform(F.filter(F.split(text, WORD), lambda w: w.rlike("^[A-Z][a-zA-Z]{2,}$")), lambda w: F.lower(w))
    return F.array_distinct(F.concat(F.filter(known, lambda k: F.contains(F.lower(text), k)), F.filter(caps, lambda w: ~w.isin("figure", "table", "section"))))


def concepts_in(text: Column, concepts: Column) -> Column:
    return F.filter(concepts, lambda c: F.contains(F.lower(text), F.lower(c)))


def rebel_triples(text: Column) -> Column:
    """Array of (subject, predicate, object) of '<triplet> s <subj> o <obj> p' strings with valid fields."""
    body = F.regexp_replace(text, r"<s>|</s>|<pad>", "")
    parts = F.slice(F.split(body, r"<triplet>"), 2, F.lit(1 << 30))
    pattern = r"(?s)^(.*?)<subj>(.*?)<obj>(.*)$"
    field = lambda p, k: F.trim(F.regexp_extract(p, pattern, k))
    out = F.transform(parts, lambda p: F.struct(field(p, 1).alias("subject"), field(p, 3).alias("predicate"), field(p, 2).alias("object")))
    return F.filter(out, lambda t: is_valid_span(t["subject"]) & is_valid_span(t["predicate"]) & is_valid_span(t["object"]))


def bioes_tag(tag: Column) -> tuple[Column, Column]:
    """Prefix (upper case) and type (lower case) of a BIOES tag; nulls outside an entity."""
    t = F.trim(tag)
    inside = F.contains(t, F.lit("-"))
    return F.when(inside, F.upper(F.split_part(t, F.lit("-"), F.lit(1)))), F.when(inside, F.lower(F.regexp_replace(t, r"^[^-]*-", "")))


def escaped(text: Column) -> Column:
    return replaced(text, {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#x27;"})


def highlighted(text: Column, concepts: list[str]) -> Column:
    """Concepts marked, longest first; everything else escaped."""
    import re
    from html import escape

    x = escaped(text)
    for c in sorted(concepts, key=lambda c: (-len(c), c)):
        x = F.regexp_replace(x, rf"(?iU)(?<!\w)({re.escape(escape(c))})(?!\w)", '<mark class="concept">$1</mark>')
    return x


# Tables


def split_row(line: Column) -> Column:
    """Cells by wide gaps, then by double blanks, then by words and numbers."""
    wide, narrow = F.split(line, r"\s{3,}"), F.split(line, r"\s{2,}")
    cells = F.when(F.size(wide) > 1, wide).when(F.size(narrow) > 1, narrow).otherwise(F.regexp_extract_all(line, F.lit(r"[A-Za-z\-]+|\d+\.\d+|\d+"), F.lit(0)))
    return F.filter(F.transform(cells, lambda c: F.trim(c)), lambda c: c != "")


MATH = r"O\s*\([^)]+\)"


def split_columns(line: Column) -> Column:
    """Columns of a text-table row; a line without structure is one column."""
    t = F.trim(line)
    spaced = F.split(t, "  +")
    tidy = lambda a: F.filter(F.transform(a, lambda c: F.trim(c)), lambda c: c != "")
    w = words(t)
    numeric = F.size(F.filter(w, lambda x: x.rlike(r"\d") | x.rlike(MATH)))
    return (
        F.when(t == "", F.array().cast("array<string>"))
        .when(F.size(spaced) >= 2, tidy(spaced))
        .when(F.contains(t, F.lit("\t")), tidy(F.split(t, "\t")))
        .when(numeric > 0.2 * F.size(w), w)
        .otherwise(F.array(t))
    )


def is_table_row(line: Column, least: int = 2) -> Column:
    def row(c: Column) -> Column:
        total = F.aggregate(c, F.lit(0), lambda a, x: a + F.length(x))
        return (F.size(c) >= least) & (total <= 20 * F.size(c)) & (F.exists(c, lambda x: x.rlike(r"\d")) | line.rlike(MATH))

    return F.get(F.transform(F.array(split_columns(line)), row), 0)  # the columns are split off once


def cells_of(headers: Column, rows: Column) -> Column:
    return F.concat(headers, F.flatten(rows))


def fill_quality(headers: Column, rows: Column) -> Column:
    cells = cells_of(headers, rows)
    return F.size(F.filter(cells, lambda c: F.trim(c) != "")) / F.greatest(F.size(cells), F.lit(1))


def padded(rows: Column) -> Column:
    """Rows filled up with empty cells to the longest one."""
    most = F.array_max(F.transform(rows, lambda r: F.size(r)))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), most - F.size(r))))


def is_valid_table(headers: Column, rows: Column) -> Column:
    text = F.array_join(cells_of(headers, rows), " ")
    w = words(text)
    short = F.size(F.filter(w, lambda x: F.length(x) <= 2))
    return ~text.rlike(r"(.)\1{5,}") & (F.size(w) > 0) & (short <= 0.6 * F.size(w))


def is_reference_table(headers: Column, rows: Column) -> Column:
    cite = r"\[\d[\d,\s]*\]"
    text = F.array_join(cells_of(headers, rows), " ")
    n = n_words(text)
    first = F.transform(F.filter(rows, lambda r: F.size(r) > 0), lambda r: F.trim(F.element_at(r, 1)))
    numbered = F.size(F.filter(first, lambda c: c.rlike(f"^{cite}$")))
    dense = F.regexp_count(text, F.lit(cite)) > 0.10 * n
    return _any(F.lower(F.trim(F.element_at(headers, 1))), V.REFERENCE_HEADERS) | ((n > 0) & (dense | (numbered > 0.4 * F.greatest(F.size(first), F.lit(1)))))


def has_caption_header(headers: Column) -> Column:
    return F.lower(F.trim(F.element_at(headers, 1))).rlike(r"^table\s*\d+")


def table_words(headers: Column, rows: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.array_join(cells_of(headers, rows), " ")), WORD), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def kept_cell(value: Column) -> Column:
    """A cell text distinctive enough to recognise table data by; null if it is not."""
    s = F.trim(F.lower(normal_text(value)))
    n = n_words(s)
    plain = (n == 1) & ~s.rlike(r"\d|[%=+\-/]") & (F.length(s) < 8)
    return F.when(F.length(s).between(4, 80) & (n <= 6) & ~plain, s)


def is_table_data(text: Column, cells: Column, least: int = 4) -> Column:
    """A paragraph that repeats the cells of a table."""
    low = F.lower(normal_text(text))
    hits = F.size(F.filter(cells, lambda c: F.contains(low, c)))
    return (F.length(text) >= 20) & (hits >= least) & ((F.length(text) <= 200) | (F.length(text) <= 60 * hits))


def is_rejected_borderless(headers: Column, rows: Column) -> Column:
    heads = F.filter(headers, lambda h: F.trim(h) != "")
    cells = F.filter(F.flatten(rows), lambda c: F.trim(c) != "")
    count = lambda a: F.aggregate(a, F.lit(0), lambda acc, x: acc + n_words(x))
    glued = F.size(F.filter(heads, lambda h: (F.length(h) > 10) & ~F.contains(h, F.lit(" "))))
    return (
        (fill_quality(headers, rows) < 0.25)
        | (glued >= 0.5 * F.size(heads))
        | F.trim(F.element_at(headers, 1)).rlike(r"^\d+\.\d+$")
        | (count(heads) > 5 * F.greatest(F.size(heads), F.lit(1)))
        | (count(cells) > 7 * F.size(cells))
        | ~F.exists(cells, lambda c: c.rlike(r"\d"))
    )


def is_tabular_row(cells: Column, most_words: int = 7) -> Column:
    filled = F.filter(cells, lambda c: F.trim(c) != "")
    return (F.size(filled) >= 2) & (F.aggregate(filled, F.lit(0), lambda a, c: a + n_words(c)) <= most_words * F.size(filled))


# Guards of model output


def length_kept(original: Column, cleaned: Column, least: float = 0.9, most: float = 1.1) -> Column:
    squeeze = lambda x: F.length(F.trim(F.regexp_replace(x, r"\s+", " ")))
    a, b = squeeze(F.regexp_replace(original, r"-\s+", "")), squeeze(cleaned)
    return F.when(a == 0, b == 0).otherwise((b >= least * a) & (b <= most * a))


def is_safe_rewrite(original: Column, cleaned: Column) -> Column:
    """No invented words (3 % of them, and over two), and a length near the original's."""
    vocabulary = F.regexp_extract_all(F.lower(original), F.lit("[a-zA-Z']+"), F.lit(0))
    out = F.regexp_extract_all(F.lower(cleaned), F.lit("[a-zA-Z']+"), F.lit(0))
    novel = F.size(F.filter(out, lambda w: (F.length(w) > 3) & ~F.array_contains(vocabulary, w)))
    invented = (novel > 0.03 * F.greatest(F.size(out), F.lit(1))) & (novel > 2)
    ratio = F.length(cleaned) / F.greatest(F.length(F.array_join(words(original), " ")), F.lit(1))
    return ~invented & length_kept(original, cleaned) & ratio.between(0.7, 1.5)
