"""Entity dictionaries: surface forms, gazetteers, matching and resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica import vocab as V
from lattica.functions import text as T
from lattica.sources.tables import staged

LONGEST_NGRAM = 8


def surface_forms(entities: DataFrame) -> DataFrame:
    """form, canonical, priority from (ord, entity, abbreviation, aliases array).

    Stated forms come first, the last statement of a form winning; vendor and size variants of abbreviations are
    added where no stated form stands, the last again winning.
    """
    e = entities.select("ord", F.col("entity").alias("canonical"), F.trim(F.coalesce("abbreviation", F.lit(""))).alias("abbr"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    stated = F.filter(F.concat(F.array(F.col("canonical")), F.array(F.col("abbr")), F.col("aliases")), lambda x: F.trim(x) != "")
    own = e.select("ord", "canonical", F.posexplode(F.transform(stated, T.entity_key)).alias("sub", "form"))
    last = Window.partitionBy("form").orderBy(F.desc("ord"), F.desc("sub"))
    own = own.withColumn("r", F.row_number().over(last)).where("r = 1").select("form", "canonical", F.lit(0).alias("priority"))
    a = F.lower("abbr")
    grown = [F.concat(F.lit(v + " "), a) for v in V.VENDORS]
    grown += [F.concat(x, F.lit(sep + size)) for size in V.SIZES for sep in V.SEPARATORS for x in (a, F.replace(a, F.lit(" "), F.lit("")))]
    extra = e.where("abbr <> ''").select("ord", "canonical", F.posexplode(F.array(*grown, a)).alias("sub", "form"))
    extra = extra.withColumn("r", F.row_number().over(last)).where("r = 1").select("form", "canonical", F.lit(1).alias("priority"))
    return own.union(extra.join(own, "form", "left_anti"))


def match_names(rows: DataFrame, name: str, forms: DataFrame) -> DataFrame:
    """Adds canonical: the entity whose form the name is, or null."""
    f = forms.select(F.col("form").alias("_form"), "canonical")
    return rows.join(f, T.entity_key(F.col(name)) == F.col("_form"), "left").drop("_form")


def resolve_names(rows: DataFrame, name: str, forms: DataFrame, out: str) -> DataFrame:
    """Adds out: the canonical name in lower case by raw form, then by normal form; else the normal form."""
    raw = forms.select(F.col("form").alias("_f1"), F.col("canonical").alias("_c1"))
    normal = forms.select(F.col("form").alias("_f2"), F.col("canonical").alias("_c2"))
    joined = rows.join(raw, T.entity_key(F.col(name)) == F.col("_f1"), "left").join(normal, T.normal_entity(F.col(name)) == F.col("_f2"), "left")
    found = F.lower(F.trim(F.coalesce("_c1", "_c2")))
    return joined.withColumn(out, F.coalesce(found, T.normal_entity(F.col(name)))).drop("_f1", "_c1", "_f2", "_c2")


def resolve_subjects(rows: DataFrame, subject: str, forms: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds canonical by tiers: form; without brackets; without size suffix; head before a colon or hyphen; and, for
    what is left, the first entity that contains the subject or is contained in it. Rows need a unique ord."""
    s = F.col(subject)
    tiers = [s, F.trim(F.regexp_replace(s, r"\s*\(.*?\)", "")), F.trim(F.regexp_replace(s, r"(?i)[-_\s]?(base|large|small|tiny|medium|xl|xxl|\d+[bBmM])$", "")), F.trim(F.element_at(F.split(s, r"[:\-]"), 1))]
    out = rows
    for i, t in enumerate(tiers):
        f = forms.select(F.col("form").alias(f"_f{i}"), F.col("canonical").alias(f"_c{i}"))
        out = out.join(f, T.entity_key(t) == F.col(f"_f{i}"), "left")
    first = F.coalesce(*(F.col(f"_c{i}") for i in range(len(tiers))))
    out = out.withColumn("_first", first).drop(*(f"_{x}{i}" for x in "fc" for i in range(len(tiers))))
    names = out.where("_first is null").select(s.alias("_s"), F.lower(s).alias("_ls")).distinct()
    e = entities.select("ord", "entity", F.lower("entity").alias("_le"))
    within = [held_in(names, "_ls", e, "_le"), held_in(e, "_le", names, "_ls")]
    near = reduce(DataFrame.unionByName, [x.select("_s", "entity", "ord") for x in within]).groupBy("_s").agg(F.min_by("entity", "ord").alias("_near"))
    return out.join(near, s == F.col("_s"), "left").withColumn("canonical", F.coalesce("_first", "_near")).drop("_first", "_near", "_s")


def _grams(text: Column, n: int) -> Column:
    count = F.length(text) - (n - 1)
    return F.when(count > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), count), lambda i: F.substr(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def held_in(long: DataFrame, long_col: str, short: DataFrame, short_col: str) -> DataFrame:
    """Pairs of rows where one string is part of the other: long's holds short's. Each short string looks for one of
    its trigrams (the one of least hash, so that no trigram is everybody's) among those of the long ones; strings of
    one or two characters look for themselves."""
    key = F.array_min(F.transform(_grams(F.col(short_col), 3), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))["g"]
    few = short.where(F.length(short_col) < 3)
    has_few = not few.isEmpty()
    grams = F.concat(_grams(F.col(long_col), 3), *([_grams(F.col(long_col), 1), _grams(F.col(long_col), 2)] if has_few else []))
    keyed = short.withColumn("_key", F.coalesce(key, short_col))
    found = long.withColumn("_key", F.explode(F.array_append(grams, F.lit("")) if has_few else grams)).join(keyed, "_key")
    return found.where(F.contains(long_col, F.col(short_col))).drop("_key")


def mentioned(texts: DataFrame, forms: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, canonical of the entities whose forms stand in a text as whole words. Forms meet texts through word
    n-grams, so the join is on equality; a form's punctuation inside is kept as it is."""
    w = F.split(F.lower(F.col(text_col)), T.WORD)
    grams = ngrams(F.filter(w, lambda x: x != ""), LONGEST_NGRAM)
    rows = texts.select(F.col(id_col), F.lower(F.col(text_col)).alias("_t"), F.explode(F.array_distinct(grams)).alias("_g"))
    keys = forms.select("canonical", "form", F.array_join(F.filter(F.split("form", T.WORD), lambda x: x != ""), " ").alias("_g"))
    return rows.join(keys, "_g").where(F.contains("_t", F.col("form"))).select(id_col, "canonical").distinct()


def ngrams(tokens: Column, longest: int) -> Column:
    """All runs of 1 to `longest` tokens, joined by spaces."""
    n = F.size(tokens)
    of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(tokens, i, F.lit(k)), " "))).otherwise(F.array().cast("array<string>"))
    return F.concat(*(of(k) for k in range(1, longest + 1)))


def aggregate_gazetteer(mentions: DataFrame) -> DataFrame:
    """key, surface, ceo_type, cnt from typed mentions (ord, surface, ceo_type): first surface, most frequent type
    (the one seen first on ties), total count; only keys that the gazetteer keeps."""
    m = mentions.where("ceo_type is not null").withColumn("surface", T.strip_punctuation(F.col("surface")))
    m = m.withColumn("key", T.gazetteer_key(F.col("surface"))).where(F.length("key") >= 3)
    by_type = m.groupBy("key", "ceo_type").agg(F.count("*").alias("n"), F.min("ord").alias("first"), F.min_by("surface", "ord").alias("surface"))
    out = by_type.groupBy("key").agg(F.min_by("surface", "first").alias("surface"), F.max_by("ceo_type", F.struct("n", (-F.col("first")).alias("f"))).alias("ceo_type"), F.sum("n").alias("cnt"))
    return out.where(T.keeps_gazetteer_entry(F.col("key"), F.col("cnt")))


def match_gazetteer(docs: DataFrame, gazetteer: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST_NGRAM) -> DataFrame:
    """id, key, hits: every occurrence of a gazetteer key as a token n-gram, overlapping ones all counted.

    A place is joined with the keys that begin with its one or two words, and only then compared in full, so the
    fan-out stays near the number of hits.
    """
    tokens = docs.select(F.col(id_col), T.gazetteer_tokens(F.col(text_col)).alias("_t"))
    at = tokens.select(id_col, F.posexplode("_t").alias("_p", "_w"), "_t").select(id_col, "_w", F.get("_t", F.col("_p") + 1).alias("_x"), F.slice("_t", F.col("_p") + 1, F.lit(longest)).alias("_run"))
    keys = gazetteer.select("key", F.split("key", " ").alias("_k")).distinct().select("key", F.get("_k", 0).alias("_w"), F.get("_k", 1).alias("_x"), F.size("_k").alias("_n"))
    single = at.select(id_col, "_w").join(keys.where("_n = 1").select("key", "_w"), "_w").select(id_col, "key")
    longer = at.join(keys.where("_n > 1"), ["_w", "_x"]).where(F.array_join(F.slice("_run", F.lit(1), F.col("_n")), " ") == F.col("key")).select(id_col, "key")
    return single.union(longer).groupBy(id_col, "key").agg(F.count("*").alias("hits"))


def entity_rows(seeds: DataFrame, body: DataFrame, to_type: dict[str, str | None] | None, least: int = 1, most: int | None = None, hard_only: bool = True, most_words: int | None = 6) -> DataFrame:
    """Each paper's dictionary: seeds first, then body entities (paper_id, name, raw_type, cnt, ord) by count; seeds
    win on equal lower-case names. to_type maps raw types; a null type drops the entity."""
    totals = body.groupBy("paper_id", "name").agg(F.sum("cnt").alias("total"), F.max_by("raw_type", F.struct("cnt", (-F.col("ord")).alias("o"))).alias("raw_type"), F.min("ord").alias("ord"))
    if to_type is None:
        kind = F.col("raw_type")
    else:
        known = F.create_map(*(x for k, v in to_type.items() for x in (F.lit(k), F.lit(v) if v else F.lit(None).cast("string"))))
        kind = F.when(F.col("raw_type").isin(list(to_type)), F.try_element_at(known, F.col("raw_type"))).otherwise(F.coalesce(F.nullif("raw_type", F.lit("")), F.lit("Other")))
    rows = totals.where((F.col("total") >= least) & ~T.is_noise_name(F.col("name"), most_words)).withColumn("ceo_type", kind).where("ceo_type is not null")
    if hard_only:
        rows = rows.where(F.col("ceo_type").isin(V.HARD_TYPES))
    name, abbr = T.abbreviation(F.col("name"))
    fresh = rows.select("paper_id", F.lower("name").alias("key"), name.alias("entity"), abbr.alias("abbreviation"), "raw_type", "ceo_type", "total", "ord")
    own = seeds.select("paper_id", F.lower("entity").alias("key"), "entity", "abbreviation", "raw_type", "ceo_type", F.lit(10**6).cast("long").alias("total"), F.lit(0).cast("long").alias("ord"))
    out = own.union(fresh.join(own, ["paper_id", "key"], "left_anti"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("total"), "ord", "key")))
    return out.where(F.col("rank") <= most) if most else out


def _near_pairs(titles: DataFrame, index: DataFrame, least: float) -> DataFrame:
    """Pairs (title_id, a, b, paper_id, ord) that include all with a ratio of `least` or more; rows are told apart by ta, ib.

    Let two strings have S characters together and M matched in pairs, 2 M >= least S. Their matched blocks number
    (1 - least) S + 1 at most, for a character of either string is unmatched between any two, so they share
    M - 2 (blocks) trigrams or more. A string of n characters thus meets any partner among all but so many of its own
    trigrams (counted with repeats), and may leave out the most frequent ones. Strings too short for that bound meet
    by bands of length.
    """
    width = (2 - least) / least
    shared = least / 2 - 2 * (1 - least)  # trigrams for each character of both, less 2
    if shared <= 0:
        long_enough = F.lit(False)
        least_shared = lambda n: F.lit(0)
    else:
        least_shared = lambda n: F.ceil(F.lit(shared) * (n + n / width) - 2)  # noqa: E731  (a partner has n / width characters at least)
        long_enough = least_shared
    ok = lambda c: (least_shared(F.length(c).cast("double")) >= 1) if shared > 0 else long_enough

    def grams(rows: DataFrame, c: str, key: str) -> DataFrame:
        g = F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substr(F.col(c), i, F.lit(3)))
        each = rows.where(ok(c)).select(key, F.length(c).alias("len"), F.explode(g).alias("g"))
        return each.groupBy(key, "len", "g").agg(F.count("*").alias("k")).select(key, "len", "g", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))).alias("k"))

    left, right = grams(titles, "a", "ta"), grams(index, "b", "ib")
    rank = left.select("g", "k").union(right.select("g", "k")).groupBy("g", "k").agg(F.count("*").alias("n"))

    def rare(rows: DataFrame, key: str) -> DataFrame:
        w = Window.partitionBy(key).orderBy("n", "g", "k")
        keep = F.col("len") - 2 - least_shared(F.col("len").cast("double")) + 1
        return rows.join(rank, ["g", "k"]).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).select(key, "g", "k")

    met = rare(left, "ta").join(rare(right, "ib"), ["g", "k"]).select("ta", "ib").distinct()
    by_gram = titles.join(met, "ta").join(index, "ib").select("title_id", "a", "b", "paper_id", "ord")
    # The rest: at least one of the two is short, so both are, by the ratio of their lengths
    band = lambda n: F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.log(F.lit(width))).cast("int")
    short = titles.select("*", F.explode(F.array(*(band(F.length("a")) + d for d in (-1, 0, 1)))).alias("band")).join(index.withColumn("band", band(F.length("b"))), "band")
    by_band = short.where(~ok("a") | ~ok("b")).select("title_id", "a", "b", "paper_id", "ord")
    return by_gram.union(by_band)


def lookup_titles(titles: DataFrame, index: DataFrame, least: float = 0.85) -> DataFrame:
    """title_id, paper_id, score: an index entry with the same normal title, else the most similar one.

    Only titles without an exact hit go on to compare. Candidates share a rare trigram (see _near_pairs); two bounds of
    the ratio (lengths, then the longest common subsequence) cut them before difflib sees them, and none can lose a match.
    """
    from lattica.functions.python_udfs import near_ratio

    # Both are read many times below, and their rules would run for each pair
    own = F.monotonically_increasing_id()
    t = staged(titles.select("title_id", T.normal_title(F.col("title")).alias("a"), own.alias("ta")), "titles")
    i = staged(index.groupBy(T.normal_title(F.col("title")).alias("b")).agg(F.max_by("paper_id", "ord").alias("paper_id"), F.min("ord").alias("ord")).withColumn("ib", own), "title-index")
    exact = t.join(i, t["a"] == i["b"]).select("title_id", "paper_id", F.lit(1.0).alias("score"))
    rest = staged(t.join(exact, "title_id", "left_anti"), "titles-left")
    la, lb = F.length("a"), F.length("b")
    pairs = _near_pairs(rest, i, least).where(2 * F.least(la, lb) >= least * (la + lb))
    # A few titles make very many pairs, in few partitions: they are dealt out before they are compared
    dealt = pairs.repartition(4 * pairs.sparkSession.sparkContext.defaultParallelism, "a", "b")
    near = dealt.withColumn("score", near_ratio(least)("a", "b")).where(F.col("score") >= least)
    best = near.groupBy("title_id").agg(F.max(F.struct("score", (-F.col("ord")).alias("o"), "paper_id")).alias("m")).select("title_id", "m.paper_id", "m.score")
    return exact.union(best)


def resolve_ids(titles: DataFrame, *tiers: DataFrame) -> DataFrame:
    """title_id, paper_id from the first tier (title_id, paper_id) that has it."""
    out = titles.select("title_id")
    for k, t in enumerate(tiers):
        out = out.join(t.select("title_id", F.col("paper_id").alias(f"_p{k}")), "title_id", "left")
    return out.select("title_id", F.coalesce(*(F.col(f"_p{k}") for k in range(len(tiers)))).alias("paper_id"))
