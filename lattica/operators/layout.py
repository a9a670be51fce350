"""Page layout and tables: bands, reading order, merging, regions, duplicates, captions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from lattica.functions import text as T


def walked(rows: DataFrame, by: list[str], columns: list[str], walk: Callable[..., list[tuple]], fields: str) -> DataFrame:
    """by, fields: the tuples that walk gives for each group, whose rows it gets as a list for each of `columns`, in
    order of the first. Groups are collected natively and walked a batch at a time: documents are many and small, and
    a frame and an Arrow stream for each would cost far more than the walk."""
    held = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("_g"))
    made = StructType.fromDDL(fields)
    kinds = to_arrow_schema(made)

    def batch_of(keys: pa.RecordBatch, at: list[int], out: list[tuple]) -> pa.RecordBatch:
        own = keys.take(pa.array(at, pa.int64()))
        cols = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*own.columns, *cols], names=[*by, *kinds.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, keys = batch.column("_g"), batch.select(by)
            flat = lists.flatten()
            cols = [flat.field(i).to_pylist() for i in range(len(columns))]
            begin, at, out = 0, [], []
            for i, n in enumerate(lists.value_lengths().to_pylist()):
                got = walk(*(c[begin : begin + n] for c in cols))
                begin += n
                at += [i] * len(got)
                out += got
                if len(out) >= 1 << 15:
                    yield batch_of(keys, at, out)
                    at, out = [], []
            if out:
                yield batch_of(keys, at, out)

    return held.mapInArrow(run, StructType([*held.select(*by).schema, *made]))


def bands(points: DataFrame, by: list[str], value: str, gap: float) -> DataFrame:
    """by, band, lo, hi: islands of rounded coordinates no further apart than gap."""
    v = points.select(*by, F.round(value, 0).alias("v")).distinct()
    w = Window.partitionBy(*by).orderBy("v")
    v = v.withColumn("_new", F.coalesce((F.col("v") - F.lag("v").over(w) > gap).cast("int"), F.lit(0)))
    v = v.withColumn("band", F.sum("_new").over(w))
    return v.groupBy(*by, "band").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def word_grid(words: DataFrame, by: list[str]) -> DataFrame:
    """by, r, c, text: words (x0, top, text) placed into row and column bands (tolerance 4), the first that fits."""
    w = words.withColumn("_i", F.monotonically_increasing_id() if "ord" not in words.columns else F.col("ord"))
    # A page's words meet in one row, its bands with them: no band is joined with a word
    page = w.groupBy(*by).agg(*(F.array_sort(F.collect_set(F.round(c, 0).cast("double"))).alias(f"_{c}") for c in ("x0", "top")), F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("_i", "x0", "top", F.trim("text").alias("t"))))).alias("_w"))
    page = page.select(*by, _islands(F.col("_x0"), 12).alias("_c"), _islands(F.col("_top"), 4).alias("_r"), "_w")

    def fits(value: Column, islands: str) -> Column:
        hit = F.transform(islands, lambda b: value.between(b["lo"] - 4, b["hi"] + 4))
        return (F.array_position(hit, True) - 1).cast("long")

    placed = page.select(*by, F.transform("_w", lambda x: F.struct(fits(x["top"], "_r").alias("r"), fits(x["x0"], "_c").alias("c"), x["_i"].alias("i"), x["t"].alias("t"))).alias("_w"))
    cells = placed.select(*by, "_w", F.explode(F.array_distinct(F.transform("_w", lambda x: F.struct(x["r"].alias("r"), x["c"].alias("c"))))).alias("_k"))
    own = F.transform(F.filter("_w", lambda x: (x["r"] == F.col("_k")["r"]) & (x["c"] == F.col("_k")["c"])), lambda x: x["t"])
    return cells.where("_k.r >= 0 and _k.c >= 0").select(*by, F.col("_k")["r"].alias("r"), F.col("_k")["c"].alias("c"), F.array_join(own, " ").alias("text"))


def _islands(values: Column, gap: float) -> Column:
    """Islands (lo, hi) of sorted values no further apart than gap, in order."""
    one = lambda a, b: F.struct(a.alias("lo"), b.alias("hi"))
    last = lambda acc: F.element_at(acc, -1)
    grown = lambda acc, v: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(one(last(acc)["lo"], v)))
    return F.aggregate(values, F.array().cast("array<struct<lo:double,hi:double>>"), lambda acc, v: F.when((F.size(acc) > 0) & (v - F.try_element_at(acc, F.lit(-1))["hi"] <= gap), grown(acc, v)).otherwise(F.concat(acc, F.array(one(v, v)))))


def table_regions(rows: DataFrame, by: list[str], n_cols: str = "n_cols", least_cols: int = 2, least_fill: float = 0.4) -> DataFrame:
    """by, start, stop: runs of three rows or more (r, cells array) that are filled, tabular and hold a number."""
    filled = F.size(F.filter("cells", lambda c: F.trim(c) != ""))
    ok = (filled >= least_fill * F.greatest(F.col(n_cols), F.lit(1))) & (filled >= least_cols) & T.is_tabular_row(F.col("cells"))
    r = rows.withColumn("_ok", ok)
    w = Window.partitionBy(*by).orderBy("r")
    r = r.withColumn("_g", F.sum((~F.col("_ok")).cast("int")).over(w)).where("_ok")
    number = F.exists("cells", lambda c: c.rlike(r"\d"))
    out = r.groupBy(*by, "_g").agg(F.min("r").alias("start"), (F.max("r") + 1).alias("stop"), F.count("*").alias("n"), F.bool_or(number).alias("_num"))
    return out.where("n >= 3 and _num").select(*by, "start", "stop")


def text_tables(blocks: DataFrame, by: list[str]) -> DataFrame:
    """by, first, lines: runs of two or more consecutive blocks (ord, text) of five words or more with a digit."""
    ok = (T.n_words(F.col("text")) >= 5) & F.col("text").rlike(r"\d")
    w = Window.partitionBy(*by).orderBy("ord")
    b = blocks.withColumn("_ok", ok).withColumn("_g", F.sum((~F.col("_ok")).cast("int")).over(w)).where("_ok")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    out = b.groupBy(*by, "_g").agg(F.min("ord").alias("first"), lines.alias("lines")).where(F.size("lines") >= 2)
    rows = T.padded(F.transform("lines", T.split_row))
    out = out.withColumn("_rows", rows).where(F.size(F.element_at("_rows", 1)) >= 2)
    return out.select(*by, "first", F.element_at("_rows", 1).alias("headers"), F.slice("_rows", 2, F.lit(1 << 30)).alias("rows"), F.lit(0.2).alias("quality"))


def reading_order(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Adds place: order by page, column (by mean x), y, x. Blocks without a column come first on their page."""
    mean = blocks.where("col is not null").groupBy(*by, "page", "col").agg(F.avg("x").alias("_m"))
    rank = mean.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "page").orderBy("_m", "col")) - 1).drop("_m")
    b = blocks.join(rank, [*by, "page", "col"], "left").withColumn("_rank", F.coalesce("_rank", F.lit(0)))
    return b.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("page", "_rank", "y", "x", "ord"))).drop("_rank")


def column_order(blocks: DataFrame, by: list[str]) -> DataFrame:
    """by, col, place: columns by their median x."""
    m = blocks.groupBy(*by, "col").agg(F.percentile("x", 0.5).alias("median"))
    return m.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("median", "col")))


def merge_lines(blocks: DataFrame, by: list[str], dy: float = 10, dx: float = 10) -> DataFrame:
    """by, page, col, first, x, y, text: lines (ord, x, y, text) merged onto the anchor line of their group.

    A line joins while it lies less than dy below and dx beside the group's first line, so each anchor depends on the
    one before and a column of a page is walked once, in order: time and memory are in proportion to its lines.
    """

    def walk(lines: pd.DataFrame) -> pd.DataFrame:
        x, y = lines["x"].to_numpy(float), lines["y"].to_numpy(float)
        order = np.lexsort((lines["ord"].to_numpy(), y))
        heads: list[int] = []
        for k, i in enumerate(order):
            a = order[heads[-1]] if heads else i
            if not (heads and 0 < y[i] - y[a] < dy and abs(x[i] - x[a]) < dx):
                heads.append(k)
        text = lines["text"].to_numpy(object)[order]
        ends = [*heads[1:], len(order)]
        merged = [" ".join(t for t in text[a:b] if t is not None) for a, b in zip(heads, ends, strict=True)]
        return lines.iloc[order[heads]].assign(first=lambda d: d["ord"], text=merged)[[*by, "page", "col", "first", "x", "y", "text"]]

    rows = blocks.select(*by, "page", "col", F.col("ord").cast("long").alias("ord"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "text")
    kinds = [StructField(f.name, f.dataType) for f in rows.select(*by, "page", "col").schema]
    schema = StructType([*kinds, StructField("first", LongType()), StructField("x", DoubleType()), StructField("y", DoubleType()), StructField("text", StringType())])
    return rows.groupBy(*by, "page", "col").applyInPandas(walk, schema)


def _kmeans_1d(x: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's iterations from evenly spread quantiles."""
    centre = np.quantile(x, (np.arange(k) + 0.5) / k)
    for _ in range(100):
        label = np.abs(x[:, None] - centre[None]).argmin(1)
        new = np.array([x[label == j].mean() if (label == j).any() else centre[j] for j in range(k)])
        if np.allclose(new, centre):
            break
        centre = new
    return label


def _silhouette(x: np.ndarray, label: np.ndarray) -> float:
    kinds = np.unique(label)
    if len(kinds) < 2:
        return -1.0
    gap = np.abs(x[:, None] - x[None])
    own = np.array([gap[i][label == label[i]].sum() / max((label == label[i]).sum() - 1, 1) for i in range(len(x))])
    other = np.min([np.where(label == j, np.inf, gap[:, label == j].mean(1)) for j in kinds], axis=0)
    alone = np.array([(label == label[i]).sum() == 1 for i in range(len(x))])
    return float(np.where(alone, 0, (other - own) / np.maximum(np.maximum(own, other), 1e-12)).mean())


def detect_columns(blocks: DataFrame, by: list[str], least: int = 10) -> DataFrame:
    """Adds col: one, two or three columns of a page by x, whichever silhouette is best (0 for one column)."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        x = page["x"].to_numpy(float)
        best, score = np.zeros(len(x), int), 0.0
        if len(x) >= least:
            for k in (2, 3):
                label = _kmeans_1d(x, k)
                if (s := _silhouette(x, label)) > score:
                    best, score = label, s
        return page.assign(col=best)

    kept = blocks.drop("col")
    return kept.groupBy(*by, "page").applyInPandas(run, StructType([*kept.schema, StructField("col", IntegerType())]))


def repair_caption_headers(tables: DataFrame) -> DataFrame:
    """Where a caption was taken for the header, the first row becomes the header and quality 0.6 at least."""
    hit = T.has_caption_header(F.col("headers")) & (F.size("rows") > 0)
    return tables.select(
        *[c for c in tables.columns if c not in ("headers", "rows", "quality")],
        F.when(hit, F.element_at("rows", 1)).otherwise(F.col("headers")).alias("headers"),
        F.when(hit, F.slice("rows", 2, F.lit(1 << 30))).otherwise(F.col("rows")).alias("rows"),
        F.when(hit, F.greatest(F.col("quality"), F.lit(0.6))).otherwise(F.col("quality")).alias("quality"),
    )


def distinct_tables(tables: DataFrame, by: list[str]) -> DataFrame:
    """Tables (ord, page, headers, rows, quality, source) without near repeats, better ones kept.

    Candidates for being the same (equal width, and Jaccard above 0.65 or a caption header within a page) come from
    a join within the document; the greedy choice by (quality, no caption) then runs over each document's few tables.
    """
    t = tables.where((F.coalesce("source", F.lit("")) == "text_reconstruct") | ~T.is_reference_table(F.col("headers"), F.col("rows")))
    t = repair_caption_headers(t).withColumn("_w", T.table_words(F.col("headers"), F.col("rows"))).withColumn("_c", T.has_caption_header(F.col("headers")))
    w = Window.partitionBy(*by).orderBy(F.desc("quality"), F.col("_c").cast("int"), "ord")
    t = t.withColumn("_place", F.row_number().over(w))
    later = t.select(*by, F.col("_place").alias("_q"), F.size("headers").alias("_n2"), F.col("_w").alias("_w2"), F.col("_c").alias("_c2"), F.coalesce("page", F.lit(0)).alias("_p2"))
    same = (F.size("headers") == F.col("_n2")) & ((T.jaccard(F.col("_w"), F.col("_w2")) > 0.65) | (F.col("_c2") & (F.abs(F.coalesce("page", F.lit(0)) - F.col("_p2")) <= 1)))
    pairs = t.join(later, by).where(F.col("_place") < F.col("_q")).where(same).select(*by, "_place", "_q")
    repeats = pairs.groupBy(*by, "_q").agg(F.collect_list("_place").alias("_over"))
    listed = repeats.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_q", "_over"))).alias("_l"))
    gone = F.aggregate("_l", F.array().cast("array<int>"), lambda acc, x: F.when(F.exists(x["_over"], lambda p: ~F.array_contains(acc, p)), F.concat(acc, F.array(x["_q"]))).otherwise(acc))
    dropped = listed.select(*by, F.explode(gone).alias("_place"))
    return t.join(dropped, [*by, "_place"], "left_anti").drop("_w", "_c", "_place")


def assign_captions(tables: DataFrame, captions: DataFrame, by: list[str]) -> DataFrame:
    """Adds cap_page, cap_y, caption to tables (ord, page): each takes, in order, a caption not taken yet, of its own
    page if there is one, else the earliest. Captions are (num, page, y, text)."""

    last = lambda *x: tuple((v is None, v) for v in x)  # noqa: E731  (nulls go last)

    def run(kinds: list, ords: list, pages: list, ys: list, nums: list, texts: list) -> list[tuple]:
        free = sorted((i for i, k in enumerate(kinds) if not k), key=lambda i: last(pages[i], ys[i], nums[i]))
        out = []
        for row in sorted((i for i, k in enumerate(kinds) if k), key=lambda i: last(ords[i])):
            pick = next((i for i in free if pages[i] is not None and pages[i] == pages[row]), free[0] if free else None)
            if pick is None:
                out.append((ords[row], pages[row], 500.0, None))
            else:
                free.remove(pick)
                out.append((ords[row], pages[pick], None if ys[pick] is None else ys[pick] + 2, texts[pick]))
        return out

    kind = tables.schema["ord"].dataType.simpleString()
    none = lambda t: F.lit(None).cast(t)
    page, y, num, text = F.col("page").cast("int").alias("page"), F.col("y").cast("double").alias("y"), F.col("num").cast("int").alias("num"), F.col("text")
    own = tables.select(*by, F.lit(1).alias("kind"), "ord", page, none("double").alias("y"), none("int").alias("num"), none("string").alias("text"))
    both = own.unionByName(captions.select(*by, F.lit(0).alias("kind"), none(kind).alias("ord"), page, y, num, text))
    placed = walked(both, by, ["kind", "ord", "page", "y", "num", "text"], run, f"ord {kind}, cap_page int, cap_y double, caption string")
    return tables.join(placed, [*by, "ord"], "left")


def page_captions(blocks: DataFrame, by: list[str]) -> DataFrame:
    """by, num, page, y, text of the first 'Table N:' block of each number."""
    t = F.trim(T.normal_text(F.col("text")))
    num = F.regexp_extract(t, r"^[Tt]able\s*(\d+)\s*[:.]", 1)
    b = blocks.withColumn("_t", t).withColumn("num", F.try_cast(num, "int") if hasattr(F, "try_cast") else num.try_cast("int")).where("num is not null")
    return b.groupBy(*by, "num").agg(F.min_by(F.struct("page", "y", F.col("_t").alias("text")), "ord").alias("m")).select(*by, "num", "m.page", "m.y", "m.text")


def union_tables(strong: DataFrame, anchored: DataFrame, borderless: DataFrame) -> DataFrame:
    """Tables of all strategies: borderless ones only on pages without an anchored table, of quality 0.78 or more,
    with two headers or more, none of over 25 characters."""
    heads = F.filter("headers", lambda h: F.trim(h) != "")
    good = borderless.where((F.col("quality") >= 0.78) & (F.size(heads) >= 2) & ~F.exists(heads, lambda h: F.length(h) > 25))
    covered = anchored.select("doc_id", "page").distinct()
    return strong.unionByName(anchored, True).unionByName(good.join(covered, ["doc_id", "page"], "left_anti"), True)


_END = r"^\s*(?:\d+\.?\s+[A-Z]|(?:Figure|Algorithm|Appendix|References?)\s*\d)"


#: What a line below a caption is, by the first that fits; see caption_tables for the flags.
BLANK, STOP, PIECE, ROW, OTHER = "BSPRO"
#: A table goes on until a stop, or the second of two blank or other lines with nothing but pieces between.
_TABLE_END = re.compile(f"{STOP}|[{BLANK}{OTHER}]{PIECE}*[{BLANK}{OTHER}]")


def scan_table(lines: list[str], kinds: str, words: list[int], head: int = 8) -> list[str]:
    """The lines of the table below a caption, given each line's kind and number of words. It begins with the first row
    among the first `head` lines; pieces (one or two characters) are parts of the line before them, unless a blank
    stands between."""
    begin = max(kinds[:head].find(ROW), 0)
    end = _TABLE_END.search(kinds, begin)
    region = range(begin, end.end() - 1 if end else len(kinds))
    kept = [i for i in region if kinds[i] == ROW or (kinds[i] == OTHER and words[i] >= 2)]
    bounds = [*kept, len(lines)]
    pieces = [i for i in region if kinds[i] == PIECE]
    return ["".join([lines[i], *(lines[j] for j in pieces if i < j < after and BLANK not in kinds[i:j])]) for i, after in zip(kept, bounds[1:], strict=True)]


def caption_tables(pages: DataFrame) -> DataFrame:
    """doc_id, num, page, caption, headers, rows, quality of tables below 'Table N:' lines of (doc_id, page, text)."""
    # Pages are dealt out whole: the rules then run where the page is walked, whatever few files the pages came in
    dealt = pages.select("doc_id", F.col("page").cast("int").alias("page"), "text").repartition("doc_id", "page")
    lines = dealt.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("ln", "raw")).withColumn("line", F.trim("raw"))
    w = T.words(F.col("line"))
    numeric = F.coalesce(F.size(F.filter(w, lambda x: x.rlike(r"\d") | x.rlike(T.MATH))) / F.nullif(F.size(w), F.lit(0)), F.lit(0.0))
    lines = lines.select(
        "doc_id", "page", "ln", "line", F.size(w).alias("n"),
        F.when(F.col("line") == "", BLANK).when(F.col("line").rlike(_END) | ((F.size(w) > 12) & (numeric < 0.15)), STOP).when(F.length("line") <= 2, PIECE).when(T.is_table_row(F.col("line")), ROW).otherwise(OTHER).alias("kind"),
        F.regexp_extract("line", r"(?i)^\s*Table\s*(\d+)\s*[:.]", 1).alias("num"),
    )

    def run(ln: list, text: list, words: list, kind: list, nums: list) -> list[tuple]:
        kinds = "".join(kind)
        return [(int(num), text[i], scan_table(text[i + 1 :], kinds[i + 1 :], words[i + 1 :])) for i, num in enumerate(nums) if num]

    found = walked(lines, ["doc_id", "page"], ["ln", "line", "n", "kind", "num"], run, "num int, caption string, lines array<string>")
    found = found.where(F.size("lines") >= 2).withColumn("_g", T.padded(F.transform("lines", T.split_columns))).where(F.size(F.element_at("_g", 1)) >= 2)
    found = found.withColumn("headers", F.element_at("_g", 1)).withColumn("rows", F.slice("_g", 2, F.lit(1 << 30))).where(T.is_valid_table(F.col("headers"), F.col("rows")))
    found = found.withColumn("quality", F.round(T.fill_quality(F.col("headers"), F.col("rows")), 3)).where("quality >= 0.25")
    first = Window.partitionBy("doc_id", "num").orderBy("page")
    return found.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("doc_id", "num", "page", "caption", "headers", "rows", "quality", F.lit("text_reconstruct").alias("source"))


def merge_paragraphs(lines: list[str]) -> list[str]:
    """Lines to paragraphs: blanks and bullets split, closing quotes split before a long line, all else joins."""
    out: list[str] = []
    now = ""
    for line in map(str.strip, lines):
        bullet = line.startswith(("•", "-", "*"))
        closed = now.endswith('"') and now[:-1].rstrip('"')[-1:] in (".", "!", "?")
        if not line or bullet or (now and closed and len(line) > 80):
            if now:
                out.append(now)
            now = "" if not line or bullet else line
            if bullet:
                out.append(line)
        else:
            now = f"{now} {line}" if now else line
    return [*out, now] if now else out


def structured_blocks(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, section_ord, heading, ord, type, text, caption of placed blocks (doc_id, ord, page, x, y, col, text)
    and tables: the rows of a structured document before paragraphs are merged."""
    cells = tables.select("doc_id", F.explode(T.cells_of(F.col("headers"), F.col("rows"))).alias("c")).select("doc_id", T.kept_cell(F.col("c")).alias("c")).where("c is not null")
    known = cells.groupBy("doc_id").agg(F.collect_set("c").alias("_cells"))
    placed = assign_captions(tables, page_captions(blocks, ["doc_id"]), ["doc_id"])
    t = placed.select("doc_id", (F.col("ord") + 1_000_000).alias("ord"), F.coalesce("cap_page", "page").alias("page"), F.lit(0.0).alias("x"), F.coalesce("cap_y", F.lit(500.0)).alias("y"), F.lit(None).cast("int").alias("col"), F.lit(None).cast("string").alias("text"), "caption", F.lit("table").alias("kind"))
    b = blocks.select("doc_id", "ord", "page", "x", "y", "col", T.normal_text(F.col("text")).alias("text"), F.lit(None).cast("string").alias("caption"), F.lit("text").alias("kind"))
    rows = reading_order(b.unionByName(t), ["doc_id"])
    n = T.n_words(F.col("text"))
    score = F.when(n < 12, 2).otherwise(0) - F.when(F.col("text").rlike(r"^\d+\s+"), 2).otherwise(0) - F.when(n > 25, 2).otherwise(0)
    titles = rows.where("kind = 'text' and place <= 20").where(F.length("text").between(5, 150)).groupBy("doc_id").agg(F.max_by("text", F.struct(score.alias("s"), (-F.col("place")).alias("p"))).alias("_title"))
    rows = rows.join(titles, "doc_id", "left").join(known, "doc_id", "left")
    text = F.col("text")
    rows = rows.where((F.col("kind") == "table") | ~(T.is_garbage(text) | F.coalesce(text == F.col("_title"), F.lit(False))))
    heading = (F.col("kind") == "text") & (T.is_references(text) | T.is_heading(text))
    w = Window.partitionBy("doc_id").orderBy("place")
    rows = rows.withColumn("_h", F.coalesce(heading, F.lit(False))).withColumn("section_ord", F.sum(F.col("_h").cast("int")).over(w))
    name = F.when(T.is_references(text), "References").otherwise(T.clean_heading(text))
    rows = rows.withColumn("heading", F.last(F.when(F.col("_h"), name), True).over(w)).where("section_ord > 0 and not _h")
    caption_row = (F.col("kind") == "text") & T.is_table_caption(text)
    pending = F.last(F.when(F.col("kind") == "table", F.lit("")).otherwise(F.when(caption_row, text)), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("caption", F.when(F.col("kind") == "table", F.coalesce("caption", F.nullif(pending, F.lit("")))))
    rows = rows.where(~F.coalesce(caption_row, F.lit(False)))
    rows = rows.where((F.col("kind") == "table") | T.is_figure_caption(text) | ~T.is_table_data(text, F.coalesce("_cells", F.array().cast("array<string>"))))
    kind = F.when(F.col("kind") == "table", "table").when(T.is_figure_caption(text), "figure").otherwise("paragraph")
    return rows.select("doc_id", "section_ord", "heading", F.col("place").alias("ord"), kind.alias("type"), "text", "caption")


def merged_paragraphs(content: DataFrame) -> DataFrame:
    """doc_id, section_ord, heading, ord, type, text: runs of paragraphs between figures and tables merged."""

    def run(ords: list, kinds: list, texts: list, headings: list) -> list[tuple]:
        out, held = [], []

        def flush():
            out.extend(("paragraph", p) for p in merge_paragraphs(held))
            held.clear()

        for kind, text in zip(kinds, texts, strict=True):
            if kind == "paragraph":
                held.append(text)
            else:
                flush()
                out.append((kind, text))
        flush()
        return [(headings[0], i, k, x) for i, (k, x) in enumerate(out)]

    rows = content.withColumn("section_ord", F.col("section_ord").cast("int"))
    out = walked(rows, ["doc_id", "section_ord"], ["ord", "type", "text", "heading"], run, "heading string, ord int, type string, text string")
    return out.withColumn("text", F.when(F.col("type") == "paragraph", T.clean_paragraph(F.col("text"))).otherwise(F.col("text")))
