"""What must not grow with the number of documents, queries or pairs: plans, bounded memory and exact bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import layout as L
from lattica.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["structured_documents", "paragraph_merge", "caption_anchored_tables", "table_captions"])
def test_documents_are_walked_in_batches(spark, name):
    """No frame and no Arrow stream for each document."""
    assert "GroupsInPandas" not in plan(QUERIES[name](spark, SF))


def test_captions_with_nulls(spark):
    t = spark.createDataFrame([("d", 0, None), ("d", 1, 2), ("e", 0, 5)], "doc_id string, ord int, page int")
    c = spark.createDataFrame([("d", 1, 1, None, "one"), ("d", 2, None, 3.0, "two"), ("f", 1, 1, 1.0, "alone")], "doc_id string, num int, page int, y double, text string")
    got = {(r.doc_id, r.ord): (r.cap_page, r.cap_y, r.caption) for r in L.assign_captions(t, c, ["doc_id"]).collect()}
    assert got == {("d", 0): (1, None, "one"), ("d", 1): (None, 5.0, "two"), ("e", 0): (5, 500.0, None)}


def test_ranks_by_label_equal_brute_force(spark, monkeypatch):
    """Ties, absent labels and several blocks of queries; true pairs are never joined."""
    from lattica.operators import ranking as R

    monkeypatch.setattr(R, "HELD", 200)
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (60, 3)).astype(float)
    x[(x == 0).all(1)] = 1.0
    label = [None if i == 7 else int(i % 4) for i in range(60)]
    v = spark.createDataFrame([(i, x[i].tolist(), label[i]) for i in range(60)], "id long, v array<double>, label int").repartition(3)
    queries = v.where("id % 5 = 2")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want, top = {}, {}
    for q in range(2, 60, 5):
        order = sorted((c for c in range(60) if c != q), key=lambda c: (-(np.round(u[q] @ u[c], 6) + 0.0), c))
        top[q] = order[:4]
        want |= {(q, c): k for k, c in enumerate(order, 1) if label[q] is not None and label[c] == label[q]}
    assert {(r.query, r.candidate): r["rank"] for r in R.label_truth_ranks(queries, v).collect()} == want
    best = {q: min(k for (a, _), k in want.items() if a == q) for q, _ in want}
    assert {r.query: r.best_rank for r in R.label_best_ranks(queries, v).collect()} == best
    few = R.label_diagnostics(R.cosine_pairs(queries, v, k=4), v.select("id", "label"), 4).collect()
    assert {q: [r.candidate for r in sorted((r for r in few if r.query == q), key=lambda r: r["rank"])] for q in top} == top
    assert all(r.is_true == ((r.query, r.candidate) in want) for r in few)


@pytest.mark.parametrize("n,fraction", [(0, 0.5), (1, 0.5), (9, 0.25), (1000, 0.25)])
def test_exact_split_of_rows_equals_the_generator(spark, n, fraction):
    """The ids stay on the executors; the members are those of the shuffle of a list."""
    from lattica.operators import ranking as R

    ids = [int(i) * 7 - 100 for i in range(n)]
    rows = R.exact_split_rows(spark.createDataFrame([(i,) for i in reversed(ids)], "x long"), "x", fraction, 42).collect()
    first, rest = R.exact_split(ids, fraction, 42)
    assert ({r.x for r in rows if r["first"]}, {r.x for r in rows if not r["first"]}) == (first, rest)


def test_common_subsequence_bounds_the_ratio():
    import difflib
    import random

    from lattica.functions.python_udfs import common_length

    r = random.Random(3)
    for _ in range(300):
        a, b = ("".join(r.choices("abc ", k=r.randrange(0, 90))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b):
                row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
        assert common_length(a, b) == row[-1]
        assert difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() * (len(a) + len(b)) <= 2 * common_length(a, b) + 1e-9


def test_word_grid_joins_nothing(spark):
    w = spark.createDataFrame([(1, 0, 10.0, 5.0, "A"), (1, 1, 30.0, 5.0, "B"), (1, 2, 12.0, 30.0, " "), (2, 0, None, 1.0, "n"), (2, 1, 3.0, 1.0, "z")], "p int, ord int, x0 double, top double, text string")
    grid = L.word_grid(w, ["p"])
    assert "Join" not in plan(grid)
    assert {(r.p, r.r, r.c): r.text for r in grid.collect()} == {(1, 0, 0): "A", (1, 0, 1): "B", (2, 0, 0): "z"}


def test_shared_entities_ship_lists(spark, monkeypatch):
    from lattica.operators import graph as G

    monkeypatch.setattr(G, "LISTED", 2)
    rows = [(s, d) for d in range(4) for s in range(10) if (s * 7 + d) % 3 == 0] + [(99, 50), (0, 0)]
    got = {r.src: r.neighbours for r in G.shared_entity_papers(spark.createDataFrame(rows, "src long, dst long")).collect()}
    own = {(s, d) for s, d in rows}
    want = {s: len({b for a, d in own if a == s for b, e in own if e == d and b != s}) for s, _ in own}
    assert got == {s: n for s, n in want.items() if n}


def test_an_epoch_of_a_large_run_writes_vectors_once(spark, monkeypatch):
    """However many groups of triples: before, each bucket of entities made a round that wrote all vectors."""
    from lattica.operators import kge

    written, staged = [], kge.staged
    monkeypatch.setattr(kge, "staged", lambda df, name: written.append(name) or staged(df, name))
    t = spark.range(60).selectExpr("id AS h", "0L AS r", "(id * 7 + 1) % 60 AS t")
    rows = kge.train_in_buckets(t, 61, 1, kge.Settings(dim=4, epochs=2, negatives=2, batch=8, rate=0.1), 3, bucket=6).collect()
    assert written.count("entity-vectors") == 1 + 2 and sorted(r.id for r in rows) == list(range(61))
    start = np.random.default_rng((3, 60)).uniform(-3, 3, 4)  # an entity of no triple stays where it began
    assert np.allclose(next(r.v for r in rows if r.id == 60), start)


def test_headings_of_odd_lines(spark):
    """A line of white space that trim() leaves has no first word, which was an error; long rows of numbers are no heading."""
    from lattica.functions import text as T

    lines = ["1" + ".1" * 60000, "1" + ".1" * 60000 + ". Of it", "\t\t\t\t\t\t", "\u000b\u000b\u000b\u000b\u000b\u000b", "1.1 Introduction", "A Proofs of it", ""]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, line string").select("i", T.is_heading(F.col("line")).alias("h"), T.is_garbage(F.col("line")).alias("g")).collect()
    assert [r.h for r in sorted(rows)] == [False, False, False, False, True, True, False]
    assert all(r.g is not None for r in rows)


def test_references_cut_short_stay_as_they_are():
    from lattica.operators import documents as H

    assert H.read_blocks("<h1>a &quot</h1><p>b &quot; &am &amp &amp; &copy; &lt;i&gt; &qu</p>") == ("a &quot", [("h1", "a &quot"), ("p", 'b " &am & & © <i> &qu')])


def test_nearest_by_term_keeps_ties_in_order(spark):
    from lattica.operators import concepts as C

    rows = [(i, f"t{j}", 1.0) for i in range(40) for j in range(6) if (i * 3 + j * 5) % 4 < 2]
    v = spark.createDataFrame(rows, "id long, term string, w double").repartition(3)
    got = {}
    from lattica.operators import ranking as R

    for r in R.ranked(C.nearest_by_term(v.where("id % 10 = 0"), v, 5), 5).collect():
        got.setdefault(r.query, []).append((r["rank"], r.candidate, r.score))
    own = {i: {t for a, t, _ in rows if a == i} for i in range(40)}
    for q in range(0, 40, 10):
        want = sorted(((-len(own[q] & own[c]), c) for c in range(40) if c != q and own[q] & own[c]))[:5]
        assert [(c, s) for _, c, s in sorted(got.get(q, []))] == [(c, -float(n)) for n, c in [(n, c) for n, c in want]]
