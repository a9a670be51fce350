import random

import corpus_pipeline
import numpy as np
from cases import edge_docs, empty_docs
from test_near_duplicates import roots

from lattica.llm import jaccard, simhash


def grams(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def brute(texts):
    g = [grams(t or "") for t in texts]
    return roots(len(g), [(i, j) for i in range(len(g)) for j in range(i) if similar(g[i], g[j])])


def changed_copies(n=12, size=200):
    """Texts, and copies with a few words replaced: about half of them over 0.8."""
    r = random.Random(4)
    out = []
    for k in range(n):
        words = [f"w{r.randrange(5000)}" for _ in range(size)]
        out.append(" ".join(words))
        for changes in (2, 3, 4, 5):
            copy = list(words)
            for i in r.sample(range(size), changes):
                copy[i] = f"new{k}x{i}"
            out.append(" ".join(copy))
    return out


def test_stage_keeps_one_of_each_component(spark):
    texts = changed_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    root = brute(texts)
    assert kept == {i for i, x in enumerate(root) if i == x}
    assert len(kept) < len(texts) / 2


def test_components_equal_brute_force(spark, monkeypatch):
    for sf, block in (("sf0.01", jaccard.BLOCK), ("sf0.001", 500)):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()
        root = brute([r.text for r in docs])
        monkeypatch.setattr(jaccard, "BLOCK", block)
        got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(docs)).collect()}
        assert got == {d.doc_id: docs[root[i]].doc_id for i, d in enumerate(docs)}


def test_forest_spans_all_links():
    r = np.random.default_rng(1)
    sets = []
    for _ in range(30):
        base = np.unique(r.integers(0, 1 << 62, 60, dtype=np.uint64))
        sets += [np.unique(np.concatenate([base[r.random(len(base)) > 0.08], r.integers(0, 1 << 62, 3, dtype=np.uint64)])) for _ in range(5)]
    held = [set(s.tolist()) for s in sets]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if similar(held[i], held[j])]
    assert roots(len(sets), zip(*jaccard.forest(sets), strict=True)) == roots(len(sets), links)


def test_awkward_rows(spark):
    got = jaccard.near_duplicates(edge_docs(spark)).collect()
    by = {r.doc_id: r.component_id for r in got}
    assert len(got) == 10 and by[2] == by[3] == by[4] == 2 and by[6] == 6 and by[None] is None
    assert jaccard.near_duplicates(empty_docs(spark)).count() == 0
    rows = [(None, "a b c d e f"), (7, "A b c d e f"), (5, "one"), (5, "two"), (9, "two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.component_id for r in jaccard.near_duplicates(docs).collect())) == [5, 5, 5, 7, 7]
    left = lambda rows: sorted((r.doc_id, r.text) for r in jaccard.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert left(rows) == [(5, "one"), (5, "two"), (7, "A b c d e f")]


def test_no_text_is_lost_with_shared_ids(spark):
    """Rows stay or go by their own text: what occurs nowhere else is kept, whatever its id."""
    rows = [(3, "alpha beta gamma delta"), (5, "alpha beta gamma delta"), (5, "another text"), (None, "another text"), (None, "lone"), (None, "lone"), (3, "alpha beta gamma delta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS key", "1 AS key_")
    for keep in (jaccard.deduplicated, simhash.deduplicated):
        kept = keep(docs)
        assert kept.columns == docs.columns
        assert sorted(((r.doc_id or 0, r.text) for r in kept.collect())) == [(0, "lone"), (0, "lone"), (3, rows[0][1]), (3, rows[0][1]), (5, "another text")]
