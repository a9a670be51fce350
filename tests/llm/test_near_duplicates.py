import re
from itertools import combinations

import numpy as np
import xxhash
from cases import CLASH, EDGE, edge_docs, empty_docs, key

from lattica.llm import embeddings, simhash
from lattica.llm.components import components
from lattica.llm.embeddings import near_duplicate_vectors
from lattica.llm.registry import queries


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_covering_meets_every_four_positions():
    assert len(simhash.TRIPLES) == 20
    assert all(any(set(t) <= set(four) for t in simhash.TRIPLES) for four in combinations(range(8), 4))


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    fp = np.array([brute_fingerprint(r.text) for r in docs], np.uint64)
    links = [(i, j) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp[:i] ^ fp[i]) <= 4)]
    root = roots(len(fp), links)
    got = {r.doc_id: r for r in queries()["op3_simhash_index"](spark, "/root/testdata/sf0.001").collect()}
    for i, d in enumerate(docs):
        assert got[d.doc_id].fingerprint == f"{int(fp[i]):016x}" and got[d.doc_id].component_id == docs[root[i]].doc_id


def fingerprints_as_table(spark, fp):
    return spark.createDataFrame([(int(np.uint64(x).astype(np.int64)), i) for i, x in enumerate(fp)], "fp long, rep long")


def test_links_of_crowded_lists_span_all(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(700)], np.uint64)
    fp = np.unique(np.concatenate([base[rng.integers(0, 6, 700)] ^ flips, rng.integers(0, 1 << 63, 300, dtype=np.uint64)]))
    want = roots(len(fp), [(i, j) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp[:i] ^ fp[i]) <= 4)])
    for hot, sample in ((simhash.HOT, 64), (20, 1), (20, 10**6)):  # lists; tiles that a sample shows; tiles of what it missed
        monkeypatch.setattr(simhash, "HOT", hot)
        monkeypatch.setattr(simhash, "SAMPLE", sample)
        got = [(r.a, r.b) for r in simhash.links(fingerprints_as_table(spark, fp)).collect()]
        assert all(int(np.bitwise_count(fp[a] ^ fp[b])) <= 4 for a, b in got)
        assert roots(len(fp), got) == want


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_edge_cases(spark):
    got = simhash.near_duplicates(edge_docs(spark)).collect()
    assert len(got) == len(EDGE)
    by = {r.doc_id: r for r in got}
    assert by[2].component_id == by[3].component_id == by[4].component_id == 2 and by[2].fp == 0
    assert by[7].component_id == 6
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0
    kept = simhash.deduplicated(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns and len(CLASH.split(", ")) + 2 == len(kept.columns)
    ids = [r.doc_id for r in kept.collect()]
    assert 3 not in ids and 4 not in ids and 7 not in ids and {1, 2, 5, 6, 8, None} <= set(ids)


def test_rows_that_share_an_id_or_have_none(spark):
    """A row without an id links two documents; a row's component comes from its own text."""
    text = "one two three four five six seven eight"
    rows = [(3, "alpha beta gamma delta"), (5, "alpha beta gamma delta"), (5, text), (None, text), (9, text), (None, "nobody has this")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 5), (3, 3), (5, 3), (5, 5), (9, 5)]


def brute_vectors(rows):
    """(n_links, component_id) of each row, by comparing all."""
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = np.zeros((len(rows), len(rows)), bool)
    for n in {len(rows[i][1]) for i in ok}:
        own = [i for i in ok if len(rows[i][1]) == n]
        x = np.array([rows[i][1] for i in own], float)
        u = x / np.linalg.norm(x, axis=1)[:, None]
        links[np.ix_(own, own)] = u @ u.T >= 0.95
    np.fill_diagonal(links, False)
    root = roots(len(rows), np.argwhere(links).tolist())
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [(d, int(links[i].sum()), least[root[i]]) for i, (d, _) in enumerate(rows)]


def check_vectors(spark, rows, blocks):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS own", "'y' AS n_links", "'z' AS v", "1 AS k", "2 AS pos")
    want = sorted(brute_vectors(rows), key=key)
    for block in blocks:
        got = near_duplicate_vectors(table, block=block).collect()
        assert sorted(((r.id, r.n_links, r.component_id) for r in got), key=key) == want


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(12, 16))
    x = np.vstack([c := centre[rng.integers(0, 12, 300)] + 0.17 * rng.normal(size=(300, 16)), np.repeat(c[:1], 60, 0)])
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0] * 3), (5004, [None] * 16), (5005, []), (5006, [float("inf")] * 16), (None, [1.0] * 16)]
    check_vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)] + odd, (32, 8192))
    assert near_duplicate_vectors(spark.createDataFrame(odd, "vec_id long, embedding array<double>").limit(0)).count() == 0


def test_vectors_of_minority_lengths_and_shared_ids(spark):
    rng = np.random.default_rng(4)
    two = rng.normal(size=(40, 2))
    rows = [(i, v.tolist()) for i, v in enumerate(two)] + [(100, [1.0, 2.0, 3.0]), (101, [1.0, 2.0, 3.0]), (102, [2.0, 4.0, 6.1]), (103, [-1.0, 2.0, 3.0])]
    rows += [(7, two[3].tolist()), (7, [9.0, 9.0, -50.0]), (None, [1.0, 2.0, 3.0]), (None, [0.5]), (200, [-2.0]), (3, [7.0]), (3, [7.0])]
    check_vectors(spark, rows, (4, 8192))


def test_tree_cells_hold_all_in_reach():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(300, 3)) * [1, 0.3, 0.1], np.zeros((50, 3))])
    tree = embeddings.Tree.of(x[::2], len(x), 20)
    row, cell, own = tree.cells(x, 0.4)
    home = np.empty(len(x), int)
    home[row[own]] = cell[own]
    assert own.sum() == len(x) and tree.leaves > 8
    seen = set(zip(row.tolist(), cell.tolist(), strict=True))
    near = np.argwhere(np.linalg.norm(x[:, None] - x[None], axis=2) <= 0.4)
    assert all((i, home[j]) in seen for i, j in near.tolist())
    assert len(seen) < len(x) * tree.leaves / 2


def test_vector_query(spark):
    got = queries()["op9_pca_tiles"](spark, "/root/testdata/sf0.001").collect()
    rows = {r.vec_id: r.embedding for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()}
    assert len(got) == len(rows)
    x = np.array([rows[r.vec_id] for r in got], float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert [r.n_links for r in got] == ((u @ u.T >= 0.95).sum(1) - 1).tolist()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
