import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import pytest
from cases import EDGE, edge_docs, empty_docs

from lattica.llm import decontaminate, licences, maxent, sharding
from lattica.llm.licence_texts import LICENCE_TEXTS
from lattica.llm.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def tok(x):
    return re.findall(r"[^\W_]+", x.lower())


def test_masks_hit_every_tolerated_window():
    w, m = decontaminate.WINDOW, decontaminate.MISSES
    for gone in combinations(range(w), m):
        assert any(all(o + i not in gone for i in mask) for mask in decontaminate.MASKS for o in range(w - max(mask)))


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(3)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    items = [(r.item_id, r.text) for r in bench] + [(9000, "five little words stand here"), (9001, "too short now"), (9002, None), (None, "one two three four five six"), (9003, ""), (9000, "five little words stand here")]
    rows = []
    for k in range(150):
        w = tok(rng.choice(items[:40])[1])[rng.randint(0, 5) :]
        rate = rng.choice([0, 0.05, 0.1, 0.2, 0.3])
        rows.append((k, "x y z " * rng.randint(0, 3) + " ".join(x if rng.random() > rate else f"zz{rng.randint(0, 9)}" for x in w).upper() + " tail end"))
    rows += [(1000, "a b Five, little-words stand HERE c"), (1001, "five little words were here"), (None, items[0][1]), (1004, "w " * 50_000 + items[0][1]), *EDGE]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS hash", "3 AS tokens")
    bench_table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS hash")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench_table).collect()}
    want = {(1004, items[0][0])}
    for i, x in rows:
        if i is None or not x or len(x) > 50_000:
            continue
        w = tok(x)
        for j, y in items:
            v = tok(y or "")
            if j is None or len(v) < 5:
                continue
            n = min(13, len(v))
            least = n - 2 if len(v) >= 13 else n
            if any(sum(p == q for p, q in zip(w[a : a + n], v[c : c + n], strict=True)) >= least for a in range(len(w) - n + 1) for c in range(len(v) - n + 1)):
                want.add((i, j))
    assert got == want
    clean = decontaminate.decontaminated(docs, bench_table)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontaminate.overlaps(docs.limit(0), bench_table).count() == 0 and decontaminate.overlaps(docs, bench_table.limit(0)).count() == 0


def test_verbatim_passages_of_the_tables(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{n}.parquet").collect() for n in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in queries()["op4_spaced_seeds"](spark, SF).collect()}
    assert {(d.doc_id, b.item_id) for d in docs for b in bench if b.text in d.text} == got


def test_licence_scan(spark):
    mit = next(t for k, t in LICENCE_TEXTS if k == "MIT")
    varied = "Copyright (c) 2020 Some One\nCopyright 2021, Other\nAll rights reserved.\n" + mit.upper().replace("LICENSE", "LICENCE").replace(",", " ,  ").replace("\n\n", "\n \n")
    rows = [(100, varied), (101, mit + " and more"), (102, "Some prose.\nReleased under the M.I.T. licence.\nReleased under the MIT Licence!\n"), *EDGE]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS digest", "'y' AS license_id")
    got = licences.scan_licences(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[100].license_id == "MIT" and by[101].license_id is None and by[102].notices == "MIT" and by[1].notices == ""
    assert by[2].license_id is None and by[2].digest == by[3].digest
    assert licences.scan_licences(empty_docs(spark)).count() == 0


COMMON = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not COMMON.exists(), reason="no licence texts on this machine")
def test_long_licences_are_known_by_their_digests(spark):
    """The whole texts, as the system has them; changed spelling and case; one word more is another text."""
    names = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    rows = [(i, (COMMON / f).read_text()) for i, f in enumerate(names)]
    rows += [(100 + i, "Copyright (c) 2001 Somebody Else\n" + t.upper().replace("LICENSE", "LICENCE").replace(",", " -- ")) for i, t in rows] + [(200 + i, t + " more") for i, t in rows]
    rows += [(300, rows[0][1].split("END OF TERMS AND CONDITIONS")[0])]
    got = {r.doc_id: r.license_id for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = dict(enumerate(names.values()))
    assert got == want | {100 + i: k for i, k in want.items()} | {200 + i: None for i in want} | {300: "Apache-2.0"}


def test_notices_of_several_paragraphs(spark):
    mit, apache = (next(t for k, t in LICENCE_TEXTS if k == n and t.count("\n\n") > 1) for n in ("MIT", "Apache-2.0"))
    rows = [(1, f"Some prose.\n\n{apache}\n\nMore prose.\n \n{mit}\n\nThe end."), (2, apache.replace("\n\n", "\n\nbut\n\n")), (3, "a\n\n" * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.notices for r in licences.scan_licences(docs).collect()}
    assert got == {1: "Apache-2.0,MIT", 2: "", 3: ""}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert {r[0]: r[1] for r in con.execute(f"SELECT doc_id, notices FROM ({oracle_sql()['op10_licence_digests']})").fetchall()} == got


def test_licence_scan_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, digest, license_id, notices FROM ({oracle_sql()['op10_licence_digests']})").fetchall())
    got = sorted((r.doc_id, r.digest, r.license_id, r.notices) for r in queries()["op10_licence_digests"](spark, SF).collect())
    assert got == want and any(r[3] for r in got)


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def base_scores(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", low(t)) + [None] for _, t in rows]
    c = Counter(w for (i, _), ws in zip(rows, words, strict=True) if not is_held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, is_held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for (i, _), ws in zip(rows, words, strict=True)]


def test_language_model_base_and_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries()["op6_class_maxent"](spark, "/root/testdata/sf0.01").collect()}
    for i, held, n, known, total, base in base_scores([tuple(r) for r in docs]):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total) and math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-6)
        assert math.isfinite(r.score) and r.score < 0
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.3 * sum(r.n_tokens for r in out)


def test_language_model_edge_cases(spark):
    got = maxent.score_texts(edge_docs(spark)).collect()
    want = base_scores(EDGE)
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for r, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert r[:5] == w[:5] and math.isclose(r[5], w[5], rel_tol=1e-9, abs_tol=1e-9) and math.isfinite(r[6])
    assert maxent.score_texts(empty_docs(spark)).count() == 0
    one = maxent.score_texts(spark.createDataFrame([(i, "a b a") for i in range(200) if is_held(i)], "doc_id long, text string"))
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in one.collect())


def test_language_model_sums_to_one():
    """Over the known words, one unseen word of each class, for a fixed context."""
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice([f"w{chr(97 + i % 26)}{chr(97 + i % 7)}{i}" for i in range(50)], 40)).encode() for _ in range(20)]
    t = maxent.Tokens.of(texts)
    key, first, n = np.unique(t.h, return_index=True, return_counts=True)
    cls, leaf, leaves = t.cls[first], t.leaves()[1][first], maxent.CLASSES * maxent.SUBS
    mass, kinds, single = (np.bincount(leaf, w, leaves) for w in (n, np.ones(len(n)), (n == 1)))
    weights = rng.normal(size=(maxent.ROWS, maxent.CLASSES)).astype(np.float32)
    model = maxent.Model(weights, np.array([0, 0.1, 0.3]), int(n.sum()), maxent.Counts(mass, kinds, single))
    context = maxent.Tokens.of([b"wab1 wbc2 next"])
    total = 0.0
    new = [(np.uint64(10**9 + c), c, 0) for c in range(maxent.CLASSES)]  # an unseen word of each class
    for h, c, count in [*zip(key, cls, n, strict=True), *new]:
        x = maxent.Tokens(context.h.copy(), context.cls.copy(), context.first)
        x.h[2], x.cls[2] = h, c
        total += 10 ** model.score(x, np.array([1, 1, count, 1]))[1][2]
    repeated = context.h[1] in key
    assert abs(total - (1 if repeated else 1 - model.repeat[1])) < 1e-4


def test_scores_equal_brute_force(spark, monkeypatch):
    """The whole query against plain Python: features, leaves, counts, discounts and repeats word by word, with the
    weights that the query trained (their training is tested below)."""
    rng = random.Random(6)
    words = [f"{rng.choice('abcdef')}{rng.choice('ghij')}{rng.choice('klmnopq')}" for _ in range(40)]
    rows = [(i, " ".join(rng.choice(words[: 10 + 30 * (i % 2)]) for _ in range(rng.randint(0, 40)))) for i in range(120)] + [(200, "klm klm klm new9 klm"), (None, "abc"), (201, None)]
    made = []
    start = maxent.Model.__init__
    monkeypatch.setattr(maxent.Model, "__init__", lambda self, *a: (start(self, *a), made.append(self))[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in maxent.score_texts(docs).collect())
    model = made[0]

    def of(text):
        """(hash, class, subclass, key) of every token, the end last."""
        t = maxent.Tokens.of([(text or "").encode()])
        return list(zip(map(int, t.h), map(int, t.cls), map(int, t.leaves()[0]), low(text or "").split() + [None], strict=True))

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    count, leaf_of, again = Counter(), {}, Counter()
    for i, text in rows:
        if not held(i):
            before, was = None, None
            for h, c, sub, w in of(text):
                count[w] += 1
                leaf_of[w] = (c, sub)
                state = 0 if before is None else 1 + bool(was)
                was = before is not None and h == before
                again[state, was] += 1
                before = h
    mass, kinds, once = Counter(), Counter(), Counter()
    for w, n in count.items():
        mass[leaf_of[w]] += n
        kinds[leaf_of[w]] += 1
        once[leaf_of[w]] += n == 1
    u64 = lambda x: np.array([x % (1 << 64)], np.uint64)

    def soft(features, choice, among=None):
        s = sum(model.weights[f].astype(float) for f in features)
        n = [1] * len(s) if among is None else among
        return s[choice] + math.log(n[choice]) - math.log(sum(math.exp(x) * m for x, m in zip(s, n, strict=True)))

    def score(text):
        total, tokens = 0.0, of(text)
        was = False
        for k, (h, c, sub, w) in enumerate(tokens):
            h1, c1 = (tokens[k - 1][0], tokens[k - 1][1]) if k > 0 else (1, 0)
            h2, c2 = (tokens[k - 2][0], tokens[k - 2][1]) if k > 1 else (1, 0)
            b = maxent.BINS
            rows = [h1 % b, b + int(maxent.mix(u64(h1 * 3 + h2 * 7))[0]) % b, 2 * b + (h2 >> 20) % b, 3 * b + (c1 * maxent.CLASSES + c2) % b]
            subs = [4 * b + j * maxent.SUB_BINS + int(maxent.mix(u64(x * (5 + 2 * j) + (c + 1) * 0x9E3779B97F4A7C15))[0]) % maxent.SUB_BINS for j, x in enumerate((h1, h2))]
            leaf = (c, sub)
            of_class = lambda x, c=c: sum(n for (k, _), n in x.items() if k == c)
            d = min(max(of_class(once), 0.5) / max(of_class(kinds), 1), 0.9)
            unseen = d * of_class(kinds) / of_class(mass) if of_class(mass) else 1.0
            choose = soft(subs, sub, [mass[c, x] for x in range(maxent.SUBS)]) if count[w] else 0.0
            within = (1 - unseen) * (count[w] - d) / (mass[leaf] - d * kinds[leaf]) if count[w] else unseen
            same = k > 0 and h == h1
            state = 0 if k == 0 else 1 + was
            r = 0.0 if state == 0 else (again[state, True] + 0.5) / (again[state, True] + again[state, False] + 1)
            was = same
            total += math.log10((1 - r) * math.exp(soft(rows, c) + choose) * within + r * same)
        return total

    want = sorted((i is None, i or 0, score(t)) for i, t in rows)
    assert all(a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-4, abs_tol=1e-3) for a, b in zip(got, want, strict=True))
    assert np.abs(model.weights).max() > 0.01


def test_gradient_updates_lower_the_loss():
    t = maxent.Tokens.of([b"aa bb cc dd " * 300])
    w = np.zeros((maxent.ROWS, maxent.CLASSES), np.float32)
    f = t.features()
    loss = lambda: -maxent.log_of(w, f, t.cls).mean()
    before = loss()
    squares, met = np.ones_like(w), np.zeros(len(w))
    for _ in range(3):
        maxent.descend(w, squares, met, f, t.cls)
    assert loss() < 0.5 * before and met.sum() == 3 * 4 * len(t.h)


def test_sharding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries()["op8_virtual_slots"](spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(texts)
    load = Counter()
    for r in got:
        b = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(b) + 1, zlib.crc32(b), "bytes", None)
        load[r.shard] += r["size"]
    assert sorted(load) == list(range(16)) and max(load.values()) < 1.01 * min(load.values())
    for k in range(16):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_bytes_law_holds_under_a_repeated_record(spark):
    rng = random.Random(8)
    rows = [(5, "x" * 200)] * 700 + [(i, "y" * rng.randint(50, 350)) for i in range(1000, 2400)] + [(None, None)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS size", "2 AS h", "3 AS pos", "4 AS shard", "5 AS slot").repartition(5)
    got = sharding.shard_documents(docs, store="/tmp/none" + str(rng.random())).collect()
    load = Counter()
    for r in got:
        load[r.shard] += r["size"]
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(t or "") + 1) for i, t in rows)
    assert len(load) == 16 and max(load.values()) - min(load.values()) <= 700
    for k in load:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_stored_map_is_loaded_and_edited(spark, tmp_path):
    """The same table again changes nothing; a grown one edits the stored map and keeps the earlier version."""
    store = f"file://{tmp_path}/map"
    docs = spark.createDataFrame([(i, "z" * (i % 97)) for i in range(1500)], "doc_id long, text string")
    first = {r.doc_id: r for r in sharding.shard_documents(docs, store=store).collect()}
    again = {r.doc_id: r for r in sharding.shard_documents(docs, store=store).collect()}
    assert again == first and {r.map_version for r in again.values()} == {1}
    more = docs.union(spark.createDataFrame([(i, "w" * 400) for i in range(5000, 5400)], docs.schema))
    grown = {r.doc_id: r for r in sharding.shard_documents(more, store=store).collect()}
    assert {r.map_version for r in grown.values()} == {2}
    assert all(grown[i].virtual_slot == r.virtual_slot for i, r in first.items())
    stay = sum(grown[i].shard == r.shard for i, r in first.items())
    assert stay > 0.5 * len(first)
    old, new = (sharding.SlotMap.load(spark, store, v) for v in (1, 2))
    assert old.version == 1 and new == sharding.SlotMap.load(spark, store)
    wider = sharding.shard_documents(more, shards=17, store=store).collect()
    assert {r.map_version for r in wider} == {3} and {r.shard for r in wider} == set(range(17))


def test_sharding_edge_cases(spark):
    got = sharding.shard_documents(edge_docs(spark)).collect()
    assert len(got) == len(EDGE) and all(0 <= r.shard < 16 for r in got)
    assert sorted(r.text_crc32 for r in got) == sorted(zlib.crc32((t or "").encode()) for _, t in EDGE)
    assert sharding.shard_documents(empty_docs(spark)).count() == 0


def test_slot_map_edits(spark, tmp_path):
    rng = random.Random(0)
    weight = [rng.randint(0, 100) for _ in range(512)]
    first = sharding.SlotMap.initial(512, 8).rebalanced(weight)
    weight[3] += 2000
    second = first.rebalanced(weight)
    grown = second.rebalanced(weight, 9)
    load = [sum(w for w, o in zip(weight, grown.owner, strict=True) if o == k) for k in range(9)]
    assert max(load) - min(load) <= 2100 - 90 and (first.version, second.version, grown.version) == (1, 2, 3)
    assert sum(a != b for a, b in zip(first.owner, second.owner, strict=True)) < 256
    path = f"file://{tmp_path}/map"
    first.save(spark, path)
    second.save(spark, path)
    assert sharding.SlotMap.load(spark, path) == second and sharding.SlotMap.load(spark, path, 1) == first
