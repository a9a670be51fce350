import zlib

import numpy as np
from cases import EDGE, edge_docs, empty_docs

from lattica.llm import quality, toxicity
from lattica.llm.labels import labelled_sample
from lattica.llm.registry import queries

SF = "/root/testdata/sf0.1"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def auc(score, y):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable").astype(float)
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    return (rank[y == 1].mean() - ((y == 1).sum() - 1) / 2) / (y == 0).sum()


def check(spark, name, label, cut):
    got = {r.doc_id: r for r in queries()[name](spark, SF).collect()}
    labels = [(r.doc_id, r[label]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in got.values())
    out = [(got[i].score, y) for i, y in labels if held(i)]
    score, y = (np.array(x) for x in zip(*out, strict=True))
    return auc(score, y), ((score >= cut) == y).mean()


def test_quality_on_held_out_labels(spark):
    area, right = check(spark, "op7_neighbour_votes", "quality", 0.3)
    assert area > 0.98 and right > 0.97


def test_toxicity_on_held_out_labels(spark):
    area, right = check(spark, "op5_noisy_channel", "toxic", 0.5)
    assert area > 0.95 and right > 0.97


def toy_docs(spark):
    rows = [(i, f"you are a moron number{i} indeed" if i % 4 == 0 else f"a kind and gentle reader number{i} indeed") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (1, None, None), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    return spark.createDataFrame(rows, "doc_id long, text string"), labels


def test_restores_disguised_words(spark):
    docs, labels = toy_docs(spark)
    model = toxicity.fit(docs, labels)
    assert any(f == "moron" for f, _ in model.rules)
    bad = ["m0r0n", "you M0R0N!!", "an m o r o n x", "moooooron", "m.o.r.o.n", "m*ron"]
    good = ["a gentle reader", "m on ron", "oxymoronic moroni", "2.0 4.0 (555) 12-34", "", "*** $$$ !!!"]
    score = model.scores([x.encode() for x in bad + good])
    assert (score[: len(bad)] >= 0.5).all() and (score[len(bad) :] < 0.5).all()


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(0)
    cost = rng.random((toxicity.SYMBOLS,) * 3) * 5

    def paths(span, i=0, text="", c=0.0):
        if i == len(span):
            yield text, c
            return
        for out, step, j in toxicity.lattice(span, False)[i]:
            yield from paths(span, j, text + out, c + step)

    def total(text, c):
        s = [0, 0, *map(toxicity.symbol, text), 0]
        return c + sum(cost[s[k], s[k + 1], s[k + 2]] for k in range(len(s) - 2))

    for span in ("m0r0n", "a1l", "coool", "5@5", "x"):
        want = min(total(t, c) for t, c in paths(span))
        found = toxicity.viterbi(span, cost, False, {})
        assert any(t == found and abs(total(t, c) - want) < 1e-9 for t, c in paths(span))


def test_edge_cases(spark):
    docs, labels = toy_docs(spark)
    for score in (quality.score_quality, toxicity.score_toxicity):
        got = score(edge_docs(spark), docs, labels).collect()
        assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
        assert score(empty_docs(spark), docs, labels).count() == 0
        for none in (labels.limit(0), labels.where("doc_id % 4 = 1")):  # no labels; labels of one kind
            assert score(edge_docs(spark), docs, none).count() == len(EDGE)
    for keep in (quality.accepted, toxicity.accepted):
        kept = keep(edge_docs(spark), docs, labels)
        assert kept.columns == edge_docs(spark).columns
        assert keep(empty_docs(spark), docs, labels).count() == 0
    assert toxicity.accepted(docs, docs, labels).count() == 300


def test_long_and_repeated_labelled_texts(spark):
    """Long texts are whole and fit under a byte budget; an id gives one text however often it is repeated."""
    long = [(i, ("moron " if i % 2 else "gentle ") + f"number{i} and so on " * 1500) for i in range(200)]
    docs = spark.createDataFrame(long + [(1, "zz" * 50)] * 40 + [(3, None)] * 5, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0), i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    sample, total = labelled_sample(docs, labels, "toxic")
    free = [i for i in range(200) if not held(i)]
    assert len(sample) == len(free) and total == {0: sum(i % 2 == 0 for i in free), 1: sum(i % 2 for i in free)}
    assert {t.decode() for t, _ in sample} == {"zz" * 50 if i == 1 else "" if i == 3 else long[i][1] for i in free}
    few, _ = labelled_sample(docs, labels, "toxic", most_bytes=20 * len(long[100][1]))
    assert 5 <= len(few) <= 24 and {y for _, y in few} == {0, 1} and {t for t, _ in few} <= {t for t, _ in sample}
    one, _ = labelled_sample(docs.where("doc_id > 3"), labels, "toxic", most_bytes=10)
    assert sorted(y for _, y in one) == [0, 1]
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(docs.where("doc_id > 3"), docs, labels).collect()}
    assert all((score[i] >= 0.5) == bool(i % 2) for i in score)


def test_whole_words_count():
    a, b = (quality.term_counts([f"abcdefgh{x}middle{x}ijklmnop".encode()]) for x in ("x", "y"))
    words = slice(quality.SHAPE_BINS, quality.SHAPE_BINS + quality.WORD_BINS)
    assert a[:, words].sum() == 1 and (a[:, words] != b[:, words]).any()


def test_tied_neighbours_all_vote():
    sample = [(b"one two three", y) for y in (1, 0, 1, 1)] + [(b"four five six seven", 0)] * 4
    model = quality.fit(sample, {0: 5, 1: 3}, rank=4, neighbours=1)
    assert abs(model.scores([b"one two three"])[0] - 0.75) < 1e-6


def test_a_rule_word_must_be_the_cheapest_reading():
    cost = np.full((toxicity.SYMBOLS,) * 3, 3.0)
    for x, y, z in zip([0, 0, *map(toxicity.symbol, "ball")], [0, *map(toxicity.symbol, "ball")], [*map(toxicity.symbol, "ball"), 0], strict=False):
        cost[x, y, z] = 0.01
    dear = {"": 0.0, "b": 0.0, "ba": 0.0, "bai": 0.0, "bail": 1.0}
    assert toxicity.viterbi("ba1l", cost, False, dear) == "ball"  # costs 1.2, the rule word 1.2 + KNOWN_COST
    assert toxicity.viterbi("ba1l", np.full_like(cost, 3.0), False, dear) == "bail"


def test_readings_are_kept_up_to_a_bound(monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_KEPT", 50)
    channel = toxicity.Channel(np.ones((toxicity.SYMBOLS,) * 3))
    for i in range(300):
        channel.token(f"a{i}b")
        channel.token("q1" * 200 + str(i))
    assert len(channel.memory) <= 50 and all(len(k) <= toxicity.LONGEST_KEPT + 1 for k in channel.memory)


def test_neighbour_votes_equal_brute_force():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    sample = [(" ".join(rng.choice(words[:40] if y else words[20:], 30)).encode(), y) for y in rng.integers(0, 2, 80).tolist()]
    model = quality.fit(sample, {0: 40, 1: 40}, rank=8, neighbours=7)
    texts = [" ".join(rng.choice(words, 25)).encode() for _ in range(20)]
    z = model.latent(quality.term_counts(texts)).astype(float)
    for i, got in enumerate(model.scores(texts)):
        sim = [(float(np.dot(z[i], v)), y) for v, y in zip(model.vectors.astype(float), model.labels, strict=True)]
        near = sorted(sim, reverse=True)[:7]
        w = [max(s, 1e-6) ** 8 * model.weights[y] for s, y in near]
        assert abs(sum(a for a, (_, y) in zip(w, near, strict=True) if y) / sum(w) - got) < 1e-3
