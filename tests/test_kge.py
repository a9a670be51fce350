"""Embedding models: gradients, losses, reproducibility, and a sweep on Spark."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import vectors as X
from lattica.operators import kge, ranking
from lattica.plans import flows


@pytest.mark.parametrize("name", sorted(kge.MODELS))
def test_gradients(name):
    score, we, wr = kge.MODELS[name]
    rng = np.random.default_rng(0)
    h, r, t = (rng.normal(size=(3, w * 4)) for w in (we, wr, we))
    g = rng.normal(size=3)
    for x, grad in zip((h, r, t), score(h, r, t, g), strict=True):
        for i in np.ndindex(x.shape):
            e = 1e-6
            x[i] += e
            up = (g * score(h, r, t)).sum()
            x[i] -= 2 * e
            down = (g * score(h, r, t)).sum()
            x[i] += e
            assert abs((up - down) / (2 * e) - grad[i]) < 1e-4


@pytest.mark.parametrize("loss,temperature", [("margin", 1.0), ("adv", 1.0), ("adv", 0.0)])
def test_loss_gradients(loss, temperature):
    s = kge.Settings(loss=loss, gamma=3.0, temperature=temperature)
    rng = np.random.default_rng(1)
    p, n = rng.normal(size=4), rng.normal(size=(4, 3))
    _, gp, gn = kge.loss_and_gradients(s, p, n)
    e = 1e-6
    for i in range(4):
        q = p.copy()
        q[i] += e
        assert abs((kge.loss_and_gradients(s, q, n)[0] - kge.loss_and_gradients(s, p, n)[0]) / e - gp[i]) < 1e-4
    if temperature != 1.0 or loss == "margin":  # softmax weights are held fixed in the gradient
        for i in np.ndindex(n.shape):
            q = n.copy()
            q[i] += e
            assert abs((kge.loss_and_gradients(s, p, q)[0] - kge.loss_and_gradients(s, p, n)[0]) / e - gn[i]) < 1e-4


def ring(n=24):
    return np.array([(i, 0, (i + 1) % n) for i in range(n)] + [(i, 1, (i + 2) % n) for i in range(n)])


@pytest.mark.parametrize("name", sorted(kge.MODELS))
def test_training_is_reproducible_and_learns(name):
    s = kge.Settings(model=name, dim=8, epochs=40, batch=16, negatives=4, rate=0.05)
    a, b = kge.train(ring(), 24, 2, s, 3), kge.train(ring(), 24, 2, s, 3)
    assert (a[0] == b[0]).all() and a[2] == b[2]
    assert np.mean(a[2][-5:]) < 0.8 * np.mean(a[2][:5])
    with pytest.raises(ValueError):
        kge.train(np.empty((0, 3), int), 2, 1, s, 0)


def test_columns_equal_numpy(spark):
    rng = np.random.default_rng(2)
    h, r, t = (rng.normal(size=(5, 8)) for _ in range(3))
    df = spark.createDataFrame([(i, *(x[i].tolist() for x in (h, r, t))) for i in range(5)], "i int, h array<double>, r array<double>, t array<double>")
    h_, r_, t_ = map(F.col, "hrt")
    got = df.select("i", X.transe_score(h_, r_, t_), X.complex_score(h_, r_, t_, 4), X.rotate_score(h_, F.slice(r_, 1, 4), t_, 4)).orderBy("i").collect()
    want = np.stack([kge.transe(h, r, t), kge.complex_(h, r, t), kge.rotate(h, r[:, :4], t)], 1)
    assert np.allclose([list(x)[1:] for x in got], want, atol=1e-9)
    losses = df.select(X.adversarial_loss(h_[0], t_, 3.0, 1.0), X.margin_loss(h_[0], t_[0])).collect()
    s = kge.Settings(loss="adv", gamma=3.0)
    assert np.allclose([x[0] for x in losses], [kge.loss_and_gradients(s, h[i, :1], t[i : i + 1])[0] for i in range(5)])


def test_sweep_checkpoint_and_evaluation(spark, tmp_path):
    names = [f"paper:{i}" for i in range(24)]
    train = spark.createDataFrame([(names[a], "mentions" if r else "near", names[b]) for a, r, b in ring()], "h string, r string, t string")
    papers = spark.createDataFrame([(n,) for n in names], "node string")
    truth = spark.createDataFrame([(names[i], names[(i + 1) % 24]) for i in range(0, 24, 3)], "query string, candidate string")
    s = kge.Settings(model="transe", dim=8, epochs=30, batch=16, negatives=4, rate=0.05)
    got = flows.link_prediction(spark, train, papers, truth, [(s, 1), (s, 2)]).collect()
    assert [(r.model, r.seed, r.n) for r in got] == [("transe", 1, 8), ("transe", 2, 8)] and all(0 < r.mrr <= 1 for r in got)
    summary = ranking.seed_summary(spark.createDataFrame(got), ["model"], "mrr").first()
    assert summary.n == 2 and summary.min <= summary.mean <= summary.max
    v = spark.createDataFrame([(0, [1.0])], "id long, v array<double>")
    kge.save(v, papers, s, f"file://{tmp_path}/m")
    assert kge.load(spark, f"file://{tmp_path}/m")[2] == s


def test_metrics_at_the_edges(spark):
    rows = [("q1", "a", 0.9), ("q1", "b", 0.9), ("q2", "a", 0.1), *(("q3", f"c{i:02d}", 1 - i / 20) for i in range(12))]
    scores = spark.createDataFrame(rows, "query string, candidate string, score double")
    truth = spark.createDataFrame([("q1", "b"), ("q2", "zz"), ("q3", "c05"), ("q3", "c10")], "query string, candidate string")
    m = ranking.evaluate(scores, truth, truth.where("query = 'q3'")).first()
    assert (m.n, m.hits_1, m.hits_5, m.hits_10, m.filt_n) == (2, 0.0, 0.5, 1.0, 1) and abs(m.mrr - (1 / 2 + 1 / 6) / 2) < 1e-12
    assert {(r.query, r.candidate): r["rank"] for r in ranking.truth_ranks(scores, truth).collect()}["q2", "zz"] is None
    a, b = ranking.exact_split([3, 1, 2, 5, 4], 0.5, 42)
    assert (a, b) == ranking.exact_split([5, 4, 3, 2, 1], 0.5, 42) and not a & b and len(a) == 2
    few = ranking.sampled_by_stratum(spark.range(100).selectExpr("id", "id % 4 AS s"), "s", "id", 3, 10, 17).collect()
    assert len(few) == 10 and len({r.id for r in few}) == 10


@pytest.mark.parametrize("name", sorted(kge.MODELS))
def test_training_in_buckets_learns_and_repeats(spark, name):
    """Three buckets of entities: every triple is seen once an epoch, and the same seed gives the same vectors."""
    t = spark.createDataFrame([tuple(map(int, x)) for x in ring()], "h long, r long, t long")
    s = kge.Settings(model=name, dim=8, epochs=4, batch=16, negatives=4, rate=0.3)

    def vectors():
        rows = kge.train_runs(t, 24, 2, [(s, 3)], bucket=8).collect()
        assert {(r.model, r.seed) for r in rows} == {(name, 3)} and sorted(r.id for r in rows) == list(range(24))
        return np.array([r.v for r in sorted(rows, key=lambda r: r.id)])

    a = vectors()
    assert (a == vectors()).all() and np.isfinite(a).all()
    assert len(np.unique(a.round(6), axis=0)) == 24
