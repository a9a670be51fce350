"""Knowledge-graph embeddings: TransE, ComplEx and RotatE in numpy.

Runs (model, seed, settings) are independent. A run of up to MOST_TRIPLES triples and BUCKET entities is one task of a
grouped map, so a sweep over models and seeds trains side by side. A larger run deals its triples into groups: in each
epoch a task trains on one group with the vectors of its entities alone, and what the groups make of an entity is
averaged by the triples they saw. Each triple is seen once an epoch, and an epoch's work is in proportion to entities and
triples: pairs of buckets of entities would write all vectors once for each bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.sources.tables import discard, staged

MOST_TRIPLES = 20_000_000
BUCKET = 200_000
EPS = 1e-9


@dataclass(frozen=True)
class Settings:
    model: str = "transe"
    dim: int = 128
    margin: float = 1.0
    rate: float = 0.01
    epochs: int = 1000
    batch: int = 256
    negatives: int = 10
    loss: str = "margin"
    gamma: float = 9.0
    temperature: float = 1.0


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return x / n, n


def transe(h: np.ndarray, r: np.ndarray, t: np.ndarray, g: np.ndarray | None = None):
    """Scores, or with g (d loss / d score) the gradients for h, r, t."""
    (hu, hn), (tu, tn) = _unit(h), _unit(t)
    d = hu + r - tu
    n = np.sqrt((d * d).sum(1) + 1e-18)
    if g is None:
        return -n
    s = -g[:, None] * d / n[:, None]
    back = lambda u, m, x: (x - u * (u * x).sum(1, keepdims=True)) / m
    return back(hu, hn, s), s, back(tu, tn, -s)


def complex_(h: np.ndarray, r: np.ndarray, t: np.ndarray, g: np.ndarray | None = None):
    k = h.shape[1] // 2
    (a, b), (c, d), (e, f) = ((x[:, :k], x[:, k:]) for x in (h, r, t))
    if g is None:
        return (a * c * e + b * c * f + a * d * f - b * d * e).sum(1)
    g = g[:, None]
    return np.hstack([g * (c * e + d * f), g * (c * f - d * e)]), np.hstack([g * (a * e + b * f), g * (a * f - b * e)]), np.hstack([g * (a * c - b * d), g * (b * c + a * d)])


def rotate(h: np.ndarray, r: np.ndarray, t: np.ndarray, g: np.ndarray | None = None):
    k = h.shape[1] // 2
    (a, b), (e, f) = (h[:, :k], h[:, k:]), (t[:, :k], t[:, k:])
    c, s = np.cos(r), np.sin(r)
    re, im = a * c - b * s - e, a * s + b * c - f
    m = np.sqrt(re * re + im * im + EPS)
    if g is None:
        return -m.sum(1)
    x, y = -g[:, None] * re / m, -g[:, None] * im / m
    return np.hstack([x * c + y * s, -x * s + y * c]), x * (-a * s - b * c) + y * (a * c - b * s), np.hstack([-x, -y])


#: Model: score function, entity width and relation width as multiples of dim.
MODELS: dict[str, tuple[Callable, int, int]] = {"transe": (transe, 1, 1), "complex": (complex_, 2, 2), "rotate": (rotate, 2, 1)}


def initial(s: Settings, entities: int, relations: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    _, we, wr = MODELS[s.model]
    b = 6 / s.dim**0.5
    rel = rng.uniform(-np.pi, np.pi, (relations, wr * s.dim)) if s.model == "rotate" else rng.uniform(-b, b, (relations, wr * s.dim))
    return rng.uniform(-b, b, (entities, we * s.dim)), rel


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def loss_and_gradients(s: Settings, positive: np.ndarray, negative: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss of positives (n) against their negatives (n x k), and its derivatives by both scores."""
    n, k = negative.shape
    if s.loss == "margin":
        gap = s.margin - positive[:, None] + negative
        on = (gap > 0) / (n * k)
        return float(np.maximum(gap, 0).mean()), -on.sum(1), on
    p, q = _sigmoid(-(s.gamma + positive)), _sigmoid(s.gamma + negative)
    if s.temperature > 0:
        w = np.exp(s.temperature * (negative - negative.max(1, keepdims=True)))
        w /= w.sum(1, keepdims=True)
    else:
        w = np.full_like(negative, 1 / k)
    value = np.logaddexp(0, -(s.gamma + positive)) + (w * np.logaddexp(0, s.gamma + negative)).sum(1)
    return float(value.mean() / 2), -p / (2 * n), w * q / (2 * n)


class _Adam:
    def __init__(self, x: np.ndarray, rate: float):
        self.x, self.rate, self.m, self.v, self.t = x, rate, np.zeros_like(x), np.zeros_like(x), 0

    def step(self, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        self.x -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def corrupt(batch: np.ndarray, entities: int, k: int, rng: np.random.Generator) -> np.ndarray:
    """k corruptions of each triple: head or tail, evenly, becomes a random entity."""
    neg = np.repeat(batch, k, axis=0)
    other = rng.integers(0, entities, len(neg))
    head = rng.random(len(neg)) < 0.5
    neg[head, 0], neg[~head, 2] = other[head], other[~head]
    return neg


def train(triples: np.ndarray, entities: int, relations: int, s: Settings, seed: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Entity and relation matrices, and the mean loss of each epoch. The same seed gives the same run."""
    if not len(triples):
        raise ValueError("no triples to train on")
    rng = np.random.default_rng(seed)
    ent, rel = initial(s, entities, relations, rng)
    score, _, _ = MODELS[s.model]
    adam_e, adam_r = _Adam(ent, s.rate), _Adam(rel, s.rate)
    losses = []
    k = max(s.negatives, 1)
    for _ in range(s.epochs):
        order, total, n = rng.permutation(len(triples)), 0.0, 0
        for i in range(0, len(order), s.batch):
            pos = triples[order[i : i + s.batch]]
            neg = corrupt(pos, entities, k, rng)
            sp = score(ent[pos[:, 0]], rel[pos[:, 1]], ent[pos[:, 2]])
            sn = score(ent[neg[:, 0]], rel[neg[:, 1]], ent[neg[:, 2]]).reshape(len(pos), k)
            value, gp, gn = loss_and_gradients(s, sp, sn)
            ge, gr = np.zeros_like(ent), np.zeros_like(rel)
            for x, g in ((pos, gp), (neg, gn.ravel())):
                dh, dr, dt = score(ent[x[:, 0]], rel[x[:, 1]], ent[x[:, 2]], g)
                np.add.at(ge, x[:, 0], dh)
                np.add.at(ge, x[:, 2], dt)
                np.add.at(gr, x[:, 1], dr)
            adam_e.step(ge)
            adam_r.step(gr)
            total, n = total + value, n + 1
        losses.append(total / n)
    return ent, rel, losses


def train_runs(triples: DataFrame, entities: int, relations: int, runs: list[tuple[Settings, int]], most_triples: int = MOST_TRIPLES, bucket: int = BUCKET) -> DataFrame:
    """model, seed, id, v of every run's entities."""
    spark = triples.sparkSession
    if triples.count() > most_triples or entities > bucket:
        parts = [train_in_buckets(triples, entities, relations, s, seed, bucket).select(F.lit(s.model).alias("model"), F.lit(seed).cast("long").alias("seed"), "id", "v") for s, seed in runs]
        return reduce(DataFrame.union, parts)
    table = spark.createDataFrame([(k, s.model, seed) for k, (s, seed) in enumerate(runs)], "run int, model string, seed long")
    settings = [asdict(s) for s, _ in runs]
    rows = triples.select("h", "r", "t").crossJoin(table.select("run"))  # the runs are a short stated list

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        k = int(key[0])
        data = own[["h", "r", "t"]].sort_values(["h", "r", "t"]).to_numpy(np.int64)
        ent, _, _ = train(data, entities, relations, Settings(**settings[k]), runs[k][1])
        return pd.DataFrame({"run": k, "id": np.arange(entities), "v": list(ent)})

    out = rows.groupBy("run").applyInPandas(run, "run int, id long, v array<double>")
    return out.join(F.broadcast(table), "run").select("model", "seed", "id", "v")


def _adagrad(x: np.ndarray, squares: np.ndarray, rows: np.ndarray, grads: np.ndarray, rate: float) -> None:
    """Moves only the rows that have a gradient."""
    own, back = np.unique(rows, return_inverse=True)
    g = np.zeros((len(own), x.shape[1]))
    np.add.at(g, back, grads)
    squares[own] += g * g
    x[own] -= rate * g / np.sqrt(squares[own] + 1e-10)


def train_in_buckets(triples: DataFrame, entities: int, relations: int, s: Settings, seed: int, bucket: int = BUCKET) -> DataFrame:
    """id, v of a run whose entities or triples are too many for a task: groups of about `bucket` triples. The relation
    matrix (one row for each relation of the ontology) lives on the driver and is averaged over tasks by the triples
    they saw; negatives come from the entities at hand."""
    spark = triples.sparkSession
    p = max(1, -(-triples.count() // bucket))
    rng = np.random.default_rng(seed)
    _, we, _ = MODELS[s.model]
    rel = initial(s, 1, relations, rng)[1]
    bound = 6 / s.dim**0.5

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_numpy()
            v = np.stack([np.random.default_rng((seed, int(i))).uniform(-bound, bound, we * s.dim) for i in ids]) if len(ids) else np.empty((0, we * s.dim))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), we * s.dim).cast(pa.list_(pa.float64()))], names=["id", "v"])

    vectors = staged(spark.range(entities).mapInArrow(start, "id long, v array<double>"), "entity-vectors")
    rows = staged(triples.select("h", "r", "t", F.pmod(F.xxhash64("h", "r", "t"), F.lit(p)).alias("grp")), "grouped-triples")
    ends = staged(rows.select("grp", F.explode(F.array("h", "t")).alias("id")).distinct(), "group-entities")
    score = MODELS[s.model][0]
    k = max(s.negatives, 1)
    for step in range(s.epochs):
        held = spark.sparkContext.broadcast(rel)

        def work(key: tuple, own: pd.DataFrame, ents: pd.DataFrame) -> pd.DataFrame:  # runs before the next step
            r = np.random.default_rng((seed, step, int(key[0])))
            ents = ents.sort_values("id")
            ids, x, rel = ents["id"].to_numpy(), np.stack(ents["v"].to_numpy()), held.value.copy()
            data = own[["h", "r", "t"]].sort_values(["h", "r", "t"]).to_numpy(np.int64)
            data[:, 0], data[:, 2] = np.searchsorted(ids, data[:, 0]), np.searchsorted(ids, data[:, 2])
            sx, sr = np.zeros_like(x), np.zeros_like(rel)
            order = r.permutation(len(data))
            for i in range(0, len(order), s.batch):
                pos = data[order[i : i + s.batch]]
                neg = corrupt(pos, len(ids), k, r)
                sp = score(x[pos[:, 0]], rel[pos[:, 1]], x[pos[:, 2]])
                sn = score(x[neg[:, 0]], rel[neg[:, 1]], x[neg[:, 2]]).reshape(len(pos), k)
                _, gp, gn = loss_and_gradients(s, sp, sn)
                both, g = np.concatenate([pos, neg]), np.concatenate([gp, gn.ravel()])
                dh, dr, dt = score(x[both[:, 0]], rel[both[:, 1]], x[both[:, 2]], g)
                _adagrad(x, sx, np.concatenate([both[:, 0], both[:, 2]]), np.concatenate([dh, dt]), s.rate)
                _adagrad(rel, sr, both[:, 1], dr, s.rate)
            moved = pd.DataFrame({"id": -1 - np.arange(len(rel)), "v": list((rel - held.value) * len(data)), "n": len(data)})
            seen = np.bincount(data[:, [0, 2]].ravel(), minlength=len(ids))
            return pd.concat([pd.DataFrame({"id": ids, "v": list(x), "n": seen}), moved])

        mine = ends.join(vectors, "id")
        out = staged(rows.groupBy("grp").cogroup(mine.groupBy("grp")).applyInPandas(work, "id long, v array<double>, n long"), "group-vectors")
        moved = out.where("id < 0").select("id", F.posexplode("v").alias("d", "x"), "n").groupBy("id", "d").agg((F.sum("x") / F.greatest(F.sum("n"), F.lit(1))).alias("x")).collect()  # the size of the relation matrix
        for m in moved:
            rel[-1 - m["id"], m["d"]] += m["x"]
        every = vectors.select("id", "v", F.lit(0).cast("long").alias("n")).union(out.where("id >= 0")).groupBy("id").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("n", "v"))).alias("l"))
        plus = lambda acc, x: F.zip_with(acc, x["v"], lambda a, b: a + b * x["n"] / F.col("n"))
        mean = F.aggregate("l", F.transform(F.get("l", 0)["v"], lambda _: F.lit(0.0)), plus)
        before, vectors = vectors, staged(every.select("id", F.when(F.col("n") == 0, F.get("l", 0)["v"]).otherwise(mean).alias("v")), "entity-vectors")
        discard(before, out)
    return vectors


def save(vectors: DataFrame, vocabulary: DataFrame, s: Settings, path: str) -> None:
    """A checkpoint: entity vectors, vocabulary and settings."""
    spark = vectors.sparkSession
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
    spark.createDataFrame([asdict(s)]).coalesce(1).write.mode("overwrite").json(f"{path}/settings")


def load(spark, path: str) -> tuple[DataFrame, DataFrame, Settings]:
    row = spark.read.json(f"{path}/settings").first().asDict()
    kinds = {f: type(getattr(Settings(), f)) for f in row}
    return spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/vocabulary"), Settings(**{k: kinds[k](v) for k, v in row.items()})
