"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Equal vectors are one node that counts as often as it occurs, so copies are never compared with each other. Nodes
are normalised and rotated onto the principal axes of the whole table (second moments are summed on the executors;
the driver sees one dim x dim matrix). A k-d tree over the leading AXES coordinates, cut from a bounded sample,
deals all nodes into cells of about `block`; every node also visits the cells that come within sqrt(2 - 2 t) of it,
for two unit vectors of cosine t lie no further apart. A cell and its visitors from another one are a tile; cells
of more than `block` nodes are dealt into several blocks, each of which meets each.

In a tile the leading coordinates are multiplied first. What the rest can still add to a cosine is at most the
product of the two suffix norms, and that product is folded into the same multiplication as one more coordinate;
pairs whose bound stays under the threshold are done. The others are verified on the original vectors in double
precision. A tile returns the number of links of each of its rows and a spanning forest of them, never all pairs.

Vectors of different lengths don't link. Lengths with up to `block` different vectors are a tile each, in one job;
a longer table of one length gets a tree of its own.

The tree holds LEAVES cells at most, so beyond LEAVES * block vectors a cell holds more blocks, and the pairs that
are compared grow with the square of what lies within reach: that is the exact count's price in a dense table.

Defined results: null and empty vectors, zero vectors, and those with null or non-finite components link with
nothing; rows are vectors, so rows that share an id each have their own links; a null id links like any other and
is named after its component (null if it has no id); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import discard, stage, table
from lattica.llm.components import components

THRESHOLD = 0.95
BLOCK = 8192
LEADING = 16
PANEL = 1024
AXES = 8
SAMPLE = 1 << 18
LEAVES = 1 << 14
SLACK = 1e-5  # of single precision in the bounds


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def usable(rows: DataFrame) -> DataFrame:
    """The rows whose vector v can link."""
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.col("v").isNotNull() & sound)


def axes(good: DataFrame, dim: int) -> np.ndarray:
    """Principal axes (columns, leading first) of the normalised vectors, from all of them."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _unit(_matrix(batch.column("v"), dim))
            total += x.T @ x
        i, j = np.indices((dim, dim)).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "x"])

    out = np.zeros((dim, dim))
    for r in good.select("v").mapInArrow(moments, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():  # dim * dim rows
        out[r["i"], r["j"]] = r["x"]
    return np.linalg.eigh((out + out.T) / 2)[1][:, ::-1]


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, keepdims=True)  # keeps squares in range
    x = x / top
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pairs_in_tile(a: np.ndarray, b: np.ndarray, same: bool, turn: np.ndarray, threshold: float, leading: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i of a, j of b) with cosine at the threshold or above, panel by panel."""
    a, b = _unit(a), _unit(b)
    k = min(leading, turn.shape[1])

    def lead(x: np.ndarray) -> np.ndarray:
        y = x @ turn[:, :k]
        rest = np.sqrt(np.maximum(1 - np.einsum("nd,nd->n", y, y), 0))  # x is a unit vector and turn orthogonal
        return np.concatenate([y, rest[:, None]], 1).astype(np.float32)

    la, lb = lead(a), lead(b)
    for p in range(0, len(a), PANEL):
        low = p if same else 0
        bound = la[p : p + PANEL] @ lb[low:].T >= np.float32(threshold - SLACK)
        if same:
            n = bound.shape[0]
            bound[:, :n] = np.triu(bound[:, :n], 1)
        rows = np.flatnonzero(bound.any(1))
        if not len(rows):
            continue
        i, j = np.nonzero(bound[rows])
        i = rows[i]
        for q in range(0, len(i), 1 << 18):
            x, y = i[q : q + (1 << 18)] + p, j[q : q + (1 << 18)] + low
            ok = np.einsum("nd,nd->n", a[x], b[y]) >= threshold
            yield x[ok], y[ok]


def _span(n: int, found: Iterator[tuple[np.ndarray, np.ndarray]], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The weight that each of 0..n-1 is linked with, and a forest over them (each non-root with its root)."""
    degree = np.zeros(n, np.int64)
    root = np.arange(n)
    for x, y in found:
        np.add.at(degree, x, weight[y])
        np.add.at(degree, y, weight[x])
        while True:  # hook the larger root under the smaller, then flatten
            a, b = root[x], root[y]
            open_ = a != b
            if not open_.any():
                break
            x, y, a, b = x[open_], y[open_], a[open_], b[open_]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while ((flat := root[root]) != root).any():
                root = flat
    i = np.flatnonzero(root != np.arange(n))
    return degree, i, root[i]


@dataclass
class Tree:
    """Cells of a k-d tree. Inner node i splits axis[i] at cut[i]: up to it low[i], above high[i]; a leaf has axis -1
    and its number in low[i]."""

    axis: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(sample: np.ndarray, total: int, block: int) -> Tree:
        """Splits the widest axis at its median while a cell is likely to hold more than `block` of `total` rows."""
        rows: list[list] = []
        leaves, scale = 0, total / max(len(sample), 1)
        queue = [(sample, None, 0)]
        least = max(2, len(sample) // LEAVES)
        while queue:
            x, parent, side = queue.pop()
            if parent is not None:
                rows[parent][side] = len(rows)
            widest = int(np.argmax(np.ptp(x, axis=0))) if len(x) else 0
            cut = float(np.median(x[:, widest])) if len(x) else 0.0
            below = x[:, widest] <= cut
            if len(x) * scale <= block or len(x) < 2 * least or below.all():
                rows.append([-1, 0.0, leaves, -1])
                leaves += 1
                continue
            rows.append([widest, cut, -1, -1])
            queue += [(x[~below], len(rows) - 1, 3), (x[below], len(rows) - 1, 2)]
        a, c, lo, hi = zip(*rows, strict=True)
        return Tree(np.array(a), np.array(c), np.array(lo), np.array(hi))

    @property
    def leaves(self) -> int:
        return int((self.axis < 0).sum())

    def cells(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, own): for each row its own cell and all others no further than `reach`."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        gap, own = np.zeros((len(x), x.shape[1])), np.ones(len(x), bool)
        done = []
        while len(row):
            leaf = self.axis[node] < 0
            done.append((row[leaf], self.low[node[leaf]], own[leaf]))
            row, node, gap, own = row[~leaf], node[~leaf], gap[~leaf], own[~leaf]
            a, at = self.axis[node], np.arange(len(row))
            off = x[row, a] - self.cut[node]
            near, far = np.where(off <= 0, self.low[node], self.high[node]), np.where(off <= 0, self.high[node], self.low[node])
            wide = gap.copy()
            wide[at, a] = np.maximum(wide[at, a], np.abs(off))
            ok = np.einsum("nd,nd->n", wide, wide) <= reach * reach
            row, node, gap, own = np.concatenate([row, row[ok]]), np.concatenate([near, far[ok]]), np.concatenate([gap, wide[ok]]), np.concatenate([own, np.zeros(ok.sum(), bool)])
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))


FOUND = "node long, n long, root long"


def _links_of(t: pa.Table, i: int, j: int, turn: np.ndarray | None, threshold: float, leading: int) -> pa.Table:
    """Of the rows (own, node, n, v) of one tile: what each is linked with, and a forest."""
    own, node, weight = (t.column(c).to_numpy() for c in ("own", "node", "n"))
    x = _matrix(t.column("v"), len(t.column("v")[0]))
    if turn is None:
        turn = np.linalg.svd(_unit(x), full_matrices=False)[2].T
    a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
    found = ((a[p], b[q]) for p, q in pairs_in_tile(x[a], x[b], i == j, turn, threshold, leading))
    degree, child, root = _span(len(node), found, weight)
    some = np.flatnonzero(degree)
    return pa.table({"node": np.concatenate([node[some], node[child]]), "n": pa.array(np.concatenate([degree[some], np.zeros(len(child), np.int64)])), "root": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(node[root])])})


def _links_by_tree(nodes: DataFrame, dim: int, total: int, threshold: float, block: int, leading: int) -> DataFrame:
    """FOUND for the `total` nodes (node, n, v) of one length."""
    turn = axes(nodes, dim)
    leading_axes, reach = turn[:, : min(AXES, dim)], (2 - 2 * threshold) ** 0.5 + 1e-9

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_matrix(batch.column("v"), dim)) @ leading_axes
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["x"])

    share = min(1.0, SAMPLE / total)
    some = nodes if share == 1 else nodes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = some.select("v").mapInArrow(place, "x array<double>").toArrow().column("x")  # about SAMPLE rows of AXES numbers
    tree = Tree.of(_matrix(sample, leading_axes.shape[1]) if len(sample) else np.empty((0, leading_axes.shape[1])), total, block)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            row, cell, own = tree.cells(_unit(_matrix(batch.column("v"), dim)) @ leading_axes, reach)
            home = np.empty(n, np.int32)
            home[row[own]] = cell[own]
            order = np.argsort(row[~own], kind="stable")
            ends = np.cumsum(np.bincount(row[~own], minlength=n))
            near = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(cell[~own][order].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "n", "v")), pa.array(home), near], names=["node", "n", "v", "cell", "near"])

    placed = stage(nodes.select("node", "n", "v").mapInArrow(cells, "node long, n long, v array<double>, cell int, near array<int>"), "placed")
    held = np.zeros(tree.leaves, np.int64)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect():  # at most LEAVES rows
        held[r["cell"]] = r["n"]
    share = np.maximum(-(-held // block), 1)
    first = np.cumsum(share) - share
    constant = lambda values, at: F.get(F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>"), at)
    own = constant(first, F.col("cell")) + F.pmod(F.xxhash64("node"), constant(share, F.col("cell"))).cast("int")
    blocks_of = lambda c: F.sequence(constant(first, c), constant(first, c) + constant(share, c) - 1)
    other = F.explode(F.flatten(F.transform(F.concat(F.array("cell"), F.col("near")), blocks_of)))
    dealt = placed.select("node", "n", "v", own.alias("own"), other.alias("other"))
    tiles = dealt.select("node", "n", "v", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def work(t: pa.Table) -> pa.Table:
        return _links_of(t, t.column("i")[0].as_py(), t.column("j")[0].as_py(), turn, threshold, leading)

    found = stage(tiles.groupBy("i", "j").applyInArrow(work, FOUND), "tiles")
    discard(placed)
    return found


def near_duplicate_vectors(rows: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, leading: int = LEADING, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, n_links, component_id for each row."""
    v = F.col(vector_col).cast("array<double>").alias("v")
    every = rows.select(F.col(id_col).cast("long").alias("id"), v)
    keyed = every.select("id", "v", F.xxhash64("v").alias("k"), F.xxhash64("v", F.lit(1)).alias("k2"))  # 128 bits tell vectors apart
    numbered = keyed.withColumn("pos", F.monotonically_increasing_id())
    good = usable(numbered)
    nodes = stage(good.groupBy("k", "k2").agg(F.min("pos").alias("node"), F.count("*").alias("n"), F.min("id").alias("rep"), F.any_value("v").alias("v")), "vectors")
    lengths = nodes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("total")).where(F.col("total") > block).orderBy("dim").collect()  # rows / block at most
    few = nodes if not lengths else nodes.where(~F.size("v").isin([r["dim"] for r in lengths]))

    def whole(t: pa.Table) -> pa.Table:
        return _links_of(t, 0, 0, None, threshold, leading)

    found = few.select("node", "n", "v", F.lit(0).alias("own"), F.size("v").alias("dim")).groupBy("dim").applyInArrow(whole, FOUND)
    for r in lengths:
        found = found.union(_links_by_tree(nodes.where(F.size("v") == r["dim"]), r["dim"], r["total"], threshold, block, leading))
    found = stage(found, "vector_links")
    degree = found.where("root is null").groupBy("node").agg(F.sum("n").alias("linked"))
    part = components(found.where("root is not null").select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = stage(
        nodes.select("k", "k2", "node", "n", "rep").join(degree, "node", "left").join(part, "node", "left")
        .select("k", "k2", "rep", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")),
        "vector_names",
    )
    discard(nodes, found)
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    named = named.join(least, "component").select("k", "k2", "n_links", "least", F.lit(True).alias("sound"))
    return keyed.drop("v").join(named, ["k", "k2"], "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("sound"), F.col("least")).otherwise(F.col("id")).alias("component_id"))


def op9_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


#: DuckDB SQL: every pair, and a walk along the links.
ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (SELECT vec_id AS node, vec_id AS other FROM v UNION SELECT node, b FROM reach JOIN links ON other = a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT node AS vec_id, coalesce(any_value(n), 0) AS n_links, min(other) AS component_id, node = min(other) AS kept FROM reach LEFT JOIN degree ON node = a GROUP BY node
"""
