"""Extremely randomised trees of any depth, grown level by level.

Each node looks at a few features, chosen by a hash of (seed, tree, node, feature), with one
threshold each, drawn between the node's least and largest value; the best split by Gini
impurity is kept. Up to LOCAL rows a task grows whole trees over the rows in the shared folder.
Beyond that all trees grow at once: a level takes an aggregation for the ranges and one for the
class counts of both sides, and from LOCAL rows on down a task grows the rest of a node. Draws
are hashes, so the trees are the same wherever they grow. A task works on ranks of values:
the rows of LARGE nodes each by themselves, those of all smaller ones of some trees together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import n_rows
from tessera.session import materialise, new_folder, plain_unions
from tessera.sources.arrays import place

#: Rows of a node from which on down one task grows it, if their values have LOCAL_BYTES at most, and rows that are scored at a time.
LOCAL, LOCAL_BYTES, SLAB = 1 << 20, 64 << 20, 16_384
#: Rows of a node from which on it is split by itself, rows times trees that a task splits together, and trees that it grows at most.
LARGE, TOGETHER, TREES = 1_024, 1 << 20, 16
ROOT = 1

_NODE = "tree long, node long, feature int, threshold double, left long, right long, p double, n long"
_NODE_SCHEMA = pa.schema([("tree", pa.int64()), ("node", pa.int64()), ("feature", pa.int32()), ("threshold", pa.float64()), ("left", pa.int64()), ("right", pa.int64()), ("p", pa.float64()), ("n", pa.int64())])


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash(*parts) -> np.ndarray:
    out = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            out = _mix((np.asarray(p).astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019)) ^ (out * np.uint64(0xD6E8FEB86659FD93)))
    return out


def children(tree: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(_hash(tree, node, side).view(np.int64) for side in (-1, -2))


def drawn(seed: int, tree: np.ndarray, node: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and thresholds (nodes, k) that the nodes try, given their ranges (nodes, features); a place without a feature that varies has -1."""
    d = low.shape[1]
    tag = lambda which: _hash(np.int64(seed), tree[:, None], node[:, None], np.arange(d)[None, :], which)
    varies = high > low
    order = np.argsort(np.where(varies, tag(1) >> np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)), axis=1, kind="stable")[:, :k]
    rows = np.arange(len(tree))[:, None]
    share = (tag(2) >> np.uint64(11)).astype(np.float64) / 2.0**53
    a, b = low[rows, order], high[rows, order]
    threshold = a + share[rows, order] * (b - a)
    threshold = np.where(threshold < b, threshold, a)  # both sides have a row
    return np.where(varies[rows, order], order, -1).astype(np.int32), threshold


def best(feature: np.ndarray, n: np.ndarray, n1: np.ndarray, left: np.ndarray, left1: np.ndarray, weights: tuple[float, float], least: int) -> np.ndarray:
    """The tried split (its place) of each node that lowers the weighted Gini impurity most, -1 where none leaves least rows on both sides or the node is pure."""
    w0, w1 = weights

    def impurity(all_: np.ndarray, ones: np.ndarray) -> np.ndarray:
        a, b = w0 * (all_ - ones), w1 * ones
        total = a + b
        return total - np.divide(a * a + b * b, total, out=np.zeros_like(total), where=total > 0)

    gain = impurity(n, n1)[:, None] - impurity(left, left1) - impurity(n[:, None] - left, n1[:, None] - left1)
    allowed = (feature >= 0) & (left >= least) & (n[:, None] - left >= least) & ((n1 > 0) & (n1 < n))[:, None]
    gain = np.where(allowed, gain, -np.inf)
    at = gain.argmax(1)
    return np.where(allowed.any(1), at, -1)


def _rows(tree, node, at, feature, threshold, n, n1, weights) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """Model rows of nodes, and the ids of their children (0: a leaf)."""
    split = at >= 0
    left, right = children(tree, node)
    left, right = np.where(split, left, 0), np.where(split, right, 0)
    pick = (np.arange(len(at)), np.maximum(at, 0))
    p = weights[1] * n1 / np.maximum(weights[1] * n1 + weights[0] * (n - n1), 1e-300)
    columns = [tree, node, np.where(split, feature[pick], -1).astype(np.int32), np.where(split, threshold[pick], 0.0), left, right, p, n]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODE_SCHEMA, strict=True)], schema=_NODE_SCHEMA), left, right


class _Rows:
    """Rows as ranks (features, rows) of the values of each feature, and whether they are of class 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        found = [np.unique(x[:, j], return_inverse=True) for j in range(x.shape[1])]
        self.values = [v for v, _ in found]
        kind = np.uint16 if max(map(len, self.values)) < 1 << 16 else np.int32
        self.ranks, self.ones = np.stack([r.astype(kind) for _, r in found]), y == 1

    def drawn(self, seed: int, tree: np.ndarray, node: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """drawn() for ranges of ranks, and the first rank (nodes, k) on the right."""
        of = lambda r: np.stack([v[r[:, j]] for j, v in enumerate(self.values)], 1)
        feature, threshold = drawn(seed, tree, node, of(low), of(high), k)
        cut = np.zeros(feature.shape, self.ranks.dtype)
        for j, v in enumerate(self.values):
            here = feature == j
            cut[here] = np.searchsorted(v, threshold[here], "right")
        return feature, threshold, cut


#: Nodes whose rows are still to be split.
_Open = tuple[int, int, np.ndarray, np.ndarray]


class _Grower:
    """Grows nodes of trees in one task; rows() gives the model rows of those that are whole."""

    def __init__(self, rows: _Rows, seed: int, k: int, least: int, weights: tuple[float, float]):
        self.of, self.seed, self.k, self.least, self.weights = rows, seed, k, least, weights
        self.out: list[pa.RecordBatch] = []
        self.small: list[_Open] = []

    def open_(self, n: np.ndarray, n1: np.ndarray) -> np.ndarray:
        """Whether nodes can be split at all."""
        return (n >= 2 * self.least) & (n1 > 0) & (n1 < n)

    def split(self, tree: np.ndarray, node: np.ndarray, n: np.ndarray, n1: np.ndarray, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, left1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Writes the nodes and those of their children that stay leaves: the split taken, and the children (2, nodes) and whether they are open."""
        at = best(feature, n, n1, left, left1, self.weights, self.least)
        batch, *sides = _rows(tree, node, at, feature, threshold, n, n1, self.weights)
        self.out.append(batch)
        pick, child = (np.arange(len(at)), np.maximum(at, 0)), np.stack(sides)
        size, ones = np.stack([left[pick], n - left[pick]]), np.stack([left1[pick], n1 - left1[pick]])
        open_ = self.open_(size, ones) & (at >= 0)
        self.leaves(np.stack([tree, tree]), child, size, ones, ~open_ & (at >= 0))
        return at, child, open_

    def leaves(self, tree: np.ndarray, node: np.ndarray, n: np.ndarray, n1: np.ndarray, which: np.ndarray) -> None:
        none = np.full(which.sum(), -1)
        self.out.append(_rows(tree[which], node[which], none, none[:, None], none[:, None], n[which], n1[which], self.weights)[0])

    def grow(self, trees: list[int], node: int) -> None:
        """Splits a node of each tree over all rows, and those below it that are large, a level at a time."""
        ranks, ones = self.of.ranks, self.of.ones
        n, n1 = np.full(len(trees), len(ones)), np.full(len(trees), np.count_nonzero(ones))
        level: list[_Open] = [(t, node, ranks, ones) for t in trees]
        if not self.open_(n, n1)[0]:
            self.leaves(np.array(trees), np.full(len(trees), node), n, n1, np.full(len(trees), True))
            return
        while level:
            self.small += [x for x in level if len(x[3]) < LARGE]
            level = [x for x in level if len(x[3]) >= LARGE]
            if not level:
                return
            of, nodes = np.array([x[0] for x in level]), np.array([x[1] for x in level])
            low, high = (np.stack([f(x[2], axis=1) for x in level]) for f in (np.min, np.max))
            feature, threshold, cut = self.of.drawn(self.seed, of, nodes, low, high, self.k)
            goes = [[r[max(f, 0)] < c for f, c in zip(fs, cs, strict=True)] for (_, _, r, _), fs, cs in zip(level, feature, cut, strict=True)]
            n, n1 = np.array([len(x[3]) for x in level]), np.array([np.count_nonzero(x[3]) for x in level])
            left = np.array([[np.count_nonzero(g) for g in gs] for gs in goes])
            left1 = np.array([[np.count_nonzero(g & x[3]) for g in gs] for gs, x in zip(goes, level, strict=True)])
            at, child, open_ = self.split(of, nodes, n, n1, feature, threshold, left, left1)
            below: list[_Open] = []
            for i, (tree, _, r, o) in enumerate(level):
                for side in (0, 1):
                    if open_[side, i]:
                        take = np.flatnonzero(goes[i][at[i]] == (side == 0))
                        below.append((tree, int(child[side, i]), r.take(take, axis=1), o.take(take)))
            level = below

    def rows(self) -> pa.Table:
        """Splits all small nodes to the end, a level of them at a time: the model rows of all nodes so far."""
        if self.small:
            tree, node, ranks, ones = (f([x[i] for x in self.small]) for i, f in enumerate((np.array, np.array, np.hstack, np.concatenate)))
            n, n1 = (np.array([f(x[3]) for x in self.small]) for f in (len, np.count_nonzero))
            self.small = []
            while len(tree):
                start, rows = np.cumsum(n) - n, np.arange(len(ones))
                low, high = (f.reduceat(ranks, start, axis=1).T for f in (np.minimum, np.maximum))
                feature, threshold, cut = self.of.drawn(self.seed, tree, node, low, high, self.k)
                flat = ranks.ravel()
                goes = np.stack([flat[np.repeat(np.maximum(f, 0) * len(ones), n) + rows] < np.repeat(c, n) for f, c in zip(feature.T.astype(np.int64), cut.T, strict=True)])
                left, left1 = (np.add.reduceat(g, start, axis=1, dtype=np.int64).T for g in (goes, goes & ones))
                at, child, open_ = self.split(tree, node, n, n1, feature, threshold, left, left1)
                side = goes.ravel()[np.repeat(np.maximum(at, 0) * len(ones), n) + rows]
                slots = open_.sum()
                slot = np.full(open_.shape, slots)
                slot[open_] = np.arange(slots)
                slot = np.where(side, np.repeat(slot[0], n), np.repeat(slot[1], n)).astype(np.uint16 if slots < 1 << 16 else np.int64)  # the former are sorted by their digits
                order = np.argsort(slot, kind="stable")[: np.count_nonzero(slot < slots)]
                ranks, ones = ranks.take(order, axis=1), ones.take(order)
                pick = (np.arange(len(at)), np.maximum(at, 0))
                n, n1 = (np.stack([a[pick], b - a[pick]])[open_] for a, b in ((left, n), (left1, n1)))
                tree, node = np.stack([tree, tree])[open_], child[open_]
        done, self.out = pa.Table.from_batches(self.out, schema=_NODE_SCHEMA), []
        return done


def _grow_group(table: pa.Table, seed: int, k: int, least: int, weights: tuple[float, float]) -> pa.Table:
    """The model rows of a node and all below it."""
    grower = _Grower(_Rows(_matrix(table["x"].combine_chunks()), table["y"].to_numpy()), seed, k, least, weights)
    grower.grow([table["tree"][0].as_py()], table["node"][0].as_py())
    return grower.rows()


def _grow_task(batches: Iterator[pa.RecordBatch], folder: str, seed: int, k: int, least: int, weights: tuple[float, float]) -> Iterator[pa.RecordBatch]:
    """Whole trees over the rows in folder, each as one row."""
    trees = [t for b in batches for t in b.column(0).to_pylist()]
    if trees:
        table = pa.concat_tables(_parts(folder, ["y", "x"]))
        grower = _Grower(_Rows(_matrix(table["x"].combine_chunks()), table["y"].to_numpy()), seed, k, least, weights)
        step = max(1, TOGETHER // table.num_rows)
        for low in range(0, len(trees), step):
            grower.grow(trees[low : low + step], ROOT)
            yield from _by_tree(grower.rows())


def _by_tree(nodes: pa.Table) -> Iterator[pa.RecordBatch]:
    nodes = nodes.sort_by("tree")
    starts = [*np.flatnonzero(np.diff(nodes["tree"].to_numpy(), prepend=-1)).tolist(), nodes.num_rows]
    for low, high in zip(starts, starts[1:]):
        yield from _pack(nodes.slice(low, high - low)).to_batches()


def _parts(folder: str, columns: list[str]) -> Iterator[pa.Table]:
    files, name = place(folder)
    for path in sorted(i.path for i in files.get_file_info(pafs.FileSelector(name)) if i.path.endswith(".parquet")):
        with files.open_input_file(path) as f:
            yield pq.ParquetFile(f).read(columns=columns)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


_TRIED = "tree long, node long, n long, n1 long, features array<int>, thresholds array<double>"


def _draw_task(batches: Iterator[pa.RecordBatch], seed: int, k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            tree, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            feature, threshold = drawn(seed, tree, node, _matrix(b.column(4)), _matrix(b.column(5)), k)
            yield pa.record_batch({"tree": b.column(0), "node": b.column(1), "n": b.column(2), "n1": b.column(3), "features": pa.array(list(feature), pa.list_(pa.int32())), "thresholds": pa.array(list(threshold), pa.list_(pa.float64()))})


def _choose_task(batches: Iterator[pa.RecordBatch], least: int, weights: tuple[float, float]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            tree, node, n, n1 = (b.column(i).to_numpy() for i in range(4))
            feature, threshold, left, left1 = (_matrix(b.column(i)) for i in range(4, 8))
            yield _rows(tree, node, best(feature, n, n1, left, left1, weights, least), feature, threshold, n, n1, weights)[0]


def _level(state: DataFrame, big: DataFrame, d: int, k: int, seed: int, least: int, weights: tuple[float, float]) -> DataFrame:
    """Model rows of the nodes of big, over their rows in state."""
    at, of = ["tree", "node"], lambda f: F.array(*[f(F.col("x")[j]) for j in range(d)])
    rows = state.join(big, at)
    ranges = rows.groupBy(*at).agg(n_rows().alias("n"), F.sum("y").alias("n1"), of(F.min).alias("low"), of(F.max).alias("high"))
    tried = materialise(ranges.mapInArrow(lambda it: _draw_task(it, seed, k), _TRIED), "tried")
    goes = [(F.col("features")[j] >= 0) & (F.get("x", F.greatest(F.col("features")[j], F.lit(0))) <= F.col("thresholds")[j]) for j in range(k)]
    sides = rows.join(tried.select(*at, "features", "thresholds"), at).groupBy(*at).agg(F.array(*[F.count_if(g) for g in goes]).alias("left"), F.array(*[F.count_if(g & (F.col("y") == 1)) for g in goes]).alias("left1"))
    counted = tried.join(sides, at).select(*at, "n", "n1", "features", "thresholds", "left", "left1")
    return materialise(counted.mapInArrow(lambda it: _choose_task(it, least, weights), _NODE), "level")


class Forest:
    """A fitted forest: nodes in a table, and in folder a row a tree, its nodes as arrays (36 bytes each)."""

    def __init__(self, nodes: DataFrame, columns: list[str], folder: str):
        self.nodes, self.columns, self.folder = nodes, columns, folder

    def scored(self, df: DataFrame) -> DataFrame:
        """df with p, the trees' mean share of class 1; a task goes through the trees for each slab of its rows."""
        folder, schema, at = self.folder, [*df.schema.names, "p"], len(df.columns)
        given = df.withColumn("__x", F.array(*[F.col(c).cast("double") for c in self.columns]))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, name = place(folder)
            paths = sorted(i.path for i in files.get_file_info(pafs.FileSelector(name)) if i.path.endswith(".parquet"))
            held: list[pa.RecordBatch] = []

            def emit() -> Iterator[pa.RecordBatch]:
                x = np.concatenate([_matrix(b.column(at)) for b in held])
                x = np.ascontiguousarray(np.where(np.isnan(x), np.inf, x).T)  # neither is on the left of a threshold
                total, n = np.zeros(x.shape[1]), 0
                for path in paths:
                    with files.open_input_file(path) as f:
                        for batch in pq.ParquetFile(f).iter_batches(batch_size=1, columns=list(_WALKED)):
                            total += _walk(x, *(np.frombuffer(batch.column(c)[0].as_buffer(), _PACKED[c]) for c in _WALKED))
                            n += 1
                low = 0
                for b in held:
                    p = total[low : low + b.num_rows] / n
                    low += b.num_rows
                    yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(p)], names=schema)

            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                if sum(b.num_rows for b in held) >= SLAB:
                    yield from emit()
                    held = []
            if held:
                yield from emit()

        return given.mapInArrow(task, df.withColumn("p", F.lit(0.0)).schema)

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(path)


def _walk(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The leaf's share for each row of x (features, rows), which has no NaN; node 0 is the root, a right child follows its left one."""
    out, rows = np.empty(x.shape[1]), np.arange(x.shape[1])
    flat, leaf = x.ravel(), feature < 0
    # A leaf leads to itself, so that rows which are through are left out only now and then.
    where, most, to = np.where(leaf, 0, feature).astype(np.int64) * x.shape[1], np.where(leaf, np.inf, threshold), np.where(leaf, np.arange(len(left)), left)
    node = np.zeros(len(rows), np.int64)
    while len(rows):
        for _ in range(4):
            node = to.take(node) + (flat.take(where.take(node) + rows) > most.take(node))
        through = leaf.take(node)
        if through.any():
            out[rows[through]] = p[node[through]]
            rows, node = rows[~through], node[~through]
    return out


_PACKED = {"feature": "<i4", "threshold": "<f8", "left": "<i4", "p": "<f8", "n": "<i8"}
_WALKED = ("feature", "threshold", "left", "p")
_TREE = "tree long, " + ", ".join(f"{c} binary" for c in _PACKED)
_TREE_SCHEMA = pa.schema([("tree", pa.int64()), *((c, pa.binary()) for c in _PACKED)])


def _pack(table: pa.Table) -> pa.Table:
    """The nodes of a tree as arrays in which left is a place, 0 at a leaf; the root is the first, children stand side by side."""
    node = table["node"].to_numpy()
    order = np.argsort(node)
    left, right = (order[np.minimum(np.searchsorted(node[order], table[c].to_numpy()), len(node) - 1)] for c in ("left", "right"))
    inner = table["feature"].to_numpy() >= 0
    level, levels = np.flatnonzero(node == ROOT), []
    while len(level):
        levels.append(level)
        level = level[inner[level]]
        level = np.stack([left[level], right[level]], 1).ravel()
    order = np.concatenate(levels)
    arrays = {c: table[c].to_numpy()[order] for c in _PACKED}
    arrays["left"] = np.where(inner[order], 2 * np.cumsum(inner[order]) - 1, 0)
    return pa.table([pa.array([table["tree"][0].as_py()], pa.int64()), *(pa.array([arrays[c].astype(kind).tobytes()], pa.binary()) for c, kind in _PACKED.items())], schema=_TREE_SCHEMA)


def _unpack_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of packed trees."""
    for b in batches:
        for i in range(b.num_rows):
            feature, threshold, at, p, n = (np.frombuffer(b.column(c)[i].as_buffer(), kind) for c, kind in _PACKED.items())
            tree, node = np.full(len(at), b.column("tree")[i].as_py()), np.zeros(len(at), np.int64)
            node[0], left, right = ROOT, np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            level = np.array([0])
            while len(level := level[feature[level] >= 0]):
                left[level], right[level] = children(tree[level], node[level])
                node[at[level]], node[at[level] + 1] = left[level], right[level]
                level = np.concatenate([at[level], at[level] + 1])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((tree, node, feature, threshold, left, right, p, n), _NODE_SCHEMA, strict=True)], schema=_NODE_SCHEMA)


def _packed(nodes: DataFrame, columns: list[str]) -> Forest:
    folder = new_folder(nodes.sparkSession, "forest")
    nodes.groupBy("tree").applyInArrow(_pack, _TREE).write.option("compression", "zstd").parquet(folder)
    return Forest(nodes, columns, folder)


def load(spark: SparkSession, path: str, columns: list[str]) -> Forest:
    return _packed(spark.read.parquet(path), columns)


def fit(df: DataFrame, columns: list[str], label: str = "y", trees: int = 500, least: int = 2, seed: int = 42, tried: int | None = None) -> Forest:
    """A forest of df (label 0 or 1 and numeric columns without nulls); classes weigh the same, a node tries the root of the number of columns.

    Every tree sees all rows. Equal rows of both classes end in one leaf; there is no limit
    of depth; a leaf has least rows at least. Up to LOCAL rows (or LOCAL_BYTES) a task grows
    whole trees and only these are written; beyond that growing takes rows x trees of state,
    which is written down once a level as long as a node has more.
    """
    spark, d, k = df.sparkSession, len(columns), tried or max(1, int(len(columns) ** 0.5))
    given, folder = df.select(F.col(label).cast("long").alias("y"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x")), new_folder(plain_unions(spark), "rows")
    given.write.option("compression", "zstd").parquet(folder)
    given = spark.read.schema(given.schema).parquet(folder)
    sizes = {int(r["y"]): int(r["n"]) for r in given.groupBy("y").agg(n_rows().alias("n")).collect()}
    total = sum(sizes.values())
    weights = tuple(total / (len(sizes) * sizes[c]) if sizes.get(c) else 0.0 for c in (0, 1))
    local = max(1, min(LOCAL, LOCAL_BYTES // (8 * d)))
    if 0 < total <= local:
        forest, tasks = new_folder(spark, "forest"), min(trees, max(4 * spark.sparkContext.defaultParallelism, -(-trees // TREES)))
        spark.range(0, trees, 1, tasks).mapInArrow(lambda it: _grow_task(it, folder, seed, k, least, weights), _TREE).write.option("compression", "zstd").parquet(forest)
        return Forest(spark.read.schema(_TREE).parquet(forest).mapInArrow(_unpack_task, _NODE), columns, forest)
    state = given.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trees - 1).cast("long"))).alias("tree"), F.lit(ROOT).cast("long").alias("node"), "y", "x")
    model, ready, at = [], [], ["tree", "node"]
    while True:
        sizes_now = state.groupBy(*at).agg(n_rows().alias("n"))
        big = materialise(sizes_now.filter(F.col("n") > local).select(*at), "big") if total > local else None
        if big is None or not big.head(1):
            ready.append(state)
            break
        ready.append(state.join(big, at, "left_anti"))
        level = _level(state, big, d, k, seed, least, weights)
        model.append(level)
        down = state.join(level.filter("feature >= 0").select(*at, "feature", "threshold", "left", "right"), at)
        node = F.when(F.get("x", F.col("feature")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        state = materialise(down.select("tree", node.alias("node"), "y", "x"), "state")
    for rows in ready:
        model.append(rows.groupBy(*at).applyInArrow(lambda t: _grow_group(t, seed, k, least, weights), _NODE))
    nodes = model[0]
    for more in model[1:]:
        nodes = nodes.unionByName(more)
    return _packed(materialise(nodes, "nodes"), columns)
