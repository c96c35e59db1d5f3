"""Random forests over binned columns.

A column is cut into BINS at most, at quantiles of both classes; a tree counts each row as
often as a Poisson draw says, a node tries a few columns and takes the cut that lowers the
Gini impurity most. Draws are hashes of (seed, tree, row) and (seed, tree, node, column) and
counts are whole numbers, so the trees are the same wherever they grow: up to LOCAL rows a
task grows whole trees over the binned rows in the shared folder; beyond that all trees grow
a level at a time, a task counts its own rows, and only counts are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import n_rows
from tessera.operators.contracts import ContractError
from tessera.operators.extra_trees import _NODE, _NODE_SCHEMA, ROOT, Forest, _hash, _matrix, _packed
from tessera.session import materialise, new_folder
from tessera.sources.arrays import place

#: Rows up to which a task grows a whole tree, if their bins have LOCAL_BYTES at most; rows counted at a time beyond.
LOCAL, LOCAL_BYTES, SLAB = 1 << 20, 64 << 20, 1 << 17
BINS = 32

#: Chances of a Poisson draw of mean 1 to be 0, 1, 2, ... at most.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)]))


def _times(seed: int, tree: int, row: np.ndarray) -> np.ndarray:
    """How often the tree counts each row."""
    share = (_hash(np.int64(seed), np.int64(tree), row) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.searchsorted(_POISSON, share, "right")


def _tried(seed: int, tree: int, node: np.ndarray, d: int, k: int) -> np.ndarray:
    """The k columns that each node tries."""
    return np.argsort(_hash(np.int64(seed), np.int64(tree), node[:, None], np.arange(d)[None, :], 1), axis=1, kind="stable")[:, :k]


def _counted(bins: np.ndarray, y: np.ndarray, times: np.ndarray, at: np.ndarray, tried: np.ndarray) -> np.ndarray:
    """Rows (nodes, columns tried, bins, classes) of nodes that rows are at."""
    n, k = tried.shape
    rows, out = np.arange(len(y)), np.empty((n, k, BINS, 2))
    for j in range(k):
        key = (at * BINS + bins[rows, tried[at, j]]) * 2 + y
        out[:, j] = np.bincount(key, times, n * BINS * 2).reshape(n, BINS, 2)
    return out


def _best(counts: np.ndarray, weights: tuple[float, float], least: int) -> tuple[np.ndarray, np.ndarray]:
    """The place among the columns tried (-1: none) and the last bin on the left of each node's best split, which leaves least rows on both sides and lowers the weighted Gini impurity."""
    left = counts.cumsum(2)
    whole = left[:, :1, -1:]
    left = left[:, :, :-1]

    def impurity(x: np.ndarray) -> np.ndarray:
        a, b = weights[0] * x[..., 0], weights[1] * x[..., 1]
        total = a + b
        return total - np.divide(a * a + b * b, total, out=np.zeros_like(total), where=total > 0)

    right, all_ = whole - left, impurity(whole)
    gain = all_ - impurity(left) - impurity(right)
    gain[(left.sum(3) < least) | (right.sum(3) < least) | (gain <= 1e-12 * np.maximum(1.0, all_))] = -np.inf
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(1)
    return np.where(flat[np.arange(len(at)), at] > 0, at // gain.shape[2], -1), at % gain.shape[2]


def _rows(tree: int, node: np.ndarray, counts: np.ndarray, tried: np.ndarray, cuts: list[list[float]], weights: tuple[float, float], least: int, last: bool) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """Model rows of nodes, and the column (-1: a leaf) and bin that they split at."""
    at, bin_ = _best(counts, weights, least)
    split = (at >= 0) & (not last)
    feature = np.where(split, tried[np.arange(len(at)), np.maximum(at, 0)], -1)
    threshold = [cuts[f][b] if f >= 0 else 0.0 for f, b in zip(feature.tolist(), bin_.tolist(), strict=True)]
    n0, n1 = counts[:, 0].sum(1).T
    p = weights[1] * n1 / np.maximum(weights[1] * n1 + weights[0] * n0, 1e-300)
    columns = [np.full(len(node), tree), node, feature, threshold, np.where(split, 2 * node, 0), np.where(split, 2 * node + 1, 0), p, (n0 + n1).astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODE_SCHEMA, strict=True)], schema=_NODE_SCHEMA), feature, bin_


def _grown(tree: int, row: np.ndarray, y: np.ndarray, bins: np.ndarray, cuts: list[list[float]], seed: int, k: int, depth: int, least: int, weights: tuple[float, float]) -> Iterator[pa.RecordBatch]:
    """A tree's model rows, a level at a time."""
    times = _times(seed, tree, row)
    drawn = np.flatnonzero(times)
    times, y, bins = times[drawn], y[drawn], bins[drawn]
    node, at = np.array([ROOT]), np.zeros(len(y), np.int64)
    for level in range(depth + 1):
        tried = _tried(seed, tree, node, bins.shape[1], k)
        batch, feature, bin_ = _rows(tree, node, _counted(bins, y, times, at, tried), tried, cuts, weights, least, level == depth)
        yield batch
        split = feature >= 0
        if not split.any():
            return
        stays = split[at]
        times, y, bins, at = times[stays], y[stays], bins[stays], at[stays]
        place_of = 2 * (np.cumsum(split) - 1)
        node = np.stack([2 * node[split], 2 * node[split] + 1], 1).ravel()
        at = place_of[at] + (bins[np.arange(len(at)), feature[at]] > bin_[at])


def _read(folder: str, columns: list[str]) -> list[pa.Table]:
    files, name = place(folder)
    found = []
    for path in sorted(i.path for i in files.get_file_info(pafs.FileSelector(name)) if i.path.endswith(".parquet")):
        with files.open_input_file(path) as f:
            found.append(pq.ParquetFile(f).read(columns=columns))
    return found


def _arrays(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, y and bins (rows, columns)."""
    return tuple(np.concatenate([of(b) for b in batches]) for of in (lambda b: b.column(0).to_numpy(), lambda b: b.column(1).to_numpy(), lambda b: np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1)))


def _bin_task(batches: Iterator[pa.RecordBatch], cuts: list[list[float]]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x = b.column(2)
            if x.flatten().null_count or np.isnan(_matrix(x)).any():
                raise ContractError("a column of the forest has missing values")
            x = _matrix(x)
            bins = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], 1).astype(np.uint8)
            yield pa.record_batch({"row": b.column(0), "y": b.column(1), "bins": pa.array([r.tobytes() for r in bins], pa.binary())})


def _cuts(given: DataFrame, d: int) -> list[list[float]]:
    """Where the bins of each column end, the last left open: quantiles of both classes, which weigh the same."""
    shares = [i / (BINS // 2) for i in range(1, BINS // 2)]
    found = given.groupBy("y").agg(*[F.percentile_approx(F.col("x")[j], shares, 10_000).alias(f"q{j}") for j in range(d)]).collect()
    return [sorted({float(v) for r in found for v in r[f"q{j}"]}) for j in range(d)]


def _level(binned: DataFrame, folder: str | None, level: int, trees: int, seed: int, d: int, k: int) -> DataFrame:
    """(tree, node, slot, n): rows by column tried, bin and class of the nodes of a level, whose forebears lie in folder."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits: dict[int, tuple[np.ndarray, ...]] = {}
        if folder:
            of = pa.concat_tables(_read(folder, ["tree", "node", "feature", "bin"]))
            tree, node, feature, bin_ = (of[c].to_numpy() for c in of.column_names)
            order = np.lexsort((node, tree))
            order = order[feature[order] >= 0]
            names, first = np.unique(tree[order], return_index=True)
            splits = {int(t): (node[i], feature[i], bin_[i]) for t, i in zip(names, np.split(order, first[1:]), strict=True)} if len(order) else {}

        def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            row, y, bins = _arrays(held)
            for tree in range(trees) if not level else splits:
                times = _times(seed, tree, row)
                at, rows = np.full(len(row), ROOT, np.int64), np.flatnonzero(times)
                for _ in range(level):
                    nodes, feature, bin_ = splits[tree]
                    i = np.minimum(np.searchsorted(nodes, at[rows]), len(nodes) - 1)
                    goes = nodes[i] == at[rows]
                    rows, i = rows[goes], i[goes]
                    at[rows] = 2 * at[rows] + (bins[rows, feature[i]] > bin_[i])
                if len(rows):
                    node, place_of = np.unique(at[rows], return_inverse=True)
                    counts = _counted(bins[rows], y[rows], times[rows], place_of, _tried(seed, tree, node, d, k)).reshape(len(node), -1)
                    i, slot = np.nonzero(counts)
                    yield pa.record_batch({"tree": pa.array(np.full(len(i), tree), pa.int64()), "node": node[i], "slot": pa.array(slot, pa.int64()), "n": pa.array(counts[i, slot].astype(np.int64))})

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= SLAB:
                yield from counted(held)
                held = []
        if held:
            yield from counted(held)

    return binned.mapInArrow(task, "tree long, node long, slot long, n long").groupBy("tree", "node", "slot").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, columns: list[str], label: str = "y", trees: int = 500, least: int = 2, seed: int = 42, depth: int = 12, tried: int | None = None) -> Forest:
    """A forest of df (label 0 or 1 and numeric columns; a missing value is an error); classes weigh the same, a node tries the root of the number of columns.

    A leaf counts least rows at least, a leaf's share of class 1 is that of the rows counted.
    """
    spark, d, k = df.sparkSession, len(columns), tried or max(1, int(np.ceil(len(columns) ** 0.5)))
    given = materialise(df.select(F.monotonically_increasing_id().alias("row"), F.col(label).cast("long").alias("y"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x")), "rows")
    sizes = {int(r["y"]): int(r["n"]) for r in given.groupBy("y").agg(n_rows().alias("n")).collect()}
    total = sum(sizes.values())
    weights = tuple(total / (len(sizes) * sizes[c]) if sizes.get(c) else 0.0 for c in (0, 1))
    cuts, folder = _cuts(given, d), new_folder(spark, "binned")
    given.mapInArrow(lambda it: _bin_task(it, cuts), "row long, y long, bins binary").write.option("compression", "zstd").parquet(folder)
    if total <= min(LOCAL, LOCAL_BYTES // d):

        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            row, y, bins = _arrays([b for t in _read(folder, ["row", "y", "bins"]) for b in t.to_batches() if b.num_rows])
            for tree in (t for b in batches for t in b.column(0).to_pylist()):
                yield from _grown(tree, row, y, bins, cuts, seed, k, depth, least, weights)

        tasks = min(trees, 2 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        return _packed(materialise(spark.range(0, trees, 1, tasks).mapInArrow(grow, _NODE), "nodes"), columns)
    binned, model, levels = spark.read.schema("row long, y long, bins binary").parquet(folder), [], new_folder(spark, "levels")

    def chosen(last: bool) -> Callable[[pa.Table], pa.Table]:
        def choose(table: pa.Table) -> pa.Table:
            tree = table["tree"][0].as_py()
            node, at = np.unique(table["node"].to_numpy(), return_inverse=True)
            counts = np.zeros((len(node), k * BINS * 2))
            counts[at, table["slot"].to_numpy()] = table["n"].to_numpy()
            batch, _, bin_ = _rows(tree, node, counts.reshape(len(node), k, BINS, 2), _tried(seed, tree, node, d, k), cuts, weights, least, last)
            return pa.Table.from_batches([batch]).append_column("bin", pa.array(bin_, pa.int32()))

        return choose

    for level in range(depth + 1):
        found = _level(binned, levels if level else None, level, trees, seed, d, k).groupBy("tree").applyInArrow(chosen(level == depth), f"{_NODE}, bin int")
        found.write.mode("append").parquet(levels)
        model = spark.read.schema(f"{_NODE}, bin int").parquet(levels)
        if not model.filter((F.col("feature") >= 0) & (F.col("node") >= 1 << level)).head(1):
            break
    return _packed(model.drop("bin"), columns)
