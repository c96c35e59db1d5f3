"""A stored index for exact nearest neighbours: unit vectors in cells around pivots, pruned by the triangle inequality.

Angles between unit vectors are a metric, so no vector of a cell is nearer to a query than
the angle to its pivot less the cell's radius. A search first looks into the cells nearest to
a query until these hold k vectors; then only into cells that could hold a better one than
the k-th found. What is stored is bound to a contract: names and order of the dimensions, and
a digest of these and the pivots.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import n_rows
from tessera.operators.contracts import ContractError
from tessera.operators.ordered import top_per_key
from tessera.operators.similarity import BLOCK, _best, _units
from tessera.session import materialise

#: Pivots at most: they come to the driver and go to every task.
PIVOTS = 1024
#: Similarities are rounded, so a cell is left out only if it is worse by this.
SLACK = 2e-6

_CELL = "cell int, id long, angle double, vector binary"
_CELL_SCHEMA = pa.schema([("cell", pa.int32()), ("id", pa.int64()), ("angle", pa.float64()), ("vector", pa.binary())])


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def _assign_task(batches: Iterator[pa.RecordBatch], pivots: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, unit = _units(batch.column(1))
        if len(kept):
            angle = _angles(unit, pivots.value)
            cell = angle.argmin(1)
            columns = [cell, batch.column(0).to_numpy(zero_copy_only=False)[kept], angle[np.arange(len(cell)), cell], [v.tobytes() for v in unit.astype("<f8")]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CELL_SCHEMA, strict=True)], schema=_CELL_SCHEMA)


_PACKED = "cell int, ids binary, vectors binary"
_PACKED_SCHEMA = pa.schema([("cell", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])


def _pack(table: pa.Table) -> pa.Table:
    ids, vectors = table["id"].to_numpy().astype("<i8"), b"".join(table["vector"].to_pylist())
    return pa.table([pa.array([table["cell"][0].as_py()], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([vectors], pa.binary())], schema=_PACKED_SCHEMA)


def _digest(names: list[str], pivots: np.ndarray) -> str:
    return hashlib.sha256(json.dumps(names).encode() + np.ascontiguousarray(pivots, "<f8").tobytes()).hexdigest()


class Index:
    """A loaded index: packed cells, and the pivots with their cells' radii and sizes."""

    def __init__(self, cells: DataFrame, names: list[str], pivots: np.ndarray, radius: np.ndarray, size: np.ndarray):
        self.cells, self.names, self.pivots, self.radius, self.size = cells, names, pivots, radius, size

    def search(self, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", exclude_self: bool = True, digits: int = 6) -> DataFrame:
        """(query_id, neighbour_id, sim, rank) as similarity.nearest() gives them; queries' ids are unique. The first look runs at once."""
        first, rest = self.rounds(queries, k, key, vector, exclude_self, digits)
        return top_per_key(first.unionByName(self._looked(rest, k, exclude_self, digits)), ["query_id"], [F.desc("sim"), F.asc("neighbour_id")], k)

    def rounds(self, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", exclude_self: bool = True, digits: int = 6) -> tuple[DataFrame, DataFrame]:
        """What the first look finds (query_id, neighbour_id, sim), and the pairs (cell, id, vector) of the second."""
        spark = queries.sparkSession
        shared = spark.sparkContext.broadcast((self.pivots, self.radius, self.size))
        asked = queries.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.lit(None).cast("double").alias("least"))
        found = self._looked(asked.mapInArrow(lambda it: _probe_task(it, shared, k + exclude_self), _CELL), k, exclude_self, digits)
        found = materialise(top_per_key(found, ["query_id"], [F.desc("sim"), F.asc("neighbour_id")], k).drop("rank"), "first-look")
        kth = found.groupBy(F.col("query_id").alias("id")).agg(F.when(n_rows() >= k, F.min("sim")).otherwise(-2.0).alias("least"))
        again = asked.drop("least").join(kth, "id", "left").select("id", "v", F.coalesce("least", F.lit(-2.0)).alias("least"))
        return found, again.mapInArrow(lambda it: _probe_task(it, shared, k + exclude_self), _CELL)

    def _looked(self, pairs: DataFrame, k: int, exclude_self: bool, digits: int) -> DataFrame:
        """The k best of each packed part of a cell for the queries that look into it; these go in blocks too."""
        blocks = F.pmod(F.xxhash64("id"), F.lit(max(1, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
        asked = pairs.select("cell", "id", "vector", blocks.alias("block")).groupBy("cell", "block").applyInArrow(_pack, _PACKED)
        met = asked.join(self.cells.select("cell", F.col("ids").alias("own"), F.col("vectors").alias("units")), "cell")

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    ids, vectors, own, units = (np.frombuffer(batch.column(i)[row].as_buffer(), kind) for i, kind in ((1, "<i8"), (2, "<f8"), (3, "<i8"), (4, "<f8")))
                    for low in range(0, len(ids), BLOCK):
                        mine = ids[low : low + BLOCK]
                        yield _best(mine, vectors.reshape(len(ids), -1)[low : low + BLOCK], own, units.reshape(len(own), -1), k, exclude_self, digits)

        return met.mapInArrow(task, "query_id long, neighbour_id long, sim double")


def _probe_task(batches: Iterator[pa.RecordBatch], shared: Broadcast, k: int) -> Iterator[pa.RecordBatch]:
    """The cells that queries (id, v, least) look into: without least the nearest until they hold k vectors, with it the others that may hold a similarity of least or more."""
    pivots, radius, size = shared.value
    for batch in batches:
        kept, unit = _units(batch.column(1))
        if not len(kept):
            continue
        angle = _angles(unit, pivots)
        order = np.argsort(angle, axis=1, kind="stable")
        before = np.cumsum(size[order], axis=1) - size[order]
        near = np.zeros(angle.shape, bool)
        np.put_along_axis(near, order, before < k, axis=1)
        least = batch.column(2)
        if least.null_count:
            chosen = near
        else:
            closest = np.cos(np.maximum(angle - radius, 0.0))
            chosen = ~near & (closest >= least.to_numpy()[kept][:, None] - SLACK)
        row, cell = np.nonzero(chosen & (size > 0))
        columns = [cell, batch.column(0).to_numpy(zero_copy_only=False)[kept][row], angle[row, cell], [unit[i].astype("<f8").tobytes() for i in row]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CELL_SCHEMA, strict=True)], schema=_CELL_SCHEMA)


def write_index(reference: DataFrame, path: str, names: list[str], key: str = "vec_id", vector: str = "embedding", pivots: int | None = None) -> None:
    """Writes cells, pivots and the contract; names are the dimensions' names in their order.

    Pivots are the vectors first in a hash order of their ids, the root of the number of
    vectors and PIVOTS at most. Null and zero vectors are left out, as they match nothing;
    vectors of another dimension are refused. A cell is stored in parts of some BLOCK vectors.
    """
    spark = reference.sparkSession
    rows = reference.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    odd = rows.filter(F.size("v") != len(names)).take(1)
    if odd:
        raise ContractError(f"vector {odd[0]['id']} has not {len(names)} dimensions")
    some = rows.filter(F.exists("v", lambda x: x != 0))
    wanted = pivots or min(PIVOTS, max(1, math.isqrt(some.count())))
    chosen = np.array([r["v"] for r in some.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()], float).reshape(-1, len(names))
    chosen /= np.linalg.norm(chosen, axis=1, keepdims=True)
    shared = spark.sparkContext.broadcast(chosen)
    assigned = materialise(rows.mapInArrow(lambda it: _assign_task(it, shared), _CELL), "cells")
    known = {r["cell"]: (r["radius"], r["n"]) for r in assigned.groupBy("cell").agg(F.max("angle").alias("radius"), n_rows().alias("n")).collect()}  # a row a pivot
    radius, size = (np.array([known.get(c, (0.0, 0))[i] for c in range(len(chosen))]) for i in (0, 1))
    parts = F.array(*[F.lit(int(n) // BLOCK + 1) for n in size])
    part = F.pmod(F.xxhash64("id"), F.get(parts, F.col("cell"))) if len(chosen) else F.lit(0)
    assigned.withColumn("part", part).groupBy("cell", "part").applyInArrow(_pack, _PACKED).write.parquet(f"{path}/cells")
    pivot_rows = [(c, chosen[c].tolist(), float(radius[c]), int(size[c])) for c in range(len(chosen))]
    spark.createDataFrame(pivot_rows, "cell int, pivot array<double>, radius double, n long").coalesce(1).write.parquet(f"{path}/pivots")
    spec = {"format": 1, "dimensions": names, "n": int(size.sum()), "digest": _digest(names, chosen)}
    spark.createDataFrame([(json.dumps(spec),)], "value string").coalesce(1).write.text(f"{path}/contract")


def load_index(spark: SparkSession, path: str, names: list[str]) -> Index:
    """The index whose contract holds: its format, the dimensions in their order, the pivots' digest and the number of vectors."""
    spec = json.loads(spark.read.text(f"{path}/contract").first()[0])
    if spec.get("format") != 1 or spec.get("dimensions") != list(names):
        raise ContractError(f"the index at {path} has format {spec.get('format')} and dimensions {spec.get('dimensions')}")
    rows = sorted(spark.read.parquet(f"{path}/pivots").collect())
    pivots = np.array([r["pivot"] for r in rows], float).reshape(-1, len(names))
    radius, size = np.array([r["radius"] for r in rows]), np.array([r["n"] for r in rows], np.int64)
    if spec.get("digest") != _digest(list(names), pivots) or spec.get("n") != int(size.sum()):
        raise ContractError(f"the pivots at {path} are not those of its contract")
    return Index(spark.read.parquet(f"{path}/cells"), list(names), pivots, radius, size)
