"""Exact nearest neighbours by cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordered import top_per_key
from tessera.session import materialise, new_folder
from tessera.sources.arrays import place

#: Query vectors to a block; bytes of reference vectors that a task compares at a time, each time going through all blocks; similarities
#: to a tile of their product.
BLOCK, SLAB_BYTES, TILE = 4096, 64 << 20, 4 << 20


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that are neither null nor zero, and these vectors at length 1."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    whole = column.drop_null()
    if not len(whole):
        return there, np.zeros((0, 0))
    m = whole.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(whole), -1)
    length = np.linalg.norm(m, axis=1)
    return there[length > 0], m[length > 0] / length[length > 0, None]


def _pack(table: pa.Table) -> pa.Table:
    """A block of queries as one row: ids, and unit vectors one after another."""
    kept, unit = _units(table.column(2))
    ids = table.column(1).to_numpy()[kept].astype("<i8")
    return pa.table({"block": pa.array([table.column(0)[0].as_py()], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()), "vectors": pa.array([unit.astype("<f8").tobytes()], pa.binary())})


def _best(ids: np.ndarray, block: np.ndarray, own: np.ndarray, unit: np.ndarray, k: int, exclude_self: bool, digits: int) -> pa.RecordBatch:
    """The k best of some reference vectors for each query of a block, tile by tile."""
    out: list[list[np.ndarray]] = [[], [], []]
    step = max(1, TILE // max(1, len(own)))
    for low in range(0, len(ids), step):
        sim = np.round(block[low : low + step] @ unit.T, digits)
        mine = ids[low : low + step]
        if exclude_self:
            sim[mine[:, None] == own[None, :]] = -np.inf
        least = np.partition(sim, -k, axis=1)[:, -k] if sim.shape[1] > k else np.full(len(sim), -np.inf)
        row, column = np.nonzero((sim >= least[:, None]) & np.isfinite(sim))  # at least k, more where equals are at the cut
        value = sim[row, column]
        order = np.lexsort((own[column], -value, row))
        row, column, value = row[order], column[order], value[order]
        first = np.searchsorted(row, np.arange(len(sim)))
        kept = np.arange(len(row)) - first[row] < k
        for part, x in zip(out, (mine[row[kept]], own[column[kept]], value[kept]), strict=True):
            part.append(x)
    return pa.record_batch({name: np.concatenate(x) if x else np.zeros(0, kind) for name, x, kind in zip(("query_id", "neighbour_id", "sim"), out, (np.int64, np.int64, float), strict=True)})


def nearest(queries: DataFrame, reference: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", exclude_self: bool = True, digits: int = 6) -> DataFrame:
    """(query_id, neighbour_id, sim, rank): the k most similar reference vectors of every query.

    Queries are packed in blocks, which lie in the shared folder; a task goes through them for
    each slab of 64 MB of its reference vectors, a tile at a time, and sends on the k best of the slab, so
    that neither side passes the driver and memory depends on neither's size. Vectors have
    one dimension; ties in the rounded similarity go to the lower id; zero and null vectors
    match nothing. The packing runs at once.
    """
    spark = queries.sparkSession
    folder = new_folder(spark, "queries")
    rows = materialise(queries.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter("v IS NOT NULL"), "asked")  # counted and packed
    blocks = max(1, math.ceil(1.1 * rows.count() / BLOCK))  # hashing fills blocks unevenly
    packed = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long").alias("block"), "id", "v").groupBy("block").applyInArrow(_pack, "block long, ids binary, vectors binary")
    packed.write.parquet(folder)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, name = place(folder)
        paths = sorted(i.path for i in files.get_file_info(pafs.FileSelector(name)) if i.path.endswith(".parquet"))
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def search() -> Iterator[pa.RecordBatch]:
            own, unit = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            for path in paths:
                with files.open_input_file(path) as f:
                    for batch in pq.ParquetFile(f).iter_batches(batch_size=1):
                        ids = np.frombuffer(batch.column(1)[0].as_buffer(), "<i8")
                        if len(ids):
                            yield _best(ids, np.frombuffer(batch.column(2)[0].as_buffer(), "<f8").reshape(len(ids), -1), own, unit, k, exclude_self, digits)

        for batch in batches:
            kept, unit = _units(batch.column(1))
            if len(kept):
                held.append((batch.column(0).to_numpy(zero_copy_only=False)[kept].astype(np.int64), unit))
            if sum(h[1].nbytes for h in held) >= SLAB_BYTES:
                yield from search()
                held = []
        if held:
            yield from search()

    found = reference.select(F.col(key).cast("long"), vector).mapInArrow(task, "query_id long, neighbour_id long, sim double")
    return top_per_key(found, ["query_id"], [F.desc("sim"), F.asc("neighbour_id")], k)
