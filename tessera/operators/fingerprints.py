"""Tanimoto similarity of fingerprints, sets of bits: search of the most similar, and all pairs over a threshold.

A pair of sets of sizes a <= b has a Tanimoto similarity of a / b at most, and one that reaches
t has t / (1 + t) of a + b in common. All pairs are looked at, block by block: at a low
threshold nearly all of them share some bit, so that no key keeps them apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import n_rows
from tessera.operators.ordered import top_per_key
from tessera.session import materialise, new_folder
from tessera.sources.arrays import place

#: Fingerprints to a block of queries, and of reference rows that a task holds.
BLOCK, SLAB = 1024, 16_384
#: Of pairs over a threshold: sets to a block at most, bytes of what a task holds of one, tasks at least if sets suffice; bits looked up and pairs sent on at a time.
PAIR_BLOCK, PAIR_BYTES, PAIR_TASKS, LOOKUPS, PAIRS = 4096, 64 << 20, 64, 1 << 22, 1 << 16


def _words(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(column), -1)


_QUERY = "block long, low long, high long, ids binary, words binary"


def _pack_block(table: pa.Table) -> pa.Table:
    words = _words(table["words"])
    n = np.bitwise_count(words).sum(1)
    return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int64()), "low": pa.array([n.min()], pa.int64()), "high": pa.array([n.max()], pa.int64()), "ids": pa.array([table["id"].to_numpy().astype("<i8").tobytes()], pa.binary()), "words": pa.array([words.tobytes()], pa.binary())})


def _similar(ids: np.ndarray, words: np.ndarray, own: np.ndarray, mine: np.ndarray, k: int | None, least: float, exclude_self: bool, digits: int) -> pa.RecordBatch:
    """Pairs of queries with reference rows of a similarity of least or more, the k best of each query."""
    n, m = np.bitwise_count(words).sum(1).astype(float), np.bitwise_count(mine).sum(1).astype(float)
    out: list[list[np.ndarray]] = [[], [], []]
    for i in range(len(ids)):
        # Sizes bound what a row can reach.
        near = np.flatnonzero(np.minimum(m, n[i]) >= (least - 10.0**-digits) * np.maximum(m, n[i]))
        both = np.bitwise_count(mine[near] & words[i]).sum(1)
        union = n[i] + m[near] - both
        sim = np.round(np.divide(both, union, out=np.zeros(len(near)), where=union > 0), digits)
        keep = sim >= least
        if exclude_self:
            keep &= own[near] != ids[i]
        found, sim = own[near][keep], sim[keep]
        order = np.lexsort((found, -sim))[:k]
        for part, x in zip(out, (np.full(len(order), ids[i]), found[order], sim[order]), strict=True):
            part.append(x)
    return pa.record_batch({name: np.concatenate(x) if x else np.zeros(0, kind) for name, x, kind in zip(("query_id", "neighbour_id", "sim"), out, (np.int64, np.int64, float), strict=True)})


def search(queries: DataFrame, reference: DataFrame, k: int | None = None, least: float = 0.0, key: str = "id", words: str = "words", exclude_self: bool = True, digits: int = 6) -> DataFrame:
    """(query_id, neighbour_id, sim, rank): the k most similar fingerprints (all without k) of a similarity of least or more.

    Queries are packed in blocks of like numbers of bits, which lie in the shared folder; a
    task goes through them for each slab of its rows, and leaves out blocks and rows whose
    numbers of bits can't reach least. Null fingerprints match nothing, empty ones have
    similarity 0; ties go to the lower id. The packing runs at once.
    """
    spark = queries.sparkSession
    folder = new_folder(spark, "fingerprints")
    asked = queries.select(F.col(key).cast("long").alias("id"), F.col(words).alias("words")).filter("words IS NOT NULL")
    size = F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + F.bit_count(w))
    sizes = materialise(asked.withColumn("n", size), "sized")
    blocks = max(1, math.ceil(sizes.count() / BLOCK))
    cuts = sizes.agg(F.percentile_approx("n", [i / 16 for i in range(1, 16)]).alias("c")).first()["c"] or []
    # Blocks of a range of sizes, dealt by a hash.
    band = sum((F.col("n") > c).cast("long") for c in cuts) if cuts else F.lit(0).cast("long")
    per_band = max(1, -(-blocks // 16))
    sizes.withColumn("block", band * per_band + F.pmod(F.xxhash64("id"), F.lit(per_band))).select("block", "id", "words").groupBy("block").applyInArrow(_pack_block, _QUERY).write.parquet(folder)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, name = place(folder)
        paths = sorted(i.path for i in files.get_file_info(pafs.FileSelector(name)) if i.path.endswith(".parquet"))
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def found() -> Iterator[pa.RecordBatch]:
            own, mine = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            n = np.bitwise_count(mine).sum(1)
            for path in paths:
                with files.open_input_file(path) as f:
                    for b in pq.ParquetFile(f).iter_batches(batch_size=1):
                        low, high = b.column(1)[0].as_py(), b.column(2)[0].as_py()
                        if n.max() < (least - 10.0**-digits) * low or high < (least - 10.0**-digits) * n.min():
                            continue
                        ids = np.frombuffer(b.column(3)[0].as_buffer(), "<i8")
                        yield _similar(ids, np.frombuffer(b.column(4)[0].as_buffer(), np.uint64).reshape(len(ids), -1), own, mine, k, least, exclude_self, digits)

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(zero_copy_only=False), _words(batch.column(1))))
            if sum(len(h[0]) for h in held) >= SLAB:
                yield from found()
                held = []
        if held:
            yield from found()

    rows = reference.select(F.col(key).cast("long").alias("id"), F.col(words).alias("words")).filter("words IS NOT NULL AND id IS NOT NULL")
    pairs = rows.mapInArrow(task, "query_id long, neighbour_id long, sim double")
    order = [F.desc("sim"), F.asc("neighbour_id")]
    return top_per_key(pairs, ["query_id"], order, k) if k else pairs


def _sets(files: pafs.FileSystem, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, sizes and bits of a block's sets; a missing bit counts as one more."""
    parts = []
    for x in sorted(i.path for i in files.get_file_info(pafs.FileSelector(path)) if i.path.endswith(".parquet")):
        with files.open_input_file(x) as f:
            parts.append(pq.ParquetFile(f).read(columns=["id", "bits"]))
    batches = [b for t in parts for b in t.to_batches()]
    join = lambda of: np.concatenate([of(b) for b in batches])
    return join(lambda b: b.column(0).to_numpy()), join(lambda b: b.column(1).value_lengths().to_numpy().astype(np.int64)), join(lambda b: b.column(1).flatten().cast(pa.int64()).fill_null(-(2**63)).to_numpy())


def _folded(n: np.ndarray, bits: np.ndarray, width: int) -> np.ndarray:
    """Each set's numbers of bits in width buckets (a power of two) of a hash."""
    with np.errstate(over="ignore"):
        bucket = ((bits.view(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - width.bit_length())
    at = np.repeat(np.arange(len(n)), n) * width + bucket.astype(np.int64)
    return np.bincount(at, minlength=len(n) * width).reshape(len(n), width).astype(np.float32)


def _common(has: np.ndarray, rows: np.ndarray, m: np.ndarray, places: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Bits in common, pair by pair, of sets as rows of has (a column a bit, the last for bits that none has) with the sets (m, places) at cols."""
    start, ends, out, low = np.cumsum(m) - m, np.cumsum(m[cols]), np.zeros(len(rows), np.int64), 0
    while low < len(rows):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + LOOKUPS, "right")))
        size = m[cols[low:high]]
        first = np.cumsum(size) - size
        each = np.arange(size.sum()) - np.repeat(first - start[cols[low:high]], size)
        out[low:high] = np.add.reduceat(has[np.repeat(rows[low:high], size), places[each]].astype(np.int64), first)
        low = high
    return out


def _pair_task(batches: Iterator[pa.RecordBatch], folder: str, width: int, floor: float) -> Iterator[pa.RecordBatch]:
    """(id, id2, n, n2, both) of the pairs of each given block with itself and with the half of the others that comes next, in a ring."""
    files, paths = place(folder)[0], _blocks(folder)
    share = floor / (1 + floor) * (1 - 1e-5)  # of both sizes together; products are single floats
    for mine in (k for batch in batches for k in batch.column(0).to_pylist()):
        own, n, bits = _sets(files, paths[mine])
        codes, code = np.unique(bits, return_inverse=True)
        folds, ends, side = _folded(n, bits, width), np.cumsum(n), max(1, min(1024, PAIR_BYTES // (len(codes) + 1)))
        for step in range(len(paths) // 2 + 1):
            other = (mine + step) % len(paths)
            if 2 * step == len(paths) and mine > other:  # two blocks that face each other meet once
                continue
            theirs, m, others = _sets(files, paths[other]) if step else (own, n, bits)
            if max(n.min(), m.min()) * floor > min(n.max(), m.max()):
                continue
            across = (_folded(m, others, width) if step else folds).T
            near = np.minimum(np.searchsorted(codes, others), len(codes) - 1)
            places = np.where(codes[near] == others, near, len(codes))
            for low in range(0, len(n), side):
                a = n[low : low + side]
                # In a bucket two sets have no more bits in common than the product of their numbers there.
                rows, cols = np.nonzero(folds[low : low + side] @ across >= (a * share).astype(np.float32)[:, None] + (m * share).astype(np.float32)[None, :])
                keep = (np.minimum(a[rows], m[cols]) >= floor * np.maximum(a[rows], m[cols])) & (own[low + rows] != theirs[cols])
                if not step:
                    keep &= low + rows < cols
                rows, cols = rows[keep], cols[keep]
                if not len(rows):
                    continue
                has = np.zeros((len(a), len(codes) + 1), bool)
                has[np.repeat(np.arange(len(a)), a), code[ends[low] - n[low] : ends[low + len(a) - 1]]] = True
                both = _common(has, rows, m, places, cols)
                reach = both >= floor * (a[rows] + m[cols] - both)
                rows, cols, both = rows[reach], cols[reach], both[reach]
                for i in range(0, len(rows), PAIRS):
                    r, c = rows[i : i + PAIRS], cols[i : i + PAIRS]
                    yield pa.record_batch({"id": own[low + r], "id2": theirs[c], "n": a[r], "n2": m[c], "both": both[i : i + PAIRS]})


def _blocks(folder: str) -> list[str]:
    """The folders of blocks, in order."""
    files, name = place(folder)
    return [path for _, path in sorted((int(i.path.rpartition("=")[2]), i.path) for i in files.get_file_info(pafs.FileSelector(name)) if "=" in i.base_name)]


def similar_pairs(rows: DataFrame, least: float, key: str = "id", bits: str = "bits", digits: int = 6) -> DataFrame:
    """(a, b, sim) for ids a < b whose sets of bits (array<int>) have a Tanimoto similarity, rounded, of least (over 0) or more.

    Sets lie in blocks by size in the shared folder, once. A task goes through half of the
    other blocks for its own and leaves out those whose sizes can't reach least; products of
    folded sets bound what a pair has in common, and only pairs that pass are compared bit by
    bit. Only pairs that reach least leave a task, and its memory does not depend on the
    number of sets. Null and empty sets have no partner; of repeated ids each row counts.
    The blocks are written at once.
    """
    spark = rows.sparkSession
    # Written before they are filtered: a filter would go below the work on the bits and repeat it.
    given = materialise(rows.select(F.col(key).cast("long").alias("id"), F.array_distinct(bits).alias("bits")), "sets").filter("id IS NOT NULL AND size(bits) > 0")
    given = given.withColumns({"n": F.size("bits"), "row": F.monotonically_increasing_id()})
    sums = given.agg(n_rows().alias("rows"), F.avg("n").alias("mean")).first()
    mean = float(sums["mean"] or 1)
    width = 1 << min(12, max(6, math.ceil(math.log2(8 * mean))))
    held = max(1, min(PAIR_BLOCK, int(PAIR_BYTES / (8 * mean))))
    # Few sets are dealt to some tasks too.
    dealt = max(1, -(-sums["rows"] // held), min(PAIR_TASKS, sums["rows"] // 64))
    folder = new_folder(spark, "blocks")
    given.repartitionByRange(dealt, "n", "row").withColumn("block", F.spark_partition_id()).write.option("compression", "zstd").partitionBy("block").parquet(folder)
    blocks = len(_blocks(folder))
    floor = least - 10.0**-digits  # rounding may lift a pair
    pairs = spark.range(0, blocks, 1, max(1, blocks)).mapInArrow(lambda it: _pair_task(it, folder, width, floor), "id long, id2 long, n long, n2 long, both long")
    sim = F.round(F.col("both") / (F.col("n") + F.col("n2") - F.col("both")), digits)
    return pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"), sim.alias("sim")).filter(F.col("sim") >= least)
