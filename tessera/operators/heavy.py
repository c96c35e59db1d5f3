"""The most common values of many columns in two passes, without a row a cell.

A task keeps a bounded number of counters a column: when there are more values, all counters
are lowered until few enough are left, which undercounts a value by at most what was taken
off. Counters of all tasks add up, and so do these errors. The candidates that could be first
or second are then counted exactly; only a column whose first two can't be told that way is
counted value by value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import n_rows

#: Counters of a column in a task, and candidates of a column that are counted exactly.
COUNTERS, CANDIDATES = 64, 32

_COUNTER = "c int, v double, n long, error long"
_SCHEMA = pa.schema([("c", pa.int32()), ("v", pa.float64()), ("n", pa.int64()), ("error", pa.int64())])


def _numbers(column: pa.Array) -> np.ndarray:
    """Values of a column, missing and not finite ones as NaN, which counts as one value; -0 is 0."""
    x = column.to_numpy(zero_copy_only=False).astype(np.float64)
    return np.where(np.isfinite(x), x, np.nan) + 0.0


def lowered(values: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The counters with what the (most + 1)-th largest has taken off, empty ones gone, and how much that was."""
    if len(values) <= most:
        return values, counts, 0
    off = int(np.partition(counts, -(most + 1))[-(most + 1)])
    left = counts > off
    return values[left], counts[left] - off, off


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list | None = None
    for batch in batches:
        if held is None:
            held = [(np.zeros(0), np.zeros(0, np.int64), 0) for _ in batch.columns]
        for i, column in enumerate(batch.columns):
            values, counts, error = held[i]
            new, n = np.unique(_numbers(column), return_counts=True)
            both, where = np.unique(np.concatenate((values, new)), return_inverse=True)
            summed = np.bincount(where, weights=np.concatenate((counts, n)), minlength=len(both)).astype(np.int64)
            *kept, off = lowered(both, summed, COUNTERS)
            held[i] = (*kept, error + off)
    for i, (values, counts, error) in enumerate(held or []):
        columns = [np.full(len(values) + 1, i), np.append(values, 0.0), np.append(counts, 0), np.append(np.zeros(len(values), np.int64), error)]
        arrays = [pa.array(x, f.type, mask=np.append(np.isnan(values), True) if f.name == "v" else None) for x, f in zip(columns, _SCHEMA, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)  # the last row carries the error alone


def _exact_task(batches: Iterator[pa.RecordBatch], wanted: Broadcast) -> Iterator[pa.RecordBatch]:
    total = {c: np.zeros(len(v) + 1, np.int64) for c, v in wanted.value.items()}
    for batch in batches:
        for c, v in wanted.value.items():
            x = _numbers(batch.column(c))
            at = np.searchsorted(v, x)  # NaN is last in both
            hit = (at < len(v)) & ((v[np.minimum(at, len(v) - 1)] == x) | (np.isnan(v[np.minimum(at, len(v) - 1)]) & np.isnan(x))) if len(v) else np.zeros(len(x), bool)
            total[c] += np.append(np.bincount(at[hit], minlength=len(v))[: len(v)], len(x))
    rows = [(c, i, n) for c, t in total.items() for i, n in enumerate(t.tolist())]
    if rows:
        yield pa.record_batch({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate((("c", pa.int32()), ("i", pa.int32()), ("n", pa.int64())))})


def _cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, v): a row a cell; missing and not finite values are null, -0 is 0."""
    return df.select(*[F.when(F.abs(F.col(f"`{c}`").cast("double")) < float("inf"), F.col(f"`{c}`").cast("double") + 0.0).alias(c) for c in columns]).unpivot([], [F.col(f"`{c}`") for c in columns], "feature", "v")


def with_distinct(found: DataFrame, df: DataFrame) -> DataFrame:
    """dominant_values() of df with all of n_distinct: columns of more than COUNTERS values are counted exactly, value by value. A name a column comes to the driver."""
    open_ = [r["feature"] for r in found.filter("n_distinct IS NULL").select("feature").collect()]
    if not open_:
        return found
    exact = _cells(df, open_).distinct().groupBy("feature").agg(n_rows().alias("__exact"))
    return found.join(exact, "feature", "left").withColumn("n_distinct", F.coalesce("n_distinct", "__exact")).drop("__exact")


def dominant_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, n_distinct, dominant, n_first, n_second) of numeric columns: the rows, the most common value (of equals the
    least, missing before all) and how often it and the next are there.

    n_distinct is given up to COUNTERS values, else null. Missing and not finite values count as
    one value. A few rows a column come to the driver. The first passes run at once.
    """
    from tessera.operators.features import dominance

    spark = df.sparkSession
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    counters = rows.mapInArrow(_count_task, _COUNTER).groupBy("c", "v").agg(F.sum("n").alias("n"), F.sum("error").alias("error"))
    # The row of errors is that of a missing value too, if there is one.
    per = counters.groupBy("c").agg(F.sum("error").alias("error"), F.count_if(F.col("n") > 0).alias("kept"), F.slice(F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.struct("n", "v"))), asc=False), 1, CANDIDATES + 1).alias("top"))
    found = {r["c"]: r for r in per.collect()}
    wanted = {c: np.sort(np.array([np.nan if t["v"] is None else t["v"] for t in r["top"][:CANDIDATES]], float)) for c, r in found.items()}
    shared = spark.sparkContext.broadcast(wanted)  # CANDIDATES numbers a column
    exact: dict[int, dict[int, int]] = {}
    for r in rows.mapInArrow(lambda it: _exact_task(it, shared), "c int, i int, n long").groupBy("c", "i").agg(F.sum("n").alias("n")).collect():
        exact.setdefault(r["c"], {})[r["i"]] = r["n"]
    done, open_ = [], []
    for c, values in wanted.items():
        counts = sorted(((-n, not np.isnan(values[i]), values[i]) for i, n in exact[c].items() if i < len(values)), key=lambda x: x[:2] if not x[1] else x)
        r = found[c]
        rest = r["error"] + (r["top"][CANDIDATES]["n"] if len(r["top"]) > CANDIDATES else 0)  # no other value is there more often
        if counts and (rest == 0 or (len(counts) > 1 and -counts[1][0] > rest)):
            dominant = None if np.isnan(counts[0][2]) else float(counts[0][2])
            done.append((columns[c], exact[c][len(values)], r["kept"] if r["error"] == 0 and r["kept"] <= COUNTERS else None, dominant, -counts[0][0], -counts[1][0] if len(counts) > 1 else None))
        else:
            open_.append(columns[c])
    schema = "feature string, n long, n_distinct long, dominant double, n_first long, n_second long"
    settled = spark.createDataFrame(done, schema)
    if not open_:
        return settled
    long = _cells(df, open_)
    others = dominance(long).select("feature", "n", F.when(F.col("n_distinct") <= COUNTERS, F.col("n_distinct")).alias("n_distinct"), "dominant", "n_first", "n_second")
    return settled.unionByName(others)

