"""Pairwise-complete correlations of many columns from blocks of a Gram matrix, in one pass over the rows.

With x the values (0 where missing) and m their presence, the moments of a pair over the
rows that have both are products of blocks: n = m'm, sums x'm, squares (xx)'m, products x'x.
A task adds up its rows' products and sends a row a column; rows of one column are added as
they stream through a task. Values count from a column's median in the task's first rows, so
that squares don't cancel; moments are moved to a common origin when they are added.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a panel: a task holds four matrices of a panel by a panel (34 MB at most). Rows whose products are formed at once.
PANEL, ROWS = 1024, 4096
#: A variance below this share of the squared mean (from the origin) is rounding.
ROUNDING = 1e-13

_MOMENTS = "a int, origin_a double, origins binary, moments binary"
_MOMENTS_SCHEMA = pa.schema([("a", pa.int32()), ("origin_a", pa.float64()), ("origins", pa.binary()), ("moments", pa.binary())])


def _values(batch: pa.RecordBatch) -> np.ndarray:
    out = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])
    out[~np.isfinite(out)] = np.nan
    return out


def _origins(x: np.ndarray) -> np.ndarray:
    """A value of each column near its middle; 0 where none is known."""
    order = np.sort(x, axis=0)  # NaN last
    n = (~np.isnan(x)).sum(0)
    return np.where(n > 0, order[np.maximum(n - 1, 0) // 2, np.arange(x.shape[1])], 0.0)


def _gram_task(batches: Iterator[pa.RecordBatch], left: int, first: int, second: int) -> Iterator[pa.RecordBatch]:
    """Moments of the first left columns with the others, or (one panel) with themselves; first and second are the panels' first columns."""
    total, origin = None, None
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            x = _values(batch.slice(low, ROWS))
            if origin is None:
                origin = _origins(x)
            x -= origin
            m = ~np.isnan(x)
            x[~m] = 0.0
            m = m.astype(np.float64)
            a, b = (slice(0, left), slice(0, left)) if first == second else (slice(0, left), slice(left, None))
            xa, xb, ma, mb = x[:, a], x[:, b], m[:, a], m[:, b]
            # Number, sums of a and of b, squares of a and of b, products.
            new = np.stack((ma.T @ mb, xa.T @ mb, ma.T @ xb, (xa * xa).T @ mb, ma.T @ (xb * xb), xa.T @ xb))
            total = new if total is None else total + new
    if total is None:
        return
    right = origin[:left] if first == second else origin[left:]
    for low in range(0, left, 64):
        rows = range(low, min(left, low + 64))
        columns = [[first + i for i in rows], [origin[i] for i in rows], [right.tobytes()] * len(rows), [total[:, i].tobytes() for i in rows]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MOMENTS_SCHEMA, strict=True)], schema=_MOMENTS_SCHEMA)


def _moved(moments: np.ndarray, da: float, db: np.ndarray) -> np.ndarray:
    """Moments of values from another origin, da and db below the old one."""
    n, sa, sb, qa, qb, p = moments
    return np.stack((n, sa + n * da, sb + n * db, qa + 2 * da * sa + n * da * da, qb + 2 * db * sb + n * db * db, p + da * sb + db * sa + n * da * db))


_PAIR = "i int, j int, n long, r double"
_PAIR_SCHEMA = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64()), ("r", pa.float64())])


def _sum_task(batches: Iterator[pa.RecordBatch], second: int) -> Iterator[pa.RecordBatch]:
    """Adds up the moments of each column of the partition and gives its correlations with later columns."""
    held: dict[int, tuple[float, np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for a, origin, origins, moments in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            right = np.frombuffer(origins)
            new = np.frombuffer(moments).reshape(6, len(right))
            if a in held:
                o, r, old = held[a]
                held[a] = o, r, old + _moved(new, origin - o, right - r)
            else:
                held[a] = origin, right, new
    for a, (_, _, (n, sa, sb, qa, qb, p)) in held.items():
        some = np.maximum(n, 1)
        ma, mb = sa / some, sb / some
        va, vb = qa / some - ma * ma, qb / some - mb * mb
        flat = (n == 0) | (va <= ROUNDING * ma * ma) | (vb <= ROUNDING * mb * mb) | (va <= 0) | (vb <= 0)
        r = (p / some - ma * mb) / np.sqrt(np.where(flat, 1.0, va * vb))
        j = second + np.arange(len(n))
        later = j > a
        columns = [np.full(int(later.sum()), a, np.int32), j[later].astype(np.int32), n[later].astype(np.int64), np.clip(r, -1, 1)[later]]
        arrays = [pa.array(c, f.type, mask=flat[later] if f.name == "r" else None) for c, f in zip(columns, _PAIR_SCHEMA, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, schema=_PAIR_SCHEMA)


def pair_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, n, r) for columns i before j: rows that have both, finite, and their Pearson correlation, null where a side is constant.

    Up to PANEL columns the rows are read once; more are dealt to panels, each pair of which
    reads its own columns.
    """
    panels = [(low, columns[low : low + PANEL]) for low in range(0, len(columns), PANEL)]
    out = None
    for (first, left), (second, right) in combinations_with_replacement(panels, 2):
        wanted = left if first == second else left + right
        rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(wanted)])
        moments = rows.mapInArrow(lambda it, n=len(left), a=first, b=second: _gram_task(it, n, a, b), _MOMENTS)
        found = moments.repartition("a").mapInArrow(lambda it, b=second: _sum_task(it, b), _PAIR)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else df.sparkSession.createDataFrame([], _PAIR)
