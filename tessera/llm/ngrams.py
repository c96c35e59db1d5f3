"""Hashed byte n-grams of texts, counted over a corpus into tables of fixed size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.filters import pack, unpack
from tessera.llm.plan import record
from tessera.llm.text import chunks, column_bytes

#: Bytes of an n-gram, bits of its hash, and rows that a table travels in.
ORDER, BITS, ROWS = 4, 17, 16


def slots(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slot of every n-gram that lies in one text, and n + 1 offsets.

    A shorter text has none.
    """
    n = np.diff(offsets)
    if len(raw) < ORDER:
        return np.zeros(0, np.int32), np.zeros(len(n) + 1, np.int64)
    gram = raw[: len(raw) - ORDER + 1].astype(np.uint32)
    for j in range(1, ORDER):
        gram = (gram << np.uint32(8)) | raw[j : len(raw) - ORDER + 1 + j]
    slot = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32)
    number = np.maximum(n - ORDER + 1, 0)
    if len(n) > 1 or number.sum() != len(slot):
        inside = np.ones(len(slot), bool)
        for j in range(ORDER - 1):  # n-grams that begin in a text's last bytes
            at = offsets[1:-1] - 1 - j
            inside[at[(at >= offsets[:-2]) & (at < len(slot))]] = False
        slot = slot[inside]
    return slot, np.concatenate(([0], np.cumsum(number)))


def text_means(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The mean of each text's values, 0 where it has none; it does not depend on the texts beside it."""
    n, out = np.diff(offsets), np.zeros(len(offsets) - 1)
    some = n > 0
    if some.any():
        out[some] = np.add.reduceat(values, offsets[:-1][some], dtype=np.float64) / n[some]
    return out


_TABLE = "part int, counts binary"
_TABLE_SCHEMA = pa.schema([("part", pa.int32()), ("counts", pa.binary())])


def table_rows(table: np.ndarray) -> pa.RecordBatch:
    """A table of counts as ROWS rows; its length is a multiple of ROWS."""
    return record(_TABLE_SCHEMA, [list(range(ROWS)), [pack(x) for x in table.astype(np.int64).reshape(ROWS, -1)]])


def _add(table: pa.Table) -> pa.Table:
    total = sum(unpack(x, np.int64) for x in table["counts"].to_pylist())
    return pa.Table.from_batches([record(_TABLE_SCHEMA, [[table["part"][0].as_py()], [pack(total)]])])


def summed(rows: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], size: int) -> np.ndarray:
    """The sum over all tasks of a table of size counts, which alone comes to the driver."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in task(batches):
            yield table_rows(table)

    total = np.zeros((ROWS, size // ROWS), np.int64)
    for part, counts in rows.mapInArrow(emit, _TABLE).groupBy("part").applyInArrow(_add, _TABLE).collect():
        total[part] = unpack(counts, np.int64)
    return total.reshape(-1)


def counted(batch: pa.RecordBatch, weights: list[Callable[[pa.RecordBatch], np.ndarray]], column: str = "text") -> np.ndarray:
    """Counts of n-grams in a batch's texts, once for each selection of texts (a boolean an argument)."""
    out = np.zeros((len(weights), 1 << BITS), np.int64)
    for part in chunks(batch, column, 4 << 20):
        slot, offsets = slots(*column_bytes(part.column(part.schema.get_field_index(column))))
        for k, chosen in enumerate(weights):
            picked = chosen(part)
            mine = slot if picked.all() else slot[np.repeat(picked, np.diff(offsets))]
            out[k] += np.bincount(mine, minlength=1 << BITS)
    return out
