"""A membership filter whose size follows the input, to keep rows without any partner out of a shuffle."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from tessera.llm.plan import key_arrays, record
from tessera.llm.text import mix

#: Bits of a filter: two to the power of PART at least and of MOST (128 MB) at most; one for so many bytes of input. It is put
#: together in parts of 128 KB. A fuller filter passes more rows, never fewer.
PART, MOST, BYTES_A_BIT = 20, 30, 64

_PLACES = "part int, places binary"
_PLACES_SCHEMA = pa.schema([("part", pa.int32()), ("places", pa.binary())])
_SALT = np.uint64(0x2545F4914F6CDD1D)


def filter_bits(size: int) -> int:
    """The power of two of the bits for so many bytes of input: some eight bits a text of 500 bytes, up to 64 GB."""
    return min(MOST, max(PART, math.ceil(math.log2(max(size, 1) / BYTES_A_BIT))))


def probes(ids: np.ndarray, bits: int) -> np.ndarray:
    """The three bits of each 64-bit id."""
    one, two = mix(ids.view(np.uint64) ^ _SALT), mix(ids.view(np.uint64) + _SALT)
    return ((one[:, None] + two[:, None] * np.arange(3, dtype=np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _places_task(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The places of set bits, by the part of the filter that they lie in."""
    held, n = [], 0

    def emit() -> pa.RecordBatch:
        at = np.unique(np.concatenate(held))
        parts, first = np.unique(at >> PART, return_index=True)
        inside = (at & ((1 << PART) - 1)).astype("<i4")
        return record(_PLACES_SCHEMA, [parts, [x.tobytes() for x in np.split(inside, first[1:])]])

    for batch in batches:
        held.append(probes(batch.column(0).to_numpy(), bits).ravel())
        n += len(held[-1])
        if n > 1 << 22:
            yield emit()
            held, n = [], 0
    if n:
        yield emit()


def _part(table: pa.Table) -> pa.Table:
    out = np.zeros(1 << PART, bool)
    for places in table["places"]:
        out[np.frombuffer(places.as_buffer(), "<i4")] = True
    return pa.Table.from_batches([record(_PLACES_SCHEMA, [[table["part"][0].as_py()], [np.packbits(out).tobytes()]])])


def member_filter(ids: DataFrame, bits: int) -> Broadcast:
    """The filter of two to the power of bits for the only column of ids (long, not null), for contains()."""
    rows = np.zeros((1 << bits - PART, 1 << PART - 3), np.uint8)
    for part, blob in ids.mapInArrow(lambda it: _places_task(it, bits), _PLACES).groupBy("part").applyInArrow(_part, _PLACES).toLocalIterator():
        rows[part] = np.frombuffer(blob, np.uint8)
    return ids.sparkSession.sparkContext.broadcast(rows.reshape(-1))


def contains(wanted: Broadcast, ids: np.ndarray) -> np.ndarray:
    """True for every member and for few others."""
    at = probes(ids, len(wanted.value).bit_length() + 2)
    return ((wanted.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)


def _keep_task(batches: Iterator[pa.RecordBatch], wanted: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(contains(wanted, key_arrays(batch.column(0))[0])))


def partners(rows: DataFrame, others: DataFrame, bits: int, key: str = "key") -> DataFrame:
    """rows (a row key first) joined to others on key; rows without a partner mostly don't travel, by a filter of two to the power of bits."""
    wanted = member_filter(others.select(f"{key}.a"), bits)
    return rows.mapInArrow(lambda it: _keep_task(it, wanted), rows.schema).join(others, key)


def pack(values: np.ndarray) -> bytes:
    """An unsigned array with its bytes regrouped by place, so that small values compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def unpack(blob: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(kind).ravel()
