"""Spark plumbing shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import math
import sys
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import materialise  # noqa: F401  (operators take it from here)

#: Bytes of input to a bucket of a packed exchange, and the number of buckets from which half of any growth goes to their size: a task
#: that had a few entries for each of millions of buckets would send more headers than entries.
BUCKET_BYTES, EVEN_BUCKETS = 16 << 20, 10_000
#: Catalyst's estimates from here on (multiplied up through joins, or the default of an unknown size) say nothing.
UNKNOWN_BYTES = 1 << 58


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size of the rows (file bytes for a plain scan), without running anything."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of the input: Catalyst's estimate, or where there is none the bytes of its texts."""
    size = estimated_bytes(docs)
    if size >= UNKNOWN_BYTES:  # not a plain scan: Catalyst can't tell
        size = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    return size


def bucket_count(docs: DataFrame) -> int:
    """Buckets of a packed exchange: in proportion to the input up to EVEN_BUCKETS (160 GB), then to its root (400 MB of input a bucket at 100 TB)."""
    size = text_bytes(docs)
    by_size = math.ceil(size / BUCKET_BYTES)
    if by_size > EVEN_BUCKETS:
        by_size = math.ceil(math.sqrt(by_size * EVEN_BUCKETS))
    return max(by_size, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Fixed value: what the second half of a key hashes first.
_SALT = 0x51ED270B
KEY = "struct<a:bigint,b:bigint>"
KEY_TYPE = pa.struct([("a", pa.int64()), ("b", pa.int64())])


def row_key(*columns: str) -> Column:
    """A 128-bit key of a row's content, null-safe; rows that share it are equal in these columns."""
    given = [c for name in columns for c in (F.col(name), F.col(name).isNull())]
    return F.struct(F.xxhash64(*given).alias("a"), F.xxhash64(F.lit(_SALT), *given).alias("b"))


def key_arrays(column: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of keys."""
    return column.field(0).to_numpy(), column.field(1).to_numpy()


def key_column(a: np.ndarray, b: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], fields=list(KEY_TYPE))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of texts: Spark's default of 10,000 rows would hold tens of megabytes in every worker and again
    in its executor. A session that sets its own size keeps it."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def forget(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished steps now: its cleaner acts when the driver has collected garbage, which else may take half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release() -> None:
    """Gives the memory of a finished task back: workers stay for the next one."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text) of documents; other columns do not take part."""
    small_batches(docs.sparkSession)
    return docs.select(row_key("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")


_kept: dict[str, tuple[object, object]] = {}


def per_process(name: str, shared: Broadcast, make: Callable) -> object:
    """make(shared.value), once for each Python worker and broadcast rather than once a task."""
    value = shared.value  # loaded once a worker
    if name not in _kept or _kept[name][0] is not value:
        _kept[name] = (value, make(value))
    return _kept[name][1]


def record(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    """A batch from arrays or lists, converted to the schema's types."""
    arrays = [c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def join_blobs(column: pa.ChunkedArray | pa.Array) -> bytes:
    """All values of a binary column behind one another; nulls are empty."""
    return b"".join(x for x in column.to_pylist() if x)
