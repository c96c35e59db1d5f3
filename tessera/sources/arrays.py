"""Dense vectors as .npy files: a folder of parts, each a matrix beside the keys of its rows."""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.contracts import ContractError

#: Bytes of a matrix that a task reads at a time.
BLOCK_BYTES = 16 << 20


def place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _header(files: pafs.FileSystem, name: str) -> tuple[np.dtype, tuple[int, ...], int]:
    """Type, shape and where the data begins."""
    with files.open_input_file(name) as f:
        start = f.read(12)
        if start[:6] != b"\x93NUMPY":
            raise ContractError(f"{name} is no .npy file")
        wide = start[6] > 1
        length = struct.unpack("<I", start[8:12])[0] if wide else struct.unpack("<H", start[8:10])[0]
        f.seek(12 if wide else 10)
        spec = ast.literal_eval(f.read(length).decode("latin-1"))
        if spec["fortran_order"]:
            raise ContractError(f"{name} is stored by column")
        return np.dtype(spec["descr"]), tuple(spec["shape"]), length + (12 if wide else 10)


def write_npy(df: DataFrame, folder: str, key: str, vector: str, dimension: int) -> DataFrame:
    """Writes (key, vector) as parts of keys and matrices; the manifest (part, n_rows), a row a part.

    Vectors must have that dimension and no nulls. A file is written aside and renamed, so
    that it is whole if it is there, and a task that is run again writes the same.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, name = place(folder)
        files.create_dir(name, recursive=True)
        part, attempt = f"part-{TaskContext.get().partitionId():06d}", TaskContext.get().taskAttemptId()
        keys, rows = [], []
        for batch in batches:
            if batch.column(1).null_count or any(len(v) != dimension for v in batch.column(1)):
                raise ContractError(f"a vector is null or has not {dimension} dimensions")
            keys.append(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8"))
            rows.append(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(-1, dimension))
        if not keys:
            return
        for kind, values in (("keys", np.concatenate(keys)), ("values", np.concatenate(rows))):
            with files.open_output_stream(f"{name}/.{part}-{kind}-{attempt}") as out:
                np.lib.format.write_array(_Sink(out), values, version=(1, 0))
            files.move(f"{name}/.{part}-{kind}-{attempt}", f"{name}/{part}-{kind}.npy")
        yield pa.record_batch({"part": [part], "n_rows": pa.array([sum(map(len, keys))], pa.int64())})

    written = df.select(F.col(key).cast("long"), F.col(vector).cast("array<float>")).mapInArrow(task, "part string, n_rows long")
    return df.sparkSession.createDataFrame(written.collect(), "part string, n_rows long")


class _Sink:
    """What numpy needs of a file."""

    def __init__(self, out):
        self.out = out

    def write(self, data) -> None:
        self.out.write(bytes(data))


def read_npy(spark: SparkSession, folder: str) -> DataFrame:
    """(key long, vector array<float>) of all parts of a folder, read in blocks of rows by byte range.

    The driver lists the parts and reads their headers; a matrix whose rows are not those of
    its keys, of another type, or stored by column, is refused.
    """
    files, name = place(folder)
    blocks = []
    for info in sorted(files.get_file_info(pafs.FileSelector(name)), key=lambda i: i.path):
        if not info.path.endswith("-values.npy") or info.base_name.startswith("."):
            continue
        keys = info.path.removesuffix("-values.npy") + "-keys.npy"
        (kind, shape, at), (key_kind, key_shape, key_at) = _header(files, info.path), _header(files, keys)
        if kind != np.dtype("<f4") or len(shape) != 2 or key_kind != np.dtype("<i8") or key_shape != shape[:1]:
            raise ContractError(f"{info.path} is no matrix of floats with a key a row")
        step = max(1, BLOCK_BYTES // max(4 * shape[1], 1))
        blocks += [(info.path, keys, low, min(step, shape[0] - low), shape[1], at, key_at) for low in range(0, shape[0], step)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = place(folder)

        def values(path: str, at: int, n: int, kind: str) -> np.ndarray:
            with files.open_input_file(path) as f:
                f.seek(at)
                return np.frombuffer(f.read(n * np.dtype(kind).itemsize), kind)

        for batch in batches:
            for path, keys, low, n, width, at, key_at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = values(path, at + 4 * low * width, n * width, "<f4")
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(rows, pa.float32()))
                yield pa.record_batch({"key": values(keys, key_at + 8 * low, n, "<i8"), "vector": vectors})

    listed = spark.createDataFrame(blocks, "path string, keys string, low long, n long, width long, at long, key_at long")
    return listed.repartition(max(1, min(len(blocks), 10_000))).mapInArrow(task, "key long, vector array<float>")
