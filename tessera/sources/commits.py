"""Work in chunks that are committed one by one, so that a run that was stopped goes on where it was."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import new_folder
from tessera.sources.arrays import place


def _names(files: pafs.FileSystem, folder: str) -> set[str]:
    found = files.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return {i.base_name for i in found}


def committed(folder: str) -> list[int]:
    """The chunks that a folder's earlier runs have committed."""
    files, name = place(folder)
    return sorted(int(n.removeprefix("chunk-")) for n in _names(files, f"{name}/done"))


def run_chunks(rows: DataFrame, key: str, chunks: int, work: Callable[[DataFrame], DataFrame], folder: str, attempts: int = 2) -> dict[int, str]:
    """Applies work to the rows of each chunk (by a hash of key) that is not committed in folder; the chunks that failed and why.

    A chunk's result is written aside in the shared folder, then moved into place in one
    step, so it is there whole or not at all, once. A chunk that raises is tried attempts
    times; then its error is written to the folder and the others go on. A later run skips
    what is committed and tries the failed ones again.
    """
    spark = rows.sparkSession
    files, name = place(folder)
    for sub in ("done", "failed"):
        files.create_dir(f"{name}/{sub}", recursive=True)
    chunk = F.pmod(F.xxhash64(key), F.lit(chunks))
    failed: dict[int, str] = {}
    there = set(committed(folder))
    for number in (n for n in range(chunks) if n not in there):
        for _ in range(attempts):
            aside = new_folder(spark, f"chunk-{number}")
            try:
                work(rows.filter(chunk == number)).write.parquet(aside)
                files.move(place(aside)[1], f"{name}/done/chunk-{number}")
                failed.pop(number, None)
                break
            except Exception as error:  # recorded, and raised by results()
                failed[number] = f"{type(error).__name__}: {error}"[:2000]
        note = f"{name}/failed/chunk-{number}.json"
        if number in failed:
            with files.open_output_stream(note) as f:
                f.write(json.dumps({"chunk": number, "error": failed[number]}).encode())
        elif f"chunk-{number}.json" in _names(files, f"{name}/failed"):
            files.delete_file(note)
    return failed


def results(spark: SparkSession, folder: str, chunks: int) -> DataFrame:
    """The rows of all chunks; it is an error if one is not committed."""
    missing = sorted(set(range(chunks)) - set(committed(folder)))
    if missing:
        raise RuntimeError(f"{len(missing)} of {chunks} chunks are not committed: {missing[:20]}")
    return spark.read.parquet(*[f"{folder}/done/chunk-{n}" for n in range(chunks)])


def replace_output(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Puts what write(folder) writes in the place of path: a reader finds the old output or the new one, whole.

    It is written aside in the shared folder first; if that fails, the old output stays as
    it is. Then the old one is moved away, the new one moved in, and the old one removed. A
    process that ends between the moves leaves the old output beside path, ending in .before,
    which the next call puts back or removes.
    """
    files, name = place(path)
    before = f"{name}.before"
    there = lambda n: files.get_file_info(n).type != pafs.FileType.NotFound
    if there(before):
        if there(name):
            files.delete_dir(before)
        else:
            files.move(before, name)
    aside = new_folder(spark, "aside")
    write(aside)
    if there(name):
        files.move(name, before)
    files.move(place(aside)[1], name)
    if there(before):
        files.delete_dir(before)
