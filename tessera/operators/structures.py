"""Featurisers of structure strings behind typed interfaces.

A toolkit is an object with the functions below; the engine only fixes their types, when a
failure gives nulls, and that a worker makes its toolkit once. PlainToolkit works on the
strings alone and needs no library; a chemistry library takes its place on a cluster that
has one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Symbols that PlainToolkit's metal flag looks for in a text; molecules.METALS has the whole set, for parsed atoms.
METALS = ("Li", "Na", "Mg", "Al", "Ca", "Fe", "Co", "Ni", "Cu", "Zn", "Ag", "Pt", "Au", "Hg", "Pb")


@dataclass(frozen=True)
class ConformerSettings:
    """One set of settings for all callers: conformers at most, seed, least distance, optimiser steps."""

    conformers: int = 3
    seed: int = 42
    prune: float = 0.5
    steps: int = 300


class Toolkit(Protocol):
    descriptors: tuple[str, ...]
    shape_descriptors: tuple[str, ...]
    fingerprint_bits: int
    dimension: int

    def parse(self, structure: str) -> tuple[str, str] | None:
        """The canonical form and the formula, or None if it is no structure."""

    def describe(self, canonical: str) -> list[float]: ...

    def conform(self, canonical: str, settings: ConformerSettings) -> tuple[str, float, list[float]]:
        """The optimiser that was used, the least energy, and the shape descriptors; it raises if there is none."""

    def fingerprint(self, canonical: str) -> bytes: ...

    def embed(self, batch: list[str]) -> np.ndarray:
        """A matrix with a row a structure."""


class PlainToolkit:
    """Counts characters: a structure is a string without white space whose round brackets close."""

    descriptors = ("length", "n_upper", "n_digits")
    shape_descriptors = ("spread",)
    fingerprint_bits = 2048
    dimension = 26

    def parse(self, structure: str) -> tuple[str, str] | None:
        depth = 0
        for c in structure:
            depth += (c == "(") - (c == ")")
            if depth < 0 or c.isspace():
                return None
        if depth or not structure:
            return None
        letters = sorted({c for c in structure if "A" <= c <= "Z"})
        return structure, "".join(f"{c}{structure.count(c)}" for c in letters)

    def describe(self, canonical: str) -> list[float]:
        return [float(len(canonical)), float(sum("A" <= c <= "Z" for c in canonical)), float(sum("0" <= c <= "9" for c in canonical))]

    def conform(self, canonical: str, settings: ConformerSettings) -> tuple[str, float, list[float]]:
        codes = np.frombuffer(canonical.encode("utf-32-le"), "<u4").astype(float)
        return "PLAIN", float(codes.mean()), [float(codes.std())]

    def fingerprint(self, canonical: str) -> bytes:
        bits = np.zeros(self.fingerprint_bits, np.uint8)
        for a, b in zip(canonical, canonical[1:], strict=False):
            bits[(31 * ord(a) + ord(b)) % self.fingerprint_bits] = 1
        return np.packbits(bits, bitorder="little").tobytes()

    def embed(self, batch: list[str]) -> np.ndarray:
        return np.array([[s.lower().count(chr(97 + i)) / max(len(s), 1) for i in range(self.dimension)] for s in batch], np.float32).reshape(len(batch), self.dimension)


_toolkits: dict[Callable, Toolkit] = {}


def _toolkit(make: Callable[[], Toolkit]) -> Toolkit:
    """make(), once a Python worker."""
    if make not in _toolkits:
        _toolkits[make] = make()
    return _toolkits[make]


def parse_structures(df: DataFrame, column: str = "structure", make: Callable[[], Toolkit] = PlainToolkit) -> DataFrame:
    """df with parsed: struct<valid, canonical, formula>; canonical and formula are null for a null, blank or wrong structure."""

    @F.pandas_udf("struct<valid boolean, canonical string, formula string>")
    def parse(values: pd.Series) -> pd.DataFrame:
        found = [None if v is None or v != v or not v.strip() else _toolkit(make).parse(v.strip()) for v in values]
        return pd.DataFrame({"valid": [f is not None for f in found], "canonical": [f and f[0] for f in found], "formula": [f and f[1] for f in found]})

    return df.withColumn("parsed", parse(F.col(column)))


def _guarded(call: Callable, *arguments):
    """The call's result, or None if the toolkit fails on this structure."""
    try:
        return call(*arguments)
    except (ValueError, ArithmeticError, RuntimeError):
        return None


def structure_descriptors(df: DataFrame, canonical: str = "canonical", make: Callable[[], Toolkit] = PlainToolkit) -> DataFrame:
    """df with descriptors: array<double>, null where there is no structure or the toolkit fails."""

    @F.pandas_udf("array<double>")
    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kit = _toolkit(make)
        for values in batches:
            yield pd.Series([None if v is None else _guarded(kit.describe, v) for v in values], dtype=object)

    return df.withColumn("descriptors", describe(F.col(canonical)))


def fingerprints(df: DataFrame, canonical: str = "canonical", make: Callable[[], Toolkit] = PlainToolkit) -> DataFrame:
    """df with fingerprint: binary, the lowest bit of the first byte first; null as for descriptors."""

    @F.pandas_udf("binary")
    def bits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kit = _toolkit(make)
        for values in batches:
            yield pd.Series([None if v is None else _guarded(kit.fingerprint, v) for v in values], dtype=object)

    return df.withColumn("fingerprint", bits(F.col(canonical)))


def embeddings(df: DataFrame, canonical: str = "canonical", make: Callable[[], Toolkit] = PlainToolkit, size: int = 32) -> DataFrame:
    """df with embedding: array<float>, by batches of so many structures; the model is loaded once a worker."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kit = _toolkit(make)
        for values in batches:
            there = [i for i, v in enumerate(values) if v is not None]
            out: list = [None] * len(values)
            for low in range(0, len(there), size):
                own = there[low : low + size]
                for i, row in zip(own, kit.embed([values.iloc[i] for i in own]), strict=True):
                    out[i] = row.tolist()
            yield pd.Series(out, dtype=object)

    return df.withColumn("embedding", embed(F.col(canonical)))


def conformers(df: DataFrame, key: str = "id", canonical: str = "canonical", settings: ConformerSettings | None = None, make: Callable[[], Toolkit] = PlainToolkit) -> DataFrame:
    """(key, status, method, energy, shape, metal) of every row: SUCCESS, FAILED or NO_STRUCTURE; metal tells whether its symbol is in the structure."""
    chosen = settings or ConformerSettings()

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kit = _toolkit(make)
        for pdf in batches:
            rows = []
            for name, text in zip(pdf["id"], pdf["canonical"], strict=True):
                found = None if text is None else _guarded(kit.conform, text, chosen)
                status = "NO_STRUCTURE" if text is None else "FAILED" if found is None else "SUCCESS"
                rows.append((name, status, *(found or (None, None, None)), None if text is None else any(m in text for m in METALS)))
            yield pd.DataFrame(rows, columns=["id", "status", "method", "energy", "shape", "metal"])

    given = df.select(F.col(key).cast("long").alias("id"), F.col(canonical).alias("canonical"))
    return given.mapInPandas(task, "id long, status string, method string, energy double, shape array<double>, metal boolean").withColumnRenamed("id", key)
