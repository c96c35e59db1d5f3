"""The library's functions under names that SQL can call."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_STRUCTURE = "n_atoms int, n_bonds int, n_rings int, charge int, metal boolean"


def register(spark: SparkSession) -> list[str]:
    """Registers the functions for spark.sql(); their names.

    two_sided_p(z): erfc(|z| / sqrt 2). ks_exact_p(gap, n1, n0): the exact Kolmogorov-Smirnov
    p-value, null where a class is too large. structure_facts(text): counts of a line
    notation, null if it is none. All take batches of rows.
    """
    from tessera.operators import molecules, stats

    def two_sided_p(z: pd.Series) -> pd.Series:
        return z.map(lambda x: None if x is None or x != x else math.erfc(abs(x) / math.sqrt(2)))

    def ks_exact_p(gap: pd.Series, n1: pd.Series, n0: pd.Series) -> pd.Series:
        known = gap.notna() & (n1 > 0) & (n0 > 0) & (n1 <= stats.EXACT_KS) & (n0 <= stats.EXACT_KS)
        return pd.Series([stats.exact_ks_p(*x) if ok else None for ok, x in zip(known, zip(gap, n1, n0, strict=True), strict=True)], dtype=float)

    def structure_facts(text: pd.Series) -> pd.DataFrame:
        rows = []
        for value in text:
            try:
                atoms, bonds = molecules.parse((value or "").strip())
                rows.append((len(atoms), len(bonds), len(bonds) - len(atoms) + value.count(".") + 1, sum(a[2] for a in atoms), any(a[0] in molecules.METALS for a in atoms)))
            except ValueError:
                rows.append((None,) * 5)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _STRUCTURE.split(", ")]).astype(object)

    kinds = {two_sided_p: "double", ks_exact_p: "double", structure_facts: _STRUCTURE}
    for function, kind in kinds.items():
        spark.udf.register(function.__name__, F.pandas_udf(function, kind))
    return [f.__name__ for f in kinds]
