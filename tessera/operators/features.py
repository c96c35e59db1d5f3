"""Train-only feature screens: missingness, imputation, variance, duplicates and correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import finite, n_rows
from tessera.operators.correlation import pair_correlations
from tessera.operators.ordered import quantiles


def column_summary(df: DataFrame, columns: list[str], **measures) -> DataFrame:
    """One pass over a wide table, then a row a column: measures are functions of a column."""
    one = df.agg(*[m(F.col(c)).alias(f"{name}|{c}") for c in columns for name, m in measures.items()])
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"`{name}|{c}`").alias(name) for name in measures]) for c in columns]))
    return one.select(stacked.alias("r")).select("r.*")


def missing_share(c: Column) -> Column:
    return F.count_if(finite(c).isNull()).cast("double") / n_rows()


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, median) of finite values, exact, without a buffer of all values."""
    long = df.select(*[finite(F.col(c)).alias(c) for c in columns]).unpivot([], columns, "feature", "v")
    return quantiles(long, ["feature"], "v", [0.5]).select("feature", F.col("q")[0].alias("median"))


def impute(df: DataFrame, train: Column, columns: list[str]) -> DataFrame:
    """Missing and non-finite values become the train rows' median, in train and test."""
    found = medians(df.filter(train), columns)
    one = found.agg(*[F.max(F.when(F.col("feature") == c, F.col("median"))).alias(f"__m_{c}") for c in columns])
    filled = df.join(F.broadcast(one))  # one row
    return filled.withColumns({c: F.coalesce(finite(F.col(c)), F.col(f"__m_{c}")) for c in columns}).drop(*[f"__m_{c}" for c in columns])


def identical_columns(df: DataFrame, key: str, columns: list[str]) -> list[tuple[str, str]]:
    """Pairs (kept, dropped) of equal columns: by a fingerprint of key and value first, then exactly.

    The two aggregations run at once; what comes to the driver is a row with a value a column.
    """
    prints = df.agg(*[F.sum(F.xxhash64(key, F.col(c).cast("double")).cast("decimal(38,0)")).alias(c) for c in columns]).first()
    groups: dict = {}
    for c in columns:
        groups.setdefault(prints[c], []).append(c)
    candidates = [(g[0], c) for g in groups.values() for c in g[1:]]
    if not candidates:
        return []
    same = df.agg(*[F.bool_and(F.col(a).cast("double").eqNullSafe(F.col(b).cast("double"))).alias(f"{i}") for i, (a, b) in enumerate(candidates)]).first()
    return [pair for i, pair in enumerate(candidates) if same[i]]


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for a before b: pairwise complete Pearson correlations, null where a side is constant."""
    names = F.array(*map(F.lit, columns)).cast("array<string>")
    return pair_correlations(df, columns).select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), "r")


def high_pairs(df: DataFrame, columns: list[str], limit: float = 0.95) -> list[tuple[str, str, float]]:
    """The pairs of correlations() above the limit in absolute value; only these come to the driver."""
    return [tuple(r) for r in correlations(df, columns).filter(F.abs("r") > limit).collect()]


def correlation_screen(pairs: list[tuple[str, str, float]], columns: list[str], limit: float = 0.95, greedy: bool = True) -> list[str]:
    """Columns to drop, in their locked order: those that correlate with an earlier one; greedy: with an earlier one that stays."""
    earlier: dict[str, list[str]] = {}
    for a, b, r in pairs:
        if r is not None and abs(r) > limit:
            earlier.setdefault(b, []).append(a)
    dropped: dict[str, None] = {}
    for c in columns:
        if any(not (greedy and a in dropped) for a in earlier.get(c, [])):
            dropped[c] = None
    return list(dropped)


def dominance(long: DataFrame) -> DataFrame:
    """Per feature of (feature, v): rows, distinct values, the most common value and its share, and its ratio to the second."""
    counts = long.groupBy("feature", "v").agg(n_rows().alias("n"))
    top = counts.withColumn("place", F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("n"), "v"))).filter("place <= 2")
    first = top.groupBy("feature").agg(F.max(F.when(F.col("place") == 1, F.col("v"))).alias("dominant"), F.max(F.when(F.col("place") == 1, F.col("n"))).alias("n_first"), F.max(F.when(F.col("place") == 2, F.col("n"))).alias("n_second"))
    total = counts.groupBy("feature").agg(F.sum("n").alias("n"), n_rows().alias("n_distinct"))
    return total.join(first, "feature").withColumn("dominant_share", F.col("n_first").cast("double") / F.col("n")).withColumn("frequency_ratio", F.try_divide(F.col("n_first").cast("double"), F.col("n_second").cast("double")))


def _placed(df: DataFrame, stratum: str, key: Column, seed: int) -> DataFrame:
    """df with __place, from 1, in its stratum's order of the MD5 of seed:key, and __size of the stratum.

    Places are found by counting ranges of hashes, so that no stratum is sorted by one task.
    """
    hashed = df.withColumn("__md5", F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))).withColumn("__h", F.substring("__md5", 1, 4))
    counts = hashed.groupBy(stratum, "__h").agg(n_rows().alias("__n"))
    before = Window.partitionBy(stratum).orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)
    cuts = counts.select(stratum, "__h", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__b"), F.sum("__n").over(Window.partitionBy(stratum)).alias("__size"))
    within = F.row_number().over(Window.partitionBy(stratum, "__h").orderBy("__md5", key))
    return hashed.join(cuts, [stratum, "__h"]).withColumn("__place", within + F.col("__b")).drop("__h", "__b", "__md5")


def stratified_split(df: DataFrame, stratum: str, key: Column, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """df with test: of each stratum the rows first in a hash order, round(share * n) of them."""
    return _placed(df, stratum, key, seed).withColumn("test", F.col("__place") <= F.round(F.col("__size") * test_share)).drop("__place", "__size")


def stratified_folds(df: DataFrame, stratum: str, key: Column, folds: int = 5, seed: int = 42, fold: str = "fold") -> DataFrame:
    """df with fold, 0 to folds - 1: each stratum's rows are dealt in turn in a hash order."""
    return _placed(df, stratum, key, seed).withColumn(fold, ((F.col("__place") - 1) % folds).cast("int")).drop("__place", "__size")


def all_missing(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns without any finite value, by one aggregation."""
    some = df.agg(*[F.bool_or(finite(F.col(c)).isNotNull()).alias(c) for c in columns]).first()
    return [c for c in columns if not some[c]]


def standardised(df: DataFrame, vector: str, train: Column) -> DataFrame:
    """df with every dimension of a vector less the train rows' mean, over their population deviation; it fails if that is 0 or not finite.

    What is broadcast is a row with two numbers a dimension.
    """
    long = df.filter(train).select(F.posexplode(vector).alias("__i", "__x"))
    moments = long.groupBy("__i").agg(F.avg(F.col("__x").cast("double")).alias("m"), F.stddev_pop(F.col("__x").cast("double")).alias("s"))
    one = moments.agg(F.array_sort(F.collect_list(F.struct("__i", "m", "s"))).alias("__moments"))
    bad = F.lit("a dimension has no finite deviation above 0")
    scale = lambda x, w: F.when(finite(w["s"]) > 0, (x.cast("double") - w["m"]) / w["s"]).otherwise(F.raise_error(bad).cast("double"))
    return df.join(F.broadcast(one)).withColumn(vector, F.zip_with(vector, "__moments", scale)).drop("__moments")
