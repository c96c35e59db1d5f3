"""Tie-aware rank statistics of long feature tables (feature, v, y), computed over distinct values."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import effect_category, finite
from tessera.operators.ordered import running_sums

#: Least size of a class for which a feature is tested.
LEAST_CLASS = 10


def value_counts(rows: DataFrame, keys: list[str], value: str = "v", label: str = "y") -> DataFrame:
    """Counts of both classes at each distinct value; what follows depends on these alone."""
    kept = rows.withColumn(value, finite(F.col(value))).filter(F.col(value).isNotNull())
    return kept.groupBy(*keys, value).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def rank_statistics(rows: DataFrame, keys: list[str], value: str = "v", label: str = "y") -> DataFrame:
    """Per key: n1, n0, u, auc, cliffs_delta, effect, ks, ks_at, ks_p, ties (sum of t^3 - t) and z of the Mann-Whitney test.

    Equal values share their average rank; z has the tie and the continuity correction.
    ks_at is the least value where the gap is largest (to 9 digits), ks_p its asymptotic
    p-value by the Kolmogorov series. auc, ks and z are null where a class is empty.
    """
    counts = value_counts(rows, keys, value, label).withColumn("__value", F.col(value))
    run = running_sums(counts, keys, "__value", {"cp": "pos", "cn": "neg"})
    total = counts.groupBy(*keys).agg(F.sum("pos").alias("n1"), F.sum("neg").alias("n0"))
    t = F.col("pos") + F.col("neg")
    ks = F.abs(F.try_divide(F.col("cp").cast("double"), F.col("n1")) - F.try_divide(F.col("cn").cast("double"), F.col("n0")))
    # Each positive beats the negatives below it and half of its equals.
    wins = F.col("pos").cast("double") * (F.col("cn") - F.col("neg") + F.col("neg") / 2.0)
    found = run.join(total, keys).groupBy(*keys).agg(F.first("n1").alias("n1"), F.first("n0").alias("n0"), F.sum(wins).alias("u"), F.max(ks).alias("ks"), F.min_by(value, F.struct(-F.round(ks, 9), F.col(value))).alias("ks_at"), F.sum(t.cast("double") * t * t - t).alias("ties"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    auc = F.try_divide(F.col("u"), n1 * n0)
    sigma = F.sqrt(n1 * n0 / 12.0 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.try_divide(F.greatest(F.abs(F.col("u") - n1 * n0 / 2.0) - 0.5, F.lit(0.0)), sigma)
    root = n1 * n0 / n * F.col("ks") * F.col("ks")
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * root))
    found = found.withColumn("ks_p", F.when(F.col("ks").isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * series))))
    return found.withColumn("auc", auc).withColumn("cliffs_delta", 2.0 * auc - 1.0).withColumn("effect", effect_category(2.0 * auc - 1.0)).withColumn("z", z)


def two_sided_p(z: Column) -> Column:
    """erfc(|z| / sqrt 2), vectorised; there is no such SQL function."""

    @F.pandas_udf("double")
    def p(values: pd.Series) -> pd.Series:
        return values.map(lambda x: math.erfc(abs(x) / math.sqrt(2)) if x == x and x is not None else None)

    return p(z)


#: Fixed value: the exact Kolmogorov-Smirnov p-value is worked out up to so many rows of the larger class.
EXACT_KS = 10_000


def exact_ks_p(ks: float, n1: int, n0: int) -> float:
    """The chance that two samples of these sizes differ by ks or more, all orders of their rows being equally likely.

    An order is a lattice path; paths that leave the band of smaller gaps are counted at the
    step with which they first do, times the ways to go on from there. Counts are kept as
    shares of the largest of their row, with its logarithm beside them.
    """
    m, n = sorted((int(n1), int(n0)))
    most = int(np.ceil(ks * m * n - 1e-6)) - 1  # the largest gap inside, in steps of 1 / (m n)
    if most < 0:
        return 1.0
    log_factorial = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, m + n + 1)))))
    ways = lambda a, b: log_factorial[a + b] - log_factorial[a] - log_factorial[b]
    total, out, scale = ways(m, n), 0.0, 0.0
    low, row = 0, np.ones(min(n, most // m) + 1)
    for i in range(m + 1):
        if i:
            new_low, new_high = max(0, -((most - i * n) // m)), min(n, (i * n + most) // m)
            left = np.arange(low, min(new_low, low + len(row)))  # these leave with the step to row i
            if len(left):
                with np.errstate(divide="ignore"):
                    out += np.exp(np.log(row[: len(left)]) + scale + ways(m - i, n - left) - total).sum()
            inside = np.zeros(max(0, new_high - new_low + 1))
            kept = row[new_low - low :][: len(inside)]
            inside[: len(kept)] = kept
            row, low = np.cumsum(inside), new_low
            if not len(row) or not row[-1]:  # no path has stayed inside
                break
            scale += np.log(row[-1])
            row /= row[-1]
        high = low + len(row) - 1
        if high < n:  # the step along the row to high + 1 leaves
            out += np.exp(np.log(row[-1]) + scale + ways(m - i, n - high - 1) - total)
    return float(min(1.0, out))


def ks_p_value(ks: Column, n1: Column, n0: Column) -> Column:
    """The exact p-value of a Kolmogorov-Smirnov gap, vectorised over features; null where a class has over EXACT_KS rows or none."""

    @F.pandas_udf("double")
    def p(gap: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        known = (a > 0) & (b > 0) & (np.maximum(a, b) <= EXACT_KS) & gap.notna()
        return pd.Series([exact_ks_p(*x) if ok else None for ok, x in zip(known, zip(gap, a, b, strict=True), strict=True)], dtype=float)

    return p(ks, n1, n0)


def average_precision(rows: DataFrame, keys: list[str], value: str = "v", label: str = "y") -> DataFrame:
    """Per key: step-wise average precision, prevalence and their ratio."""
    counts = value_counts(rows, keys, value, label).withColumn("__value", F.col(value))
    run = running_sums(counts, keys, "__value", {"tp": "pos", "fp": "neg"}, descending=True)
    step = F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")) * F.col("pos")
    found = run.groupBy(*keys).agg(F.sum(step).alias("s"), F.sum("pos").alias("n1"), F.sum("neg").alias("n0"))
    prevalence = F.try_divide(F.col("n1").cast("double"), (F.col("n1") + F.col("n0")).cast("double"))
    ap = F.try_divide(F.col("s"), F.col("n1").cast("double"))
    return found.select(*keys, ap.alias("average_precision"), prevalence.alias("prevalence"), F.try_divide(ap, prevalence).alias("ap_over_baseline"))


def confusion_metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Metrics of confusion counts; null where a divisor is 0."""
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    div = F.try_divide
    sens, spec = div(tp, tp + fn), div(tn, tn + fp)
    return {
        "accuracy": div(tp + tn, tp + fp + fn + tn), "balanced_accuracy": (sens + spec) / 2.0, "sensitivity": sens, "specificity": spec, "ppv": div(tp, tp + fp), "npv": div(tn, tn + fn),
        "f1": div(2.0 * tp, 2.0 * tp + fp + fn), "mcc": div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), "youden": sens + spec - 1.0,
    }


def relevance(tested: DataFrame, alpha: float = 0.05, least_delta: float = 0.2, least_auc: float = 0.6) -> DataFrame:
    """tested (auc, cliffs_delta, q) with significant (q <= alpha), practical (|delta| or oriented AUC large enough) and relevant (both)."""
    practical = (F.abs("cliffs_delta") >= least_delta) | (F.greatest(F.col("auc"), 1.0 - F.col("auc")) >= least_auc)
    flagged = tested.withColumn("significant", F.coalesce(F.col("q") <= alpha, F.lit(False))).withColumn("practical", F.coalesce(practical, F.lit(False)))
    return flagged.withColumn("relevant", F.col("significant") & F.col("practical"))


def replication(flagged: DataFrame, keys: tuple[str, ...] = ("feature",), train: str = "train") -> DataFrame:
    """Train and test rows of relevance() side by side, one a key each: flags of what holds in both, and changes of the effect."""
    side = lambda own, name: flagged.filter(own).select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in ("auc", "cliffs_delta", "significant", "practical")])
    both = side(F.col(train), "train").join(side(~F.col(train), "test"), list(keys))
    of = lambda c: (F.col(f"train_{c}"), F.col(f"test_{c}"))
    (a, b), (d, e) = of("auc"), of("cliffs_delta")
    both = both.withColumn("same_direction", F.signum(d) == F.signum(e)).withColumn("both_significant", of("significant")[0] & of("significant")[1]).withColumn("both_practical", of("practical")[0] & of("practical")[1])
    both = both.withColumn("fully_replicated", F.col("both_significant") & F.col("both_practical") & F.col("same_direction"))
    return both.withColumn("auc_change", F.abs(a - b)).withColumn("delta_change", F.abs(F.abs(d) - F.abs(e)))


def stability(pairs: DataFrame, family: str, x: str, y: str, least: int = 3) -> DataFrame:
    """Per family of features: Pearson and Spearman correlation of two effects, null for fewer than least features."""
    tied = lambda c: F.rank().over(Window.partitionBy(family).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(family, c)) - 1) / 2.0
    found = pairs.select(family, x, y, tied(x).alias("__rx"), tied(y).alias("__ry")).groupBy(family).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("pearson"), F.corr("__rx", "__ry").alias("spearman"))
    return found.select(family, "n", *[F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("pearson", "spearman")])
