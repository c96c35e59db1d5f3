"""Bootstrap and permutation of rank statistics, drawn by splitting: first over ranges of values, then inside each.

A resample is known by how many rows it has at each distinct value. Those counts are drawn
down a tree of value ranges with FAN children each: a multinomial (for the bootstrap of each
class) or a multivariate hypergeometric (for the permutation of labels) of a node's count
over its children has the same distribution as one draw over all values. A node's counts, and
those below it, are one row, so a task handles one node whatever the number of values.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordered import running_sums
from tessera.operators.stats import LEAST_CLASS, value_counts

#: Children of a node of the tree of value ranges.
FAN = 1024
#: Replicates that are drawn at once.
_AT_ONCE = 128

#: Of each replicate: counts drawn in a node and below it, for the positives, the negatives and the permuted positives.
_STATE = ("x", "y", "h", "x_below", "y_below", "h_below")


def _draw(rng: np.random.Generator, state: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    """State (6, replicates) of a node dealt to its children: (6, replicates, children)."""
    x, y, h = (
        rng.multinomial(state[0], pos / max(pos.sum(), 1)) if pos.sum() else np.zeros((state.shape[1], len(pos)), np.int64),
        rng.multinomial(state[1], neg / max(neg.sum(), 1)) if neg.sum() else np.zeros((state.shape[1], len(neg)), np.int64),
        np.stack([rng.multivariate_hypergeometric(pos + neg, n, method="marginals") for n in state[2]]),
    )
    below = [np.cumsum(d, axis=1) - d + b[:, None] for d, b in zip((x, y, h), state[3:], strict=True)]
    return np.stack((x, y, h, *below))


def _generator(seed: int, key: object, level: int, node: int) -> np.random.Generator:
    return np.random.default_rng([seed, level, node, *str(key).encode()])


def _split(children: pd.DataFrame, states: pd.DataFrame, key: str, seed: int, level: int) -> pd.DataFrame:
    """The states of a node's children."""
    if not len(children) or not len(states):
        return pd.DataFrame({key: pd.Series(dtype=object), "node": pd.Series(dtype="int64"), "state": pd.Series(dtype=object)})
    children = children.sort_values("child")
    name, node = states[key].iloc[0], int(states["node"].iloc[0])
    state = np.frombuffer(states["state"].iloc[0], np.int64).reshape(6, -1)
    rng, pos, neg = _generator(seed, name, level, node), children["pos"].to_numpy(np.int64), children["neg"].to_numpy(np.int64)
    dealt = np.concatenate([_draw(rng, state[:, i : i + _AT_ONCE], pos, neg) for i in range(0, state.shape[1], _AT_ONCE)], axis=1)
    return pd.DataFrame({key: name, "node": children["child"].to_numpy(np.int64), "state": [np.ascontiguousarray(dealt[:, :, i]).tobytes() for i in range(len(children))]})


def _measure(values: pd.DataFrame, states: pd.DataFrame, key: str, seed: int) -> pd.DataFrame:
    """What a range of values adds to each replicate: wins of positives, summed precision, wins of permuted positives."""
    if not len(values) or not len(states):
        return pd.DataFrame({key: pd.Series(dtype=object), "wins": pd.Series(dtype=object), "precision": pd.Series(dtype=object), "null_wins": pd.Series(dtype=object)})
    values = values.sort_values("child")
    name, node = states[key].iloc[0], int(states["node"].iloc[0])
    state, n1, n0 = np.frombuffer(states["state"].iloc[0], np.int64).reshape(6, -1), int(values["n1"].iloc[0]), int(values["n0"].iloc[0])
    pos, neg, below = (values[c].to_numpy(np.int64) for c in ("pos", "neg", "all_below"))
    rng, parts = _generator(seed, name, 1, node), []
    for i in range(0, state.shape[1], _AT_ONCE):
        x, y, h, x_below, y_below, h_below = _draw(rng, state[:, i : i + _AT_ONCE], pos, neg)
        wins = (x * (y_below + y / 2)).sum(1)
        above = n1 - x_below  # drawn positives at this value or above it
        precision = (x * np.divide(above, above + n0 - y_below, out=np.zeros(x.shape), where=x > 0)).sum(1)
        null = (h * (below - h_below + (pos + neg - h) / 2)).sum(1)
        parts.append((wins, precision, null))
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    return pd.DataFrame({key: [name], **{n: [c] for n, c in zip(("wins", "precision", "null_wins"), columns, strict=True)}})


def _observed(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Values (key, v, pos, neg, place, all_below, n1, n0) in the orientation in which positives are higher, and each key's n1, n0, u, ap and n_values."""
    counts = value_counts(rows, [key]).withColumn("one", F.lit(1)).withColumn("at", F.col("v"))
    run = running_sums(counts, [key], "at", {"cp": "pos", "cn": "neg", "place": "one"})
    total = counts.groupBy(key).agg(F.sum("pos").alias("n1"), F.sum("neg").alias("n0"), F.count(F.lit(1)).alias("n_values"))
    joined = run.join(total, key)
    u = F.sum(F.col("pos") * (F.col("cn") - F.col("neg") / 2.0))
    step = lambda tp, fp: F.sum(F.try_divide(tp.cast("double"), (tp + fp).cast("double")) * F.col("pos"))
    up = step(F.col("n1") - F.col("cp") + F.col("pos"), F.col("n0") - F.col("cn") + F.col("neg"))
    known = joined.groupBy(key, "n1", "n0", "n_values").agg(u.alias("u"), up.alias("ap_up"), step(F.col("cp"), F.col("cn")).alias("ap_down"))
    flip = F.col("u") < F.col("n1").cast("double") * F.col("n0") / 2.0
    known = known.withColumn("flip", flip).withColumn("u", F.when(flip, F.col("n1").cast("double") * F.col("n0") - F.col("u")).otherwise(F.col("u")))
    known = known.withColumn("ap", F.try_divide(F.when(F.col("flip"), F.col("ap_down")).otherwise(F.col("ap_up")), F.col("n1").cast("double"))).drop("ap_up", "ap_down")
    all_ = F.col("cp") + F.col("cn")
    own = F.when(F.col("flip"), F.col("n1") + F.col("n0") - all_).otherwise(all_ - F.col("pos") - F.col("neg"))
    place = F.when(F.col("flip"), F.col("n_values") - F.col("place")).otherwise(F.col("place") - 1)
    tested = known.filter(F.least("n1", "n0") >= LEAST_CLASS).select(key, "flip")
    return joined.join(tested, key).select(key, "pos", "neg", place.cast("long").alias("place"), own.alias("all_below"), "n1", "n0"), known


def resampled(rows: DataFrame, key: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Per feature (key) of long rows (key, v, y): AUC, Cliff's delta and average precision, each with its stratified bootstrap interval
    (2.5 and 97.5 percent), and of the label permutation the p-value and the null's mean and deviation.

    Values are oriented so that AUC is at least 0.5 on all rows. A feature with a class
    below LEAST_CLASS has nulls. Draws depend on seed, feature and range alone, so reruns
    agree. No task has more than FAN values or ranges of a feature.
    """
    values, known = _observed(rows, key)
    most = known.agg(F.max("n_values")).first()[0] or 1
    levels = max(1, math.ceil(math.log(most, FAN) - 1e-9))
    start = known.filter(F.least("n1", "n0") >= LEAST_CLASS)
    fill = lambda pdf: pd.DataFrame({key: pdf[key], "node": 0, "state": [np.repeat(np.array([a, b, a, 0, 0, 0], np.int64), replicates).tobytes() for a, b in zip(pdf["n1"], pdf["n0"], strict=True)]})
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, node long, state binary"
    states = start.select(key, "n1", "n0").mapInPandas(lambda it: map(fill, it), schema)
    splitter = lambda level: lambda a, b: _split(a, b, key, seed, level)
    at = lambda level: F.expr(f"place div {FAN**level}")
    for level in range(levels, 1, -1):
        children = values.groupBy(key, at(level - 1).alias("child"), at(level).alias("node")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        states = children.groupBy(key, "node").cogroup(states.groupBy(key, "node")).applyInPandas(splitter(level), schema)
    leaves = values.select(key, at(1).alias("node"), F.col("place").alias("child"), "pos", "neg", "all_below", "n1", "n0")
    parts = leaves.groupBy(key, "node").cogroup(states.groupBy(key, "node")).applyInPandas(lambda a, b: _measure(a, b, key, seed), f"`{key}` {kind}, wins array<double>, precision array<double>, null_wins array<double>")
    each = parts.select(key, F.posexplode(F.arrays_zip("wins", "precision", "null_wins")).alias("replicate", "m"))
    sums = each.groupBy(key, "replicate").agg(F.sum("m.wins").alias("wins"), F.sum("m.precision").alias("precision"), F.sum("m.null_wins").alias("null_wins"))
    pairs = F.col("n1").cast("double") * F.col("n0")
    drawn = sums.join(known, key).select(key, "u", pairs.alias("pairs"), (F.col("wins") / pairs).alias("auc"), (F.col("precision") / F.col("n1")).alias("ap"), "null_wins")
    extreme = F.abs(2 * F.col("null_wins") - F.col("pairs")) >= F.abs(2 * F.col("u") - F.col("pairs"))
    null = F.col("null_wins") / F.col("pairs")
    low, high = lambda c: F.percentile(c, F.lit(0.025)), lambda c: F.percentile(c, F.lit(0.975))
    found = drawn.groupBy(key).agg(low("auc").alias("auc_low"), high("auc").alias("auc_high"), low("ap").alias("ap_low"), high("ap").alias("ap_high"), F.count_if(extreme).alias("extreme"), F.avg(null).alias("null_mean"), F.stddev_samp(null).alias("null_sd"))
    auc = F.when(F.least("n1", "n0") >= LEAST_CLASS, F.col("u") / pairs)
    out = known.select(key, auc.alias("auc"), F.when(auc.isNotNull(), F.col("ap")).alias("ap")).join(found, key, "left")
    of_delta = lambda c: 2 * F.col(c) - 1
    return out.select(key, "auc", "auc_low", "auc_high", of_delta("auc").alias("delta"), of_delta("auc_low").alias("delta_low"), of_delta("auc_high").alias("delta_high"), "ap", "ap_low", "ap_high", ((F.col("extreme") + 1) / (replicates + 1)).alias("permutation_p"), "null_mean", "null_sd")


def null_moments(rows: DataFrame, key: str) -> DataFrame:
    """Per key: mean and deviation of the AUC under permutation of the labels, in closed form with ties; null where a class is empty."""
    t = F.col("pos") + F.col("neg")
    found = value_counts(rows, [key]).groupBy(key).agg(F.sum("pos").cast("double").alias("n1"), F.sum("neg").cast("double").alias("n0"), F.sum(t.cast("double") * t * t - t).alias("ties"))
    n = F.col("n1") + F.col("n0")
    variance = F.try_divide(n + 1 - F.try_divide(F.col("ties"), n * (n - 1)), 12 * F.col("n1") * F.col("n0"))
    return found.select(key, F.when(variance.isNotNull(), 0.5).alias("mean"), F.sqrt(variance).alias("sd"))
