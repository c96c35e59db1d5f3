"""Running totals, ranks and top rows that don't need one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialise

#: Rows of a key that one task sorts; a key with more is dealt by ranges of its values.
ONE_TASK = 1 << 20


def running_sums(df: DataFrame, keys: list[str], order: str, sums: dict[str, str], descending: bool = False, minima: dict[str, str] | None = None) -> DataFrame:
    """df with the inclusive running sum (and for minima the running minimum) of each column (alias: column) over order within keys.

    order is unique within a key. df is written down first. If no key has over ONE_TASK rows,
    a window over the keys does it. Else rows are dealt by ranges of keys and order, which
    Spark samples; a task sums one range, to which the totals of its key's ranges before are
    added. There are no more totals than ranges and keys together.
    """
    minima = minima or {}
    df = materialise(df, "ordered")
    by = F.col(order).desc() if descending else F.col(order).asc()
    running = lambda over: {a: F.sum(c).over(over) for a, c in sums.items()} | {a: F.min(c).over(over) for a, c in minima.items()}
    upto = (Window.unboundedPreceding, 0)
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if (largest or 0) <= ONE_TASK:
        return df.withColumns(running(Window.partitionBy(*keys).orderBy(by).rowsBetween(*upto)))
    rows = materialise(df.repartitionByRange(*[F.col(k).asc() for k in keys], by).withColumn("__range", F.spark_partition_id()), "ranges")
    at = [*keys, "__range"]
    total = lambda a, c: F.min(c).alias(f"__t_{a}") if a in minima else F.sum(c).alias(f"__t_{a}")
    totals = rows.groupBy(*at).agg(*[total(a, c) for a, c in (sums | minima).items()])
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(f"__t_{a}").over(before).alias(f"__b_{a}") for a in sums] + [F.min(f"__t_{a}").over(before).alias(f"__b_{a}") for a in minima]
    totals = totals.select(*at, *carried)
    rows = rows.withColumns(running(Window.partitionBy(*at).orderBy(by).rowsBetween(*upto))).join(totals, at)
    rows = rows.withColumns({a: F.col(a) + F.coalesce(f"__b_{a}", F.lit(0)) for a in sums} | {a: F.least(a, f"__b_{a}") for a in minima})
    return rows.drop("__range", *[f"__b_{a}" for a in (*sums, *minima)])


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key; the limit is pushed below the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_key(df, keys, order, 1, "__rank").drop("__rank")


def score_ranks(df: DataFrame, score: str, alias: str = "rank") -> DataFrame:
    """df with rank 1 for the highest score and the least rank for equals, by way of the distinct scores."""
    counts = df.groupBy(score).agg(F.count(F.lit(1)).alias("__n"))
    ranks = running_sums(counts, [], score, {"__below": "__n"}, descending=True)
    ranks = ranks.select(score, (F.col("__below") - F.col("__n") + 1).cast("long").alias(alias))
    return df.join(ranks, score)


def benjamini_hochberg(df: DataFrame, p: str, alias: str = "q_value") -> DataFrame:
    """df with adjusted p-values; null p-values have none and don't count.

    df is written down: its p-values meet their adjusted ones by equality, and sums of doubles
    that are taken again may differ in their last bit.
    """
    df = materialise(df, "tested")
    counts = df.filter(F.col(p).isNotNull()).groupBy(p).agg(F.count(F.lit(1)).alias("__n"))
    ranked = running_sums(counts, [], p, {"__i": "__n"})
    total = counts.agg(F.sum("__n").alias("__m"))
    raw = ranked.join(F.broadcast(total)).select(p, (F.col(p) * F.col("__m") / F.col("__i")).alias("__raw"))
    adjusted = running_sums(raw, [], p, {}, descending=True, minima={"__q": "__raw"})
    return df.join(adjusted.select(p, F.least(F.lit(1.0), F.col("__q")).alias(alias)), p, "left")


def quantiles(df: DataFrame, keys: list[str], value: str, at: list[float]) -> DataFrame:
    """(*keys, q) with q the exact quantiles of value, linear between neighbours, as one array.

    They are found among the distinct values with their counts, of which a task sorts a
    range, so that no buffer holds a key's values; nulls don't count.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    named = counts.withColumn("__v", F.col(value).cast("double")).select(*keys, "__v", "__n", F.col("__v").alias("__order"))
    ranked = running_sums(named, keys, "__order", {"__up": "__n"})
    total = named.groupBy(*keys).agg(F.sum("__n").alias("__t"))
    joined = ranked.join(total, keys) if keys else ranked.join(F.broadcast(total))
    # Rows have places __up - __n to __up - 1; a quantile lies between the rows at the floor and the ceiling of its place.
    low = lambda q: F.floor(F.lit(q) * (F.col("__t") - 1))
    inside = lambda place: (F.col("__up") - F.col("__n") <= place) & (place < F.col("__up"))
    ends = [c for i, q in enumerate(at) for c in (F.max(F.when(inside(low(q)), F.col("__v"))).alias(f"__l{i}"), F.max(F.when(inside(F.least(low(q) + 1, F.col("__t") - 1)), F.col("__v"))).alias(f"__h{i}"))]
    found = joined.groupBy(*keys).agg(F.max("__t").alias("__t"), *ends)
    part = lambda q: F.lit(q) * (F.col("__t") - 1) - low(q)
    return found.select(*keys, F.array(*[F.col(f"__l{i}") + (F.col(f"__h{i}") - F.col(f"__l{i}")) * part(q) for i, q in enumerate(at)]).alias("q"))
