"""Places in a total order and totals of the rows before, with DataFrame operations and no task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.plan import materialise

#: Bits of monotonically_increasing_id() that count within a partition.
_WITHIN = 33


def numbered(df: DataFrame, order: list[Column], alias: str) -> DataFrame:
    """df, written down, with each row's place from 0 in the order, which has to be total for a place to be the row's own.

    The sort deals rows by ranges; places are the rows of the partitions before plus the
    place in the partition, so what is broadcast is a row a partition.
    """
    placed = materialise(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), alias)
    placed = placed.withColumn("__part", F.shiftright("__at", _WITHIN))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.col("__before") + F.col("__at").bitwiseAND((1 << _WITHIN) - 1)
    return placed.join(F.broadcast(parts), "__part").withColumn(alias, place).drop("__part", "__at", "__before")


def totals_before(rows: DataFrame, keys: list[str], step: str, order: list[str], sums: dict[str, str]) -> DataFrame:
    """rows with the totals (alias: column) of the rows before each, within keys, in the order of step and then order.

    A task sorts the rows of one step; a key's steps alone meet in one task. step and keys
    are not null, and step grows with the order.
    """
    steps = rows.groupBy(*keys, step).agg(*[F.sum(c).alias(f"__s_{a}") for a, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select(*keys, step, *[F.coalesce(F.sum(f"__s_{a}").over(before), F.lit(0)).alias(f"__b_{a}") for a in sums])
    within = Window.partitionBy(*keys, step).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({a: F.coalesce(F.sum(c).over(within), F.lit(0)) for a, c in sums.items()}).join(steps, [*keys, step])
    return rows.withColumns({a: F.col(a) + F.col(f"__b_{a}") for a in sums}).drop(*[f"__b_{a}" for a in sums])
