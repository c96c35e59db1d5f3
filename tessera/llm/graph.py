"""Connected components by alternating large-star and small-star steps, and joins that spread hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.plan import materialise

#: A key with more than this share of all rows, and more rows than LEAST_HOT, is hot: there can't be more than 1 / HOT_SHARE.
HOT_SHARE, LEAST_HOT = 1 / 1000, 1_000


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], times: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) to table, which has one row a key and in times the rows of that key.

    A hot key's rows stay where they are and meet its row of table by a broadcast, whose
    number of rows has a bound (1 / HOT_SHARE); only the other keys are dealt by key. total
    is the number of rows, or more.
    """
    least = max(LEAST_HOT, int(total * HOT_SHARE))
    if total <= least:  # no key can be hot
        return rows.join(table.drop(times), keys, how)
    hot, rest = table.filter(F.col(times) > least).drop(times), table.filter(F.col(times) <= least).drop(times)
    far = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(far.join(rest, keys, how))


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return int(row[0]), int(row[1] or 0)


def _star(pairs: DataFrame, large: bool, total: int) -> DataFrame:
    """pairs (u, v): every neighbour v of u is joined to the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("times")).withColumn("m", F.least("u", "m"))
    joined = spread_join(pairs, least, ["u"], "times", total)
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the least node it reaches.

    Nodes are longs. Self-loops, repeated and reversed edges, and an empty table are
    allowed. Each step aggregates before it shuffles, and a hub's edges are not brought
    together: its least neighbour goes to them.
    """
    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    before = _fingerprint(edges)
    for _ in range(limit):
        if not before[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        turned = materialise(_star(both, True, 2 * before[0]), "large")
        edges = materialise(_star(turned, False, 2 * before[0]), "small")
        now = _fingerprint(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {limit} steps")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
