"""Input contracts and the quality ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import finite
from tessera.operators.ordered import first_per_key


class ContractError(ValueError):
    """A table does not keep what is required of it."""


def missing_columns(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c not in df.columns]


def require_columns(df: DataFrame, columns: list[str], table: str = "table") -> DataFrame:
    missing = missing_columns(df, columns)
    if missing:
        raise ContractError(f"{table} lacks {', '.join(missing)}")
    return df


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def priority_columns(df: DataFrame, first: list[str]) -> DataFrame:
    """The named columns that there are first, the others after them in their order."""
    known = [c for c in first if c in df.columns]
    return df.select(*known, *[c for c in df.columns if c not in known])


def predictors(df: DataFrame, excluded: list[str]) -> list[str]:
    """Numeric columns that are not excluded by name, in any case."""
    barred = {c.lower() for c in excluded}
    return [c for c, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") and c.lower() not in barred]


def usable_predictors(df: DataFrame, excluded: list[str]) -> list[str]:
    """Of predictors() those with a finite value, by one aggregation."""
    columns = predictors(df, excluded)
    some = df.agg(*[F.bool_or(finite(F.col(c)).isNotNull()).alias(c) for c in columns]).first() if columns else {}
    return [c for c in columns if some[c]]


def find_column(columns: list[str], candidates: list[str], required: bool = True) -> str | None:
    """The first candidate among the columns as it is, else in any case, else by containing its words."""
    for test in (lambda c, w: c == w, lambda c, w: c.lower() == w.lower(), lambda c, w: all(x in c.lower() for x in w.lower().replace("_", " ").split())):
        for wanted in candidates:
            for c in columns:
                if test(c.strip(), wanted):
                    return c
    if required:
        raise ContractError(f"none of {candidates} among {columns}")
    return None


def subset(df: DataFrame, manifest: list[str]) -> DataFrame:
    """The columns of an ordered manifest, all of which must be there."""
    return require_columns(df, manifest).select(*manifest)


def same_order(found: list[str], locked: list[str]) -> None:
    if list(found) != list(locked):
        raise ContractError(f"columns are not the locked ones in their order: {[c for c in locked if c not in found] or 'order'}")


def schema_differences(df: DataFrame, locked: dict[str, str]) -> DataFrame:
    """(column, expected, state): OK, MISSING or TYPE for each locked column, EXTRA for others; a row a column."""
    found = dict(df.dtypes)
    rows = [(c, kind, "MISSING" if c not in found else "OK" if found[c] == kind else "TYPE") for c, kind in locked.items()]
    rows += [(c, None, "EXTRA") for c in found if c not in locked]
    return df.sparkSession.createDataFrame(rows, "column string, expected string, state string")


def split(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that are valid, and the others (false or null)."""
    flag = F.coalesce(valid, F.lit(False))
    return df.filter(flag), df.filter(~flag)


def _demand(rows: DataFrame, message: str) -> None:
    """Raises if there is a row."""
    first = rows.take(1)
    if first:
        raise ContractError(f"{message}: {first[0].asDict()}")


def require_unique(df: DataFrame, keys: list[str], table: str = "table") -> DataFrame:
    _demand(repeats(df, keys), f"{table} repeats {', '.join(keys)}")
    return df


def join_many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join to a right side whose keys are unique, which is checked; so left's rows stay as many as they are."""
    return left.join(require_unique(right, keys, "the right side"), keys, "left")


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A join of sides that have the same keys, each once, which is checked."""
    require_unique(left, keys, "the left side")
    require_unique(right, keys, "the right side")
    _demand(left.join(right, keys, "left_anti").select(*keys), "the right side lacks a key")
    _demand(right.join(left, keys, "left_anti").select(*keys), "the left side lacks a key")
    return left.join(right, keys)


def join_guarded(left: DataFrame, right: DataFrame, keys: list[str], least_share: float = 1.0) -> DataFrame:
    """An inner join of unique keys that keeps at least that share of left's rows, which is checked."""
    require_unique(left, keys, "the left side")
    require_unique(right, keys, "the right side")
    joined = left.join(right, keys)
    kept, all_ = joined.count(), left.count()
    if kept < least_share * all_:
        raise ContractError(f"the join keeps {kept} of {all_} rows")
    return joined


def join_last(left: DataFrame, right: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """A left join to the first row of each key of right in an order."""
    return left.join(first_per_key(right, keys, order), keys, "left")


def clipped(df: DataFrame, column: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Rows whose finite value lies between low and high, sorted by it."""
    return df.filter(finite(F.col(column)).between(low, high)).orderBy(column)


def sorted_head(df: DataFrame, order: dict[str, str], n: int) -> DataFrame:
    """The first n rows by columns of either direction (asc, desc), NaN and nulls last, with rank; each task sends n rows at most."""
    last = lambda c, d: (F.col(c).asc_nulls_last() if d == "asc" else F.col(c).desc_nulls_last())
    floats = {c for c, kind in df.dtypes if kind in ("double", "float")}
    named = df.withColumns({f"__o_{c}": F.nanvl(F.col(c), F.lit(None)) if c in floats else F.col(c) for c in order})
    keys = [last(f"__o_{c}", d) for c, d in order.items()]
    head = named.orderBy(*keys).limit(n)
    return head.withColumn("rank", F.row_number().over(Window.orderBy(*keys)).cast("long")).drop(*[f"__o_{c}" for c in order])


def check(section: str, name: str, observed: DataFrame, expected: str = "0") -> DataFrame:
    """A ledger row (section, check, observed, expected, status) from a one-row, one-column frame."""
    value = F.col(observed.columns[0]).cast("string")
    return observed.select(F.lit(section).alias("section"), F.lit(name).alias("check"), F.coalesce(value, F.lit("")).alias("observed"), F.lit(expected).alias("expected"), F.when(value == expected, "PASS").otherwise("FAIL").alias("status"))


def ledger(rows: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


def enforce(rows: DataFrame) -> DataFrame:
    """Raises if any check has failed; a ledger is a row a check."""
    failed = [r["check"] for r in rows.filter("status = 'FAIL'").collect()]
    if failed:
        raise ContractError(f"failed: {', '.join(failed)}")
    return rows


def repeats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows and of extra ones."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1").withColumn("extra_rows", F.col("group_size") - 1)


def not_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many keys break uniqueness."""
    return repeats(df, keys).agg(F.count(F.lit(1)).alias("n"))


def id_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids that only one side has."""
    one, two = left.select(key).distinct(), right.select(key).distinct()
    return one.join(two, key, "left_anti").withColumn("side", F.lit("left_only")).unionByName(two.join(one, key, "left_anti").withColumn("side", F.lit("right_only")))


def gate(rows: DataFrame) -> DataFrame:
    """The verdict over a ledger: FAIL, PASS_WITH_REVIEW or PASS, with counts."""
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s.lower()}")
    return rows.agg(n("PASS"), n("REVIEW"), n("FAIL")).withColumn("verdict", F.when(F.col("n_fail") > 0, "FAIL").when(F.col("n_review") > 0, "PASS_WITH_REVIEW").otherwise("PASS"))
