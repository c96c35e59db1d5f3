"""Types of columns found from their texts, in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import null_normalised

#: Kinds of a text, each a bit: what a column holds is the union over its rows, which merges in any order.
KINDS = ("boolean", "long", "double", "timestamp", "string")
_BIT = {kind: 1 << i for i, kind in enumerate(KINDS)}


def kind_bit(text: Column) -> Column:
    """The bit of a text's kind; 0 for a missing value. Integers beyond 64 bits are doubles."""
    number = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(inf|Infinity|NaN)$")
    whole = text.rlike(r"^[+-]?\d+$") & text.try_cast("long").isNotNull()
    moment = text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}") & text.try_cast("timestamp").isNotNull()
    return F.when(text.isNull(), 0).when(F.lower(text).isin("true", "false"), _BIT["boolean"]).when(whole, _BIT["long"]).when(number, _BIT["double"]).when(moment, _BIT["timestamp"]).otherwise(_BIT["string"])


def kind_of(bits: int) -> str:
    """The least type that holds all kinds of a column."""
    for kind in ("boolean", "long", "timestamp"):
        if bits == _BIT[kind]:
            return kind
    if bits and bits | _BIT["long"] == _BIT["long"] | _BIT["double"]:
        return "double"
    return "string"


def inferred_types(texts: DataFrame) -> dict[str, str]:
    """The type of each column of texts, by one aggregation; a column without a value is a string. A row with a number a column comes to the driver."""
    if not texts.columns:
        return {}
    seen = texts.agg(*[F.bit_or(kind_bit(null_normalised(F.col(f"`{c}`")))).alias(f"k{i}") for i, c in enumerate(texts.columns)]).first()
    return {c: kind_of(seen[i] or 0) for i, c in enumerate(texts.columns)}


def conflicts(texts: DataFrame, columns: list[str]) -> DataFrame:
    """(column, kind, n, example): how many values of each kind a column holds, and the least; for columns whose type is not clear."""
    long = texts.select(*[F.struct(F.lit(c).alias("column"), null_normalised(F.col(f"`{c}`")).alias("text")).alias(f"k{i}") for i, c in enumerate(columns)])
    each = long.select(F.explode(F.array(*long.columns)).alias("v")).select("v.column", "v.text").filter("text IS NOT NULL")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.log2(kind_bit(F.col("text"))) + 1).cast("int"))
    return each.groupBy("column", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("example"))


def typed(texts: DataFrame, types: dict[str, str]) -> DataFrame:
    """texts with each column as its type, missing values null."""
    return texts.select(*[null_normalised(F.col(f"`{c}`")).cast(types[c]).alias(c) for c in texts.columns])


def read_inferred(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A separated file with a header, its columns typed by all of their values. The scan for types runs at once."""
    texts = spark.read.csv(path, sep=sep, header=True, inferSchema=False)
    return typed(texts, inferred_types(texts))
