"""Registration of queries: a function over the tables, and its SQL counterpart if it has one."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import plain_unions, small_splits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None) -> Callable:
    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name or f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return add


#: The same surrogates in SQL.
ASSOC = "(SELECT l_orderkey AS np_id, l_partkey AS target_id, l_suppkey AS reference_id, l_returnflag AS activity_type, l_linestatus AS relation, l_quantity AS activity_value FROM lineitem)"
TARGETS = "(SELECT p_partkey AS target_id, p_name AS target_name, p_brand AS level1, p_type AS level2, p_size AS level3 FROM part WHERE p_partkey % 3 <> 0)"
TRAIN = "((o_orderkey * 2654435761) % 1000003 % 5 <> 0)"
PREDICTIONS = "(SELECT l_orderkey * 8 + l_linenumber AS row_id, l_suppkey, l_partkey, round(l_discount * 8 + l_tax, 6) AS p, CAST(l_quantity > 25 AS INTEGER) AS y FROM lineitem)"
FEATURES = ("quantity", "price", "discount", "tax")
LONG = "(SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({c} AS DOUBLE) AS v, CAST(l_returnflag = 'R' AS INTEGER) AS y, l_shipdate >= TIMESTAMP '1996-01-01' AS train FROM lineitem" for f, c in zip(FEATURES, ("l_quantity", "round(l_extendedprice, 0)", "l_discount", "l_tax"), strict=True)) + ") AS u)"
NEIGHBOURS = """(SELECT query_id, neighbour_id, sim, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, neighbour_id) AS rank FROM (
    SELECT q.vec_id AS query_id, r.vec_id AS neighbour_id,
           round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(r.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])))), 6) AS sim
    FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0) AS s) AS k WHERE rank <= 20)"""


class Tables:
    """The tables of a folder, and stand-ins of the domain's tables made from them.

    Molecules are orders, targets the parts whose key 3 does not divide (so that some
    associations stay unmapped), associations line items.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = small_splits(plain_unions(spark)), sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def molecules(self) -> DataFrame:
        return self.read("orders").withColumnRenamed("o_orderkey", "np_id")

    @cached_property
    def associations(self) -> DataFrame:
        return self.read("lineitem").select(F.col("l_orderkey").alias("np_id"), F.col("l_partkey").alias("target_id"), F.col("l_suppkey").alias("reference_id"), F.col("l_returnflag").alias("activity_type"), F.col("l_linestatus").alias("relation"), F.col("l_quantity").alias("activity_value"))

    @cached_property
    def targets(self) -> DataFrame:
        return self.read("part").filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("target_id"), F.col("p_name").alias("target_name"), F.col("p_brand").alias("level1"), F.col("p_type").alias("level2"), F.col("p_size").alias("level3"))

    @cached_property
    def pairs(self) -> DataFrame:
        """Distinct molecule-target pairs and whether the target is known."""
        known = self.targets.select("target_id", F.lit(True).alias("mapped"))
        return self.associations.select("np_id", "target_id").distinct().join(known, "target_id", "left").select("np_id", "target_id", F.coalesce("mapped", F.lit(False)).alias("mapped"))

    @cached_property
    def predictions(self) -> DataFrame:
        return self.read("lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), "l_suppkey", "l_partkey", F.round(F.col("l_discount") * 8 + F.col("l_tax"), 6).alias("p"), (F.col("l_quantity") > 25).cast("int").alias("y"))

    @cached_property
    def wide_features(self) -> DataFrame:
        """y, train and a column a feature."""
        return self.read("lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp")).alias("train"), F.col("l_quantity").alias("quantity"), F.round("l_extendedprice", 0).alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_linenumber").alias("line"))

    @cached_property
    def features(self) -> DataFrame:
        """Long form: feature, v, y, train."""
        return self.wide_features.unpivot(["y", "train"], list(FEATURES), "feature", "v")

    @cached_property
    def line_features(self) -> DataFrame:
        """Long form with a feature a line number."""
        return self.wide_features.unpivot(["y", "train", "line"], list(FEATURES), "feature", "v").withColumn("feature", F.concat_ws("_", "feature", "line")).drop("line")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.read("embeddings")
