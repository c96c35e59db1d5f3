"""Classifiers, calibration and evaluation over pyspark.ml."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import extra_trees, features, random_forest, stats
from tessera.operators.contracts import ContractError, require_columns
from tessera.session import materialise

#: Fixed value: the decision threshold on calibrated probabilities.
LOCKED_THRESHOLD = 0.046126477738876355


#: Rows of a training table to a partition, where there are more partitions than cores: every iteration of a fit sends a result and a record of its task from each to the driver.
FIT_ROWS = 500_000


def compact(df: DataFrame, name: str) -> DataFrame:
    """df, written down and read again in as many partitions as there are cores or FIT_ROWS of rows, whichever is more."""
    rows = materialise(df, name)
    return rows.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // FIT_ROWS)))


def balanced(df: DataFrame, label: str = "y") -> DataFrame:
    """df with weight: rows over twice the rows of the class."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    total = sizes.agg(F.sum("__n").alias("__t"), F.count(F.lit(1)).alias("__k"))
    weights = sizes.join(F.broadcast(total)).select(label, (F.col("__t") / (F.col("__k") * F.col("__n"))).alias("weight"))
    return df.join(F.broadcast(weights), label)


def pipeline(columns: list[str], penalty: float = 0.0) -> Pipeline:
    """Logistic regression (scaled, with an L2 penalty), weighted by the column weight."""
    assemble = VectorAssembler(inputCols=columns, outputCol="raw_features", handleInvalid="error")
    return Pipeline(stages=[assemble, StandardScaler(inputCol="raw_features", outputCol="features", withMean=True), LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", regParam=penalty, standardization=False, maxIter=100)])


def fitted(df: DataFrame, kind: str, columns: list[str], **settings) -> PipelineModel | extra_trees.Forest:
    """A model of balanced rows (logistic, forest or extra_trees); the logistic penalty is that of C = 1, half the squared weights against the summed loss."""
    if kind != "logistic":
        return {"extra_trees": extra_trees, "forest": random_forest}[kind].fit(df, columns, **settings)
    if "penalty" not in settings:
        settings["penalty"] = 1.0 / max(df.count(), 1)
    return pipeline(columns, **settings).fit(balanced(df))


def scored(model: PipelineModel | extra_trees.Forest | Calibrated, df: DataFrame) -> DataFrame:
    """df with p."""
    if isinstance(model, extra_trees.Forest):
        return model.scored(df)
    if isinstance(model, Calibrated):
        return model.transform(df)
    return model.transform(df).withColumn("p", vector_to_array("probability")[1]).drop("raw_features", "features", "rawPrediction", "probability", "prediction")


class Calibrated:
    """Models of the other folds, each with the sigmoid that calibrates it on its own; a row's probability is their mean."""

    def __init__(self, members: list[tuple[PipelineModel, float, float]], columns: list[str]):
        self.members, self.columns = members, columns

    def transform(self, df: DataFrame) -> DataFrame:
        """df with p."""
        names = []
        for i, (model, slope, offset) in enumerate(self.members):
            df = calibrated(scored(model, df), slope, offset).withColumnRenamed("p", f"__p{i}")
            names.append(f"__p{i}")
        total = sum((F.col(c) for c in names), F.lit(0.0))
        return df.withColumn("p", total / len(names)).drop(*names)


def spread(df: DataFrame, kind: str) -> DataFrame:
    """df to be scored by a model of that kind: where hundreds of trees see each row all tasks get some, however few partitions the rows are in."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, "id") if kind != "logistic" else df


def fit_calibrated(df: DataFrame, kind: str, columns: list[str], folds: int = 3, fold: str = "__inner", **settings) -> Calibrated:
    """Calibrated over stratified folds of df (id, y and the columns)."""
    dealt = compact(features.stratified_folds(df, "y", F.col("id"), folds, seed=7, fold=fold), "inner-folds")
    members = []
    for k in range(folds):
        model = fitted(dealt.filter(F.col(fold) != k), kind, columns, **settings)
        scores = scored(model, spread(dealt.filter(F.col(fold) == k), kind)).select("y", "p")
        # Calibration reads them several times; hundreds of trees a row are gone through once.
        members.append((model, *platt(materialise(scores, "scores") if kind != "logistic" else scores)))
    return Calibrated(members, columns)


def out_of_fold(df: DataFrame, kind: str, columns: list[str], folds: int = 5, inner: int = 0, **settings) -> DataFrame:
    """Every row scored by the model of the other folds, calibrated within them over inner folds if that is not 0; df has id, y, fold and the columns."""
    parts = []
    for k in range(folds):
        rest, own = df.filter(F.col("fold") != k), spread(df.filter(F.col("fold") == k), kind)
        if inner:
            out = fit_calibrated(rest, kind, columns, inner, **settings).transform(own)
        else:
            out = scored(fitted(rest, kind, columns, **settings), own)
        parts.append(out.select("id", "y", "fold", "p"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cross_calibrated(oof: DataFrame, folds: int = 5) -> DataFrame:
    """Out-of-fold scores (fold, y, p), each fold's calibrated by the sigmoid that the other folds' scores give."""
    p = F.col("p")
    for k in range(folds):
        slope, offset = platt(oof.filter(F.col("fold") != k))
        p = F.when(F.col("fold") == k, sigmoid(F.col("p"), slope, offset)).otherwise(p)
    return oof.withColumn("p", p)


def locked_threshold(value: float) -> float:
    """The threshold of a bundle, which must be the locked one to 1e-12."""
    if abs(value - LOCKED_THRESHOLD) > 1e-12:
        raise ContractError(f"threshold {value} is not the locked one")
    return value


def save_bundle(model: Calibrated, spark: SparkSession, path: str, threshold: float = LOCKED_THRESHOLD) -> None:
    """Writes the models, their calibration, the ordered features and the threshold."""
    for i, (member, _, _) in enumerate(model.members):
        if isinstance(member, extra_trees.Forest):
            member.save(f"{path}/member-{i}")
        else:
            member.write().overwrite().save(f"{path}/member-{i}")
    spec = {"format": 1, "kind": "extra_trees" if isinstance(model.members[0][0], extra_trees.Forest) else "pipeline", "features": model.columns, "threshold": threshold, "calibration": [[s, o] for _, s, o in model.members]}
    spark.createDataFrame([(json.dumps(spec),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/contract")


def load_bundle(spark: SparkSession, path: str, columns: list[str]) -> tuple[Calibrated, float]:
    """The model and threshold of a bundle whose contract holds: its format, its features in their locked order, and the locked threshold. Pickles are not read."""
    spec = json.loads(spark.read.text(f"{path}/contract").first()[0])
    if spec.get("format") != 1 or spec.get("features") != list(columns):
        raise ContractError(f"the bundle at {path} has format {spec.get('format')} and features {spec.get('features')}")
    load = (lambda at: extra_trees.load(spark, at, list(columns))) if spec.get("kind") == "extra_trees" else PipelineModel.load
    members = [(load(f"{path}/member-{i}"), *pair) for i, pair in enumerate(spec["calibration"])]
    return Calibrated(members, list(columns)), locked_threshold(spec["threshold"])


def decided(model: Calibrated, df: DataFrame, threshold: float) -> DataFrame:
    """df with p and positive, after a check that it has the features."""
    return model.transform(require_columns(df, model.columns)).withColumn("positive", F.col("p") >= threshold)


def logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1.0 - q))


def platt(oof: DataFrame) -> tuple[float, float]:
    """Slope and offset of the sigmoid that calibrates out-of-fold scores."""
    rows = VectorAssembler(inputCols=["s"], outputCol="features").transform(oof.select("y", logit(F.col("p")).alias("s")))
    fitted = LogisticRegression(labelCol="y", maxIter=50).fit(rows)
    return float(fitted.coefficients[0]), float(fitted.intercept)


def sigmoid(p: Column, slope: float, offset: float) -> Column:
    return 1.0 / (1.0 + F.exp(-(F.lit(slope) * logit(p) + F.lit(offset))))


def calibrated(df: DataFrame, slope: float, offset: float) -> DataFrame:
    return df.withColumn("p", sigmoid(F.col("p"), slope, offset))


def permutation_importance(model: PipelineModel | extra_trees.Forest | Calibrated, df: DataFrame, columns: list[str], repeats: int = 30) -> DataFrame:
    """(feature, repeat, drop): loss of average precision when a column's values are dealt anew among rows, in one pass. Rows should not be those that the model was fitted on.

    For each column and repeat a row takes the value of the row that a hash order puts in its
    place; so each value is used once, and a row is scored columns * repeats times.
    """
    measure = lambda d, keys: stats.average_precision(scored(model, d).select(*keys, F.col("p").alias("v"), "y"), keys).select(*keys, "average_precision")
    base = measure(df.withColumn("all", F.lit(1)), ["all"]).select(F.col("average_precision").alias("base"))
    jobs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("repeat")) for c in columns for i in range(repeats)]))
    rows = df.select("id", "y", *columns).select("*", jobs.alias("job")).select("*", "job.feature", "job.repeat").drop("job")
    value = F.coalesce(*[F.when(F.col("feature") == c, F.col(c).cast("double")) for c in columns])
    dealt = shuffled(rows.withColumn("__value", value), "__value", ["feature", "repeat"])
    dealt = dealt.withColumns({c: F.when(F.col("feature") == c, F.col("__value")).otherwise(F.col(c)) for c in columns}).drop("__value")
    return measure(dealt, ["feature", "repeat"]).join(F.broadcast(base)).select("feature", "repeat", (F.col("base") - F.col("average_precision")).alias("drop"))


def shuffled(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """df with one column's values moved within hash buckets of id, apart for each of keys; each value is used once.

    Buckets are as many as the shuffle's partitions, 64 at least, so that a task sorts a part of the rows.
    """
    buckets = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = [*keys, "__slot"]
    place = lambda salt: F.row_number().over(Window.partitionBy(*dealt).orderBy(F.xxhash64(*keys, "id", F.lit(salt)), "id"))
    rows = df.withColumn("__slot", F.pmod(F.xxhash64("id", *keys), F.lit(buckets)))
    values = rows.select(*dealt, place(1).alias("__at"), F.col(column).alias("__v"))
    return rows.withColumn("__at", place(2)).join(values, [*dealt, "__at"]).withColumn(column, F.col("__v")).drop("__slot", "__at", "__v")
