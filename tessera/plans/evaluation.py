"""Queries of model training, calibration and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import confidence_level, entropy, n_rows
from tessera.operators import features, models, stats
from tessera.operators.ordered import quantiles, running_sums
from tessera.operators.stats import confusion_metrics
from tessera.plans.registry import PREDICTIONS, Tables, query
from tessera.session import new_folder

r6 = lambda c: F.round(c, 6)

_METRICS = """round((tp + tn) * 1e0 / (tp + fp + fn + tn), 6) AS accuracy, round(tp * 1e0 / nullif(tp + fn, 0), 6) AS sensitivity, round(tn * 1e0 / nullif(tn + fp, 0), 6) AS specificity, round(tp * 1e0 / nullif(tp + fp, 0), 6) AS ppv,
  round(tn * 1e0 / nullif(tn + fn, 0), 6) AS npv, round(2e0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((1e0 * tp * tn - 1e0 * fp * fn) / nullif(sqrt(1e0 * (tp + fp) * (tp + fn)) * sqrt(1e0 * (tn + fp) * (tn + fn)), 0), 6) AS mcc"""
_MCC = "(1e0 * tp * tn - 1e0 * fp * fn) / nullif(sqrt(1e0 * (tp + fp) * (tp + fn)) * sqrt(1e0 * (tn + fp) * (tn + fn)), 0)"
_SHOWN = ("accuracy", "sensitivity", "specificity", "ppv", "npv", "f1", "mcc")


def _counts(p: Column, y: Column, threshold: float) -> list[Column]:
    hit = p >= threshold
    return [F.count_if(hit & (y == 1)).alias("tp"), F.count_if(hit & (y == 0)).alias("fp"), F.count_if(~hit & (y == 1)).alias("fn"), F.count_if(~hit & (y == 0)).alias("tn")]


def _with_metrics(df: DataFrame, shown=_SHOWN) -> DataFrame:
    found = confusion_metrics(*map(F.col, ("tp", "fp", "fn", "tn")))
    return df.select("*", *[r6(found[m]).alias(m) for m in shown])


_AT = "CAST(count(*) FILTER (WHERE p >= {t} AND y = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE p >= {t} AND y = 0) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE p < {t} AND y = 1) AS BIGINT) AS fn, CAST(count(*) FILTER (WHERE p < {t} AND y = 0) AS BIGINT) AS tn"


@query(f"SELECT *, {_METRICS} FROM (SELECT {_AT.format(t='4e-1')} FROM {PREDICTIONS} p) c")
def confusion_counts(t: Tables) -> DataFrame:
    return _with_metrics(t.predictions.agg(*_counts(F.col("p"), F.col("y"), 0.4)))


@query(f"SELECT l_suppkey, {_METRICS} FROM (SELECT l_suppkey, {_AT.format(t='4e-1')} FROM {PREDICTIONS} p GROUP BY 1) c", name="confusion_metrics")
def confusion_metrics_by_group(t: Tables) -> DataFrame:
    return _with_metrics(t.predictions.groupBy("l_suppkey").agg(*_counts(F.col("p"), F.col("y"), 0.4))).select("l_suppkey", *_SHOWN)


_H = "(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END + CASE WHEN p < 1 THEN -(1 - p) * log2(1 - p) ELSE 0 END)"


@query(f"SELECT CASE WHEN 1 - {_H} < .4 THEN 'Low' WHEN 1 - {_H} < .7 THEN 'Medium' ELSE 'High' END AS confidence, CAST(count(*) AS BIGINT) AS n FROM {PREDICTIONS} q GROUP BY 1", name="confidence_level")
def confidence_levels(t: Tables) -> DataFrame:
    return t.predictions.groupBy(confidence_level(1.0 - entropy(F.col("p"))).alias("confidence")).agg(n_rows().alias("n"))


_CURVE = f"""(SELECT p AS threshold, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp, CAST(sum(pos) OVER () - sum(pos) OVER w AS BIGINT) AS fn, CAST(sum(neg) OVER () - sum(neg) OVER w AS BIGINT) AS tn
  FROM (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM {PREDICTIONS} q GROUP BY 1) d WINDOW w AS (ORDER BY p DESC))"""


def _curve(t: Tables) -> DataFrame:
    """Confusion counts at every distinct score, by one running total over distinct scores."""
    counts = t.predictions.groupBy("p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).withColumn("threshold", F.col("p"))
    run = running_sums(counts, [], "p", {"tp": "pos", "fp": "neg"}, descending=True)
    total = counts.agg(F.sum("pos").alias("n1"), F.sum("neg").alias("n0"))
    return run.join(F.broadcast(total)).select("threshold", "tp", "fp", (F.col("n1") - F.col("tp")).alias("fn"), (F.col("n0") - F.col("fp")).alias("tn"))


@query(f"SELECT threshold, tp, fp, fn, tn, {_METRICS} FROM {_CURVE} c")
def threshold_curve(t: Tables) -> DataFrame:
    return _with_metrics(_curve(t))


@query(f"SELECT round(fp * 1e0 / (fp + tn), 6) AS fpr, round(tp * 1e0 / (tp + fn), 6) AS tpr, threshold FROM {_CURVE} c")
def roc_curve(t: Tables) -> DataFrame:
    found = confusion_metrics(*map(F.col, ("tp", "fp", "fn", "tn")))
    return _curve(t).select(r6(F.try_divide(F.col("fp").cast("double"), (F.col("fp") + F.col("tn")).cast("double"))).alias("fpr"), r6(found["sensitivity"]).alias("tpr"), "threshold")


@query(f"SELECT round(tp * 1e0 / (tp + fn), 6) AS recall, round(tp * 1e0 / (tp + fp), 6) AS precision_, threshold FROM {_CURVE} c")
def pr_curve(t: Tables) -> DataFrame:
    found = confusion_metrics(*map(F.col, ("tp", "fp", "fn", "tn")))
    return _curve(t).select(r6(found["sensitivity"]).alias("recall"), r6(found["ppv"]).alias("precision_"), "threshold")


_BEST = f"(SELECT threshold, round(tp * 1e0 / (tp + fn) + tn * 1e0 / (tn + fp) - 1, 9) AS youden, round(2e0 * tp / (2 * tp + fp + fn), 9) AS f1, coalesce(round({_MCC}, 9), -2) AS mcc FROM {_CURVE} c)"


@query(" UNION ALL ".join(f"SELECT '{c}' AS criterion, (SELECT threshold FROM {_BEST} b ORDER BY {c} DESC, threshold LIMIT 1) AS threshold" for c in ("youden", "f1", "mcc")))
def best_threshold(t: Tables) -> DataFrame:
    found = confusion_metrics(*map(F.col, ("tp", "fp", "fn", "tn")))
    rows = _curve(t).select("threshold", *[F.coalesce(F.round(found[c], 9), F.lit(-2.0)).alias(c) for c in ("youden", "f1", "mcc")])
    best = rows.agg(*[F.min_by("threshold", F.struct(-F.col(c), "threshold")).alias(c) for c in ("youden", "f1", "mcc")])
    return best.unpivot([], ["youden", "f1", "mcc"], "criterion", "threshold")


_CLIPPED = f"(SELECT *, greatest(1e-15, least(1 - 1e-15, p)) AS c FROM {PREDICTIONS} p)"


@query(f"SELECT round(avg(pow(p - y, 2)), 6) AS brier, round(-avg(y * ln(c) + (1 - y) * ln(1 - c)), 6) AS log_loss FROM {_CLIPPED} p")
def brier_logloss(t: Tables) -> DataFrame:
    p, y = F.col("p"), F.col("y")
    c = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p))
    return t.predictions.agg(r6(F.avg((p - y) * (p - y))).alias("brier"), r6(-F.avg(y * F.log(c) + (1 - y) * F.log(1.0 - c))).alias("log_loss"))


_BINS = f"(SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n, avg(p) AS mean_p, avg(y) AS observed FROM {PREDICTIONS} p GROUP BY 1)"


def _bins(t: Tables) -> DataFrame:
    bin_ = F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int")
    return t.predictions.groupBy(bin_.alias("bin")).agg(n_rows().alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("observed"))


@query(f"SELECT bin, n, round(mean_p, 6) AS mean_p, round(observed, 6) AS observed FROM {_BINS} b")
def calibration_bins(t: Tables) -> DataFrame:
    return _bins(t).select("bin", "n", r6(F.col("mean_p")).alias("mean_p"), r6(F.col("observed")).alias("observed"))


@query(f"SELECT round(sum(n * abs(mean_p - observed)) / sum(n), 6) AS ece, round(max(abs(mean_p - observed)), 6) AS mce FROM {_BINS} b")
def ece(t: Tables) -> DataFrame:
    gap = F.abs(F.col("mean_p") - F.col("observed"))
    return _bins(t).agg(r6(F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), r6(F.max(gap)).alias("mce"))


@query(f"SELECT row_id, p, round({_H}, 6) AS entropy, round(1 - {_H}, 6) AS certainty, round(abs(2 * p - 1), 6) AS margin, CASE WHEN 1 - {_H} < .4 THEN 'Low' WHEN 1 - {_H} < .7 THEN 'Medium' ELSE 'High' END AS confidence, p BETWEEN .4 AND .6 AS borderline FROM {PREDICTIONS} q")
def prediction_uncertainty(t: Tables) -> DataFrame:
    h = entropy(F.col("p"))
    return t.predictions.select("row_id", "p", r6(h).alias("entropy"), r6(1.0 - h).alias("certainty"), r6(F.abs(F.col("p") * 2 - 1)).alias("margin"), confidence_level(1.0 - h).alias("confidence"), F.col("p").between(0.4, 0.6).alias("borderline"))


@query(f"SELECT y, CAST(count(*) AS BIGINT) AS n, round(avg(p), 6) AS mean_p, round(median(p), 6) AS median_p, round(avg(CAST(p < .3 AS INTEGER)), 6) AS below_03, round(avg(CAST(p BETWEEN .4 AND .6 AS INTEGER)), 6) AS borderline FROM {PREDICTIONS} q GROUP BY 1")
def prediction_distribution(t: Tables) -> DataFrame:
    share = lambda c: r6(F.avg(c.cast("int")))
    found = t.predictions.groupBy("y").agg(n_rows().alias("n"), r6(F.avg("p")).alias("mean_p"), share(F.col("p") < 0.3).alias("below_03"), share(F.col("p").between(0.4, 0.6)).alias("borderline"))
    return found.join(quantiles(t.predictions, ["y"], "p", [0.5]), "y").select("y", "n", "mean_p", r6(F.col("q")[0]).alias("median_p"), "below_03", "borderline")


@query(f"SELECT threshold, round((tp + fp) * 1e0 / tp, 6) AS needed_to_test FROM {_CURVE} c WHERE tp > 0")
def number_needed(t: Tables) -> DataFrame:
    return _curve(t).filter("tp > 0").select("threshold", r6((F.col("tp") + F.col("fp")).cast("double") / F.col("tp")).alias("needed_to_test"))


_FOLDS = f"(SELECT l_partkey % 3 AS model, l_suppkey % 5 AS fold, avg(pow(p - y, 2)) AS brier FROM {PREDICTIONS} p GROUP BY 1, 2)"


@query(f"SELECT model, round(avg(brier), 6) AS mean_brier, round(stddev_samp(brier), 6) AS sd_brier FROM {_FOLDS} f GROUP BY 1")
def cv_fold_summary(t: Tables) -> DataFrame:
    folds = t.predictions.groupBy((F.col("l_partkey") % 3).alias("model"), (F.col("l_suppkey") % 5).alias("fold")).agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))
    return folds.groupBy("model").agg(r6(F.avg("brier")).alias("mean_brier"), r6(F.stddev_samp("brier")).alias("sd_brier"))


_MODELS = f"(SELECT l_partkey % 3 AS model, p, y FROM {PREDICTIONS} q)"
_MODEL_AP = f"(SELECT model, sum(tp * 1e0 / (tp + fp) * pos) / sum(pos) AS ap FROM (SELECT model, pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM (SELECT model, p, sum(y) AS pos, sum(1 - y) AS neg FROM {_MODELS} m GROUP BY 1, 2) c WINDOW w AS (PARTITION BY model ORDER BY p DESC)) k GROUP BY 1)"
_MODEL_AUC = f"(SELECT model, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2e0) / (1e0 * sum(y) * sum(1 - y)) AS auc FROM (SELECT model, y, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2e0 AS r FROM {_MODELS} m) k GROUP BY 1)"
_MODEL_LOSS = f"(SELECT model, avg(pow(p - y, 2)) AS brier, -avg(y * ln(greatest(1e-15, least(1 - 1e-15, p))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, p)))) AS log_loss, {_AT.format(t='4e-1')} FROM {_MODELS} m GROUP BY 1)"


@query(f"SELECT model, round(ap, 6) AS average_precision, round(auc, 6) AS auc, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, round({_MCC}, 6) AS mcc, row_number() OVER (ORDER BY round(ap, 9) DESC, round(auc, 9) DESC, round(brier, 9), round(log_loss, 9), round({_MCC}, 9) DESC, model) AS rank FROM {_MODEL_AP} a JOIN {_MODEL_AUC} b USING (model) JOIN {_MODEL_LOSS} c USING (model)")
def model_ranking(t: Tables) -> DataFrame:
    """By average precision, AUC, Brier score, log loss and MCC, in this order. Models are few: one ordered pass ranks them."""
    rows = t.predictions.select((F.col("l_partkey") % 3).alias("model"), "p", "y")
    p, y = F.col("p"), F.col("y")
    c = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p))
    losses = rows.groupBy("model").agg(F.avg((p - y) * (p - y)).alias("brier"), (-F.avg(y * F.log(c) + (1 - y) * F.log(1.0 - c))).alias("log_loss"), *_counts(p, y, 0.4))
    losses = losses.withColumn("mcc", confusion_metrics(*map(F.col, ("tp", "fp", "fn", "tn")))["mcc"])
    scores = stats.average_precision(rows, ["model"], "p").join(stats.rank_statistics(rows, ["model"], "p").select("model", "auc"), "model").join(losses, "model")
    key = lambda name, up=False: F.round(name, 9).asc() if up else F.round(name, 9).desc()
    order = Window.orderBy(key("average_precision"), key("auc"), key("brier", True), key("log_loss", True), key("mcc"), "model")
    return scores.select("model", *[r6(F.col(x)).alias(x) for x in ("average_precision", "auc", "brier", "log_loss", "mcc")], F.row_number().over(order).cast("long").alias("rank"))


@query("SELECT p_brand AS family, CAST(count(*) AS BIGINT) AS n, round(avg(p_retailprice), 6) AS mean_importance, round(sum(abs(p_retailprice)) / sum(sum(abs(p_retailprice))) OVER (), 6) AS share FROM part GROUP BY 1")
def family_contribution(t: Tables) -> DataFrame:
    sums = t.read("part").groupBy(F.col("p_brand").alias("family")).agg(n_rows().alias("n"), r6(F.avg("p_retailprice")).alias("mean_importance"), F.sum(F.abs("p_retailprice")).alias("s"))
    return sums.join(F.broadcast(sums.agg(F.sum("s").alias("total")))).select("family", "n", "mean_importance", r6(F.col("s") / F.col("total")).alias("share"))


_LEVELS = """(SELECT 'row' AS level, n_chars > 1000 AS hit, quality AS y FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT 'structure', mean_n > 1000, q FROM (SELECT md5(text) AS m, avg(n_chars) AS mean_n, min(quality) AS q FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING count(DISTINCT quality) = 1) g)"""


@query(f"SELECT level, tp + fp + fn + tn AS n, {_METRICS} FROM (SELECT level, CAST(count(*) FILTER (WHERE hit AND y = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE hit AND y = 0) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE NOT hit AND y = 1) AS BIGINT) AS fn, CAST(count(*) FILTER (WHERE NOT hit AND y = 0) AS BIGINT) AS tn FROM {_LEVELS} l GROUP BY 1) c")
def canonical_group_metrics(t: Tables) -> DataFrame:
    """All metrics by row and by structure; structures whose labels conflict are left out."""
    rows = t.read("documents").select("doc_id", "n_chars", F.md5("text").alias("m")).join(t.read("labels"), "doc_id")
    groups = rows.groupBy("m").agg(F.avg("n_chars").alias("n_chars"), F.min("quality").alias("quality"), F.max("quality").alias("high")).filter("quality = high")
    both = rows.select(F.lit("row").alias("level"), F.col("n_chars").cast("double").alias("n_chars"), "quality").unionByName(groups.select(F.lit("structure").alias("level"), "n_chars", "quality"))
    counts = both.groupBy("level").agg(*_counts(F.col("n_chars"), F.col("quality"), 1000.0000001))
    return _with_metrics(counts).select("level", (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"), *_SHOWN)


_COLUMNS = ["size", "symbols", "capitals", "words"]


def _training(t: Tables) -> DataFrame:
    """Labelled documents with four surface features and a stratified fold, written down: every fit reads them again."""
    joined = t.read("documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("size"), (F.length(F.regexp_replace("text", "[^|!*$%&#]+", "")) / (F.length("text") + 1)).alias("symbols"), (F.length(F.regexp_replace("text", "[^A-Z]+", "")) / (F.length("text") + 1)).alias("capitals"), F.size(F.split("text", " ")).cast("double").alias("words"))
    rows = joined.join(t.read("labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y")), "id")
    return models.compact(features.stratified_folds(rows, "y", F.col("id"), 5), "training")


@query()
def out_of_fold_models(t: Tables) -> DataFrame:
    """Logistic regression over five stratified folds, each model calibrated over three folds of its own rows."""
    return models.out_of_fold(_training(t), "logistic", _COLUMNS, inner=3)


@query()
def forest_model(t: Tables) -> DataFrame:
    """A random forest of 500 trees, out of fold, calibrated by the other folds' scores; the locked threshold is one on calibrated probabilities."""
    oof = models.compact(models.out_of_fold(_training(t), "forest", _COLUMNS), "scores")
    return models.cross_calibrated(oof).withColumn("positive", F.col("p") >= models.LOCKED_THRESHOLD)


@query()
def extra_trees_model(t: Tables) -> DataFrame:
    """500 extremely randomised trees, out of fold, each model calibrated over three folds of its own rows."""
    return models.out_of_fold(_training(t), "extra_trees", _COLUMNS, inner=3).withColumn("positive", F.col("p") >= models.LOCKED_THRESHOLD)


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_changed FROM documents JOIN labels USING (doc_id)")
def model_bundle(t: Tables) -> DataFrame:
    """A calibrated model saved and loaded under its contract gives the probabilities and decisions it gave before."""
    rows, path = _training(t), new_folder(t.spark, "bundle")
    model = models.fit_calibrated(rows, "logistic", _COLUMNS)
    models.save_bundle(model, t.spark, path)
    again, threshold = models.load_bundle(t.spark, path, _COLUMNS)
    before = models.decided(model, rows, models.LOCKED_THRESHOLD).select("id", F.col("p").alias("before"), F.col("positive").alias("was"))
    joined = models.decided(again, rows, threshold).join(before, "id")
    return joined.agg(n_rows().alias("n"), F.count_if((F.abs(F.col("p") - F.col("before")) > 1e-12) | (F.col("positive") != F.col("was"))).alias("n_changed"))


@query()
def permutation_importance(t: Tables) -> DataFrame:
    """All columns, 30 repeats, on rows held out from the final model, which is calibrated over five folds of the others."""
    rows = _training(t)
    model = models.fit_calibrated(rows.filter("fold <> 0"), "logistic", _COLUMNS, folds=5)
    return models.permutation_importance(model, rows.filter("fold = 0"), _COLUMNS)
