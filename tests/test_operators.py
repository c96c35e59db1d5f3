"""Operators on small hand-made tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import columns as c
from tessera.operators import contracts, correlation, extra_trees, features, fingerprints, heavy, models, molecules, neighbour_index, ordered, resampling, similarity, stats, structures
from tessera.sources import arrays, text_lists
from tessera.streaming import scoring


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_null_vocabularies(spark):
    df = spark.createDataFrame([(" A ",), ("",), (None,), ("nan",), ("n.a.",), ("N/A",)], "x string")
    by = lambda v: [r[0] for r in df.select(c.null_normalised(F.col("x"), v)).collect()]
    assert by("table") == ["A", None, None, None, "n.a.", None]
    assert by("structure") == ["A", None, None, None, None, "N/A"]
    assert by("identifier") == ["A", "", None, None, "n.a.", "N/A"]


def test_numbers_are_finite_or_null(spark):
    df = spark.createDataFrame([("1",), ("NaN",), ("inf",), (None,), ("n.a.",)], "x string")
    assert [r[0] for r in df.select(c.number(F.col("x"))).collect()] == [1.0, None, None, None, None]


def test_bins_bands_and_entropy(spark):
    df = spark.createDataFrame([(0.0,), (0.4,), (0.5,), (1.0,), (None,)], "p double")
    got = df.select(c.entropy(F.col("p")), c.confidence_level(F.col("p")), c.support_category(F.col("p") * 20)).collect()
    assert [r[0] for r in got[:4]] == [0.0, pytest.approx(0.970951), 1.0, 0.0]
    assert [r[1] for r in got] == ["Low", "Medium", "Medium", "High", None]
    assert [r[2] for r in got] == ["NO_SUPPORT", "LOW_4_TO_9", "MODERATE_10_TO_19", "HIGH_GE_20", None]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [3], [1]), ([0.0, 0.0], [1.0, 0.0], [0], [0])], "a array<double>, b array<double>, s array<bigint>, t array<bigint>")
    got = df.select(c.cosine(F.col("a"), F.col("b")), c.tanimoto(F.col("s"), F.col("t")), c.unit(F.col("a"))).collect()
    assert got[0][0] == pytest.approx(math.sqrt(0.5)) and got[0][1] == 0.5 and got[0][2] == [1.0, 0.0]
    assert got[1][0] is None and got[1][1] is None and got[1][2] is None


def test_dimension_names_count_from_a_documented_base(spark):
    df = spark.createDataFrame([([10.0, 20.0, 30.0],)], "v array<double>")
    assert df.select(c.dimension(F.col("v"), "emb_1"), c.dimension(F.col("v"), "emb_1", base=1)).first() == (20.0, 10.0)


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id long, x string")
    with pytest.raises(contracts.ContractError):
        contracts.require_columns(df, ["id", "y"])
    assert values(contracts.repeats(df, ["id"])) == [(1, 2, 1)]
    failing = contracts.check("s", "unique", contracts.not_unique(df, ["id"]))
    assert failing.first()["status"] == "FAIL"
    with pytest.raises(contracts.ContractError):
        contracts.enforce(failing)
    assert contracts.gate(failing).first()["verdict"] == "FAIL"
    assert contracts.find_column(["Np_ID", "name"], ["np_id"]) == "Np_ID"
    with pytest.raises(contracts.ContractError):
        contracts.same_order(["b", "a"], ["a", "b"])


@pytest.mark.parametrize("one_task", [1 << 20, 3])
@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_in_one_task_and_by_ranges(spark, monkeypatch, one_task, descending):
    monkeypatch.setattr(ordered, "ONE_TASK", one_task)
    rng = random.Random(2)
    rows = [(k, None if v == 3 else v / 8, rng.randint(-5, 9), rng.random()) for k, n in (("a", 300), ("b", 1), ("c", 40)) for v in rng.sample(range(1000), n)]
    df = spark.createDataFrame(rows, "k string, v double, n long, x double").repartition(7)
    for keys in (["k"], []):
        if not keys:
            df, rows = df.filter("k = 'a'"), [r for r in rows if r[0] == "a"]
        got = {(r["k"], r["v"]): (r["s"], r["m"]) for r in ordered.running_sums(df, keys, "v", {"s": "n"}, descending, {"m": "x"}).collect()}
        for k in {r[0] for r in rows}:
            mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0), reverse=descending)
            for i, r in enumerate(mine):
                assert got[k, r[1]] == (sum(x[2] for x in mine[: i + 1]), min(x[3] for x in mine[: i + 1]))


def test_running_sums_and_ranks(spark):
    df = spark.createDataFrame([("k", float(i), i) for i in range(200)] + [("l", 5.0, 7)], "k string, v double, n long")
    got = {(r["k"], r["v"]): r["s"] for r in ordered.running_sums(df, ["k"], "v", {"s": "n"}).collect()}
    assert got[("k", 199.0)] == sum(range(200)) and got[("k", 10.0)] == 55 and got[("l", 5.0)] == 7
    down = {r["v"]: r["s"] for r in ordered.running_sums(df.filter("k = 'k'"), [], "v", {"s": "n"}, descending=True).collect()}
    assert down[199.0] == 199 and down[0.0] == sum(range(200))
    ranked = ordered.score_ranks(spark.createDataFrame([(3.0,), (3.0,), (1.0,), (9.0,)], "p double"), "p")
    assert values(ranked) == [(1.0, 4), (3.0, 2), (3.0, 2), (9.0, 1)]


def test_adjusted_p_values_with_nulls_and_ties(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.04,), (0.5,), (None,)], "p double")
    got = {r["p"]: r["q_value"] for r in ordered.benjamini_hochberg(df, "p").collect()}
    assert got[0.01] == pytest.approx(0.04) and got[0.04] == pytest.approx(0.04 * 4 / 3) and got[0.5] == 0.5 and got[None] is None


def test_rank_statistics_against_pairs(spark):
    rows = [("f", 1.0, 1), ("f", 2.0, 1), ("f", 2.0, 0), ("f", 0.0, 0), ("f", 5.0, 1), ("f", 2.0, 0), ("one", 1.0, 1), ("nan", float("nan"), 0), ("nan", 1.0, 1)]
    df = spark.createDataFrame(rows, "feature string, v double, y int")
    got = {r["feature"]: r for r in stats.rank_statistics(df, ["feature"]).collect()}
    pos, neg = [1.0, 2.0, 5.0], [2.0, 0.0, 2.0]
    wins = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
    assert got["f"]["u"] == wins and got["f"]["auc"] == pytest.approx(wins / 9) and got["f"]["cliffs_delta"] == pytest.approx(2 * wins / 9 - 1)
    assert got["one"]["auc"] is None and got["nan"]["n0"] == 0
    ap = {r["feature"]: r["average_precision"] for r in stats.average_precision(df, ["feature"]).collect()}
    assert ap["f"] == pytest.approx((1 * 1 + 1 * 2 / 4 + 1 * 3 / 5) / 3)
    assert stats.rank_statistics(df, ["feature"]).filter("feature = 'f'").select(stats.two_sided_p(F.col("z"))).first()[0] <= 1


@pytest.mark.parametrize("fan", [1024, 3])
def test_resampling_brackets_the_auc(spark, monkeypatch, fan):
    monkeypatch.setattr(resampling, "FAN", fan)
    df = spark.createDataFrame([("f", float(i % 10 + 3 * (i % 2)), i % 2) for i in range(200)] + [("small", 1.0, 1)], "feature string, v double, y int")
    got = {r["feature"]: r for r in resampling.resampled(df, "feature", 200).collect()}
    assert got["f"]["permutation_p"] < 0.05 and abs(got["f"]["null_mean"] - 0.5) < 0.02
    assert all(got["f"][f"{m}_low"] < got["f"][m] < got["f"][f"{m}_high"] for m in ("auc", "delta", "ap"))
    exact = stats.average_precision(df, ["feature"]).filter("feature = 'f'").first()["average_precision"]
    assert got["f"]["ap"] == pytest.approx(exact) and got["f"]["delta"] == pytest.approx(2 * got["f"]["auc"] - 1)
    assert got["small"]["auc"] is None and resampling.resampled(df, "feature", 200).filter("feature = 'f'").first() == got["f"]


def plain_resampling(rows, replicates, seed):
    """The same statistics, drawn in one group of all values by plain numpy."""
    v, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    rng, drawn, null = np.random.default_rng(seed), [], []

    def measures(v, y):
        order = np.argsort(v, kind="stable")
        ranks = np.empty(len(v))
        ranks[order] = np.arange(1, len(v) + 1)
        mean = {x: ranks[v == x].mean() for x in set(v)}
        n1, n0 = y.sum(), (1 - y).sum()
        auc = (sum(mean[x] for x in v[y == 1]) - n1 * (n1 + 1) / 2) / (n1 * n0)
        ap = sum(((v == x) & (y == 1)).sum() / n1 * ((v >= x) & (y == 1)).sum() / (v >= x).sum() for x in set(v[y == 1]))
        return auc, ap

    for _ in range(replicates):
        at = np.concatenate([rng.choice(np.flatnonzero(y == k), (y == k).sum()) for k in (0, 1)])
        drawn.append(measures(v[at], y[at]))
        null.append(measures(v, rng.permutation(y))[0])
    return measures(v, y), np.array(drawn), np.array(null)


def test_resampling_by_splitting_has_the_same_distribution(spark, monkeypatch):
    """Values in a deep tree of ranges, against draws of rows; a feature whose positives are lower is turned round."""
    rng = random.Random(4)
    rows = [("up", float(rng.randint(0, 40) + 6 * (i % 3 == 0)), int(i % 3 == 0)) for i in range(150)]
    rows += [("down", -v + rng.random() * 1e-3, y) for _, v, y in rows]
    df = spark.createDataFrame(rows, "feature string, v double, y int")
    n = 1500
    monkeypatch.setattr(resampling, "FAN", 4)
    got = {r["feature"]: r for r in resampling.resampled(df, "feature", n, seed=3).collect()}
    for name, sign in (("up", 1), ("down", -1)):
        (auc, ap), drawn, null = plain_resampling([(f, sign * v, y) for f, v, y in rows if f == name], n, 5)
        r = got[name]
        assert r["auc"] == pytest.approx(auc) and r["ap"] == pytest.approx(ap)
        low, high = np.percentile(drawn, [2.5, 97.5], axis=0)
        assert np.allclose([r["auc_low"], r["ap_low"], r["auc_high"], r["ap_high"]], [*low, *high], atol=0.02)
        assert r["null_mean"] == pytest.approx(0.5, abs=0.008) and r["null_sd"] == pytest.approx(null.std(ddof=1), rel=0.1)
    moments = {r["feature"]: r["sd"] for r in resampling.null_moments(df, "feature").collect()}
    assert all(got[k]["null_sd"] == pytest.approx(sd, rel=0.1) for k, sd in moments.items())


def test_draws_down_the_tree_add_up():
    rng = np.random.default_rng(0)
    pos, neg = np.array([3, 0, 9, 1]), np.array([2, 5, 0, 1])
    state = np.array([[13, 4], [8, 20], [10, 0], [5, 5], [1, 1], [0, 2]])
    drawn = resampling._draw(rng, state, pos, neg)
    assert (drawn[:3].sum(2) == state[:3]).all() and (drawn[2] <= pos + neg).all() and (drawn[0][:, 1] == 0).all()
    assert (drawn[3:] == np.cumsum(drawn[:3], 2) - drawn[:3] + state[3:, :, None]).all()


def test_feature_screens(spark):
    rows = [(i, float(i), float(i), i + 0.001 * (i % 3), 1.0, None if i % 4 == 0 else 2.0) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double")
    assert features.identical_columns(df, "id", ["a", "b", "c", "d"]) == [("a", "b")]
    pairs = [tuple(r) for r in features.correlations(df, ["a", "b", "c"]).collect()]
    assert features.correlation_screen(pairs, ["a", "b", "c"]) == ["b", "c"]
    chain = [("a", "b", 0.99), ("b", "c", 0.99), ("a", "c", 0.5)]
    assert features.correlation_screen(chain, ["a", "b", "c"]) == ["b"] and features.correlation_screen(chain, ["a", "b", "c"], greedy=False) == ["b", "c"]
    assert features.impute(df, F.col("id") < 20, ["e"]).filter("e IS NULL").count() == 0
    split = features.stratified_split(df.withColumn("s", F.col("id") % 2), "s", F.col("id"))
    assert values(split.groupBy("s").agg(F.count_if("test"))) == [(0, 4), (1, 4)]


def test_confusion_metrics_of_the_published_counts(spark):
    df = spark.createDataFrame([(415, 2642, 181, 8800), (0, 0, 0, 5)], "tp long, fp long, fn long, tn long")
    m = stats.confusion_metrics(*map(F.col, ("tp", "fp", "fn", "tn")))
    got, empty = df.select(*[x.alias(k) for k, x in m.items()]).collect()
    expected = {"sensitivity": 0.696309, "specificity": 0.769096, "ppv": 0.135754, "f1": 0.227211, "mcc": 0.231950}
    assert all(got[k] == pytest.approx(v, abs=1e-6) for k, v in expected.items())
    assert empty["sensitivity"] is None and empty["mcc"] is None


def test_nearest_with_ties_zero_vectors_and_self(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = values(similarity.nearest(df.filter("vec_id IN (1, 4)"), df, 2))
    assert got == [(1, 2, 1.0, 1), (1, 3, 0.0, 2)]
    assert values(similarity.nearest(df.filter("vec_id = 2"), df, 1, exclude_self=False)) == [(2, 1, 1.0, 1)]
    assert similarity.nearest(df.filter("vec_id = 9"), df, 2).count() == 0


def test_line_sources(spark, tmp_path):
    lines = spark.createDataFrame([(1, "label\tstructure"), (2, "1\tCC O"), (3, "0 CCN"), (4, "# x"), (5, ""), (6, "7 CC"), (7, "only")], "line_no long, line string")
    assert values(text_lists.parse_labelled(lines)) == [(2, 1, "CC O", None), (3, 0, "CCN", None), (6, None, None, "7 CC"), (7, None, None, "only")]
    ids = spark.createDataFrame([("T1",), ("T2",)], "id string")
    found = text_lists.ids_in_lines(spark.createDataFrame([("a\tT1\tT1",), ("T12\tb",)], "line string"), ids)
    assert values(found.select("id", "line")) == [("T1", "a\tT1\tT1")]
    df = spark.createDataFrame([("x", 1.5), (None, float("nan"))], "a string, b double")
    text_lists.write_tsv(df, str(tmp_path / "t"), digits=8)
    assert text_lists.read_tsv(spark, str(tmp_path / "t"), ["a", "b"]).count() == 2
    text_lists.write_json(df, str(tmp_path / "j"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"a":"x","b":1.5}', '{"a":null,"b":null}']
    assert len(text_lists.provenance(spark, str(tmp_path / "j"), "*.txt").first()["sha256"]) == 64
    assert values(text_lists.resume(spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(2,)], "id long"), "id")) == [(1,)]


def test_models_and_calibration(spark):
    rows = [(i, float(i % 7), float((i * 13) % 11), int(i % 7 > 3), i % 3) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int, fold int")
    oof = models.out_of_fold(df, "logistic", ["a", "b"], folds=3)
    assert oof.count() == 120
    slope, offset = models.platt(oof)
    assert slope > 0
    assert stats.rank_statistics(models.calibrated(oof, slope, offset).select(F.lit("m").alias("feature"), F.col("p").alias("v"), "y"), ["feature"]).first()["auc"] > 0.9
    mixed = models.shuffled(df, "a", ["fold"])
    assert sorted(tuple(r) for r in mixed.select("fold", "a").collect()) == sorted(tuple(r) for r in df.select("fold", "a").collect())
    drops = models.permutation_importance(models.fitted(df, "logistic", ["a", "b"]), df, ["a", "b"], repeats=4).groupBy("feature").agg(F.avg("drop").alias("d"), F.count(F.lit(1)).alias("n"))
    found = {r["feature"]: (r["n"], r["d"]) for r in drops.collect()}
    assert found["a"][0] == found["b"][0] == 4 and found["a"][1] > 0.2 > abs(found["b"][1])


def plain_tree(x, y, tree, seed, k, weights, least=2):
    """Grows a tree node by node: {node: (feature, threshold, left, right, share)}, trying every drawn split in turn."""
    out, stack = {}, [(extra_trees.ROOT, list(range(len(y))))]
    gini = lambda rows: (lambda a, b: (a + b) - (a * a + b * b) / (a + b) if a + b else 0.0)(weights[0] * sum(y[i] == 0 for i in rows), weights[1] * sum(y[i] == 1 for i in rows))
    while stack:
        node, rows = stack.pop()
        low, high = ([f(x[i][j] for i in rows) for j in range(len(x[0]))] for f in (min, max))
        features, thresholds = extra_trees.drawn(seed, np.array([tree]), np.array([node]), np.array([low]), np.array([high]), k)
        found = None
        for f, t in zip(features[0], thresholds[0]):
            sides = [[i for i in rows if x[i][f] <= t], [i for i in rows if x[i][f] > t]]
            if f >= 0 and min(map(len, sides)) >= least and len({y[i] for i in rows}) == 2:
                gain = gini(rows) - sum(map(gini, sides))
                if found is None or gain > found[0]:
                    found = (gain, int(f), float(t), sides)
        a, b = (weights[c] * sum(y[i] == c for i in rows) for c in (0, 1))
        if found is None:
            out[node] = (-1, 0.0, 0, 0, b / (a + b))
            continue
        left, right = (int(c[0]) for c in extra_trees.children(np.array([tree]), np.array([node])))
        out[node] = (*found[1:3], left, right, b / (a + b))
        stack += [(left, found[3][0]), (right, found[3][1])]
    return out


@pytest.mark.parametrize("local", [4096, 20, 1])
def test_extremely_randomised_trees_split_by_split(spark, monkeypatch, local):
    """Against a plain learner, grown in one task, from the middle on, or level by level to the end."""
    monkeypatch.setattr(extra_trees, "LOCAL", local)
    rng = random.Random(6)
    rows = [(i, rng.randint(0, 5) / 4, rng.random(), 3.0, rng.gauss(0, 1)) for i in range(60)]
    rows = [(*r, int(r[1] + r[4] + rng.gauss(0, 0.3) > 1)) for r in rows] + [(100, 0.5, 0.5, 3.0, 0.5, 0), (101, 0.5, 0.5, 3.0, 0.5, 1)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y int")
    forest = extra_trees.fit(df, ["a", "b", "c", "d"], trees=3, seed=9, tried=2)
    x, y = [r[1:5] for r in rows], [r[5] for r in rows]
    weights = [len(y) / (2 * y.count(c)) for c in (0, 1)]
    got: dict = {}
    for r in forest.nodes.collect():
        got.setdefault(r["tree"], {})[r["node"]] = (r["feature"], r["threshold"], r["left"], r["right"], r["p"])
    total = np.zeros(len(rows))
    for tree in range(3):
        wanted = plain_tree(x, y, tree, 9, 2, weights)
        assert got[tree].keys() == wanted.keys() and all(got[tree][n] == pytest.approx(wanted[n]) for n in wanted)
        for i, row in enumerate(x):
            node = extra_trees.ROOT
            while wanted[node][0] >= 0:
                node = wanted[node][2 if row[wanted[node][0]] <= wanted[node][1] else 3]
            total[i] += wanted[node][4] / 3
    assert {r["id"]: pytest.approx(r["p"]) for r in forest.scored(df).collect()} == dict(zip([r[0] for r in rows], total))


def test_extremely_randomised_trees_learn_and_keep(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, rng.random(), rng.random(), i % 3) for i in range(300)]
    rows = [(*r, int((r[1] > 0.5) != (r[2] > 0.5))) for r in rows]  # no single feature tells
    df = spark.createDataFrame(rows, "id long, a double, b double, fold int, y int")
    oof = models.out_of_fold(df, "extra_trees", ["a", "b"], folds=3, trees=40)
    assert sum((r["p"] > 0.5) == r["y"] for r in oof.collect()) > 270
    model = models.fit_calibrated(df, "extra_trees", ["a", "b"], folds=2, trees=10)
    models.save_bundle(model, spark, str(tmp_path / "trees"))
    again, _ = models.load_bundle(spark, str(tmp_path / "trees"), ["a", "b"])
    assert values(again.transform(df).select("id", "p")) == values(model.transform(df).select("id", "p"))
    one_class = extra_trees.fit(df.filter("y = 1"), ["a", "b"], trees=2)
    assert {r["p"] for r in one_class.scored(df).collect()} == {1.0}
    calm = models.cross_calibrated(oof, 3)
    assert calm.columns == oof.columns and stats.rank_statistics(calm.select(F.lit("m").alias("feature"), F.col("p").alias("v"), "y"), ["feature"]).first()["auc"] > 0.9


def test_bundles_keep_their_contract(spark, tmp_path):
    rows = [(i, float(i % 7), float((i * 13) % 11), int(i % 7 > 3)) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    model = models.fit_calibrated(df, "logistic", ["a", "b"])
    path = str(tmp_path / "bundle")
    models.save_bundle(model, spark, path)
    again, threshold = models.load_bundle(spark, path, ["a", "b"])
    assert threshold == models.LOCKED_THRESHOLD and values(again.transform(df).select("id", "p")) == values(model.transform(df).select("id", "p"))
    with pytest.raises(contracts.ContractError):
        models.load_bundle(spark, path, ["b", "a"])
    with pytest.raises(contracts.ContractError):
        models.decided(again, df.drop("b"), threshold)
    models.save_bundle(model, spark, path, threshold=0.5)
    with pytest.raises(contracts.ContractError):
        models.load_bundle(spark, path, ["a", "b"])


def test_asserted_joins_fail_where_they_should(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k long, x string")
    right = spark.createDataFrame([(1, "p"), (2, "q")], "k long, z string")
    twice = right.union(right.limit(1))
    assert contracts.join_many_to_one(left, right, ["k"]).count() == 3
    for join, one, two in ((contracts.join_many_to_one, left, twice), (contracts.join_one_to_one, left, right), (contracts.join_one_to_one, right, right.filter("k = 1")), (contracts.join_guarded, right, right.filter("k = 1"))):
        with pytest.raises(contracts.ContractError):
            join(one, two.withColumnRenamed("z", "w"), ["k"])
    assert contracts.join_guarded(right, right.filter("k = 1").withColumnRenamed("z", "w"), ["k"], least_share=0.5).count() == 1
    assert values(contracts.schema_differences(right, {"k": "bigint", "z": "int", "n": "int"})) == [("k", "bigint", "OK"), ("n", "int", "MISSING"), ("z", "int", "TYPE")]


def test_exact_quantiles(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, float(rng.randint(0, 40)), rng.random() * 40])) for k in "ab" for _ in range(301)]
    df = spark.createDataFrame(rows, "k string, v double")
    at = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r["k"]: r["q"] for r in ordered.quantiles(df, ["k"], "v", at).collect()}
    for k in "ab":
        assert got[k] == pytest.approx(list(np.quantile([v for x, v in rows if x == k and v is not None], at)))
    assert ordered.quantiles(df, [], "v", [0.5]).first()["q"] == pytest.approx([np.median([v for _, v in rows if v is not None])])


def test_folds_are_stratified(spark):
    df = spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(207)], "id long, y int")
    counts = features.stratified_folds(df, "y", F.col("id")).groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {(r["y"], r["n"]) for r in counts} == {(0, 37), (0, 36), (1, 5), (1, 4)}


@pytest.mark.parametrize(("slab", "tile"), [(64 << 20, 4 << 20), (300, 50)])
def test_nearest_in_blocks_and_slabs(spark, monkeypatch, slab, tile):
    monkeypatch.setattr(similarity, "SLAB_BYTES", slab)
    monkeypatch.setattr(similarity, "TILE", tile)
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(0, 3, 4).astype(float).tolist()) for i in range(180)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    m = np.array([v for _, v in rows])
    unit = np.divide(m, np.linalg.norm(m, axis=1)[:, None], out=np.zeros_like(m), where=np.linalg.norm(m, axis=1)[:, None] > 0)
    sim = np.round(unit @ unit.T, 6)
    expected = [(i, j, s) for i in range(180) if unit[i].any() for s, j in sorted(((s, j) for j, s in enumerate(sim[i].tolist()) if j != i and unit[j].any()), key=lambda x: (-x[0], x[1]))[:7]]
    assert [r[:3] for r in values(similarity.nearest(df, df, 7))] == sorted(expected, key=repr)
    ids, own = np.arange(180), np.arange(180)
    for slab in (1, 5, 64):
        parts = [similarity._best(ids, unit, own[a : a + slab], unit[a : a + slab], 7, True, 6) for a in range(0, 180, slab)]
        assert all(p.num_rows <= 180 * min(7, slab) for p in parts)


def test_standardising_refuses_constant_dimensions(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], "id long, v array<double>")
    with pytest.raises(Exception, match="deviation"):
        features.standardised(df, "v", F.lit(True)).collect()
    assert values(features.standardised(df.withColumn("v", F.slice("v", 1, 1)), "v", F.lit(True))) == [(1, [-1.0]), (2, [1.0])]


def test_arrays_and_their_refusals(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), 2.0]) for i in range(50)], "k long, v array<double>").repartition(3)
    folder = str(tmp_path / "npy")
    assert arrays.write_npy(df, folder, "k", "v", 2).agg(F.sum("n_rows")).first()[0] == 50
    assert values(arrays.read_npy(spark, folder)) == sorted(((i, [float(i), 2.0]) for i in range(50)), key=repr)
    with pytest.raises(Exception, match="dimensions"):
        arrays.write_npy(df, str(tmp_path / "other"), "k", "v", 3)
    np.save(tmp_path / "npy" / "part-x-values.npy", np.zeros((2, 2)))
    np.save(tmp_path / "npy" / "part-x-keys.npy", np.arange(2))
    with pytest.raises(contracts.ContractError):
        arrays.read_npy(spark, folder)


def test_ids_as_tokens(spark):
    ids = spark.createDataFrame([("T1",), ("A b.2",), ("x-9",), ("",), ("...",)], "id string")
    lines = spark.createDataFrame([("see T1, T1;",), ("T12 and xT1 T1.a",), ("the A b.2 of",), ("A b.23",), ("f\tx-9\tg",), ("(x-9)",), ("x-91",)], "line string")
    assert values(text_lists.ids_as_tokens(lines, ids).select("id", "line")) == [("A b.2", "the A b.2 of"), ("T1", "see T1, T1;"), ("x-9", "(x-9)"), ("x-9", "f\tx-9\tg")]
    assert values(text_lists.ids_in_artifact(spark.createDataFrame([(" T1 ", "a x-9!")], "Id string, note string"), ids)) == [("T1",), ("x-9",)]


def test_digests_of_files_larger_than_a_chunk(spark, tmp_path):
    import hashlib

    data = random.Random(1).randbytes(text_lists.CHUNK * 2 + 77)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.bin").write_bytes(data)
    (tmp_path / "b.bin").write_bytes(b"")
    found = {r["path"]: (r["size_bytes"], r["sha256"]) for r in text_lists.provenance(spark, str(tmp_path), "*.bin").collect()}
    assert found == {"a.bin": (len(data), hashlib.sha256(data).hexdigest()), "b.bin": (0, hashlib.sha256(b"").hexdigest())}
    kinds = text_lists.classified(text_lists.discover(spark, str(tmp_path)), {"first": "^a[.]"})
    assert sorted(r[0] for r in kinds.select("file_kind").collect()) == ["first", "other"]


def test_failures_leave_a_manifest(spark, tmp_path):
    path = str(tmp_path / "failure")
    with pytest.raises(contracts.ContractError):
        text_lists.with_manifest(lambda: contracts.require_columns(spark.range(1), ["nowhere"]), spark, path)
    found = spark.read.json(path).first()
    assert found["status"] == "FAILED" and found["error"] == "ContractError" and "nowhere" in found["message"] and "Traceback" in found["traceback"]
    assert text_lists.with_manifest(lambda: spark.range(3), spark, path).count() == 3


def test_structures_with_failures(spark):
    class FailingToolkit(structures.PlainToolkit):  # here, so that workers get it by value
        def conform(self, canonical, settings):
            raise ValueError("no conformer")

    df = spark.createDataFrame([(1, "CC(O)Fe"), (2, "C(("), (3, None), (4, "  ")], "id long, structure string")
    parsed = structures.parse_structures(df).select("id", "parsed.*")
    assert values(parsed) == [(1, True, "CC(O)Fe", "C2F1O1"), (2, False, None, None), (3, False, None, None), (4, False, None, None)]
    assert [r[1:3] for r in values(structures.conformers(parsed))] == [("SUCCESS", "PLAIN"), ("NO_STRUCTURE", None), ("NO_STRUCTURE", None), ("NO_STRUCTURE", None)]
    failed = structures.conformers(parsed, make=FailingToolkit)
    assert values(failed.select("id", "status", "metal"))[0] == (1, "FAILED", True)
    assert structures.embeddings(parsed).filter("size(embedding) = 26").count() == 1


def test_stream_scoring(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df.write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = scoring.score_stream(arriving, df, lambda rows, n: rows.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "check"), k=1)
    query.awaitTermination(60)
    assert values(spark.read.parquet(str(tmp_path / "out")).select("query_id", "neighbour_id")) == [(1, 2), (2, 1), (3, 2)]


def test_shared_folder_and_runs(spark):
    from tessera import session

    with session.Run("step") as run:
        kept = session.materialise(spark.range(3), "numbers")
        assert kept.count() == 3
    found = run.record()
    assert found["name"] == "step" and found["began"] < found["ended"] and found["seconds"] >= 0
    session.clear(spark)
    assert session.materialise(spark.range(2), "numbers").count() == 2
    with pytest.raises(Exception):
        kept.collect()


def test_correlations_of_a_thousand_columns(spark):
    """Pairwise complete, against numpy; in one panel and in several."""
    import pandas as pd

    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 40)) @ rng.normal(size=(40, 1000)) * 10.0 ** rng.integers(0, 7, 1000) + rng.choice([0.0, 1e6], 1000)
    x[rng.random(x.shape) < 0.1] = np.nan
    x[5, 3], x[:, 7], x[:, 8] = np.inf, 0.1, np.nan
    x[3:, 9] = np.nan
    columns = [f"c.{i}" for i in range(1000)]
    schema = ", ".join(f"`{c}` double" for c in columns)
    df = spark.createDataFrame([[None if i % 2 and np.isnan(v) else float(v) for i, v in enumerate(r)] for r in x], schema).repartition(3)
    clean = np.where(np.isfinite(x), x, np.nan)
    wanted = pd.DataFrame(clean).corr().to_numpy()
    got = correlation.pair_correlations(df, columns).toPandas()
    assert len(got) == 1000 * 999 // 2 and (got.i < got.j).all()
    r = got.r.to_numpy()
    assert np.isnan(r[(got.i.isin([7, 8]) | got.j.isin([7, 8])).to_numpy()]).all()
    plain = ~(got.i.isin([7, 8, 9]) | got.j.isin([7, 8, 9])).to_numpy()
    assert np.allclose(r[plain], wanted[got.i[plain], got.j[plain]], atol=1e-8)
    present = np.isfinite(x)
    assert (got.n == (present[:, got.i] & present[:, got.j]).sum(0)).all()


def test_correlations_in_panels(spark, monkeypatch):
    monkeypatch.setattr(correlation, "PANEL", 3)
    monkeypatch.setattr(correlation, "ROWS", 7)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 8)).cumsum(1)
    df = spark.createDataFrame([[*map(float, r)] for r in x], [f"c{i}" for i in range(8)])
    got = correlation.pair_correlations(df, df.columns).toPandas()
    assert len(got) == 28 and np.allclose(got.r, np.corrcoef(x.T)[got.i, got.j])
    high = features.high_pairs(df, df.columns, 0.8)
    for greedy in (True, False):
        kept: list[str] = []
        for c in df.columns:
            if not any((a, c) in {p[:2] for p in high} for a in (kept if greedy else df.columns)):
                kept.append(c)
        assert features.correlation_screen(high, df.columns, 0.8, greedy) == [c for c in df.columns if c not in kept]
    assert features.correlations(df.limit(0), df.columns).count() == 0 and features.correlations(df, []).count() == 0


def clustered(rng, n, d, groups):
    centres = rng.normal(size=(groups, d))
    return centres[rng.integers(0, groups, n)] + 0.05 * rng.normal(size=(n, d))


def test_stored_index_is_exact_and_prunes(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    x = clustered(rng, 600, 12, 15)
    x[10], x[11] = x[12], x[12] * 2  # ties
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, [0.0] * 12), (901, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    names = [f"d{i}" for i in range(12)]
    monkeypatch.setattr(neighbour_index, "BLOCK", 16)  # cells in parts, queries in blocks
    neighbour_index.write_index(df, str(tmp_path / "index"), names, pivots=24)
    index = neighbour_index.load_index(spark, str(tmp_path / "index"), names)
    queries = df.filter("vec_id % 7 = 0 OR vec_id >= 900")
    for k, own in ((1, False), (5, True), (40, True), (700, True)):
        wanted = values(similarity.nearest(queries, df, k, exclude_self=own))
        assert values(index.search(queries, k, exclude_self=own).select("query_id", "neighbour_id", "sim", "rank")) == wanted
    first, rest = index.rounds(queries, 5)
    assert rest.count() < 0.2 * queries.count() * 24  # the other cells are pruned
    assert index.search(queries.limit(0), 3).count() == 0


def test_a_broken_index_is_refused(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), 1.0, float(-i)]) for i in range(30)], "vec_id long, embedding array<double>")
    path = str(tmp_path / "index")
    neighbour_index.write_index(df, path, ["a", "b", "c"])
    for names in (["a", "c", "b"], ["a", "b"]):
        with pytest.raises(contracts.ContractError):
            neighbour_index.load_index(spark, path, names)
    with pytest.raises(contracts.ContractError):
        neighbour_index.write_index(df, str(tmp_path / "other"), ["a", "b"])
    pivots = spark.read.parquet(f"{path}/pivots").withColumn("n", F.col("n") + 1).collect()
    spark.createDataFrame(pivots, "cell int, pivot array<double>, radius double, n long").write.mode("overwrite").parquet(f"{path}/pivots")
    with pytest.raises(contracts.ContractError):
        neighbour_index.load_index(spark, path, ["a", "b", "c"])


def plain_tanimoto(a, b):
    return round(len(a & b) / len(a | b), 6) if a | b else 0.0


@pytest.mark.parametrize(("k", "least"), [(3, 0.0), (None, 0.4), (10, 0.7)])
def test_fingerprint_search(spark, monkeypatch, k, least):
    monkeypatch.setattr(fingerprints, "BLOCK", 8)
    monkeypatch.setattr(fingerprints, "SLAB", 40)
    rng = random.Random(2)
    base = [set(rng.sample(range(130), rng.randint(1, 60))) for _ in range(12)]
    sets = {i: {b for b in rng.choice(base) if rng.random() < 0.9} for i in range(150)} | {200: set(), 201: set(base[0]), 202: set(base[0])}
    df = spark.createDataFrame([*((i, sorted(s)) for i, s in sets.items()), (300, [])], "id long, bits array<int>").repartition(3)
    df = df.withColumn("words", F.when(F.col("id") != 300, c.packed_bits(F.col("bits"), 130)))
    found = fingerprints.search(df.filter("id % 5 = 0"), df, k, least)
    wanted = []
    for q in (i for i in sets if i % 5 == 0):
        near = sorted(((-plain_tanimoto(sets[q], s), i) for i, s in sets.items() if i != q and plain_tanimoto(sets[q], s) >= least))
        wanted += [(q, i, -s) for s, i in (near[:k] if k else near)]
    assert values(found.select("query_id", "neighbour_id", "sim")) == sorted([(q, i, s + 0.0) for q, i, s in wanted], key=repr)


@pytest.mark.parametrize("least", [0.3, 0.8, 1.0])
def test_similar_fingerprint_pairs(spark, least):
    rng = random.Random(5)
    base = [rng.sample(range(90), 30) for _ in range(6)]
    sets = {i: {b for b in rng.choice(base) if rng.random() < 0.93} | {0} for i in range(120)} | {200: set(), 201: set(), 202: {1}, 203: {1}}
    df = spark.createDataFrame([(i, [*s, *s]) for i, s in sets.items()] + [(300, None)], "id long, bits array<int>")
    wanted = sorted(((a, b, plain_tanimoto(sets[a], sets[b])) for a in sets for b in sets if a < b and sets[a] and sets[b] and plain_tanimoto(sets[a], sets[b]) >= least), key=repr)
    assert wanted and values(fingerprints.similar_pairs(df, least)) == wanted


@pytest.mark.parametrize(("counters", "candidates"), [(64, 32), (4, 3), (1, 1)])
def test_dominant_values_of_many_columns(spark, monkeypatch, counters, candidates):
    """Against exact counts: few values, many, ties, missing and not finite ones, and columns that can't be told by counters."""
    monkeypatch.setattr(heavy, "COUNTERS", counters)
    monkeypatch.setattr(heavy, "CANDIDATES", candidates)
    rng = random.Random(counters)
    nan, inf = float("nan"), float("inf")
    makers = {
        "one": lambda: 3.0, "two": lambda: float(rng.random() < 0.3), "most": lambda: 0.0 if rng.random() < 0.97 else rng.random(), "flat": rng.random, "tie": lambda: float(rng.randint(0, 1)), "gone": lambda: rng.choice([None, None, nan, inf, 1.0]), "none": lambda: None,
        "many": lambda: float(int(rng.paretovariate(0.7))), "zero": lambda: rng.choice([0.0, -0.0, 1.0]),
    }
    rows = [tuple(m() for m in makers.values()) for _ in range(700)]
    rows += [(*r[:4], 1.0 - r[4], *r[5:]) for r in rows]  # both values of tie are there equally often
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in makers)).repartition(5)
    got = {r["feature"]: r for r in heavy.dominant_values(df, list(makers)).collect()}
    for i, c in enumerate(makers):
        counts: dict = {}
        for r in rows:
            x = None if r[i] is None or not math.isfinite(r[i]) else r[i] + 0.0
            counts[x] = counts.get(x, 0) + 1
        top = sorted(counts.items(), key=lambda x: (-x[1], x[0] is not None, x[0] or 0))
        r = got[c]
        assert (r["n"], r["dominant"], r["n_first"], r["n_second"]) == (1400, *top[0], top[1][1] if len(top) > 1 else None), c
        assert r["n_distinct"] == (len(counts) if len(counts) <= counters else None), c


def test_counters_undercount_by_no_more_than_their_error():
    rng = np.random.default_rng(1)
    values, counts = np.arange(50.0), rng.integers(1, 100, 50)
    kept, left, off = heavy.lowered(values, counts, 8)
    assert len(kept) <= 8 and (counts[kept.astype(int)] - left == off).all() and (np.delete(counts, kept.astype(int)) <= off).all()


def test_line_notations_are_parsed():
    atoms, bonds = molecules.parse("CC(=O)Oc1ccccc1C(=O)O")
    assert len(atoms) == 13 and len(bonds) == 13 and sum(a[3] for a in atoms) == 8  # C9H8O4
    assert sum(b[2] == 1.5 for b in bonds) == 6 and sum(b[2] == 2.0 for b in bonds) == 2
    assert molecules.parse("[13CH3][N+](=O)[O-]")[0] == [("C", False, 0, 3, 13), ("N", False, 1, 0, 0), ("O", False, 0, 0, 0), ("O", False, -1, 0, 0)]
    assert molecules.parse("[Na+].[Cl-]")[1] == [] and molecules.parse("[Fe+++]")[0][0][2] == molecules.parse("[Fe+3]")[0][0][2] == 3
    assert molecules.parse("C%12CC%12")[1] == [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0)] and molecules.parse("N[C@@H](C)C(=O)O")[0][1][:4] == ("C", False, 0, 1)
    for bad in ("", "C(", "C)", "C1CC", "C==C", "=C", "X", "[Xx]", "C(C.C)C", "C11", "C-", "(C)"):
        with pytest.raises(ValueError):
            molecules.parse(bad)
    assert len(molecules.METALS) == 2 + 3 + 13 + 14 + 29 and {"K", "Mn", "Cr", "Sn", "Bi"} <= set(molecules.METALS) and "Si" not in molecules.METALS


def test_two_spellings_of_a_structure_meet(spark):
    spellings = [
        ("CCO", "OCC", "C(O)C", "[CH3][CH2][OH]"), ("CC(=O)Oc1ccccc1C(=O)O", "OC(=O)c1ccccc1OC(C)=O"), ("c1ccc2ccccc2c1", "c1cccc2c1cccc2"), ("C1CCCCC1C", "CC1CCCCC1"), ("COC",), ("CCN",), ("[Na+].[Cl-]", "[Cl-].[Na+]"), ("C1CC1", "C2CC2"), ("CCCC",), ("CC(C)C",), ("[Sn]",), ("not one",), (None,),
    ]
    rows = [(10 * i + k, text) for i, group in enumerate(spellings) for k, text in enumerate(group)]
    found = molecules.parsed(spark.createDataFrame(rows, "id long, structure string"))
    assert {r["structure"] for r in found.filter("error IS NOT NULL").collect()} == {110, 120}
    atoms, bonds = molecules.tables(found)
    colours = molecules.refined(atoms, bonds, 4)
    of = {r["structure"]: r["class"] for r in molecules.classes(colours[-1]).collect()}
    prints = {r["structure"]: tuple(r["bits"]) for r in molecules.circular_bits(colours[:3]).collect()}
    for i, group in enumerate(spellings[:11]):
        assert len({of[10 * i + k] for k in range(len(group))}) == len({prints[10 * i + k] for k in range(len(group))}) == 1
    assert len(set(of.values())) == 11 == len(set(prints.values()))
    made = {r["structure"]: r for r in molecules.composition(atoms).collect()}
    assert made[0]["n_hetero"] == 1 and made[0]["hydrogens"] == 6 and made[60]["metal"] and made[100]["metal"] and not made[10]["metal"] and made[20]["n_aromatic"] == 10
    counted = {r["structure"]: r for r in molecules.graph_counts(atoms, bonds, spark.createDataFrame([(60, 2), (61, 2)], "structure long, n_parts int")).collect()}
    assert [counted[k]["n_rings"] for k in (0, 10, 20, 30, 60, 70, 100)] == [0, 1, 2, 1, 0, 1, 0] and counted[90]["most_bonds"] == 3 and counted[90]["n_ends"] == 3


def test_groups_of_a_union_come_out_once(spark):
    """Sides that are dealt alike, one of them much smaller, and a join after it: a group must not be in two rows."""
    from tessera.session import materialise

    spark.conf.unset("spark.sql.unionOutputPartitioning")  # on, as Spark has it
    rows = materialise(spark.range(3000).select((F.col("id") % 700).alias("k"), F.col("id").alias("v")), "rows")
    assert spark.conf.get("spark.sql.unionOutputPartitioning") == "false"
    from pyspark.sql import Window

    chain = rows.withColumn("n", F.lead("v").over(Window.partitionBy("k").orderBy("v"))).filter("n IS NOT NULL").select("k", "v", "n")
    ends = rows.groupBy("k").agg(F.max("v").alias("v"), F.min("v").alias("n"), F.count(F.lit(1)).alias("c")).filter("c > 2").select("k", "v", "n")
    counted = rows.groupBy("k").agg(F.count(F.lit(1)).alias("rows")).join(chain.unionByName(ends).groupBy("k").agg(F.count(F.lit(1)).alias("links")), "k", "left")
    assert counted.count() == len(counted.collect()) == 700


def test_functions_for_sql(spark):
    from tessera.functions import registered

    assert registered.register(spark) == ["two_sided_p", "ks_exact_p", "structure_facts"]
    one = spark.sql("SELECT two_sided_p(1.959963984540054D) AS p, two_sided_p(CAST(NULL AS DOUBLE)) AS none, ks_exact_p(1D, 3, 3) AS ks, ks_exact_p(1D, 20000, 3) AS large").first()
    assert one["p"] == pytest.approx(0.05) and one["none"] is None and one["ks"] == pytest.approx(0.1) and one["large"] is None
    facts = spark.sql("SELECT s.* FROM (SELECT structure_facts(x) AS s FROM VALUES ('[Na+].c1ccccc1'), ('no such'), (NULL) AS t(x))").collect()
    assert [tuple(r) for r in facts] == [(7, 6, 1, 1, True), (None,) * 5, (None,) * 5]
