"""What the findings of the third round named."""

import datetime as dt
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import fingerprints, heavy, models, molecules, random_forest
from tessera.operators.ordered import benjamini_hochberg
from tessera.plans import catalog, files, registry
from tessera.sources import line_files
from tessera.streaming import scoring


def test_final_gate_of_a_mean_at_the_limit(spark, tmp_path):
    """Each supplier's mean is .051 exactly, which is not over it, in whatever order its rows are added."""
    rows = [(k, (3 + (i % 2) * 4.2 + 0.0) / 100.0) for k in range(40) for i in range(10 + 2 * k)]
    exact = sum(r[1] * 1000 for r in rows)
    assert math.isclose(exact / len(rows), 51)
    spark.createDataFrame(rows, "l_suppkey long, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = catalog.queries()["final_gate"](spark, str(tmp_path)).first()
    assert (got["n_pass"], got["n_review"], got["verdict"]) == (40, 0, "PASS")


def test_event_rates_of_all_windows(spark, tmp_path):
    """The windows that are open when the stream ends are counted too, over batches that both add to one."""
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    schema, source = "ts timestamp, event_type string", str(tmp_path / "in")
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for part in ([(at(1), "a"), (at(2), "a")], [(at(3), "a"), (at(6), "b")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        query = scoring.rates_stream(spark.readStream.schema(schema).parquet(source), out, check, mode="update")
        query.awaitTermination(120)
        assert scoring.dropped_late(query) == 0
    got = {(r["window_start"].minute, r["event_type"], r["n"]) for r in scoring.latest_rates(spark, out).collect()}
    assert got == {(0, "a", 3), (5, "b", 1)}
    spark.createDataFrame([(1, at(1), "a"), (2, at(59), "b")], "event_id long, ts timestamp, event_type string").write.parquet(str(tmp_path / "t" / "events.parquet"))
    assert {tuple(r) for r in catalog.queries()["stream_event_rates"](spark, str(tmp_path / "t")).collect()} == {("2024-01-01 00:00", "a", 1), ("2024-01-01 00:55", "b", 1)}


def test_all_distinct_values_are_counted(spark):
    """Beyond the counters too, with missing and not finite values as one."""
    rows = [(float(i), float(i % 3), None if i % 10 == 0 else float("nan") if i % 10 == 1 else float(i % 500)) for i in range(1000)]
    df = spark.createDataFrame(rows, "many double, few double, gaps double").repartition(3)
    got = {r["feature"]: r["n_distinct"] for r in heavy.with_distinct(heavy.dominant_values(df, df.columns), df).collect()}
    assert got == {"many": 1000, "few": 3, "gaps": 401}


def test_adjusted_p_values_of_values_that_come_out_anew(spark):
    """A p-value that is not the same when it is worked out again still has its adjusted one."""
    drawn = F.udf(lambda i: random.random() if i % 4 else None, "double").asNondeterministic()
    rows = benjamini_hochberg(spark.range(40).withColumn("p", drawn("id")), "p", "q").collect()
    assert len(rows) == 40 and all((r["p"] is None) == (r["q"] is None) and (r["q"] is None or r["q"] >= r["p"]) for r in rows)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _lines(n: int = 12, parts: int = 3) -> list[tuple]:
    return [(o, i, o * i % 5 + 1, i % 3 + 1, float(20 + i + o % 9), "ARN"[i % 3], "OF"[o % 2], 0.01 * i, 0.02) for o in range(1, n + 1) for i in range(1, parts + o % 4 + 1)]


_LINEITEM = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string, l_tax double, l_discount double"


def test_pairs_of_bits_are_dealt_to_all_tasks(spark, tmp_path):
    """A small table of few groups makes very many pairs: it is not broadcast to the one task that reads it."""
    spark.range(1, 41).selectExpr("id AS p_partkey", "'b' AS p_brand", "CAST(id % 2 AS INT) AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    found = catalog.queries()["tanimoto_bits"](spark, str(tmp_path))
    assert "BroadcastHashJoin" not in _plan(found) and found.count() == 2 * 20 * 19 // 2
    words = lambda k: (k * 2654435761 % 1099511627776 + 1) | (k * 40503 % 65536 * 97) << 64
    for r in found.collect():
        a, b = words(r["a"]), words(r["b"])
        assert r["n_bits"] == a.bit_count() and r["tanimoto"] == round((a & b).bit_count() / (a | b).bit_count(), 6)


def test_refinement_meets_once_and_broadcasts_nothing(spark, tmp_path):
    """However small the files of atoms look; a bond to an atom that is not there counts for nothing."""
    spark.createDataFrame(_lines(), _LINEITEM).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(1, 41).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    assert "Broadcast" not in _plan(catalog.queries()["parsed_molecules"](spark, str(tmp_path)))
    for name in ("structure_classes", "circular_fingerprints"):
        found = catalog.queries()[name](spark, str(tmp_path))
        assert "Join" not in _plan(found) and found.count() == 12
    atoms = spark.createDataFrame([(1, 0, "C"), (1, 1, "O"), (2, 0, "O"), (2, 1, "C"), (3, 0, "C")], "structure long, atom int, label string")
    bonds = spark.createDataFrame([(1, 0, 1, "2.0"), (2, 0, 1, "2.0"), (3, 0, 9, "1.0")], "structure long, a int, b int, bond string")
    of = {r["structure"]: (r["n_atoms"], r["class"]) for r in molecules.classes(molecules.refined(atoms, bonds, 2)[-1]).collect()}
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    assert of[1] == of[2] != of[3] and of[3] == (1, md5(md5(md5(md5("C") + ":") + ":")))


def test_training_tables_have_few_partitions(spark, monkeypatch):
    """As many as cores or as their rows need, not as many as a shuffle made."""
    monkeypatch.setattr(models, "FIT_ROWS", 100)
    cores = spark.sparkContext.defaultParallelism
    many = spark.range(1000).repartition(40)
    assert models.compact(many.limit(50), "few").rdd.getNumPartitions() <= cores
    got = models.compact(many, "more")
    assert got.rdd.getNumPartitions() <= max(cores, 10) and got.count() == 1000


def test_lines_of_a_file_in_parts(spark, tmp_path):
    """Line numbers go on from part to part; no task sorts a whole file; a task reads a bounded split of a table."""
    rows = spark.createDataFrame([(i % 2, i, f"line {i}") for i in range(400)], "g int, at int, line string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows.createOrReplaceTempView("tessera_rows")
        folder = files._written_lines(registry.Tables(spark, str(tmp_path)), rows, "g", "at")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    got = line_files.numbered_lines(spark, folder, parts=True).collect()
    assert len(got) == 400 and len({r["file"] for r in got}) == 2
    assert all(int(r["line"][5:]) == 2 * (r["line_no"] - 1) + int(r["file"][-2]) for r in got)
    assert line_files.numbered_lines(spark, folder).select("file").distinct().count() > 2
    assert spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() <= 32 << 20


def test_fingerprint_pairs_are_not_shuffled(spark, monkeypatch):
    """only pairs that reach the threshold leave a task, whatever bits are in common, over many blocks and tiles."""
    monkeypatch.setattr(fingerprints, "PAIR_BLOCK", 16)
    monkeypatch.setattr(fingerprints, "PAIR_BYTES", 1 << 13)
    monkeypatch.setattr(fingerprints, "LOOKUPS", 50)
    monkeypatch.setattr(fingerprints, "PAIRS", 7)
    rng = random.Random(8)
    base = [rng.sample(range(-(10**6), 10**6), 24) for _ in range(9)]
    sets = [(i % 140, sorted({1, 2, *(b for b in rng.choice(base) if rng.random() < 0.8)})) for i in range(150)] + [(500, [1]), (501, [1]), (502, []), (503, [None, 1]), (504, [None, 1])]
    df = spark.createDataFrame([(i, [*s, *s]) for i, s in sets], "id long, bits array<int>").repartition(5)
    for least in (0.05, 0.45, 1.0):
        found = fingerprints.similar_pairs(df, least)
        assert "Exchange" not in _plan(found) and "Join" not in _plan(found)
        wanted = [(a, b, round(len(set(s) & set(t)) / len(set(s) | set(t)), 6)) for a, s in sets for b, t in sets if a < b and s and t]
        assert sorted(map(tuple, found.collect())) == sorted(w for w in wanted if w[2] >= least)
    assert fingerprints.similar_pairs(df.limit(0), 0.5).count() == 0


def test_forests_grow_by_trees_and_by_rows(spark, monkeypatch):
    """no fit runs in the few tasks that the rows lie in, and trees are the same from whole-tree tasks and from counts of rows."""
    rng = random.Random(7)
    rows = [(i, rng.random(), rng.random(), rng.randint(0, 3) / 3, i % 3) for i in range(300)]
    rows = [(*r, int((r[1] > 0.5) != (r[2] > 0.5))) for r in rows]  # no single feature tells
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, fold int, y int").coalesce(1)
    whole = models.fitted(df, "forest", ["a", "b", "c"], trees=7, depth=5)
    nodes = sorted(map(tuple, whole.nodes.collect()))
    monkeypatch.setattr(random_forest, "LOCAL", 1)
    monkeypatch.setattr(random_forest, "SLAB", 50)
    assert sorted(map(tuple, models.fitted(df, "forest", ["a", "b", "c"], trees=7, depth=5).nodes.collect())) == nodes
    monkeypatch.undo()
    # A tree's nodes against the rows that it counts.
    row, x = np.array([r["row"] for r in df.select(F.monotonically_increasing_id().alias("row")).collect()]), np.array([r[1:4] for r in rows])
    y, of = np.array([r[5] for r in rows]), {n[:2]: n[2:] for n in nodes}
    share = len(y) / (2 * np.bincount(y))
    for tree in range(7):
        times, at = random_forest._times(42, tree, row), np.ones(len(row), np.int64)
        assert 0.5 < times.mean() < 1.5
        for node in sorted(n for t, n in of if t == tree):
            feature, threshold, left, right, p, n = of[tree, node]
            here = at == node
            ones, all_ = (times * y)[here].sum(), times[here].sum()
            assert n == all_ >= 2 and math.isclose(p, share[1] * ones / (share[1] * ones + share[0] * (all_ - ones)))
            if feature >= 0:
                at[here] = np.where(x[here, feature] <= threshold, left, right)
            assert node < 1 << 6
    oof = models.out_of_fold(df, "forest", ["a", "b"], folds=3, trees=40)
    assert sum((r["p"] > 0.5) == r["y"] for r in oof.collect()) > 270
    with pytest.raises(Exception, match="missing values"):
        models.fitted(df.withColumn("a", F.when(F.col("id") > 5, F.col("a"))), "forest", ["a", "b"], trees=2)
