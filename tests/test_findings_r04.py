"""What the findings of the fourth round named."""

import numpy as np
import pytest

from tessera.operators import extra_trees, models
from tessera.plans import catalog


def test_final_gate_counts_values_as_its_sql_does(spark, tmp_path):
    """missing discounts are in no mean, one that is no decimal decides as a double does, and small digits count."""
    duckdb = pytest.importorskip("duckdb")
    values = {1: [0.06, None, None], 2: [None], 3: [float("nan"), 0.0], 4: [float("inf"), 0.0], 5: [1e15, 0.0], 6: [0.0510000000001], 7: [0.0509999999999], 8: [0.02, 0.08], 9: [-1e15, 1e6], None: [0.07, None]}
    spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "l_suppkey long, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    sql = catalog.oracle_sql()["final_gate"].replace("FROM lineitem", f"FROM '{tmp_path}/lineitem.parquet/*.parquet' lineitem")
    got = catalog.queries()["final_gate"](spark, str(tmp_path)).first()
    assert tuple(got) == duckdb.sql(sql).fetchall()[0] == (4, 6, 0, "PASS_WITH_REVIEW")


def _grown(x, y, trees):
    grower = extra_trees._Grower(extra_trees._Rows(x, y), 9, 2, 2, (1.0, 2.0))
    grower.grow(trees, extra_trees.ROOT)
    return sorted(map(tuple, grower.rows().to_pandas().to_numpy().tolist()))


def test_trees_grow_whole_in_tasks(spark, monkeypatch):
    """trees come whole out of their tasks, no row is dealt out a tree at a time; they are the same from large and small nodes, and from trees together and alone."""
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 6, 400) / 4, rng.random(400), np.full(400, 3.0), rng.normal(size=400)])
    x[:9, 1], x[9:12, 3] = np.nan, np.inf
    y = ((x[:, 0] + x[:, 3] + rng.normal(0, 0.3, 400)) > 1).astype(int)
    wanted = _grown(x, y, [0, 1, 2])
    for large in (2, 50):
        monkeypatch.setattr(extra_trees, "LARGE", large)
        assert _grown(x, y, [0, 1, 2]) == wanted == sorted(n for t in range(3) for n in _grown(x, y, [t]))
    for tree in range(3):
        of, at = {int(n[1]): n for n in wanted if n[0] == tree}, np.full(400, extra_trees.ROOT)
        for _ in range(len(of)):
            for node in set(at.tolist()):
                _, _, feature, threshold, left, right, p, n = of[node]
                here = at == node
                assert n == here.sum() and p == pytest.approx(2 * y[here].sum() / (2 * y[here].sum() + (here & (y == 0)).sum()))
                if feature >= 0:
                    at[here] = np.where(x[here, int(feature)] <= threshold, left, right)
            if all(of[n][2] < 0 for n in set(at.tolist())):
                break

    def dealt(*_):
        raise AssertionError("nodes are dealt by tree")

    monkeypatch.setattr(extra_trees, "_packed", dealt)
    monkeypatch.setattr(extra_trees, "TOGETHER", 300)
    df = spark.createDataFrame([(i, *map(float, r[1::2]), int(v)) for i, (r, v) in enumerate(zip(x[12:], y[12:]))], "id long, a double, b double, y int")
    forest = models.fitted(df, "extra_trees", ["a", "b"], trees=20)
    assert forest.nodes.select("tree").distinct().count() == 20 and forest.nodes.filter("node = 1 AND n = 388").count() == 20
    assert sum((r["p"] > 0.5) == r["y"] for r in forest.scored(df).collect()) > 350
