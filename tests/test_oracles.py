"""Every query against its SQL counterpart in DuckDB, over whole tables."""

import math
import os
from pathlib import Path

import pytest

from tessera.plans import catalog

duckdb = pytest.importorskip("duckdb")

DATA = Path(os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, db, name):
    df = catalog.queries()[name](spark, str(DATA))
    got = [tuple(r) for r in df.collect()]
    found = db.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, got) == rows(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, str(DATA)).count() > 0


def test_statistics_cover_every_feature(spark):
    run = lambda name: catalog.queries()[name](spark, str(DATA))
    for name in ("ecdf", "bootstrap_permutation"):
        assert {r[0] for r in run(name).select("feature").distinct().collect()} == {"quantity", "price", "discount", "tax"}


def test_neighbours_of_a_label_have_lower_ids_too(spark):
    found = catalog.queries()["cosine_within_label"](spark, str(DATA))
    assert found.filter("neighbour_id < query_id").count() > 0
