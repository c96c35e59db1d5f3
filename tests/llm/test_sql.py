"""Queries with a SQL counterpart against DuckDB, over whole tables."""

from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

from tessera.llm.oracles import ORACLE_SQL  # noqa: E402
from tessera.llm.queries import QUERIES  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, str(DATA))
    found = db.execute(ORACLE_SQL[name])
    assert df.columns == [d[0] for d in found.description]
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted(found.fetchall(), key=repr)
