"""The pipeline's stages take and give documents, and its result is that of its stages."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))
import corpus_pipeline  # noqa: E402

import __spark_entry__  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(DATA))
        assert out.columns[: len(columns)] == columns, name
        assert i == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        after = docs.count()
        assert 0 < after <= before
        before = after
    again = corpus_pipeline.run(spark, str(DATA))
    assert sorted(r["doc_id"] for r in again.select("doc_id").collect()) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert docs.filter("ids IS NULL").count() == 0


def test_registry():
    names = list(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
