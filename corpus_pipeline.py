"""Corpus preparation in stages, each one an operator of tessera.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame: the rows that it keeps, in
the columns of documents; the last adds the piece ids. Rows are written to Parquet
between stages, so a stage works on what its predecessor has kept and a lost executor
costs no more than its own stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import cotraining, decontaminate, pieces, pii, stages
from tessera.llm.plan import materialise
from tessera.llm.queries import table, tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go.

    Null and empty texts are judged by their metadata, null metadata is a value of its own,
    repeated rows are each judged, without labels of both classes all stay, an empty table
    gives no rows, and further columns pass through.
    """
    return cotraining.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the Jaccard join stays.

    Null, empty and blank texts all stay, of repeated rows one does, ties go to the lower
    doc_id, an empty table gives no rows, and further columns pass through.
    """
    return stages.one_of_each_class(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts.

    Null and empty texts and an empty benchmark change nothing, repeated rows all stay, an
    empty table gives no rows, and further columns pass through; n_chars follows the text.
    """
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked by its kind.

    Null and empty texts stay, repeated rows are each masked, an empty table gives no rows,
    and further columns pass through; n_chars follows the text.
    """
    return pii.masked_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts get their piece ids, in column ids, which takes the place of one of that name.

    Null and empty texts have none, repeated rows are each encoded, an empty table gives no
    rows, and further columns pass through.
    """
    return pieces.encoded(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark),
    ("PII", personal_data),
    ("SentencePiece encoding and decoding", encode),
]

#: Co-training and BPE can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
