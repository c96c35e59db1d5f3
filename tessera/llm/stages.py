"""Operators of this subpackage as steps over the documents table: rows in its columns go in and come out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.jaccard_join import jaccard_components
from tessera.llm.plan import row_key


def _free(docs: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of docs has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """Of each class of near copies the row with the least doc_id; texts without words all stay.

    Null, empty and blank texts are such; of repeated rows one stays; rows without doc_id give
    way to others of their class; an empty table gives no rows; further columns, of any name,
    pass through.
    """
    wordless = F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    found, key = jaccard_components(docs), _free(docs, "row_key")
    stay = found.filter("n_shingles > 0 AND key = first_key").select(F.col("key").alias(key)).distinct()
    rest = docs.filter(~wordless).withColumn(key, row_key("doc_id", "text")).join(stay, key, "left_semi").dropDuplicates([key]).drop(key)
    return rest.unionByName(docs.filter(wordless))
