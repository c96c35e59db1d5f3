"""Files of lines with exact line numbers, whatever tasks they are split over, and what is read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.columns import n_rows
from tessera.sources import text_lists


def numbered_lines(spark: SparkSession, path: str | list[str], parts: bool = False) -> DataFrame:
    """(file, line_no, line) of text files, line numbers from 1 in each file; a byte order mark before the first line is not part of it.

    parts: the files of a folder, by name, are the parts of one; file is then the folder, with a slash at its end.

    A task reads a byte range of a file; a first scan counts the lines of each range, and a
    line's number is its place in its range after the lines of the ranges before. What is
    joined is a row a range, which goes to the lines, so that these stay where they are.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path, recursiveFileLookup=True).select(meta["file_path"].alias("__path"), meta["file_block_start"].alias("__start"), F.monotonically_increasing_id().alias("__at"), F.col("value").alias("line"))
    file = F.regexp_replace("__path", "[^/]+$", "") if parts else F.col("__path")
    ranges = lines.groupBy("__path", "__start").agg(n_rows().alias("__n"), F.min("__at").alias("__first")).withColumn("file", file)
    before = Window.partitionBy("file").orderBy("__path", "__start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("file", "__path", "__start", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    numbered = lines.join(F.broadcast(ranges), ["__path", "__start"]).withColumn("line_no", F.col("__before") + F.col("__at") - F.col("__first") + 1)
    line = F.when(F.col("line_no") == 1, F.regexp_replace("line", "^﻿", "")).otherwise(F.col("line"))
    return numbered.select("file", "line_no", line.alias("line"))


def labelled_list(spark: SparkSession, path: str | list[str], parts: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records (file, line_no, label, structure) of label-and-structure lists, and the lines that are none (file, line_no, line, error).

    Two fields, parted by one tab or else by white space; blank lines and # comments are
    skipped, and a header where it is a file's first line. A label is 0 or 1.
    """
    lines = numbered_lines(spark, path, parts).withColumn("text", F.trim(F.regexp_replace("line", r"^[\s]+|[\s]+$", "")))
    lines = lines.filter((F.col("text") != "") & ~F.col("text").startswith("#"))
    tabs, pattern = F.split("text", "\t"), r"^(\S+)\s+(.*)$"
    two = F.size(tabs) == 2
    label = F.trim(F.when(two, tabs[0]).otherwise(F.regexp_extract("text", pattern, 1)))
    structure = F.trim(F.when(two, F.get(tabs, F.lit(1))).otherwise(F.regexp_extract("text", pattern, 2)))
    lines = lines.withColumns({"label": label, "structure": structure})
    header = (F.col("line_no") == 1) & F.lower("label").isin("label", "activity", "class") & F.lower("structure").isin("smiles", "canonical_smiles")
    number = F.when(F.col("label").rlike(r"^[+-]?\d+$"), F.col("label").try_cast("int"))
    error = (
        F.when((F.col("label") == "") & (F.col("structure") == ""), "two fields expected").when(number.isNull(), "label is no number").when(~number.isin(0, 1), "label is neither 0 nor 1").when(F.col("structure") == "", "structure is empty")
    )
    read = lines.filter(~header).withColumns({"number": number, "error": error})
    good = read.filter("error IS NULL").select("file", "line_no", F.col("number").alias("label"), "structure")
    return good, read.filter("error IS NOT NULL").select("file", "line_no", "line", "error")


def named_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, name, structure, bad_line) of name-and-structure lists; rules as in text_lists.parse_named()."""
    return text_lists.parse_named(numbered_lines(spark, path))


def id_scan(spark: SparkSession, path: str | list[str], ids: DataFrame, origin: str = "", parts: bool = False) -> DataFrame:
    """(id, file, line_no) where ids (column id) occur as tokens of lines; files whose path ends in origin are left out."""
    lines = numbered_lines(spark, path, parts)
    return text_lists.ids_as_tokens(lines.filter(~F.col("file").endswith(origin)) if origin else lines, ids).select("id", "file", "line_no")


def atom_records(spark: SparkSession, path: str | list[str], parts: bool = False) -> DataFrame:
    """(file, line_no, record, x, y, z) of the ATOM and HETATM records of structure files."""
    at = lambda start: F.trim(F.substring("line", start, 8)).try_cast("double")
    records = numbered_lines(spark, path, parts).filter(F.col("line").startswith("ATOM") | F.col("line").startswith("HETATM"))
    return records.select("file", "line_no", F.trim(F.substring("line", 1, 6)).alias("record"), at(31).alias("x"), at(39).alias("y"), at(47).alias("z"))
