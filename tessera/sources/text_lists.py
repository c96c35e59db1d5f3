"""Line-oriented sources: labelled lists, identifier scans, fixed-width atoms, and file provenance."""

from __future__ import annotations

import hashlib
import json
import traceback
from collections.abc import Callable, Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StringType, StructField, StructType

from tessera.operators.contracts import find_column
from tessera.sources.arrays import place


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A tab-separated table with a header, every column a string; nothing is inferred."""
    return spark.read.csv(path, sep="\t", header=True, schema=StructType([StructField(c, StringType()) for c in columns]))


def significant(c: Column, digits: int) -> Column:
    """A double rounded to so many significant digits; 0, NaN and infinities stay."""
    size = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(c))))
    return F.when((c == 0) | F.isnan(c) | (F.abs(c) == float("inf")), c).otherwise(F.round(c * size) / size)


def write_tsv(df: DataFrame, path: str, digits: int | None = None) -> None:
    """Writes through Spark's commit protocol, so that a reader sees all rows or none; digits: significant digits of doubles."""
    if digits:
        df = df.withColumns({c: significant(F.col(c), digits) for c, kind in df.dtypes if kind in ("double", "float")})
    df.write.csv(path, sep="\t", header=True)


def _without_nan(c: Column, kind: DataType) -> Column:
    """A value with null for NaN and infinities, in arrays, maps and structs too."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _without_nan(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda _, v: _without_nan(v, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[_without_nan(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return c


def json_lines(df: DataFrame) -> DataFrame:
    """(value): one JSON object a row, nulls kept and NaN as null at any depth."""
    clean = df.select(*[_without_nan(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
    return clean.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    """Writes json_lines() as text."""
    json_lines(df).write.text(path)


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of json_lines(), by their schema; a line that is none gives nulls."""
    return spark.read.text(path).select(F.from_json("value", schema).alias("r")).select("r.*")


def parse_labelled(lines: DataFrame) -> DataFrame:
    """(line_no, label, structure, bad_line) from lines (line_no, line) of the form label <tab or space> structure.

    Blank lines and # comments are skipped, and a header where it is the first line; other
    lines that do not parse come back as bad_line.
    """
    text = F.trim("line")
    kept = lines.select("line_no", text.alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    pattern = r"^([^\t ]+)[\t ]+(.*)$"
    label, value = F.regexp_extract("line", pattern, 1), F.trim(F.regexp_extract("line", pattern, 2))
    kept = kept.filter(~((F.col("line_no") == 1) & F.lower(label).isin("label", "activity", "class")))
    ok = label.isin("0", "1") & (value != "")
    return kept.select("line_no", F.when(ok, label.try_cast("int")).alias("label"), F.when(ok, value).alias("structure"), F.when(~ok, F.col("line")).alias("bad_line"))


def parse_named(lines: DataFrame) -> DataFrame:
    """(line_no, name, structure, bad_line) from lines (line_no, line) of the form name <tab> structure.

    Blank lines and # comments are skipped, and a header where it is the first line; a line
    without both parts comes back as bad_line. Names may hold spaces.
    """
    kept = lines.select("line_no", F.rtrim("line").alias("line")).filter((F.trim("line") != "") & ~F.ltrim("line").startswith("#"))
    fields = F.split("line", "\t")
    name, value = F.trim(F.get(fields, F.lit(0))), F.trim(F.coalesce(F.get(fields, F.lit(1)), F.lit("")))
    kept = kept.filter(~((F.col("line_no") == 1) & F.lower(name).isin("name", "id")))
    ok = (name != "") & (value != "")
    return kept.select("line_no", F.when(ok, name).alias("name"), F.when(ok, value).alias("structure"), F.when(~ok, F.col("line")).alias("bad_line"))


def ids_in_lines(lines: DataFrame, ids: DataFrame, field: int | None = None) -> DataFrame:
    """lines joined to the ids (column id) that a tab-separated field of theirs equals (any field without a number)."""
    fields = F.split("line", "\t")
    keys = F.explode(F.array_distinct(fields)) if field is None else F.get(fields, F.lit(field))
    return lines.withColumn("id", keys).join(ids.distinct(), "id")


#: The signs that an id may hold, which may not stand beside an occurrence of it: of a line scan, of an artifact.
LINE_SIGNS, TEXT_SIGNS = "A-Za-z0-9_.:-", "A-Za-z0-9_"


def ids_as_tokens(lines: DataFrame, ids: DataFrame, signs: str = LINE_SIGNS) -> DataFrame:
    """lines (with line) joined to the ids (column id) that occur in them with none of signs on either side, once each.

    A field that equals an id is such an occurrence. Every id starts or ends within some run
    of signs of the line, so lines and ids meet by equality of runs: an id of one run equals
    a run of the line; an id with other characters inside is first met by its longest run,
    then looked for as a whole. No line meets all ids.
    """
    tokens = lines.select("*", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(f"([{signs}]+)"), F.lit(1)))).alias("__token"))
    runs = F.regexp_extract_all("id", F.lit(f"([{signs}]+)"), F.lit(1))
    wanted = ids.select(F.trim("id").alias("id")).filter("id <> ''").distinct()
    longest = F.try_element_at(F.array_sort(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("r")))), F.lit(-1))["r"]
    wanted = wanted.withColumn("__token", longest).filter("__token IS NOT NULL")
    quoted = F.concat(F.lit(f"(?<![{signs}])\\Q"), F.col("id"), F.lit(f"\\E(?![{signs}])"))
    met = tokens.join(wanted, "__token").filter((F.col("id") == F.col("__token")) | F.regexp_like("line", quoted))
    return met.drop("__token")


def source_scan(files: DataFrame, ids: DataFrame, origin: str) -> DataFrame:
    """(id, n_files, n_occurrences) of the ids that files (file, line) other than origin mention: the file that the ids come from tells nothing of them."""
    found = ids_as_tokens(files.filter(F.col("file") != origin), ids)
    return found.groupBy("id").agg(F.count_distinct("file").alias("n_files"), F.count(F.lit(1)).alias("n_occurrences"))


def ids_in_artifact(table: DataFrame, ids: DataFrame, columns: tuple[str, ...] = ("np_id", "ingredient_id", "molecule_id", "id")) -> DataFrame:
    """The ids (column id) that an artifact mentions: in an id column of it, or as a token of any text."""
    wanted = ids.select(F.trim("id").alias("id")).distinct()
    named = find_column(table.columns, list(columns), required=False)
    texts = table.select(F.concat_ws("\t", *[F.col(f"`{c}`").cast("string") for c in table.columns]).alias("line"))
    found = ids_as_tokens(texts, wanted, TEXT_SIGNS).select("id")
    if named:
        found = found.union(table.select(F.trim(F.col(f"`{named}`").cast("string")).alias("id")).join(wanted, "id", "left_semi"))
    return found.distinct()


def atoms(lines: DataFrame) -> DataFrame:
    """(atom_id, x, y, z) of fixed-width ATOM and HETATM records (columns 31-38, 39-46, 47-54)."""
    at = lambda start: F.trim(F.substring("line", start, 8)).try_cast("double")
    return lines.filter(F.col("line").startswith("ATOM") | F.col("line").startswith("HETATM")).select("atom_id", at(31).alias("x"), at(39).alias("y"), at(47).alias("z"))


#: Bytes of a file that are read at a time.
CHUNK = 1 << 20


def discover(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, size_bytes) of the files in a folder and all below it, empty ones too; no content is read. The driver lists them, as for any scan."""
    files, name = place(folder)
    before = folder.removesuffix(name) if folder != name else ""
    listed = files.get_file_info(pafs.FileSelector(name, recursive=True))
    found = [(before + i.path, i.size) for i in listed if i.type == pafs.FileType.File and fnmatchcase(i.base_name, pattern)]
    return spark.createDataFrame(found, "path string, size_bytes long")


def classified(files: DataFrame, kinds: dict[str, str], otherwise: str = "other") -> DataFrame:
    """files (path) with file_kind: the first kind whose pattern the file's name matches, in any case."""
    name = F.lower(F.regexp_extract("path", "([^/]+)$", 1))
    out = F.lit(otherwise)
    for kind, pattern in reversed(kinds.items()):
        out = F.when(name.rlike(pattern), kind).otherwise(out)
    return files.withColumn("file_kind", out)


def provenance(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, size_bytes, sha256) of the files in a folder, with all folders below it; a file is read in chunks, whatever its size."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for path in batch.column(0).to_pylist():
                files, name = place(path)
                digest = hashlib.sha256()
                with files.open_input_stream(name) as f:
                    while chunk := f.read(CHUNK):
                        digest.update(chunk)
                digests.append(digest.hexdigest())
            names = [p.rpartition("/")[2] for p in batch.column(0).to_pylist()]
            yield pa.record_batch({"path": pa.array(names, pa.string()), "size_bytes": batch.column(1), "sha256": pa.array(digests, pa.string())})

    return discover(spark, folder, pattern).repartition("path").mapInArrow(task, "path string, size_bytes long, sha256 string")


def with_manifest(run: Callable[[], DataFrame], spark: SparkSession, path: str) -> DataFrame | None:
    """The result of run; if it raises, a manifest with status, error and traceback is written to path, and the error goes on."""
    try:
        return run()
    except Exception as error:
        manifest = json.dumps({"status": "FAILED", "error": type(error).__name__, "message": str(error), "traceback": traceback.format_exc()})
        spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(path)
        raise


def resume(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that no earlier run has committed."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
