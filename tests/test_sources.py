"""Files of lines, inferred types, committed chunks, streams, and the test without the subpackage's folders has its own file."""

import itertools
import math
import random
import shutil

import pytest
from pyspark.sql import functions as F

from tessera.operators import stats
from tessera.sources import commits, inferred, line_files
from tessera.streaming import scoring


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def small_splits(spark):
    """Files are read in byte ranges of 64."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")  if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k) if k not in before else spark.conf.set(k, before[k])


def test_line_numbers_over_many_splits(spark, tmp_path, small_splits):
    rng = random.Random(1)
    files = {f"f{i}.txt": ["x" * rng.choice([0, 1, 5, 30, 200]) + f" {i}:{k}" * rng.randint(0, 1) for k in range(n)] for i, n in enumerate((300, 1, 0, 77))}
    for name, lines in files.items():
        (tmp_path / name).write_text("".join(f"{x}\n" for x in lines))
    (tmp_path / "deeper").mkdir()
    (tmp_path / "deeper" / "bom.txt").write_bytes("﻿first\r\nsecond\r\n\r\nlast without an end".encode())
    found = line_files.numbered_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path / "f0.txt")).rdd.getNumPartitions() > 10
    wanted = [(f, i, x) for f, lines in files.items() for i, x in enumerate(lines, 1)] + [("bom.txt", i, x) for i, x in enumerate(("first", "second", "", "last without an end"), 1)]
    assert values(found.withColumn("file", F.regexp_extract("file", "([^/]+)$", 1))) == sorted(wanted, key=repr)


def test_labelled_lists_and_their_errors(spark, tmp_path, small_splits):
    (tmp_path / "a.txt").write_text("Label\tSMILES\n1\tCCO\n\n# note\n0   C C\nx\tCC\n2\tCC\nalone\n1\t\n 1\tN \nlabel\tSMILES\n" + "0\tCCCC\n" * 40)
    (tmp_path / "b.txt").write_text("class other\n1 O\n")
    good, bad = line_files.labelled_list(spark, str(tmp_path))
    name = F.regexp_extract("file", "([^/]+)$", 1)
    assert values(good.select(name, "line_no", "label", "structure")) == sorted([("a.txt", 2, 1, "CCO"), ("a.txt", 5, 0, "C C"), ("a.txt", 10, 1, "N"), ("b.txt", 2, 1, "O"), *(("a.txt", i, 0, "CCCC") for i in range(12, 52))], key=repr)
    assert {(r[0], r[1]): r[2] for r in bad.select(name, "line_no", "error").collect()} == {
        ("a.txt", 6): "label is no number", ("a.txt", 7): "label is neither 0 nor 1", ("a.txt", 8): "two fields expected", ("a.txt", 9): "two fields expected", ("a.txt", 11): "label is no number", ("b.txt", 1): "label is no number",
    }


def test_named_lists_ids_and_atoms_in_files(spark, tmp_path, small_splits):
    (tmp_path / "n.txt").write_text("Name\tSMILES\n# c\nmy name\tCCO\nbroken\n")
    assert values(line_files.named_list(spark, str(tmp_path / "n.txt")).select("line_no", "name", "structure", "bad_line")) == [(3, "my name", "CCO", None), (4, None, None, "broken")]
    (tmp_path / "ids").mkdir()
    (tmp_path / "ids" / "one.tsv").write_text("".join(f"row {i}\tT{i % 7}\n" for i in range(30)))
    (tmp_path / "ids" / "origin.tsv").write_text("T1\nT2\n")
    found = line_files.id_scan(spark, str(tmp_path / "ids"), spark.createDataFrame([("T1",), ("T9",)], "id string"), "origin.tsv")
    assert [r["line_no"] for r in found.orderBy("line_no").collect()] == [i + 1 for i in range(30) if i % 7 == 1]
    record = "{:<6}{:>5}  CA  ALA A   1    {:8.3f}{:8.3f}{:8.3f}\n"
    (tmp_path / "s.pdb").write_text("HEADER\n" + "".join(record.format("ATOM" if i % 2 else "HETATM", i, i * 1.5, -i, 0.25) for i in range(20)) + "TER\n")
    atoms = line_files.atom_records(spark, str(tmp_path / "s.pdb")).drop("file")
    assert values(atoms) == sorted([(i + 2, "ATOM" if i % 2 else "HETATM", i * 1.5, float(-i), 0.25) for i in range(20)], key=repr)


def test_types_are_found_over_all_values(spark, tmp_path):
    columns = {
        "i": ["1", "-20", "NA", ""], "big": ["1", "99999999999999999999", "3", "4"], "d": ["1", "2.5", "1e-3", "nan"], "b": ["true", "False", None, "NULL"], "t": ["2024-01-31", "2024-02-01 10:11:12", None, ""], "bad_date": ["2024-02-31", "2024-02-01", None, ""],
        "s": ["1", "2", "x", "4"], "tb": ["2024-01-31", "true", None, ""], "none": ["", None, "N/A", "None"], "zero": ["0", "1", "0", "1"],
    }
    texts = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} string" for c in columns)).repartition(3)
    types = inferred.inferred_types(texts)
    assert types == {"i": "long", "big": "double", "d": "double", "b": "boolean", "t": "timestamp", "bad_date": "string", "s": "string", "tb": "string", "none": "string", "zero": "long"}
    assert sorted(r[0] for r in inferred.typed(texts, types).select("d").filter("d IS NOT NULL").collect()) == [0.001, 1.0, 2.5]
    assert values(inferred.conflicts(texts, ["s", "tb"])) == [("s", "long", 3, "1"), ("s", "string", 1, "x"), ("tb", "boolean", 1, "true"), ("tb", "timestamp", 1, "2024-01-31")]
    assert inferred.inferred_types(texts.limit(0)) == dict.fromkeys(columns, "string") and inferred.inferred_types(texts.select()) == {}
    # Any split of the rows gives the same union of kinds.
    parts = [inferred.inferred_types(texts.filter(F.col("zero") == z)) for z in "01"]
    assert parts[0]["s"] in ("long", "string") and parts[1]["d"] == "double"


def test_a_stopped_run_goes_on(spark, tmp_path):
    rows, folder = spark.range(500).withColumnRenamed("id", "k"), str(tmp_path / "run")
    done: list[int] = []

    class Killed(BaseException):
        """Not an error that a run records: the process ends."""

    def work(chunk):
        done.append(1)
        if len(done) == 4:
            raise Killed
        return chunk.withColumn("twice", F.col("k") * 2)

    with pytest.raises(Killed):
        commits.run_chunks(rows, "k", 6, work, folder)
    assert commits.committed(folder) == [0, 1, 2]
    with pytest.raises(RuntimeError):
        commits.results(spark, folder, 6)
    assert commits.run_chunks(rows, "k", 6, work, folder) == {}
    assert len(done) == 4 + 3 and values(commits.results(spark, folder, 6)) == sorted([(k, 2 * k) for k in range(500)], key=repr)
    assert commits.run_chunks(rows, "k", 6, work, folder) == {} and len(done) == 7  # nothing is left to do


def test_a_failed_chunk_is_tried_again_and_reported(spark, tmp_path):
    rows, folder, tries = spark.range(50), str(tmp_path / "run"), []

    def work(chunk):
        tries.append(1)
        if len(tries) in (2, 3):
            raise ValueError("no luck")
        return chunk

    failed = commits.run_chunks(rows, "id", 3, work, folder, attempts=2)
    assert list(failed) == [1] and "no luck" in failed[1] and "no luck" in (tmp_path / "run" / "failed" / "chunk-1.json").read_text()
    assert commits.run_chunks(rows, "id", 3, work, folder) == {} and not (tmp_path / "run" / "failed" / "chunk-1.json").exists()
    assert commits.results(spark, folder, 3).count() == 50


def test_exact_ks_by_enumeration():
    for n1, n0 in ((1, 1), (2, 3), (4, 4), (3, 5), (5, 2), (1, 6)):
        gaps = []
        for ones in itertools.combinations(range(n1 + n0), n1):
            a, gap = 0, 0.0
            for i in range(n1 + n0):
                a += i in ones
                gap = max(gap, abs(a / n1 - (i + 1 - a) / n0))
            gaps.append(gap)
        for ks in sorted({round(g, 12) for g in gaps}):
            assert stats.exact_ks_p(ks, n1, n0) == pytest.approx(sum(g >= ks - 1e-9 for g in gaps) / len(gaps)), (n1, n0, ks)
    assert stats.exact_ks_p(0.0, 5, 7) == 1.0 and stats.exact_ks_p(0.05, 4000, 6000) == pytest.approx(1.2e-5, rel=0.1)
    assert stats.exact_ks_p(1.0, 300, 400) == pytest.approx(2 * math.exp(math.lgamma(301) + math.lgamma(401) - math.lgamma(701)), rel=1e-9)


def test_ks_p_values_name_their_form(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 0.5, 8, 8), ("b", None, 3, 3), ("c", 1.0, 0, 5), ("d", 0.1, 20_000, 5)], "f string, ks double, n1 long, n0 long")
    found = {r["f"]: r["p"] for r in rows.withColumn("p", stats.ks_p_value(F.col("ks"), F.col("n1"), F.col("n0"))).collect()}
    assert found["a"] == pytest.approx(0.2826728, abs=1e-6) and found["b"] is found["c"] is found["d"] is None


def test_a_replayed_batch_replaces_its_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    df.write.parquet(source)
    run = lambda: scoring.score_stream(spark.readStream.schema(df.schema).parquet(source), df, scoring.batch_folder(out), check, k=1).awaitTermination(60)
    run()
    once = values(scoring.batches(spark, out))
    shutil.rmtree(f"{check}/commits")  # as if the run had ended between its write and its commit
    run()
    assert len(once) == 3 and values(scoring.batches(spark, out)) == once


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "ts timestamp, event_type string"

    def arrive(*rows):
        spark.createDataFrame([(t, "a") for t in rows], "t string, event_type string").select(F.col("t").cast("timestamp").alias("ts"), "event_type").coalesce(1).write.mode("append").parquet(source)
        query = scoring.rates_stream(spark.readStream.schema(schema).parquet(source), out, check)
        query.awaitTermination(60)
        return scoring.dropped_late(query)

    assert arrive("2024-01-01 10:01:00", "2024-01-01 10:02:00", "2024-01-01 11:00:00") == 0
    assert arrive("2024-01-01 10:03:00", "2024-01-01 11:01:00", "2024-01-01 12:00:00") == 1  # 10:03 is too late
    found = scoring.batches(spark, out).select(F.date_format("window_start", "HH:mm"), "n")
    assert values(found) == [("10:00", 2), ("11:00", 2)]


def test_outputs_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "out")
    put = lambda n: commits.replace_output(spark, path, lambda folder: spark.range(n).write.parquet(folder))
    put(3)
    put(5)
    assert spark.read.parquet(path).count() == 5 and not (tmp_path / "out.before").exists()

    def broken(folder):
        spark.range(2).write.parquet(folder)
        raise ValueError("no")

    with pytest.raises(ValueError):
        commits.replace_output(spark, path, broken)
    assert spark.read.parquet(path).count() == 5
    (tmp_path / "out").rename(tmp_path / "out.before")  # a process ended between the moves
    with pytest.raises(ValueError):
        commits.replace_output(spark, path, broken)
    assert spark.read.parquet(path).count() == 5
    put(1)
    assert spark.read.parquet(path).count() == 1 and sorted(p.name for p in tmp_path.iterdir()) == ["out"]
