"""Queries over sources and sinks: what is written is read back and compared with the tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import n_rows
from tessera.operators import contracts, features
from tessera.plans.registry import ASSOC, NEIGHBOURS, TARGETS, Tables, query
from tessera.session import materialise, new_folder
from tessera.sources import arrays, commits, inferred, line_files, text_lists
from tessera.streaming import scoring


@query("SELECT c_custkey, c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def tsv_all_strings(t: Tables) -> DataFrame:
    """A tab-separated table, written and read with every column a string."""
    rows, path = t.read("customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"), new_folder(t.spark, "tsv")
    text_lists.write_tsv(rows, path)
    return text_lists.read_tsv(t.spark, path, rows.columns).withColumn("c_custkey", F.col("c_custkey").cast("long"))


_SIGNIFICANT = "round({x} * pow(10e0, 3 - floor(log10(abs({x}))))) / pow(10e0, 3 - floor(log10(abs({x}))))"


@query(f"SELECT p_partkey, round({_SIGNIFICANT.format(x='p_retailprice')}, 6) AS p_retailprice FROM part")
def tsv_significant_digits(t: Tables) -> DataFrame:
    """Doubles with four significant digits, through a file."""
    path = new_folder(t.spark, "digits")
    text_lists.write_tsv(t.read("part").select("p_partkey", "p_retailprice"), path, digits=4)
    back = text_lists.read_tsv(t.spark, path, ["p_partkey", "p_retailprice"])
    return back.select(F.col("p_partkey").cast("long").alias("p_partkey"), F.round(F.col("p_retailprice").cast("double"), 6).alias("p_retailprice"))


@query("SELECT event_id, user_id, CASE WHEN event_id % 5 <> 0 THEN value END AS value, [CASE WHEN event_id % 5 <> 0 THEN value END, CAST(user_id AS DOUBLE)][1] AS first_of_list, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_round_trip(t: Tables) -> DataFrame:
    """Rows as JSON lines with NaN as null, also inside lists, and back; and a field of a JSON column."""
    value = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    rows = t.read("events").select("event_id", "user_id", value.alias("value"), F.array(value, F.col("user_id").cast("double")).alias("list"), "props")
    path = new_folder(t.spark, "json")
    text_lists.write_json(rows, path)
    back = text_lists.read_json(t.spark, path, rows.schema)
    return back.select("event_id", "user_id", "value", F.get("list", F.lit(0)).alias("first_of_list"), F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dimension, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[len(embedding)] AS DOUBLE), 6) AS last FROM embeddings")
def npy_round_trip(t: Tables) -> DataFrame:
    """Dense vectors, written as .npy parts and read back by byte range."""
    folder, width = new_folder(t.spark, "npy"), int(t.vectors.select(F.size("embedding")).first()[0])
    arrays.write_npy(t.vectors.select("vec_id", "embedding"), folder, "vec_id", "embedding", width)
    back = arrays.read_npy(t.spark, folder)
    value = lambda i: F.round(F.element_at("vector", i).cast("double"), 6)
    return back.select(F.col("key").alias("vec_id"), F.size("vector").alias("dimension"), value(1).alias("first"), value(-1).alias("last"))


@query("SELECT 'segment=' || c_mktsegment AS folder, 'facts' AS file_kind, CAST(1 AS BIGINT) AS n_files FROM customer GROUP BY c_mktsegment UNION ALL SELECT 'region=' || r_regionkey, 'lists', 1 FROM region UNION ALL SELECT DISTINCT 'status=' || o_orderstatus, 'other', 1 FROM orders")
def discover_files(t: Tables) -> DataFrame:
    """The files of a folder and all below it, by kind, told by their names; the folders are written from the tables, a file a value."""
    folder = new_folder(t.spark, "discover")
    t.read("customer").select(F.col("c_mktsegment").alias("segment"), "c_name").repartition("segment").write.partitionBy("segment").csv(f"{folder}/a")
    t.read("region").select(F.col("r_regionkey").alias("region"), "r_name").repartition("region").write.partitionBy("region").text(f"{folder}/b")
    t.read("orders").select(F.col("o_orderstatus").alias("status"), "o_custkey").repartition("status").write.partitionBy("status").json(f"{folder}/b/c")
    found = text_lists.classified(text_lists.discover(t.spark, folder, "part-*"), {"facts": "[.]csv$", "lists": "[.]txt$"})
    return found.groupBy(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("folder"), "file_kind").agg(n_rows().alias("n_files"))


def _written_lines(t: Tables, rows: DataFrame, group: str, order: str) -> str:
    """A folder with a folder for each value of group: a text file in parts, by their names in the order of a column, so that no task sorts a whole file."""
    folder = new_folder(t.spark, "lines")
    rows.repartitionByRange(group, order).sortWithinPartitions(group, order).select(group, "line").write.partitionBy(group).text(folder)
    return folder


_EVENT_LINE = "CASE WHEN event_id % 11 = 0 THEN '# note' WHEN event_id % 11 = 1 THEN '' WHEN event_id % 11 = 2 THEN 'alone' WHEN event_id % 2 = 0 THEN {a} || chr(9) || event_type ELSE {a} || ' ' || event_type END"
_NUMBERED = f"(SELECT *, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS BIGINT) AS line_no FROM (SELECT event_type, event_id, user_id % 3 AS lab, {_EVENT_LINE.format(a='CAST(user_id % 3 AS VARCHAR)')} AS line FROM events) e)"


@query(f"SELECT event_type AS file, line_no, CASE WHEN line <> 'alone' AND lab < 2 THEN CAST(lab AS INTEGER) END AS label, CASE WHEN line <> 'alone' AND lab < 2 THEN event_type END AS structure, CASE WHEN line = 'alone' THEN 'two fields expected' WHEN lab > 1 THEN 'label is neither 0 nor 1' END AS error FROM {_NUMBERED} n WHERE line NOT IN ('', '# note')")
def labelled_files(t: Tables) -> DataFrame:
    """Lists of label and structure in a file an event type, read with line numbers, and the lines that are none."""
    rows = t.read("events").select(F.col("event_type").alias("g"), "event_id", F.expr(_EVENT_LINE.format(a="user_id % 3")).alias("line"))
    good, bad = line_files.labelled_list(t.spark, _written_lines(t, rows, "g", "event_id"), parts=True)
    both = good.withColumn("error", F.lit(None).cast("string")).unionByName(bad.drop("line"), allowMissingColumns=True)
    return both.select(F.regexp_extract("file", "g=([^/]+)/", 1).alias("file"), "line_no", "label", "structure", "error")


@query("SELECT CAST(l_suppkey % 5 AS VARCHAR) AS file, line_no, x, y, z FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey % 5 ORDER BY l_orderkey * 8 + l_linenumber, l_quantity, l_tax, l_discount) AS BIGINT) AS line_no, round(l_quantity, 3) AS x, round(l_tax, 3) AS y, round(l_discount, 3) AS z FROM lineitem) l WHERE (l_orderkey * 8 + l_linenumber) % 2 = 0")
def atom_files(t: Tables) -> DataFrame:
    """ATOM records of several structure files, with the lines that they stand on."""
    number8 = lambda c: F.lpad(F.format_string("%.3f", F.col(c)), 8, " ")
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    line = F.concat(F.when(key % 2 == 0, "ATOM  ").otherwise("REMARK"), F.rpad(key.cast("string"), 24, " "), number8("l_quantity"), number8("l_tax"), number8("l_discount"))
    rows = t.read("lineitem").select((F.col("l_suppkey") % 5).alias("g"), F.struct(key.alias("key"), "l_quantity", "l_tax", "l_discount").alias("at"), line.alias("line"))
    found = line_files.atom_records(t.spark, _written_lines(t, rows, "g", "at"), parts=True)
    return found.select(F.regexp_extract("file", "g=([^/]+)/", 1).alias("file"), "line_no", "x", "y", "z")


@query(f"SELECT CAST(target_id AS VARCHAR) AS id, CAST(count(*) AS BIGINT) AS n_lines, min(line_no) AS first_line FROM (SELECT target_id, g, row_number() OVER (PARTITION BY g ORDER BY pos, target_id) AS line_no FROM (SELECT l_partkey AS target_id, l_suppkey % 7 AS g, l_orderkey * 8 + l_linenumber AS pos FROM lineitem) l) n WHERE g <> 3 AND target_id NOT IN (SELECT target_id FROM {TARGETS} t) GROUP BY 1")
def id_file_scan(t: Tables) -> DataFrame:
    """Ids in the lines of several files but the one they come from, with the first line that mentions them."""
    missing = t.associations.select("target_id").distinct().join(t.targets, "target_id", "left_anti").select(F.col("target_id").cast("string").alias("id"))
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    rows = t.read("lineitem").select((F.col("l_suppkey") % 7).alias("g"), F.struct(key.alias("key"), "l_partkey").alias("at"), F.concat(F.lit("see ["), "l_partkey", F.lit("], not x"), "l_partkey").alias("line"))
    folder = _written_lines(t, rows, "g", "at")
    found = line_files.id_scan(t.spark, folder, missing, parts=True).filter(~F.col("file").contains("/g=3/"))
    return found.groupBy("id").agg(n_rows().alias("n_lines"), F.min("line_no").alias("first_line"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 3 = 0 END AS flag FROM orders")
def inferred_scan(t: Tables) -> DataFrame:
    """A tab-separated table, written as text and read back with the types that its values have."""
    path = new_folder(t.spark, "inferred")
    flag = F.when(F.col("o_orderkey") % 4 == 0, F.lit("N/A")).otherwise((F.col("o_orderkey") % 3 == 0).cast("string"))
    text_lists.write_tsv(t.read("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", flag.alias("flag")), path)
    found = inferred.read_inferred(t.spark, path)
    return found.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query("SELECT * FROM (VALUES ('o_orderkey', 'bigint'), ('o_custkey', 'bigint'), ('o_orderstatus', 'string'), ('o_totalprice', 'double'), ('o_orderdate', 'timestamp'), ('mixed', 'string'), ('whole', 'double'), ('none', 'string')) AS v(\"column\", kind)")
def inferred_kinds(t: Tables) -> DataFrame:
    """The types found for the same table with a column of mixed values, one of whole and broken numbers, and one without values."""
    path = new_folder(t.spark, "kinds")
    mixed = F.when(F.col("o_orderkey") % 50 == 0, "none of them").otherwise(F.col("o_custkey").cast("string"))
    whole = F.when(F.col("o_orderkey") % 2 == 0, "1.5").otherwise("7")
    rows = t.read("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", mixed.alias("mixed"), whole.alias("whole"), F.lit("NULL").alias("none"))
    text_lists.write_tsv(rows, path)
    return t.spark.createDataFrame(inferred.read_inferred(t.spark, path).dtypes, "column string, kind string")


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS INTEGER) AS run FROM orders")
def resume_run(t: Tables) -> DataFrame:
    """A first run commits a third of the keys; the second works on those that are not committed yet."""
    keys = t.read("orders").select("o_orderkey")
    done = materialise(keys.filter("o_orderkey % 3 = 0").withColumn("run", F.lit(1)), "run")
    return done.unionByName(text_lists.resume(keys, done, "o_orderkey").withColumn("run", F.lit(2)))


@query("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name FROM customer WHERE c_custkey % 2 = 1")
def replaced_output(t: Tables) -> DataFrame:
    """An output that is written, replaced by another, and kept when a third write breaks off."""
    path, rows = new_folder(t.spark, "output"), t.read("customer").select("c_custkey", "c_name")
    put = lambda keep: commits.replace_output(t.spark, path, lambda folder: text_lists.write_tsv(rows.filter(keep), folder))
    put("c_custkey % 2 = 0")
    put("c_custkey % 2 = 1")
    try:
        put(F.raise_error(F.lit("broken off")).cast("boolean"))
    except Exception as error:
        if "broken off" not in str(error):
            raise
    return text_lists.read_tsv(t.spark, path, rows.columns).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("SELECT o_orderkey, round(o_totalprice * 2, 2) AS doubled FROM orders")
def chunked_run(t: Tables) -> DataFrame:
    """Work in eight committed chunks, two of which fail at first; a second run does these alone, and all rows are there once."""
    rows, folder = t.read("orders").select("o_orderkey", "o_totalprice"), new_folder(t.spark, "chunks")
    work = lambda chunk: chunk.select("o_orderkey", F.round(F.col("o_totalprice") * 2, 2).alias("doubled"))
    broken = F.when(F.pmod(F.xxhash64("o_orderkey"), F.lit(8)).isin(2, 5), F.raise_error(F.lit("broken off")).cast("double")).otherwise(F.col("o_totalprice"))
    commits.run_chunks(rows, "o_orderkey", 8, lambda chunk: work(chunk.withColumn("o_totalprice", broken)), folder, attempts=1)
    commits.run_chunks(rows, "o_orderkey", 8, work, folder)
    return commits.results(t.spark, folder, 8)


@query("SELECT n.n_name AS name, r.r_name AS structure FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE n.n_nationkey % 4 <> 3")
def parse_named_lines(t: Tables) -> DataFrame:
    """A list of name and structure, with comments, blank lines and lines of one part only."""
    joined = t.read("nation").join(t.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.when(F.col("n_nationkey") % 4 == 3, F.col("n_name")).otherwise(F.concat_ws("\t", "n_name", "r_name"))
    lines = joined.select((F.col("n_nationkey") + 3).cast("long").alias("line_no"), line.alias("line"))
    extra = t.spark.createDataFrame([(1, "Name\tSMILES"), (2, "# a comment"), (999, "  ")], "line_no long, line string")
    return text_lists.parse_named(lines.union(extra)).filter("bad_line IS NULL").select("name", "structure")


_MISSING = f"(SELECT DISTINCT target_id FROM {ASSOC} a WHERE target_id NOT IN (SELECT target_id FROM {TARGETS} t))"
_LINES = "(SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN 'associations' WHEN l_linenumber % 3 = 1 THEN 'notes' ELSE 'other' END AS file FROM lineitem)"


@query(f"""SELECT CAST(l_partkey AS VARCHAR) AS id, CAST(count(DISTINCT file) AS BIGINT) AS n_files, CAST(count(*) AS BIGINT) AS n_occurrences FROM {_LINES} l WHERE file <> 'associations' AND l_linenumber % 4 <> 2 AND l_partkey IN (SELECT target_id FROM {_MISSING} m) GROUP BY 1""")
def id_token_scan(t: Tables) -> DataFrame:
    """Ids as tokens of lines: beside signs that no id holds they count, inside longer runs they don't; their own file is left out."""
    missing = t.associations.select("target_id").distinct().join(t.targets, "target_id", "left_anti")
    kind = F.when(F.col("l_linenumber") % 3 == 0, "associations").when(F.col("l_linenumber") % 3 == 1, "notes").otherwise("other")
    tail = F.when(F.col("l_linenumber") % 4 == 2, F.lit("-1)")).otherwise(F.lit(")"))
    lines = t.read("lineitem").select(kind.alias("file"), F.concat(F.lit("order ["), F.col("l_orderkey") + 10**9, F.lit("] has ("), F.col("l_partkey"), tail).alias("line"))
    return text_lists.source_scan(lines, missing.select(F.col("target_id").cast("string").alias("id")), "associations")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 50 = 0 AND (c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0) OR c_custkey IN (SELECT s_suppkey FROM supplier))")
def artifact_id_check(t: Tables) -> DataFrame:
    """Excluded ids that artifacts mention: in an id column of one, or as a token in the text of another."""
    ids = t.read("customer").filter("c_custkey % 50 = 0").select(F.col("c_custkey").cast("string").alias("id"))
    orders = t.read("orders").filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias(" NP_ID "))
    notes = t.read("supplier").select(F.concat(F.lit("see supplier "), "s_suppkey", F.lit(", x"), F.col("s_suppkey") + 1).alias("note"))
    return text_lists.ids_in_artifact(orders, ids).union(text_lists.ids_in_artifact(notes, ids)).distinct()


@query("SELECT strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def stream_event_rates(t: Tables) -> DataFrame:
    """The events table as a stream: counts of all windows, those that the watermark has not passed too; a row that comes too late to be counted is an error."""
    out, checkpoint = new_folder(t.spark, "rates"), new_folder(t.spark, "checkpoint")
    schema = t.read("events").schema
    arriving = t.spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{t.sf_dir}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    query = scoring.rates_stream(arriving, out, checkpoint, mode="update")
    query.awaitTermination()
    if late := scoring.dropped_late(query):
        raise contracts.ContractError(f"{late} rows came after the watermark had passed their window")
    return scoring.latest_rates(t.spark, out).select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n")


@query(f"SELECT query_id, neighbour_id, sim, rank FROM {NEIGHBOURS} n")
def stream_scores(t: Tables) -> DataFrame:
    """Vectors as a stream: each micro-batch gets its neighbours, in a folder of its own; the same rows as cosine_topk."""
    out, checkpoint = new_folder(t.spark, "scores"), new_folder(t.spark, "checkpoint")
    arriving = t.spark.readStream.schema(t.vectors.schema).parquet(f"{t.sf_dir}/embeddings*.parquet").filter("vec_id % 100 = 0")
    scoring.score_stream(arriving, t.vectors, scoring.batch_folder(out), checkpoint).awaitTermination()
    return scoring.batches(t.spark, out).drop("batch")


# Contracts -------------------------------------------------------------------------------------


def _customer_file(t: Tables, header: list[str]) -> DataFrame:
    """Four columns of customers, written as a tab-separated file with that header and read by it, all strings."""
    path = new_folder(t.spark, "customers")
    text_lists.write_tsv(t.read("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").toDF(*header), path)
    return t.spark.read.csv(path, sep="\t", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


_HEADER = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer")
def trimmed_headers(t: Tables) -> DataFrame:
    """The rows of a file whose header is padded, by the trimmed names."""
    return contracts.trim_headers(_customer_file(t, ["  c_custkey", "c_name  ", " c_nationkey ", "c_mktsegment"])).select(*_HEADER)


@query("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name || '|' || c_nationkey || '|' || c_custkey || '|' || c_mktsegment AS line FROM customer")
def priority_order(t: Tables) -> DataFrame:
    """The fields of a file's rows with the named columns first; a name that is not there is passed over."""
    found = contracts.priority_columns(_customer_file(t, _HEADER), ["c_name", "nowhere", "c_nationkey"])
    return found.select(F.col("c_custkey").cast("long").alias("c_custkey"), F.concat_ws("|", *found.columns).alias("line"))


@query("SELECT wanted, (SELECT CAST(count(*) AS BIGINT) FROM customer) AS n_rows FROM (VALUES ('c_phone'), ('c_comment')) AS v(wanted)")
def missing_columns(t: Tables) -> DataFrame:
    """What a required-column contract finds missing in a file, and how many rows lack it; require_columns() raises with these."""
    rows = _customer_file(t, _HEADER)
    wanted = contracts.missing_columns(rows, ["c_custkey", "c_phone", "c_name", "c_comment"])
    return rows.agg(n_rows().alias("n_rows")).select(F.explode(F.array(*map(F.lit, wanted))).alias("wanted"), "n_rows")


@query("SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation, c_mktsegment AS segment FROM customer")
def resolved_columns(t: Tables) -> DataFrame:
    """The rows of a file by columns found by their exact name, by name in any case, and by containing the words; a price is nowhere."""
    rows = _customer_file(t, ["C_CustKey", "c_name", "customer nation key", "mkt_segment"])
    at = lambda *names: F.col(f"`{contracts.find_column(rows.columns, list(names))}`")
    none = contracts.find_column(rows.columns, ["price"], required=False)
    found = rows.select(at("c_custkey").cast("long").alias("id"), at("label", "c_name").alias("name"), at("nation_key").cast("long").alias("nation"), at("segment").alias("segment"))
    return found.filter(F.lit(none).isNull())


_NUMERIC = {"l_linenumber": "l_linenumber", "l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "l_discount": "l_discount", "l_tax": "l_tax"}


@query(" UNION ALL ".join(f"SELECT '{c}' AS predictor, round(avg({c}), 4) AS mean FROM lineitem" for c in _NUMERIC))
def allowed_predictors(t: Tables) -> DataFrame:
    """Numeric columns with a finite value that are neither identifiers nor forbidden by name, and their means."""
    rows = t.read("lineitem").withColumn("empty", F.lit(None).cast("double")).withColumn("broken", F.lit(float("nan")))
    kept = contracts.usable_predictors(rows, ["L_OrderKey", "l_partkey", "l_suppkey"])
    return features.column_summary(rows, kept, mean=lambda c: F.round(F.avg(c), 4)).select(F.col("feature").alias("predictor"), "mean")


@query("SELECT * FROM (VALUES ('c_custkey', 'bigint', 'OK'), ('c_name', 'string', 'MISSING'), ('c_nationkey', 'bigint', 'TYPE'), ('c_mktsegment', 'string', 'OK'), ('extra', NULL, 'EXTRA')) AS v(\"column\", expected, state), (SELECT CAST(count(*) AS BIGINT) AS n_rows FROM customer) n")
def locked_schema(t: Tables) -> DataFrame:
    """A file against its locked schema: one column is missing, one has another type, one is more; and the rows that this concerns."""
    rows = _customer_file(t, ["c_custkey", "extra", "c_nationkey", "c_mktsegment"]).withColumn("c_custkey", F.col("c_custkey").cast("long"))
    found = contracts.schema_differences(rows, {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "bigint", "c_mktsegment": "string"})
    return found.join(F.broadcast(rows.agg(n_rows().alias("n_rows"))))


@query("SELECT CAST(count(*) FILTER (WHERE s = 'PASS') AS BIGINT) AS n_pass, CAST(count(*) FILTER (WHERE s = 'REVIEW') AS BIGINT) AS n_review, CAST(count(*) FILTER (WHERE s = 'FAIL') AS BIGINT) AS n_fail, CASE WHEN count(*) FILTER (WHERE s = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) FILTER (WHERE s = 'REVIEW') > 0 THEN 'PASS_WITH_REVIEW' ELSE 'PASS' END AS verdict FROM (SELECT CASE WHEN avg(l_discount) > .051 THEN 'REVIEW' ELSE 'PASS' END AS s FROM lineitem GROUP BY l_suppkey) k")
def final_gate(t: Tables) -> DataFrame:
    """The verdict over a ledger with a row a supplier."""
    # Exact sums: a mean of doubles that lies at the limit falls to either side of it by the order of its rows. Missing
    # values count for nothing; where one is no decimal (NaN, infinite or huge) the mean can't be at the limit.
    exact = F.col("l_discount").try_cast("decimal(28,15)")
    over = F.when(F.count(exact) == F.count("l_discount"), F.sum(exact) > F.count(exact) * F.lit(Decimal("0.051"))).otherwise(F.avg("l_discount") > 0.051)
    rows = t.read("lineitem").groupBy("l_suppkey").agg(F.when(over, "REVIEW").otherwise("PASS").alias("status"))
    return contracts.gate(rows)


@query("SELECT valid, np_id FROM (SELECT o_orderkey AS np_id, o_totalprice > 150000 AS valid FROM orders) r")
def split_outputs(t: Tables) -> DataFrame:
    """Both outputs of a split, each with its rows."""
    kept, rest = contracts.split(t.read("orders").select(F.col("o_orderkey").alias("np_id"), "o_totalprice"), F.col("o_totalprice") > 150000)
    return kept.select(F.lit(True).alias("valid"), "np_id").unionByName(rest.select(F.lit(False).alias("valid"), "np_id"))


@query("SELECT o.o_orderkey AS np_id, c.c_mktsegment, c.c_acctbal FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey")
def asserted_many_to_one(t: Tables) -> DataFrame:
    """A left join that fails if the right side repeats a key or the left side's rows change in number."""
    right = t.read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    return contracts.join_many_to_one(t.read("orders").select(F.col("o_orderkey").alias("np_id"), "o_custkey"), right, ["o_custkey"]).select("np_id", "c_mktsegment", "c_acctbal")


@query("SELECT p_partkey AS id, p_name, p_size FROM part")
def asserted_one_to_one(t: Tables) -> DataFrame:
    """A left join that fails unless both sides have each key once."""
    part = t.read("part")
    return contracts.join_one_to_one(part.select(F.col("p_partkey").alias("id"), "p_name"), part.select(F.col("p_partkey").alias("id"), "p_size"), ["id"])


@query("SELECT p.p_partkey AS id, p.p_size, s.n FROM part p JOIN (SELECT l_partkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1) s ON p.p_partkey = s.l_partkey")
def guarded_inner(t: Tables) -> DataFrame:
    """An inner join that fails if it loses more rows than allowed."""
    counts = t.read("lineitem").groupBy(F.col("l_partkey").alias("id")).agg(n_rows().alias("n"))
    return contracts.join_guarded(t.read("part").select(F.col("p_partkey").alias("id"), "p_size"), counts, ["id"], least_share=0.5)


@query("SELECT o.o_orderkey, l.l_partkey, l.l_quantity FROM orders o LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r FROM lineitem) x WHERE r = 1) l ON o.o_orderkey = l.l_orderkey")
def join_last_result(t: Tables) -> DataFrame:
    """A left join to the last of repeated results."""
    order = [F.col("l_shipdate").desc(), *map(F.col, ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))]
    right = t.read("lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return contracts.join_last(t.read("orders").select("o_orderkey"), right, ["o_orderkey"], order).select("o_orderkey", "l_partkey", "l_quantity")


@query("SELECT p, n FROM (SELECT l_discount * 20 - .1 AS p, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1) c WHERE p BETWEEN 0 AND 1")
def clipped_thresholds(t: Tables) -> DataFrame:
    """Finite thresholds from 0 to 1, for curves; they come sorted."""
    counts = t.read("lineitem").groupBy((F.col("l_discount") * 20 - 0.1).alias("p")).agg(n_rows().alias("n"))
    return contracts.clipped(counts.union(t.spark.createDataFrame([(float("nan"), 1), (float("inf"), 1), (None, 1)], counts.schema)), "p")


@query("SELECT rank, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (ORDER BY (l_returnflag = 'R') DESC, CASE WHEN l_linenumber % 5 <> 0 THEN l_extendedprice END DESC NULLS LAST, l_discount, l_orderkey, l_linenumber, l_partkey, l_quantity) AS rank FROM lineitem) r WHERE rank <= 5000")
def sorted_head(t: Tables) -> DataFrame:
    """The first 5,000 rows by keys of mixed direction, with missing and NaN values last."""
    price = F.when(F.col("l_linenumber") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("l_extendedprice"))
    rows = t.read("lineitem").withColumn("relevant", (F.col("l_returnflag") == "R").cast("int")).withColumn("effect", price)
    return contracts.sorted_head(rows, {"relevant": "desc", "effect": "desc", "l_discount": "asc", "l_orderkey": "asc", "l_linenumber": "asc", "l_partkey": "asc", "l_quantity": "asc"}, 5000).select("rank", "l_orderkey", "l_linenumber")
