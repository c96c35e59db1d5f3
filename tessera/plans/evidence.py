"""Queries over molecule-target evidence: reading, joins, supports, resolution and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import identifier_pattern, n_rows, null_normalised, number, sorted_set, support_category
from tessera.operators import contracts
from tessera.operators.ordered import first_per_key, running_sums
from tessera.plans.registry import ASSOC, TARGETS, TRAIN, Tables, query
from tessera.sources import text_lists

PAIRS = f"(SELECT DISTINCT a.np_id, a.target_id, t.target_id IS NOT NULL AS mapped FROM {ASSOC} a LEFT JOIN {TARGETS} t ON a.target_id = t.target_id)"


def distinct(column: str, alias: str):
    return F.count_distinct(column).alias(alias)


# Reading and cleaning -------------------------------------------------------------------

_RAW = "CASE WHEN o_orderkey % 7 = 0 THEN ' n/a ' WHEN o_orderkey % 7 = 1 THEN 'N/A' WHEN o_orderkey % 7 = 2 THEN '' WHEN o_orderkey % 7 = 3 THEN 'nan' ELSE ' ' || o_orderpriority || ' ' END"


@query(f"""SELECT o_orderkey AS np_id, CASE WHEN trim(raw) NOT IN ('', 'nan', 'None', 'NULL', 'NA', 'N/A') THEN trim(raw) END AS as_table,
  CASE WHEN lower(trim(raw)) NOT IN ('', 'nan', 'none', 'null', 'na', 'n/a') THEN trim(raw) END AS as_knowledge FROM (SELECT o_orderkey, {_RAW} AS raw FROM orders) AS r""")
def null_normalize(t: Tables) -> DataFrame:
    raw = t.molecules.select("np_id", F.expr(_RAW.replace("o_orderkey", "np_id")).alias("raw"))
    return raw.select("np_id", null_normalised(F.col("raw")).alias("as_table"), null_normalised(F.col("raw"), "knowledge").alias("as_knowledge"))


@query("""SELECT o_orderkey AS np_id, lower(trim(o_orderpriority)) AS id_normalized FROM orders""")
def id_normalize(t: Tables) -> DataFrame:
    return t.molecules.select("np_id", F.lower(F.trim("o_orderpriority")).alias("id_normalized"))


@query(f"""SELECT np_id, structure FROM (SELECT o_orderkey AS np_id, {_RAW} AS structure FROM orders) AS r WHERE trim(structure) <> '' AND lower(trim(structure)) NOT IN ('nan', 'n.a.')""")
def clean_filter(t: Tables) -> DataFrame:
    raw = t.molecules.select("np_id", F.expr(_RAW.replace("o_orderkey", "np_id")).alias("structure"))
    return raw.filter(null_normalised(F.col("structure"), "structure").isNotNull())


@query(f"""SELECT valid, CAST(count(*) AS BIGINT) AS n, min(np_id) AS first_id FROM (SELECT o_orderkey AS np_id, NOT (trim({_RAW}) = '' OR lower(trim({_RAW})) IN ('nan', 'n.a.')) AS valid FROM orders) AS r GROUP BY valid""")
def valid_invalid_split(t: Tables) -> DataFrame:
    raw = t.molecules.select("np_id", null_normalised(F.expr(_RAW.replace("o_orderkey", "np_id")), "structure").isNotNull().alias("valid"))
    return raw.groupBy("valid").agg(n_rows().alias("n"), F.min("np_id").alias("first_id"))


@query("""SELECT doc_id, CAST(count(*) FILTER (WHERE TRY_CAST(w AS DOUBLE) IS NULL) AS BIGINT) AS n_invalid, CAST(count(*) FILTER (WHERE TRY_CAST(w AS DOUBLE) IS NOT NULL) AS BIGINT) AS n_number
  FROM (SELECT event_id AS doc_id, unnest([CAST(value AS VARCHAR), event_type, 'x' || CAST(user_id AS VARCHAR)]) AS w FROM events) AS u GROUP BY doc_id""")
def numeric_coercion(t: Tables) -> DataFrame:
    words = t.read("events").select(F.col("event_id").alias("doc_id"), F.explode(F.array(F.col("value").cast("string"), "event_type", F.concat(F.lit("x"), F.col("user_id").cast("string")))).alias("w"))
    return words.groupBy("doc_id").agg(F.count_if(number(F.col("w")).isNull()).alias("n_invalid"), F.count_if(number(F.col("w")).isNotNull()).alias("n_number"))


_X = "CASE WHEN l_linenumber = 1 THEN CAST('nan' AS DOUBLE) WHEN l_linenumber = 2 THEN CAST('inf' AS DOUBLE) WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END"


@query(f"""SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE x IS NULL) AS BIGINT) AS n_null, CAST(count(*) FILTER (WHERE isnan(x)) AS BIGINT) AS n_nan, CAST(count(*) FILTER (WHERE isinf(x)) AS BIGINT) AS n_inf,
  round(avg(x) FILTER (WHERE isfinite(x)), 6) AS mean_finite FROM (SELECT {_X} AS x FROM lineitem) AS r""")
def numeric_qc(t: Tables) -> DataFrame:
    x = F.col("x")
    infinite = F.abs(x) == float("inf")
    return t.read("lineitem").select(F.expr(_X).alias("x")).agg(n_rows().alias("n_rows"), F.count_if(x.isNull()).alias("n_null"), F.count_if(F.isnan(x)).alias("n_nan"), F.count_if(infinite).alias("n_inf"), F.round(F.avg(F.when(~F.isnan(x) & ~infinite, x)), 6).alias("mean_finite"))


@query("""SELECT line_no, CASE WHEN ok THEN CAST(lab AS INTEGER) END AS label, CASE WHEN ok THEN val END AS structure, CASE WHEN NOT ok THEN line END AS bad_line FROM (
  SELECT line_no, line, regexp_extract(line, '^([^\\t ]+)[\\t ]+(.*)$', 1) AS lab, trim(regexp_extract(line, '^([^\\t ]+)[\\t ]+(.*)$', 2)) AS val,
    regexp_extract(line, '^([^\\t ]+)[\\t ]+(.*)$', 1) IN ('0', '1') AND trim(regexp_extract(line, '^([^\\t ]+)[\\t ]+(.*)$', 2)) <> '' AS ok FROM (
    SELECT event_id AS line_no, trim(CASE WHEN event_id % 11 = 0 THEN '# note' WHEN event_id % 11 = 1 THEN '' WHEN event_id % 2 = 0 THEN CAST(user_id % 3 AS VARCHAR) || chr(9) || event_type ELSE CAST(user_id % 3 AS VARCHAR) || ' ' || event_type END) AS line FROM events) AS l
  WHERE line <> '' AND line NOT LIKE '#%') AS p""")
def parse_labelled_lines(t: Tables) -> DataFrame:
    line = "CASE WHEN event_id % 11 = 0 THEN '# note' WHEN event_id % 11 = 1 THEN '' WHEN event_id % 2 = 0 THEN user_id % 3 || chr(9) || event_type ELSE user_id % 3 || ' ' || event_type END"
    return text_lists.parse_labelled(t.read("events").select(F.col("event_id").alias("line_no"), F.expr(line).alias("line")))


@query(f"""SELECT w.target_id, CAST(count(*) AS BIGINT) AS n_rows, min(w.np_id) AS first_np_id FROM {ASSOC} w JOIN (SELECT DISTINCT target_id FROM {ASSOC} a WHERE NOT EXISTS (SELECT 1 FROM {TARGETS} t WHERE t.target_id = a.target_id)) u ON w.target_id = u.target_id GROUP BY w.target_id""")
def id_source_scan(t: Tables) -> DataFrame:
    missing = t.associations.select("target_id").distinct().join(t.targets, "target_id", "left_anti")
    lines = t.associations.select(F.concat_ws("\t", "np_id", "target_id").alias("line"), "np_id")
    found = text_lists.ids_in_lines(lines, missing.select(F.col("target_id").cast("string").alias("id")), field=1)
    return found.groupBy(F.col("id").cast("long").alias("target_id")).agg(n_rows().alias("n_rows"), F.min("np_id").alias("first_np_id"))


@query()
def file_provenance(t: Tables) -> DataFrame:
    return text_lists.provenance(t.spark, t.sf_dir, "*.parquet")


@query("""SELECT p_type AS target_name, CASE WHEN p_type IS NULL OR trim(p_type) = '' THEN 'EMPTY' WHEN regexp_matches(trim(p_type), '^[0-9]+$') THEN 'DIGITS' WHEN regexp_matches(trim(p_type), '^[A-Za-z]+$') THEN 'LETTERS'
  WHEN regexp_matches(trim(p_type), '^[A-Za-z]+[0-9]+$') THEN 'LETTERS_DIGITS' WHEN regexp_matches(trim(p_type), '^[A-Za-z0-9]+([#_:./ -][A-Za-z0-9]+)+$') THEN 'WITH_SEPARATORS' ELSE 'OTHER' END AS pattern, CAST(count(*) AS BIGINT) AS n
  FROM (SELECT p_type FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT CAST(p_size AS VARCHAR) FROM part) AS u GROUP BY 1, 2""", name="identifier_pattern")
def identifier_patterns(t: Tables) -> DataFrame:
    names = t.read("part").select(F.explode(F.array("p_type", "p_brand", F.col("p_size").cast("string"))).alias("target_name"))
    return names.groupBy("target_name", identifier_pattern(F.col("target_name")).alias("pattern")).agg(n_rows().alias("n"))


# Joins ----------------------------------------------------------------------------------


@query(f"""SELECT a.np_id, a.target_id, a.reference_id, o.o_orderstatus, t.target_name, CASE WHEN t.target_name IS NOT NULL OR t.level1 IS NOT NULL OR t.level2 IS NOT NULL THEN 'MAPPED' ELSE 'UNMAPPED' END AS mapping_status
  FROM {ASSOC} a LEFT JOIN (SELECT o_orderkey AS np_id, o_orderstatus FROM orders) o ON a.np_id = o.np_id LEFT JOIN {TARGETS} t ON a.target_id = t.target_id""")
def evidence_master(t: Tables) -> DataFrame:
    joined = t.associations.join(t.molecules.select("np_id", "o_orderstatus"), "np_id", "left").join(t.targets, "target_id", "left")
    mapped = F.coalesce("target_name", "level1", "level2").isNotNull()
    return joined.select("np_id", "target_id", "reference_id", "o_orderstatus", "target_name", F.when(mapped, "MAPPED").otherwise("UNMAPPED").alias("mapping_status"))


@query(f"""SELECT CASE WHEN t.target_id IS NULL THEN 'UNMAPPED' ELSE 'MAPPED' END AS mapping_status, CAST(count(*) AS BIGINT) AS n FROM {ASSOC} a LEFT JOIN {TARGETS} t ON a.target_id = t.target_id GROUP BY 1""")
def mapping_status(t: Tables) -> DataFrame:
    return evidence_master(t).groupBy("mapping_status").agg(n_rows().alias("n"))


@query("""SELECT c_custkey AS id, c_acctbal > 5000 AS active, CASE WHEN c_acctbal > 5000 THEN 'Active' ELSE 'Inactive' END AS label FROM customer""")
def label_by_membership(t: Tables) -> DataFrame:
    active = t.read("customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("id"), F.lit(True).alias("hit"))
    found = t.read("customer").select(F.col("c_custkey").alias("id")).join(active, "id", "left")
    return found.select("id", F.coalesce("hit", F.lit(False)).alias("active"), F.when(F.col("hit"), "Active").otherwise("Inactive").alias("label"))


@query("""SELECT c_mktsegment AS grp, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE c_acctbal > 5000) AS BIGINT) AS n_active, round(100e0 * count(*) FILTER (WHERE c_acctbal > 5000) / count(*), 6) AS active_pct FROM customer GROUP BY 1""")
def class_distribution(t: Tables) -> DataFrame:
    hit = F.count_if(F.col("c_acctbal") > 5000)
    return t.read("customer").groupBy(F.col("c_mktsegment").alias("grp")).agg(n_rows().alias("n"), hit.alias("n_active"), F.round(F.lit(100.0) * hit / n_rows(), 6).alias("active_pct"))


@query("""SELECT o.o_orderkey AS np_id, c.c_acctbal, c.c_mktsegment FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""")
def align_one_to_one(t: Tables) -> DataFrame:
    return t.molecules.join(t.read("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("np_id", "c_acctbal", "c_mktsegment")


@query("""SELECT p.p_partkey AS id, p.p_size, p.p_retailprice, s.n_rows, round(s.mean_quantity, 6) AS mean_quantity FROM part p JOIN (SELECT l_partkey, CAST(count(*) AS BIGINT) AS n_rows, avg(l_quantity) AS mean_quantity FROM lineitem GROUP BY 1) s ON p.p_partkey = s.l_partkey""")
def merge_features(t: Tables) -> DataFrame:
    summary = t.read("lineitem").groupBy(F.col("l_partkey").alias("id")).agg(n_rows().alias("n_rows"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity"))
    return t.read("part").select(F.col("p_partkey").alias("id"), "p_size", "p_retailprice").join(summary, "id")


@query(f"""SELECT coalesce(t.target_id, r.target_id) AS target_id, coalesce(r.status, 'ANNOTATION_ONLY') AS status, coalesce(r.n_records, 0) AS n_records, t.level1
  FROM {TARGETS} t FULL JOIN (SELECT target_id, 'MAPPED' AS status, CAST(count(*) AS BIGINT) AS n_records FROM {ASSOC} a WHERE activity_type = 'R' GROUP BY 1) r ON t.target_id = r.target_id""")
def target_hierarchy_outer(t: Tables) -> DataFrame:
    found = t.associations.filter("activity_type = 'R'").groupBy("target_id").agg(F.lit("MAPPED").alias("status"), n_rows().alias("n_records"))
    joined = t.targets.select("target_id", "level1").join(found, "target_id", "full_outer")
    return joined.select("target_id", F.coalesce("status", F.lit("ANNOTATION_ONLY")).alias("status"), F.coalesce("n_records", F.lit(0).cast("long")).alias("n_records"), "level1")


_RESOLVED = f"(SELECT i.target_id, CASE WHEN t.target_id IS NULL THEN NULL ELSE i.target_id END AS resolved_id FROM (SELECT DISTINCT target_id FROM {ASSOC} a) i LEFT JOIN {TARGETS} t ON i.target_id = t.target_id)"


@query(f"""SELECT a.np_id, a.target_id, r.resolved_id, t.level1, t.level2 FROM {ASSOC} a LEFT JOIN {_RESOLVED} r ON a.target_id = r.target_id LEFT JOIN {TARGETS} t ON r.resolved_id = t.target_id""")
def two_hop_resolution(t: Tables) -> DataFrame:
    known = t.targets.select(F.col("target_id").alias("resolved_id"))
    ids = t.associations.select("target_id").distinct()
    resolved = ids.join(known, ids.target_id == known.resolved_id, "left")
    notes = t.targets.select(F.col("target_id").alias("resolved_id"), "level1", "level2")
    return t.associations.select("np_id", "target_id").join(resolved, "target_id", "left").join(notes, "resolved_id", "left").select("np_id", "target_id", "resolved_id", "level1", "level2")


@query(f"""SELECT DISTINCT target_id FROM {ASSOC} a WHERE target_id IN (SELECT target_id FROM {TARGETS} t)""")
def semi_known_targets(t: Tables) -> DataFrame:
    return t.associations.select("target_id").distinct().join(t.targets, "target_id", "left_semi")


@query(f"""SELECT DISTINCT target_id FROM {ASSOC} a WHERE target_id NOT IN (SELECT target_id FROM {TARGETS} t)""")
def anti_unmapped_targets(t: Tables) -> DataFrame:
    return t.associations.select("target_id").distinct().join(t.targets, "target_id", "left_anti")


@query(f"""SELECT target_id, side FROM (SELECT target_id, 'left_only' AS side FROM (SELECT DISTINCT target_id FROM {ASSOC} a EXCEPT SELECT target_id FROM {TARGETS} t) x UNION ALL SELECT target_id, 'right_only' FROM (SELECT target_id FROM {TARGETS} t EXCEPT SELECT DISTINCT target_id FROM {ASSOC} a) y) AS u""")
def idset_diff(t: Tables) -> DataFrame:
    return contracts.id_differences(t.associations, t.targets, "target_id")


# Supports and summaries ------------------------------------------------------------------


@query(f"SELECT np_id, CAST(count(DISTINCT target_id) AS BIGINT) AS n_targets FROM {ASSOC} a GROUP BY 1")
def targets_per_molecule(t: Tables) -> DataFrame:
    return t.associations.groupBy("np_id").agg(distinct("target_id", "n_targets"))


@query(f"SELECT target_id, CAST(count(DISTINCT np_id) AS BIGINT) AS n_molecules FROM {ASSOC} a GROUP BY 1")
def molecules_per_target(t: Tables) -> DataFrame:
    return t.associations.groupBy("target_id").agg(distinct("np_id", "n_molecules"))


@query(f"SELECT np_id, target_id, CAST(count(DISTINCT reference_id) AS BIGINT) AS n_references, CAST(count(*) AS BIGINT) AS n_records FROM {ASSOC} a GROUP BY 1, 2")
def pair_reference_support(t: Tables) -> DataFrame:
    return t.associations.groupBy("np_id", "target_id").agg(distinct("reference_id", "n_references"), n_rows().alias("n_records"))


@query(f"SELECT target_id, CAST(count(*) AS BIGINT) AS n_records, CAST(count(DISTINCT np_id) AS BIGINT) AS n_molecules, CAST(count(DISTINCT reference_id) AS BIGINT) AS n_references FROM {ASSOC} a WHERE target_id NOT IN (SELECT target_id FROM {TARGETS} t) GROUP BY 1")
def unmapped_summary(t: Tables) -> DataFrame:
    missing = t.associations.join(t.targets, "target_id", "left_anti")
    return missing.groupBy("target_id").agg(n_rows().alias("n_records"), distinct("np_id", "n_molecules"), distinct("reference_id", "n_references"))


@query(f"SELECT activity_type, relation, CAST(count(*) AS BIGINT) AS n_records, CAST(count(DISTINCT np_id) AS BIGINT) AS n_molecules, CAST(count(DISTINCT target_id) AS BIGINT) AS n_targets, CAST(count(DISTINCT reference_id) AS BIGINT) AS n_references FROM {ASSOC} a GROUP BY 1, 2")
def activity_evidence(t: Tables) -> DataFrame:
    return t.associations.groupBy("activity_type", "relation").agg(n_rows().alias("n_records"), distinct("np_id", "n_molecules"), distinct("target_id", "n_targets"), distinct("reference_id", "n_references"))


@query(f"SELECT np_id, CAST(count(DISTINCT target_id) AS BIGINT) AS n_targets, string_agg(DISTINCT CAST(target_id AS VARCHAR), ';' ORDER BY CAST(target_id AS VARCHAR)) AS targets, string_agg(DISTINCT activity_type, ';' ORDER BY activity_type) AS activity_types FROM {ASSOC} a GROUP BY 1")
def molecule_target_summary(t: Tables) -> DataFrame:
    return t.associations.groupBy("np_id").agg(distinct("target_id", "n_targets"), sorted_set(F.col("target_id")).alias("targets"), sorted_set(F.col("activity_type")).alias("activity_types"))


_PAIR_SUPPORT = f"(SELECT np_id, target_id, count(DISTINCT reference_id) AS r, count(*) AS n FROM {ASSOC} a GROUP BY 1, 2)"


@query(f"""SELECT s.target_id, CAST(count(*) AS BIGINT) AS n_molecules, CAST(sum(r) AS BIGINT) AS references_over_pairs, round(avg(r), 6) AS mean_references, round(median(r), 6) AS median_references, CAST(max(r) AS BIGINT) AS max_references, any_value(d.refs) AS distinct_references
  FROM {_PAIR_SUPPORT} s JOIN (SELECT target_id, CAST(count(DISTINCT reference_id) AS BIGINT) AS refs FROM {ASSOC} a GROUP BY 1) d ON s.target_id = d.target_id GROUP BY 1""")
def target_support(t: Tables) -> DataFrame:
    """References summed over pairs, and counted once: both readings of support."""
    pairs = pair_reference_support(t)
    summed = pairs.groupBy("target_id").agg(n_rows().alias("n_molecules"), F.sum("n_references").alias("references_over_pairs"), F.round(F.avg("n_references"), 6).alias("mean_references"), F.round(F.median("n_references"), 6).alias("median_references"), F.max("n_references").alias("max_references"))
    return summed.join(t.associations.groupBy("target_id").agg(distinct("reference_id", "distinct_references")), "target_id")


@query(f"SELECT np_id, CAST(count(*) AS BIGINT) AS n_targets, CAST(sum(n) AS BIGINT) AS n_records, round(avg(r), 6) AS mean_references FROM {_PAIR_SUPPORT} s GROUP BY 1")
def molecule_support(t: Tables) -> DataFrame:
    return pair_reference_support(t).groupBy("np_id").agg(n_rows().alias("n_targets"), F.sum("n_records").alias("n_records"), F.round(F.avg("n_references"), 6).alias("mean_references"))


@query("SELECT l_orderkey, l_partkey, CAST(count(*) AS BIGINT) AS group_size, CAST(count(*) - 1 AS BIGINT) AS extra_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_groups(t: Tables) -> DataFrame:
    return contracts.repeats(t.read("lineitem"), ["l_orderkey", "l_partkey"])


@query(f"SELECT coalesce(level1, '<MISSING>') AS level1, CAST(count(*) AS BIGINT) AS n, round(100e0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM (SELECT a.*, t.level1 FROM {ASSOC} a LEFT JOIN {TARGETS} t ON a.target_id = t.target_id) u GROUP BY 1")
def frequency_table(t: Tables) -> DataFrame:
    counts = t.associations.join(t.targets.select("target_id", "level1"), "target_id", "left").groupBy(F.coalesce("level1", F.lit("<MISSING>")).alias("level1")).agg(n_rows().alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("level1", "n", F.round(F.lit(100.0) * F.col("n") / F.col("total"), 6).alias("pct"))


@query(f"""SELECT k, n, CAST(sum(n) OVER (ORDER BY k) AS BIGINT) AS cum, round(100e0 * sum(n) OVER (ORDER BY k) / sum(n) OVER (), 6) AS cum_pct FROM (SELECT k, CAST(count(*) AS BIGINT) AS n FROM (SELECT CAST(count(DISTINCT np_id) AS BIGINT) AS k FROM {ASSOC} a GROUP BY target_id) s GROUP BY 1) h""")
def support_distribution_cum(t: Tables) -> DataFrame:
    histogram = molecules_per_target(t).groupBy(F.col("n_molecules").alias("k")).agg(n_rows().alias("n"))
    total = histogram.agg(F.sum("n").alias("total"))
    return running_sums(histogram, [], "k", {"cum": "n"}).join(F.broadcast(total)).select("k", "n", "cum", F.round(F.lit(100.0) * F.col("cum") / F.col("total"), 6).alias("cum_pct"))


@query(f"SELECT category, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN k <= 0 THEN 'NO_SUPPORT' WHEN k <= 3 THEN 'VERY_LOW_1_TO_3' WHEN k <= 9 THEN 'LOW_4_TO_9' WHEN k <= 19 THEN 'MODERATE_10_TO_19' ELSE 'HIGH_GE_20' END AS category FROM (SELECT t.target_id, count(DISTINCT a.np_id) AS k FROM {TARGETS} t LEFT JOIN {ASSOC} a ON a.target_id = t.target_id GROUP BY 1) s) c GROUP BY 1", name="support_category")
def support_categories(t: Tables) -> DataFrame:
    n = t.targets.select("target_id").join(molecules_per_target(t), "target_id", "left")
    return n.groupBy(support_category(F.coalesce("n_molecules", F.lit(0))).alias("category")).agg(n_rows().alias("n"))


_NOTES = ("target_name", "level1", "level2", "level3")
_OUTER = f"(SELECT i.target_id, t.target_name, t.level1, t.level2, t.level3 FROM (SELECT DISTINCT target_id FROM {ASSOC} a) i LEFT JOIN {TARGETS} t ON i.target_id = t.target_id)"


def _annotated(t: Tables) -> DataFrame:
    return t.associations.select("target_id").distinct().join(t.targets, "target_id", "left")


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, CAST(count(*) - count({c}) AS BIGINT) AS n_missing, round(100e0 * (count(*) - count({c})) / count(*), 6) AS missing_pct FROM {_OUTER} o" for c in _NOTES))
def missing_summary(t: Tables) -> DataFrame:
    one = _annotated(t).agg(n_rows().alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in _NOTES])
    return one.unpivot(["n"], list(_NOTES), "field", "n_missing").select("field", "n_missing", F.round(F.lit(100.0) * F.col("n_missing") / F.col("n"), 6).alias("missing_pct"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, CAST(count({c}) AS BIGINT) AS n_present, round(100e0 * count({c}) / count(*), 6) AS complete_pct FROM {_OUTER} o" for c in _NOTES))
def annotation_completeness(t: Tables) -> DataFrame:
    one = _annotated(t).agg(n_rows().alias("n"), *[F.count(c).alias(c) for c in _NOTES])
    return one.unpivot(["n"], list(_NOTES), "field", "n_present").select("field", "n_present", F.round(F.lit(100.0) * F.col("n_present") / F.col("n"), 6).alias("complete_pct"))


_LEVELS = {"level1": "p_brand", "level2": "CASE WHEN p_partkey % 5 <> 0 THEN p_type ELSE ' ' END", "level3": "CAST(p_size AS VARCHAR)", "displayed": "CASE WHEN p_partkey % 4 <> 0 THEN p_type END", "kind": "CASE WHEN p_partkey % 7 <> 0 THEN p_name ELSE '' END"}


@query(f"SELECT p_partkey AS target_id, CAST({' + '.join(f'(coalesce(trim({e}), {chr(39)}{chr(39)}) <> {chr(39)}{chr(39)})::INT' for e in _LEVELS.values())} AS INTEGER) AS completeness FROM part")
def hierarchy_completeness(t: Tables) -> DataFrame:
    """How many of the five values of a target's hierarchy are there and not blank."""
    rows = t.read("part").select(F.col("p_partkey").alias("target_id"), *[F.expr(e.replace("VARCHAR", "STRING")).alias(c) for c, e in _LEVELS.items()])
    there = [F.coalesce(F.trim(c) != "", F.lit(False)).cast("int") for c in _LEVELS]
    return rows.select("target_id", sum(there[1:], there[0]).alias("completeness"))


@query(f"SELECT 'level1' AS field, CAST(count(DISTINCT level1) AS BIGINT) AS cardinality FROM {TARGETS} t UNION ALL SELECT 'level2', CAST(count(DISTINCT level2) AS BIGINT) FROM {TARGETS} t UNION ALL SELECT 'level3', CAST(count(DISTINCT level3) AS BIGINT) FROM {TARGETS} t")
def hierarchy_cardinality(t: Tables) -> DataFrame:
    one = t.targets.agg(*[distinct(c, c) for c in _NOTES[1:]])
    return one.unpivot([], list(_NOTES[1:]), "field", "cardinality")


@query(f"SELECT level1, level2, CAST(count(*) AS BIGINT) AS n, grouping(level1) * 2 + grouping(level2) AS grouping_level FROM {TARGETS} t GROUP BY ROLLUP (level1, level2)")
def hierarchy_rollup(t: Tables) -> DataFrame:
    return t.targets.rollup("level1", "level2").agg(n_rows().alias("n"), F.grouping_id().alias("grouping_level"))


@query(f"""SELECT train, CAST(count(*) AS BIGINT) AS n_molecules, CAST(count(*) FILTER (WHERE covered) AS BIGINT) AS n_covered, round(1e0 * count(*) FILTER (WHERE covered) / count(*), 6) AS coverage FROM (SELECT {TRAIN} AS train, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS covered FROM orders) s GROUP BY 1""")
def split_coverage(t: Tables) -> DataFrame:
    hit = t.associations.select("np_id", F.lit(True).alias("covered")).distinct()
    rows = t.molecules.select("np_id", F.expr(TRAIN.replace("o_orderkey", "np_id")).alias("train")).join(hit, "np_id", "left")
    n = F.count_if(F.coalesce("covered", F.lit(False)))
    return rows.groupBy("train").agg(n_rows().alias("n_molecules"), n.alias("n_covered"), F.round(n.cast("double") / n_rows(), 6).alias("coverage"))


@query(f"""SELECT 'records' AS metric, CAST(count(*) AS BIGINT) AS n FROM {ASSOC} a WHERE target_id NOT IN (SELECT target_id FROM {TARGETS} t) UNION ALL SELECT 'pairs', CAST(count(*) AS BIGINT) FROM {PAIRS} p WHERE NOT mapped
  UNION ALL SELECT 'molecules', CAST(count(DISTINCT np_id) AS BIGINT) FROM {PAIRS} p WHERE NOT mapped UNION ALL SELECT 'targets', CAST(count(DISTINCT target_id) AS BIGINT) FROM {PAIRS} p WHERE NOT mapped""")
def unresolved_burden(t: Tables) -> DataFrame:
    missing = t.associations.join(t.targets, "target_id", "left_anti")
    one = missing.agg(n_rows().alias("records"), F.count_distinct("np_id", "target_id").alias("pairs"), distinct("np_id", "molecules"), distinct("target_id", "targets"))
    return one.unpivot([], ["records", "pairs", "molecules", "targets"], "metric", "n")


@query(f"""SELECT np_id, n_mapped, n_unmapped, CASE WHEN n_unmapped = 0 THEN 'ANNOTATED' WHEN n_mapped = 0 THEN 'UNANNOTATED' ELSE 'MIXED' END AS usability FROM (SELECT np_id, CAST(count(*) FILTER (WHERE mapped) AS BIGINT) AS n_mapped, CAST(count(*) FILTER (WHERE NOT mapped) AS BIGINT) AS n_unmapped FROM {PAIRS} p GROUP BY 1) u""")
def molecule_usability(t: Tables) -> DataFrame:
    counts = t.pairs.groupBy("np_id").agg(F.count_if("mapped").alias("n_mapped"), F.count_if(~F.col("mapped")).alias("n_unmapped"))
    return counts.withColumn("usability", F.when(F.col("n_unmapped") == 0, "ANNOTATED").when(F.col("n_mapped") == 0, "UNANNOTATED").otherwise("MIXED"))


@query("""SELECT l_suppkey AS box_id, round(avg(l_quantity), 6) AS center_x, round(avg(l_tax * 100), 6) AS center_y, round(least(126e0, max(l_quantity) - min(l_quantity) + 10), 6) AS size_x, round(least(126e0, max(l_tax * 100) - min(l_tax * 100) + 10), 6) AS size_y FROM lineitem GROUP BY 1""")
def bounding_box(t: Tables) -> DataFrame:
    rows = t.read("lineitem").withColumn("y", F.col("l_tax") * 100)
    size = lambda c: F.round(F.least(F.lit(126.0), F.max(c) - F.min(c) + 10), 6)
    return rows.groupBy(F.col("l_suppkey").alias("box_id")).agg(F.round(F.avg("l_quantity"), 6).alias("center_x"), F.round(F.avg("y"), 6).alias("center_y"), size("l_quantity").alias("size_x"), size("y").alias("size_y"))


@query("""SELECT atom_id, x, y, z FROM (SELECT l_orderkey * 8 + l_linenumber AS atom_id, round(l_quantity, 3) AS x, round(l_tax, 3) AS y, round(l_discount, 3) AS z FROM lineitem) a WHERE atom_id % 2 = 0""")
def fixed_width_atoms(t: Tables) -> DataFrame:
    rows = t.read("lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("atom_id"), "l_quantity", "l_tax", "l_discount")
    number8 = lambda c: F.lpad(F.format_string("%.3f", F.col(c)), 8, " ")
    line = F.concat(F.when(F.col("atom_id") % 2 == 0, "ATOM  ").otherwise("REMARK"), F.rpad(F.col("atom_id").cast("string"), 24, " "), number8("l_quantity"), number8("l_tax"), number8("l_discount"))
    return text_lists.atoms(rows.select("atom_id", line.alias("line")))


# Sets, duplicates, reshaping ---------------------------------------------------------------


@query("SELECT 'customer' AS side, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier")
def union_tables(t: Tables) -> DataFrame:
    one = t.read("customer").select(F.lit("customer").alias("side"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    two = t.read("supplier").select(F.lit("supplier").alias("side"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return one.unionByName(two, allowMissingColumns=True)


@query(f"SELECT o_custkey FROM orders WHERE {TRAIN} INTERSECT SELECT o_custkey FROM orders WHERE NOT {TRAIN}")
def split_overlap(t: Tables) -> DataFrame:
    train = F.expr(TRAIN)
    rows = t.read("orders")
    return rows.filter(train).select("o_custkey").intersect(rows.filter(~train).select("o_custkey"))


@query(f"SELECT DISTINCT np_id, target_id, mapped FROM {PAIRS} p")
def unique_pairs(t: Tables) -> DataFrame:
    return t.pairs


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r FROM lineitem) x WHERE r = 1")
def keep_last_duplicate(t: Tables) -> DataFrame:
    order = [F.col("l_shipdate").desc(), *map(F.col, ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))]
    return first_per_key(t.read("lineitem"), ["l_orderkey"], order).select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")


@query("SELECT c_custkey AS np_id, " + ", ".join(f"CAST(coalesce(max(CASE WHEN o_orderpriority = '{p}' THEN 1 END), 0) AS INTEGER) AS has_{i}, CAST(count(CASE WHEN o_orderpriority = '{p}' THEN 1 END) AS BIGINT) AS n_{i}" for i, p in ((1, "1-URGENT"), (2, "2-HIGH"), (5, "5-LOW"))) + " FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def pivot_binary(t: Tables) -> DataFrame:
    chosen = {"1-URGENT": 1, "2-HIGH": 2, "5-LOW": 5}
    wide = t.read("orders").groupBy(F.col("o_custkey").alias("np_id")).pivot("o_orderpriority", list(chosen)).agg(n_rows())
    full = t.read("customer").select(F.col("c_custkey").alias("np_id")).join(wide, "np_id", "left").na.fill(0)
    return full.select("np_id", *[c for p, i in chosen.items() for c in (F.least(F.col(f"`{p}`"), F.lit(1)).cast("int").alias(f"has_{i}"), F.col(f"`{p}`").alias(f"n_{i}"))])


@query("SELECT c_custkey AS id, 'balance' AS metric, c_acctbal AS metric_value FROM customer UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS DOUBLE) FROM customer")
def wide_to_long(t: Tables) -> DataFrame:
    wide = t.read("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    return wide.unpivot(["id"], ["balance", "nation"], "metric", "metric_value")


# Resolution --------------------------------------------------------------------------------


@query(f"SELECT i.target_id, i.n_records, CASE WHEN t.target_id IS NULL THEN 'UNMAPPED' ELSE 'MAPPED' END AS status FROM (SELECT target_id, CAST(count(*) AS BIGINT) AS n_records FROM {ASSOC} a GROUP BY 1) i LEFT JOIN {TARGETS} t ON i.target_id = t.target_id")
def target_resolution(t: Tables) -> DataFrame:
    counts = t.associations.groupBy("target_id").agg(n_rows().alias("n_records"))
    known = t.targets.select("target_id", F.lit("MAPPED").alias("status"))
    return counts.join(known, "target_id", "left").withColumn("status", F.coalesce("status", F.lit("UNMAPPED")))


@query("""SELECT w.raw_id, CASE WHEN e.id IS NOT NULL THEN 'EXACT' WHEN n.k IS NULL THEN 'UNRESOLVED' WHEN n.k = 1 THEN 'NORMALIZATION_ONLY' ELSE 'AMBIGUOUS' END AS status, CASE WHEN e.id IS NOT NULL THEN e.id WHEN n.k = 1 THEN n.only_id END AS resolved_id
  FROM (SELECT DISTINCT CASE WHEN p_partkey % 5 = 0 THEN ' ' || upper(p_name) || ' ' WHEN p_partkey % 5 = 1 THEN p_name || 'x' ELSE p_name END AS raw_id FROM part) w
  LEFT JOIN (SELECT DISTINCT CASE WHEN length(p_name) % 2 = 0 THEN upper(p_name) ELSE p_name END AS id FROM part UNION SELECT DISTINCT p_name FROM part WHERE p_name LIKE 's%') e ON w.raw_id = e.id
  LEFT JOIN (SELECT lower(trim(id)) AS norm, CAST(count(*) AS BIGINT) AS k, min(id) AS only_id FROM (SELECT DISTINCT CASE WHEN length(p_name) % 2 = 0 THEN upper(p_name) ELSE p_name END AS id FROM part UNION SELECT DISTINCT p_name FROM part WHERE p_name LIKE 's%') d GROUP BY 1) n ON lower(trim(w.raw_id)) = n.norm""")
def normalized_match(t: Tables) -> DataFrame:
    part = t.read("part")
    known = part.select(F.expr("CASE WHEN length(p_name) % 2 = 0 THEN upper(p_name) ELSE p_name END").alias("id")).union(part.filter("p_name LIKE 's%'").select("p_name")).distinct()
    wanted = part.select(F.expr("CASE WHEN p_partkey % 5 = 0 THEN ' ' || upper(p_name) || ' ' WHEN p_partkey % 5 = 1 THEN p_name || 'x' ELSE p_name END").alias("raw_id")).distinct()
    return resolve_ids(wanted, known)


def resolve_ids(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(raw_id, status, resolved_id): exact, unique after normalising, ambiguous, or unresolved. An id is never made up."""
    norm = lambda c: F.lower(F.trim(c))
    groups = known.groupBy(norm("id").alias("norm")).agg(n_rows().alias("k"), F.min("id").alias("only_id"))
    exact = known.select(F.col("id").alias("exact_id"))
    joined = wanted.join(exact, wanted.raw_id == exact.exact_id, "left").withColumn("norm", norm("raw_id")).join(groups, "norm", "left")
    status = F.when(F.col("exact_id").isNotNull(), "EXACT").when(F.col("k").isNull(), "UNRESOLVED").when(F.col("k") == 1, "NORMALIZATION_ONLY").otherwise("AMBIGUOUS")
    return joined.select("raw_id", status.alias("status"), F.coalesce("exact_id", F.when(F.col("k") == 1, F.col("only_id"))).alias("resolved_id"))


_ELSEWHERE = "(SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS id FROM lineitem WHERE l_linenumber = 2 AND l_partkey % 2 = 0)"
_WANTED = f"(SELECT DISTINCT CASE WHEN target_id % 5 = 1 THEN ' ' || target_id || 'A' ELSE CAST(target_id AS VARCHAR) END AS raw_id, CAST(target_id AS VARCHAR) AS plain FROM {ASSOC} a)"
_KNOWN_IDS = f"(SELECT CAST(target_id AS VARCHAR) || CASE WHEN target_id % 5 = 1 THEN 'a' ELSE '' END AS id FROM {TARGETS} t UNION SELECT target_id || 'A' FROM {TARGETS} t WHERE target_id % 20 = 1)"


#: The names of the five states of a resolution, below and in its SQL.
@query(f"""SELECT w.raw_id, CASE WHEN e.id IS NOT NULL THEN 'MAPPED_IN_TARGET_TABLE' WHEN n.k = 1 THEN 'NORMALIZATION_ONLY_MATCH' WHEN n.k > 1 THEN 'UNMAPPED_NO_UNIQUE_ANNOTATION' WHEN s.id IS NOT NULL THEN 'UNMAPPED_BUT_FOUND_IN_OTHER_FILE' ELSE 'UNMAPPED_NO_ANNOTATION' END AS status, CASE WHEN e.id IS NOT NULL THEN e.id WHEN n.k = 1 THEN n.only_id END AS resolved_id
  FROM (SELECT DISTINCT raw_id FROM {_WANTED} x) w LEFT JOIN {_KNOWN_IDS} e ON w.raw_id = e.id LEFT JOIN (SELECT lower(trim(id)) AS norm, count(*) AS k, min(id) AS only_id FROM {_KNOWN_IDS} d GROUP BY 1) n ON lower(trim(w.raw_id)) = n.norm LEFT JOIN {_ELSEWHERE} s ON w.raw_id = s.id""")
def resolution_ladder(t: Tables) -> DataFrame:
    """Five states: mapped, only after normalising, ambiguous, found in another file, nowhere."""
    ids = t.associations.select("target_id").distinct()
    wanted = ids.select(F.expr("CASE WHEN target_id % 5 = 1 THEN concat(' ', target_id, 'A') ELSE CAST(target_id AS STRING) END").alias("raw_id")).distinct()
    known = t.targets.select(F.expr("concat(target_id, CASE WHEN target_id % 5 = 1 THEN 'a' ELSE '' END)").alias("id")).union(t.targets.filter("target_id % 20 = 1").select(F.concat("target_id", F.lit("A")))).distinct()
    elsewhere = t.read("lineitem").filter("l_linenumber = 2 AND l_partkey % 2 = 0").select(F.col("l_partkey").cast("string").alias("id")).distinct()
    return final_states(resolve_ids(wanted, known), elsewhere)


def final_states(resolved: DataFrame, elsewhere: DataFrame) -> DataFrame:
    """resolve_ids() with the states of the ladder; elsewhere: ids that other files mention, from which nothing is taken."""
    found = resolved.join(elsewhere.select(F.col("id").alias("raw_id"), F.lit(True).alias("__found")), "raw_id", "left")
    status = F.col("status")
    state = F.when(status == "EXACT", "MAPPED_IN_TARGET_TABLE").when(status == "NORMALIZATION_ONLY", "NORMALIZATION_ONLY_MATCH").when(status == "AMBIGUOUS", "UNMAPPED_NO_UNIQUE_ANNOTATION").when(F.col("__found"), "UNMAPPED_BUT_FOUND_IN_OTHER_FILE").otherwise("UNMAPPED_NO_ANNOTATION")
    return found.select("raw_id", state.alias("status"), "resolved_id")


@query(f"SELECT mapping_status, CAST(count(*) AS BIGINT) AS n_pairs, CAST(count(DISTINCT np_id) AS BIGINT) AS n_molecules, CAST(count(DISTINCT target_id) AS BIGINT) AS n_targets FROM (SELECT np_id, target_id, CASE WHEN mapped THEN 'MAPPED' ELSE 'UNMAPPED' END AS mapping_status FROM {PAIRS} p) q GROUP BY 1")
def pair_status_distribution(t: Tables) -> DataFrame:
    """Distinct pairs by the state of their target."""
    return t.pairs.groupBy(F.when(F.col("mapped"), "MAPPED").otherwise("UNMAPPED").alias("mapping_status")).agg(n_rows().alias("n_pairs"), distinct("np_id", "n_molecules"), distinct("target_id", "n_targets"))


@query(f"""SELECT section, "check", observed, expected, CASE WHEN observed = expected THEN 'PASS' ELSE 'FAIL' END AS status FROM (
  SELECT 'pairs' AS section, 'pairs are unique' AS "check", CAST((SELECT count(*) FROM (SELECT np_id, target_id FROM {PAIRS} p GROUP BY 1, 2 HAVING count(*) > 1) x) AS VARCHAR) AS observed, '0' AS expected
  UNION ALL SELECT 'records', 'joined rows minus records', CAST((SELECT count(*) FROM {ASSOC} a LEFT JOIN (SELECT o_orderkey FROM orders) o ON a.np_id = o.o_orderkey LEFT JOIN {TARGETS} t ON a.target_id = t.target_id) - (SELECT count(*) FROM {ASSOC} a) AS VARCHAR), '0'
  UNION ALL SELECT 'pairs', 'mapped and unmapped pairs minus all', CAST((SELECT sum(n) FROM (SELECT mapped, count(*) AS n FROM {PAIRS} p GROUP BY 1) m) - (SELECT count(*) FROM (SELECT DISTINCT np_id, target_id FROM {ASSOC} a) d) AS VARCHAR), '0'
  UNION ALL SELECT 'targets', 'repeated annotation ids', CAST((SELECT count(*) FROM (SELECT target_id FROM {TARGETS} t GROUP BY 1 HAVING count(*) > 1) r) AS VARCHAR), '0') AS c""")
def conservation_checks(t: Tables) -> DataFrame:
    count = lambda d, sign: d.agg((n_rows() * sign).alias("n"))
    total = lambda *frames: contracts.ledger(list(frames)).agg(F.sum("n").alias("n"))
    support = t.pairs.groupBy("mapped").agg(n_rows().alias("n"))
    return contracts.ledger([
        contracts.check("pairs", "pairs are unique", contracts.not_unique(t.pairs, ["np_id", "target_id"])),
        contracts.check("records", "joined rows minus records", total(count(evidence_master(t), 1), count(t.associations, -1))),
        contracts.check("pairs", "mapped and unmapped pairs minus all", total(support.select("n"), count(t.associations.select("np_id", "target_id").distinct(), -1))),
        contracts.check("targets", "repeated annotation ids", contracts.not_unique(t.targets, ["target_id"])),
    ])


@query(f"SELECT m.target_id, m.n, t.level1 FROM (SELECT target_id, CAST(count(DISTINCT np_id) AS BIGINT) AS n FROM {ASSOC} a GROUP BY 1) m LEFT JOIN {TARGETS} t ON m.target_id = t.target_id WHERE m.n >= 10")
def high_support_targets(t: Tables) -> DataFrame:
    return molecules_per_target(t).filter("n_molecules >= 10").join(t.targets, "target_id", "left").select("target_id", F.col("n_molecules").alias("n"), "level1")


_RARE = f"(SELECT target_id, CAST(count(DISTINCT np_id) AS BIGINT) AS n FROM {ASSOC} a WHERE activity_type = 'R' AND activity_value > 47 GROUP BY 1)"


@query(f"SELECT m.target_id, m.n, CASE WHEN m.n <= 3 THEN 'LOW' ELSE 'HIGH' END AS cut, t.level1 FROM {_RARE} m LEFT JOIN {TARGETS} t ON m.target_id = t.target_id WHERE m.n <= 3 OR m.n >= 10")
def support_cuts(t: Tables) -> DataFrame:
    """Targets with at most 3 or at least 10 molecules of strong evidence, with their annotation."""
    counts = t.associations.filter("activity_type = 'R' AND activity_value > 47").groupBy("target_id").agg(distinct("np_id", "n"))
    return counts.filter("n <= 3 OR n >= 10").join(t.targets, "target_id", "left").select("target_id", "n", F.when(F.col("n") <= 3, "LOW").otherwise("HIGH").alias("cut"), "level1")


@query("SELECT c_custkey AS np_id, o_orderpriority AS target, CAST(count(*) AS BIGINT) AS n_records, CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS n_references FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2")
def pivot_wide(t: Tables) -> DataFrame:
    """A pivot of records and of distinct references over all values that there are, filled with 0 for every id, and back to the pairs that are not 0."""
    orders = t.read("orders").select(F.col("o_custkey").alias("np_id"), "o_orderpriority", "o_orderstatus")
    wide, values = pivoted(orders, t.read("customer").select(F.col("c_custkey").alias("np_id")), "np_id", "o_orderpriority", {"n_records": n_rows(), "n_references": F.count_distinct("o_orderstatus")})
    stacked = F.explode(F.array(*[F.struct(F.lit(v).alias("target"), *[F.col(f"`{v}_{m}`").alias(m) for m in ("n_records", "n_references")]) for v in values]))
    return wide.select("np_id", stacked.alias("r")).select("np_id", "r.*").filter("n_records > 0")


def pivoted(df: DataFrame, ids: DataFrame, key: str, column: str, measures: dict, most: int = 10_000) -> tuple[DataFrame, list[str]]:
    """A column for each value and measure, 0 where there is none, a row for each of ids; and the values, in order.

    The values are listed first, most of them at most: more are an error, as a table that wide is of no use.
    """
    values = [r[0] for r in df.select(column).distinct().filter(F.col(column).isNotNull()).orderBy(column).limit(most + 1).collect()]
    if len(values) > most:
        raise contracts.ContractError(f"{column} has more than {most} values")
    wide = df.groupBy(key).pivot(column, values).agg(*[m.alias(name) for name, m in measures.items()])
    return ids.join(wide, key, "left").na.fill(0), values


@query("""SELECT text_md5, n_docs, n_labels > 1 AS conflict, round(mean_q, 6) AS mean_quality, min_q, max_q, ids FROM (SELECT md5(d.text) AS text_md5, min(l.quality) AS min_q, max(l.quality) AS max_q, CAST(count(*) AS BIGINT) AS n_docs, count(DISTINCT l.quality) AS n_labels, avg(l.quality) AS mean_q, string_agg(CAST(d.doc_id AS VARCHAR), ';' ORDER BY CAST(d.doc_id AS VARCHAR)) AS ids FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1) g""")
def canonical_groups(t: Tables) -> DataFrame:
    joined = t.read("documents").select("doc_id", F.md5("text").alias("text_md5")).join(t.read("labels"), "doc_id")
    ids = F.array_join(F.array_sort(F.collect_list(F.col("doc_id").cast("string"))), ";")
    return joined.groupBy("text_md5").agg(n_rows().alias("n_docs"), (F.count_distinct("quality") > 1).alias("conflict"), F.round(F.avg("quality"), 6).alias("mean_quality"), F.min("quality").alias("min_q"), F.max("quality").alias("max_q"), ids.alias("ids"))


@query("""SELECT doc_id, n_chars, n_copies FROM (SELECT d.doc_id, c.n_chars, c.n_copies FROM documents d JOIN (SELECT text, CAST(any_value(length(text)) AS BIGINT) AS n_chars, CAST(count(*) AS BIGINT) AS n_copies FROM documents GROUP BY 1) c ON d.text = c.text) x""")
def memoised_duplicates(t: Tables) -> DataFrame:
    """Equal structures are computed once and joined back by digest."""
    docs = t.read("documents").select("doc_id", "text", F.sha2("text", 256).alias("digest"))
    once = docs.groupBy("digest").agg(F.char_length(F.first("text")).cast("long").alias("n_chars"), n_rows().alias("n_copies"))
    return docs.select("doc_id", "digest").join(once, "digest").select("doc_id", "n_chars", "n_copies")
