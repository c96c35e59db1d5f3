"""Queries of feature screens and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import finite, n_rows
from tessera.operators import contracts, features, heavy, molecules, structures
from tessera.plans.registry import FEATURES, LONG, Tables, query
from tessera.session import materialise

r6 = lambda c: F.round(c, 6)

#: Features of line items: b equals a, c follows a closely, d is constant, e misses a quarter.
_WIDE = {"a": "l_quantity", "b": "l_quantity * 1e0", "c": "l_quantity + l_tax", "d": "1e0", "e": "CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_discount END", "f": "CASE WHEN l_linenumber = 7 THEN CAST('nan' AS DOUBLE) ELSE l_extendedprice END"}
WIDE = "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate >= TIMESTAMP '1996-01-01' AS train, CAST(l_returnflag = 'R' AS INTEGER) AS y, " + ", ".join(f"{e} AS {c}" for c, e in _WIDE.items()) + " FROM lineitem)"
_FINITE = "(SELECT * REPLACE (" + ", ".join(f"CASE WHEN isfinite({c}) THEN {c} END AS {c}" for c in _WIDE) + f") FROM {WIDE} w)"


def _wide(t: Tables) -> DataFrame:
    return t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr("l_shipdate >= TIMESTAMP '1996-01-01'").alias("train"), (F.col("l_returnflag") == "R").cast("int").alias("y"), *[F.expr(e).alias(c) for c, e in _WIDE.items()])


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg(CAST({c} IS NULL AS INTEGER)), 6) AS missing_share, avg(CAST({c} IS NULL AS INTEGER)) > .2 AS dropped FROM {_FINITE} w WHERE train" for c in _WIDE))
def missingness_screen(t: Tables) -> DataFrame:
    found = features.column_summary(_wide(t).filter("train"), list(_WIDE), share=features.missing_share)
    return found.select("feature", r6(F.col("share")).alias("missing_share"), (F.col("share") > 0.2).alias("dropped"))


@query(f"SELECT w.train, round(avg(coalesce(w.e, m.e)), 6) AS mean_e, round(avg(coalesce(w.f, m.f)), 4) AS mean_f, CAST(count(*) FILTER (WHERE w.e IS NULL) AS BIGINT) AS n_imputed FROM {_FINITE} w, (SELECT median(e) AS e, median(f) AS f FROM {_FINITE} v WHERE train) m GROUP BY 1")
def median_impute(t: Tables) -> DataFrame:
    wide = _wide(t).withColumn("gap", finite(F.col("e")).isNull())
    filled = features.impute(wide, F.col("train"), ["e", "f"])
    return filled.groupBy("train").agg(r6(F.avg("e")).alias("mean_e"), F.round(F.avg("f"), 4).alias("mean_f"), F.count_if("gap").alias("n_imputed"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(var_pop({c}), 4) AS variance, var_pop({c}) <= 1e-12 AS dropped FROM {_FINITE} w WHERE train" for c in _WIDE))
def variance_screen(t: Tables) -> DataFrame:
    found = features.column_summary(_wide(t).filter("train"), list(_WIDE), variance=lambda c: F.var_pop(finite(c)))
    return found.select("feature", F.round("variance", 4).alias("variance"), (F.col("variance") <= 1e-12).alias("dropped"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(median({c}), 6) AS median, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS sd, min({c}) AS minimum, max({c}) AS maximum FROM {_FINITE} w WHERE train" for c in _WIDE))
def train_statistics(t: Tables) -> DataFrame:
    train = _wide(t).filter("train")
    found = features.column_summary(train, list(_WIDE), mean=lambda c: F.avg(finite(c)), sd=lambda c: F.stddev_pop(finite(c)), minimum=lambda c: F.min(finite(c)), maximum=lambda c: F.max(finite(c)))
    found = found.join(features.medians(train, list(_WIDE)), "feature", "left")
    return found.select("feature", r6(F.col("median")).alias("median"), F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), F.col("minimum").cast("double").alias("minimum"), F.col("maximum").cast("double").alias("maximum"))


def _identical(rows: str, columns: str) -> str:
    """Columns that equal an earlier one, with the first that they equal."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    equal = " UNION ALL ".join(f"SELECT '{a}' AS kept, '{b}' AS dropped FROM {rows} w HAVING bool_and({a} IS NOT DISTINCT FROM {b})" for a, b in pairs)
    return f"SELECT min(kept) AS kept, dropped FROM ({equal}) e GROUP BY dropped"


@query(_identical(f"(SELECT * FROM {WIDE} v WHERE train)", "abcdef"))
def identical_features(t: Tables) -> DataFrame:
    pairs = features.identical_columns(_wide(t).filter("train"), "l_orderkey", list(_WIDE))
    return t.spark.createDataFrame(pairs, "kept string, dropped string")


@query(_identical(f"(SELECT * FROM {WIDE} v WHERE NOT train AND l_linenumber % 4 = 0)", "abcdef"))
def identical_in_test(t: Tables) -> DataFrame:
    """Equal columns among test rows: a report, nothing is dropped for it."""
    pairs = features.identical_columns(_wide(t).filter("NOT train AND l_linenumber % 4 = 0"), "l_orderkey", list(_WIDE))
    return t.spark.createDataFrame(pairs, "kept string, dropped string")


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature FROM {WIDE} w WHERE l_linenumber % 4 = 0 HAVING count(CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN 1 END) = 0" for c in "abcdef"))
def all_missing_columns(t: Tables) -> DataFrame:
    """Columns without a finite value over train and test together."""
    return t.spark.createDataFrame([(c,) for c in features.all_missing(_wide(t).filter("l_linenumber % 4 = 0"), list(_WIDE))], "feature string")


_PAIRS = [(a, b) for i, a in enumerate("abcdef") for b in "abcdef"[i + 1 :]]
_CORRELATED = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM {_FINITE} w WHERE train" for a, b in _PAIRS)


@query(f"SELECT a, b, CASE WHEN isfinite(r) THEN round(r, 6) END AS r FROM ({_CORRELATED}) c")
def correlation_pairs(t: Tables) -> DataFrame:
    """All pairs; a constant column correlates with nothing."""
    return features.correlations(_wide(t).filter("train"), list(_WIDE)).select("a", "b", r6(finite(F.col("r"))).alias("r"))


@query(f"""WITH RECURSIVE high AS (SELECT a, b FROM ({_CORRELATED}) c WHERE isfinite(r) AND abs(r) > .95), pairs AS (SELECT list({{'a': a, 'b': b}}) AS p FROM high),
step(j, dropped) AS (SELECT 0, CAST([] AS VARCHAR[]) UNION ALL SELECT j + 1, CASE WHEN len(list_filter(p, lambda x: x.b = 'abcdef'[j + 1] AND NOT list_contains(dropped, x.a))) > 0 THEN list_append(dropped, 'abcdef'[j + 1]) ELSE dropped END FROM step, pairs WHERE j < 6)
SELECT unnest(dropped) AS dropped, true AS greedy FROM step WHERE j = 6 UNION ALL SELECT DISTINCT b, false FROM high""")
def correlation_screen(t: Tables) -> DataFrame:
    """Both variants; features are few, so the order-dependent choice is made over their small matrix."""
    pairs = features.high_pairs(_wide(t).filter("train"), list(_WIDE))
    rows = [(c, greedy) for greedy in (True, False) for c in features.correlation_screen(pairs, list(_WIDE), greedy=greedy)]
    return t.spark.createDataFrame(rows, "dropped string, greedy boolean")


_DOMINANT = f"""(SELECT feature, CAST(sum(n) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS n_distinct, max(CASE WHEN place = 1 THEN n END) AS n1, max(CASE WHEN place = 2 THEN n END) AS n2 FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, v) AS place FROM (SELECT feature, v, count(*) AS n FROM {LONG} l WHERE train GROUP BY 1, 2) c) p GROUP BY 1)"""


def _shares(t: Tables) -> DataFrame:
    """The most common values of the wide features' train rows, their share and its ratio to the next."""
    found = heavy.dominant_values(t.wide_features.filter("train"), list(FEATURES))
    n = F.col("n_first").cast("double")
    return found.withColumns({"dominant_share": n / F.col("n"), "frequency_ratio": F.try_divide(n, F.col("n_second").cast("double"))})


@query(f"SELECT feature, n_distinct, round(n1 * 1e0 / n, 6) AS dominant_share, round(n1 * 1e0 / n2, 6) AS frequency_ratio, n1 * 1e0 / n >= .95 AND n1 * 1e0 / n2 >= 19 AS near_zero_variance FROM {_DOMINANT} d")
def near_zero_variance(t: Tables) -> DataFrame:
    """All distinct values are counted."""
    flag = (F.col("dominant_share") >= 0.95) & (F.col("frequency_ratio") >= 19)
    shares = heavy.with_distinct(_shares(t), t.wide_features.filter("train"))
    return shares.select("feature", "n_distinct", r6(F.col("dominant_share")).alias("dominant_share"), r6(F.col("frequency_ratio")).alias("frequency_ratio"), flag.alias("near_zero_variance"))


@query(f"SELECT feature, CASE WHEN n_distinct = 1 OR n1 * 1e0 / n >= .999 THEN 'REMOVE' WHEN n1 * 1e0 / n >= .1 THEN 'REVIEW' ELSE 'KEEP' END AS decision FROM {_DOMINANT} d")
def nzv_decision(t: Tables) -> DataFrame:
    share = F.col("dominant_share")
    decision = F.when((F.col("n_distinct") == 1) | (share >= 0.999), "REMOVE").when(share >= 0.1, "REVIEW").otherwise("KEEP")
    return _shares(t).select("feature", decision.alias("decision"))


@query(f"SELECT v, CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS n_active, round(avg(y), 6) AS active_share FROM {LONG} l WHERE feature = 'discount' AND train GROUP BY 1")
def activity_value_table(t: Tables) -> DataFrame:
    return t.features.filter("feature = 'discount' AND train").groupBy("v").agg(n_rows().alias("n"), F.sum("y").alias("n_active"), r6(F.avg("y")).alias("active_share"))


@query(f"SELECT feature, round(corr(v, CAST(y AS DOUBLE)), 6) AS r FROM {LONG} l WHERE train GROUP BY 1")
def point_biserial(t: Tables) -> DataFrame:
    return t.features.filter("train").groupBy("feature").agg(r6(F.corr("v", F.col("y").cast("double"))).alias("r"))


_TOP = "(SELECT {c} AS v, count(*) AS k FROM {w} w WHERE isfinite(CAST({c} AS DOUBLE)) GROUP BY 1 ORDER BY k DESC, v LIMIT 1)"


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(count(*) FILTER (WHERE {c} IS NULL OR isnan({c})) AS BIGINT) AS n_missing, CAST(count(*) FILTER (WHERE isinf({c})) AS BIGINT) AS n_infinite, CAST(count(DISTINCT CASE WHEN isfinite({c}) THEN {c} END) AS BIGINT) AS n_distinct, CAST((SELECT v FROM {_TOP.format(c=c, w=WIDE)} t) AS DOUBLE) AS dominant, round((SELECT k FROM {_TOP.format(c=c, w=WIDE)} t) * 1e0 / count(CASE WHEN isfinite({c}) THEN 1 END), 6) AS dominant_share, 'double' AS dtype FROM {WIDE} w" for c in _WIDE))
def column_profile(t: Tables) -> DataFrame:
    missing = lambda c: F.count_if(c.isNull() | F.isnan(c.cast("double")))
    wide = _wide(t).withColumns({c: F.col(c).cast("double") for c in _WIDE})
    found = features.column_summary(wide, list(_WIDE), n_missing=missing, n_infinite=lambda c: F.count_if(F.abs(c) == float("inf")))
    long = wide.select(*[finite(F.col(c)).alias(c) for c in _WIDE]).unpivot([], list(_WIDE), "feature", "v").filter("v IS NOT NULL")
    top = features.dominance(long).select("feature", "n_distinct", "dominant", "dominant_share")
    kinds = t.spark.createDataFrame([(c, kind) for c, kind in wide.dtypes if c in _WIDE], "feature string, dtype string")
    return found.join(top, "feature", "left").join(F.broadcast(kinds), "feature").select("feature", "n_missing", "n_infinite", "n_distinct", "dominant", r6(F.col("dominant_share")).alias("dominant_share"), "dtype")


@query(f"SELECT 'copy' AS feature, bool_and(y = 1 - inverse) AS leaks FROM (SELECT y, 1 - y AS inverse FROM {WIDE} w) a UNION ALL SELECT 'a', bool_and(a = y) OR bool_and(a = 1 - y) FROM {WIDE} w")
def leakage_scan(t: Tables) -> DataFrame:
    wide = _wide(t).withColumn("copy", 1 - F.col("y"))
    return features.column_summary(wide, ["copy", "a"], leaks=lambda c: F.bool_and(c == F.col("y")) | F.bool_and(c == 1 - F.col("y")))


_PLACED = "(SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42:' || CAST(c_custkey AS VARCHAR)), c_custkey) AS place, count(*) OVER (PARTITION BY c_mktsegment) AS size FROM customer)"


@query(f"SELECT c_custkey, c_mktsegment, place <= round(size * .2e0) AS test FROM {_PLACED} p")
def stratified_split(t: Tables) -> DataFrame:
    return features.stratified_split(t.read("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", F.col("c_custkey"))


@query(f"SELECT c_custkey, c_mktsegment, CAST((place - 1) % 5 AS INTEGER) AS fold FROM {_PLACED} p")
def fold_assignment(t: Tables) -> DataFrame:
    """Five folds, dealt within each stratum."""
    return features.stratified_folds(t.read("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", F.col("c_custkey"))


@query("SELECT CAST(p_size AS BIGINT) AS size, CAST(floor(p_retailprice / 100) AS BIGINT) AS price, CAST(count(*) AS BIGINT) AS group_size, CAST(count(*) - 1 AS BIGINT) AS extra_rows FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_vectors(t: Tables) -> DataFrame:
    """Feature vectors that several rows share."""
    vector = F.array(F.col("p_size").cast("long"), F.floor(F.col("p_retailprice") / 100)).alias("vector")
    return contracts.repeats(t.read("part").select(vector), ["vector"]).select(F.col("vector")[0].alias("size"), F.col("vector")[1].alias("price"), "group_size", "extra_rows")


@query("SELECT l_returnflag || ':' || l_linestatus AS \"group\", CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def manifest_subset(t: Tables) -> DataFrame:
    """Columns by an ordered manifest; the subset must have them in that order."""
    manifest = ["l_returnflag", "l_linestatus"]
    rows = contracts.subset(t.read("lineitem"), manifest)
    contracts.same_order(rows.columns, manifest)
    return rows.groupBy(F.concat_ws(":", *manifest).alias("group")).agg(n_rows().alias("n"))


#: Structures of parts: a type's words joined by signs; every seventh is not closed, every eleventh is missing.
_STRUCTURE = "CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN '(' || replace(p_type, ' ', '-') ELSE replace(p_type, ' ', '-') || '(' || p_size || ')' END"
_CANONICAL = f"(SELECT p_partkey AS id, CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 7 <> 0 THEN {_STRUCTURE} END AS c FROM part)"


def _parsed(t: Tables) -> DataFrame:
    rows = t.read("part").select(F.col("p_partkey").alias("id"), F.expr(_STRUCTURE).alias("structure"))
    return structures.parse_structures(rows).select("id", "parsed.*")


@query(f"SELECT id, c IS NOT NULL AS valid, c AS canonical FROM {_CANONICAL} s")
def parsed_structures(t: Tables) -> DataFrame:
    return _parsed(t).select("id", "valid", "canonical")


@query(f"SELECT id, length(c) * 1e0 AS length, length(regexp_replace(c, '[^A-Z]', '', 'g')) * 1e0 AS n_upper, length(regexp_replace(c, '[^0-9]', '', 'g')) * 1e0 AS n_digits FROM {_CANONICAL} s")
def descriptors(t: Tables) -> DataFrame:
    """Descriptors of a structure as one array; nulls where there is none."""
    found = structures.structure_descriptors(_parsed(t))
    return found.select("id", *[F.col("descriptors")[i].alias(name) for i, name in enumerate(structures.PlainToolkit.descriptors)])


@query(f"SELECT id, CASE WHEN c IS NULL THEN 'NO_STRUCTURE' ELSE 'SUCCESS' END AS status, CASE WHEN c IS NOT NULL THEN 'PLAIN' END AS method, round(list_avg(list_transform(range(1, length(c) + 1), lambda i: unicode(c[i]))), 6) AS energy, CASE WHEN c IS NOT NULL THEN regexp_matches(c, 'Li|Na|Mg|Al|Ca|Fe|Co|Ni|Cu|Zn|Ag|Pt|Au|Hg|Pb') END AS metal FROM {_CANONICAL} s")
def conformer_status(t: Tables) -> DataFrame:
    """Status, method, energy and the metal flag of each row."""
    return structures.conformers(_parsed(t)).select("id", "status", "method", r6(F.col("energy")).alias("energy"), "metal")


@query(f"SELECT id, CAST(len(list_distinct(list_transform(range(1, length(c)), lambda i: (31 * unicode(c[i]) + unicode(c[i + 1])) % 2048))) AS BIGINT) AS n_bits FROM {_CANONICAL} s")
def fingerprint_bits(t: Tables) -> DataFrame:
    """Set bits of each fingerprint."""
    ones = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(2048 // 8)), lambda i: F.bit_count(F.conv(F.hex(F.substring("fingerprint", i, F.lit(1))), 16, 10).cast("int"))), F.lit(0), lambda s, x: s + x)
    return structures.fingerprints(_parsed(t)).select("id", F.when(F.col("fingerprint").isNotNull(), ones).cast("long").alias("n_bits"))


@query(f"SELECT id, CAST(26 AS INTEGER) AS dimension, round((length(lower(c)) - length(replace(lower(c), 'a', ''))) * 1e0 / length(c), 5) AS first FROM {_CANONICAL} s WHERE c IS NOT NULL")
def structure_embeddings(t: Tables) -> DataFrame:
    found = structures.embeddings(_parsed(t)).filter("embedding IS NOT NULL")
    return found.select("id", F.size("embedding").alias("dimension"), F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(coalesce(w.e, m.e), 6) AS e, round(coalesce(w.f, m.f), 4) AS f, CASE WHEN w.e IS NULL AND w.f IS NULL THEN 'e;f' WHEN w.e IS NULL THEN 'e' WHEN w.f IS NULL THEN 'f' ELSE '' END AS imputed FROM {_FINITE} w, (SELECT median(e) AS e, median(f) AS f FROM {_FINITE} v WHERE train) m")
def median_fallback(t: Tables) -> DataFrame:
    """Query rows with the train medians where a feature is missing, and the names of those."""
    gone = F.array_join(F.filter(F.array(*[F.when(finite(F.col(c)).isNull(), F.lit(c)) for c in "ef"]), lambda x: x.isNotNull()), ";")
    filled = features.impute(_wide(t).withColumn("imputed", gone), F.col("train"), ["e", "f"])
    return filled.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(F.col("e")).alias("e"), F.round("f", 4).alias("f"), "imputed")


@query("SELECT md5(text) AS structure FROM documents WHERE doc_id % 5 <> 0 INTERSECT SELECT md5(text) FROM documents WHERE doc_id % 5 = 0")
def structure_overlap(t: Tables) -> DataFrame:
    """Structures on both sides of a split by row: a warning, not an error."""
    rows = t.read("documents").select("doc_id", F.md5("text").alias("structure"))
    return rows.filter("doc_id % 5 <> 0").select("structure").intersect(rows.filter("doc_id % 5 = 0").select("structure"))


# Structures as graphs ----------------------------------------------------------------------

#: Structures made from orders: an atom a line, bonds between lines that follow each other, and one from the last to the first of three or more.
_ATOMS = "(SELECT l_orderkey AS structure, l_linenumber AS atom, min(l_returnflag || l_linestatus) AS label, CASE WHEN min(l_quantity) > 25 THEN '2.0' ELSE '1.0' END AS bond FROM lineitem GROUP BY 1, 2)"
_BONDS = f"(SELECT structure, atom AS a, nxt AS b, bond FROM (SELECT *, lead(atom) OVER (PARTITION BY structure ORDER BY atom) AS nxt FROM {_ATOMS} a) x WHERE nxt IS NOT NULL UNION ALL SELECT structure, max(atom), min(atom), '1.0' FROM {_ATOMS} a GROUP BY 1 HAVING count(*) > 2)"
_ROUND = "{new} AS (SELECT c.structure, c.atom, md5(c.colour || ':' || coalesce(string_agg(n.bond || o.colour, ',' ORDER BY n.bond || o.colour), '')) AS colour FROM {old} c LEFT JOIN near n ON n.structure = c.structure AND n.atom = c.atom LEFT JOIN {old} o ON o.structure = n.structure AND o.atom = n.other GROUP BY c.structure, c.atom, c.colour)"
_COLOURS = f"WITH near AS MATERIALIZED (SELECT structure, a AS atom, b AS other, bond FROM {_BONDS} b UNION ALL SELECT structure, b, a, bond FROM {_BONDS} b), c0 AS MATERIALIZED (SELECT structure, atom, md5(label) AS colour FROM {_ATOMS} a), " + _ROUND.format(new="c1", old="c0") + ", " + _ROUND.format(new="c2", old="c1")


def _graphs(t: Tables) -> tuple[DataFrame, DataFrame]:
    bond = F.when(F.min("l_quantity") > 25, "2.0").otherwise("1.0")
    atoms = t.read("lineitem").groupBy(F.col("l_orderkey").alias("structure"), F.col("l_linenumber").alias("atom")).agg(F.min(F.concat("l_returnflag", "l_linestatus")).alias("label"), bond.alias("bond"))
    atoms = materialise(atoms, "atoms")
    row = Window.partitionBy("structure").orderBy("atom")
    chain = atoms.withColumn("b", F.lead("atom").over(row)).filter("b IS NOT NULL").select("structure", F.col("atom").alias("a"), "b", "bond")
    ring = atoms.groupBy("structure").agg(F.max("atom").alias("a"), F.min("atom").alias("b"), n_rows().alias("n")).filter("n > 2").select("structure", "a", "b", F.lit("1.0").alias("bond"))
    return atoms, chain.unionByName(ring)


@query(f"{_COLOURS} SELECT structure, CAST(count(*) AS BIGINT) AS n_atoms, md5(string_agg(colour, ',' ORDER BY colour)) AS class FROM c2 GROUP BY 1")
def structure_classes(t: Tables) -> DataFrame:
    """Classes of equal structures by two rounds of colour refinement."""
    return molecules.classes(molecules.refined(*_graphs(t), 2)[-1])


@query(f"{_COLOURS} SELECT structure, CAST(count(*) AS BIGINT) AS n_bits, CAST(sum(bit) AS BIGINT) AS bit_sum FROM (SELECT DISTINCT structure, CAST('0x' || substr(colour, 1, 8) AS BIGINT) % 2048 AS bit FROM (SELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2) u) b GROUP BY 1")
def circular_fingerprints(t: Tables) -> DataFrame:
    """Number and sum of the bits of circular fingerprints of radius 2."""
    found = molecules.circular_bits(molecules.refined(*_graphs(t), 2))
    return found.select("structure", F.size("bits").cast("long").alias("n_bits"), F.aggregate("bits", F.lit(0).cast("long"), lambda s, b: s + b).alias("bit_sum"))


@query(f"SELECT a.structure, n_atoms, coalesce(n_bonds, 0) AS n_bonds, n_ends, most_bonds, coalesce(n_bonds, 0) - n_atoms + 1 AS n_rings FROM (SELECT structure, CAST(count(*) AS BIGINT) AS n_atoms, CAST(count(*) FILTER (WHERE d = 1) AS BIGINT) AS n_ends, CAST(max(d) AS BIGINT) AS most_bonds FROM (SELECT a.structure, a.atom, (SELECT count(*) FROM {_BONDS} b WHERE b.structure = a.structure AND (b.a = a.atom OR b.b = a.atom)) AS d FROM {_ATOMS} a) x GROUP BY 1) a LEFT JOIN (SELECT structure, CAST(count(*) AS BIGINT) AS n_bonds FROM {_BONDS} b GROUP BY 1) n ON n.structure = a.structure")
def graph_descriptors(t: Tables) -> DataFrame:
    """Counts of atoms, bonds, ends and rings."""
    found = molecules.graph_counts(*_graphs(t))
    return found.withColumn("most_bonds", F.col("most_bonds").cast("long"))


@query()
def parsed_molecules(t: Tables) -> DataFrame:
    """Line notations made from the parts' keys, a piece a digit, parsed into atoms and bonds; their composition and class."""
    pieces = F.array(*map(F.lit, ("C", "N", "O", "(C)", "(=O)", "c1ccccc1", "C(N)", "S", "[Na+].C", "F")))
    digits = F.filter(F.split(F.col("p_partkey").cast("string"), ""), lambda d: d != "")
    text = F.concat(F.lit("C"), F.array_join(F.transform(digits, lambda d: F.get(pieces, d.cast("int"))), ""))
    # A small file of parts makes much work: its rows are dealt to all tasks.
    dealt = t.read("part").select("p_partkey").repartition(max(200, int(t.spark.conf.get("spark.sql.shuffle.partitions"))), "p_partkey")
    found = materialise(molecules.parsed(dealt.select(F.col("p_partkey").alias("id"), text.alias("structure"))), "parsed")
    atoms, bonds = molecules.tables(found)
    # Few kinds of atoms make small files of many rows: no side is broadcast.
    made, of = molecules.composition(atoms).hint("merge"), molecules.classes(molecules.refined(atoms, bonds, 3)[-1]).hint("merge")
    return found.select("structure", "error").join(made, "structure", "left").join(of, "structure", "left")
