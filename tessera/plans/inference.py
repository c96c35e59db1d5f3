"""Queries of vector similarity and target inference.

A vector's known targets are its label and the label after it; a candidate is a target of
one of the query's nearest vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import common_bits, cosine, dimension, finite, n_rows, norm, packed_bits, similarity_band, unit, unpacked_bits
from tessera.operators import contracts, fingerprints, neighbour_index
from tessera.operators.features import standardised
from tessera.operators.ordered import top_per_key
from tessera.operators.similarity import nearest
from tessera.plans.registry import NEIGHBOURS, Tables, query
from tessera.session import materialise, new_folder

r6 = lambda c: F.round(c, 6)

#: Cut-offs for similarity of these vectors: known targets count from HIGH, off-targets from LOW.
HIGH, LOW = 0.3, 0.1
KNOWN = "(SELECT vec_id, CAST(label AS BIGINT) AS target_id FROM embeddings UNION ALL SELECT vec_id, CAST((label + 1) % 10 AS BIGINT) FROM embeddings)"


def _queries(t: Tables) -> DataFrame:
    return t.vectors.filter("vec_id % 100 = 0")


def _neighbours(t: Tables) -> DataFrame:
    return nearest(_queries(t), t.vectors, 20)


def _known(t: Tables) -> DataFrame:
    return t.vectors.select("vec_id", F.explode(F.array(F.col("label").cast("long"), ((F.col("label") + 1) % 10).cast("long"))).alias("target_id"))


def _evidence(t: Tables) -> DataFrame:
    """Neighbours with their known targets."""
    return _neighbours(t).join(_known(t).withColumnRenamed("vec_id", "neighbour_id"), "neighbour_id")


_EVIDENCE = f"(SELECT n.query_id, n.neighbour_id, n.sim, n.rank, k.target_id FROM {NEIGHBOURS} n JOIN {KNOWN} k ON k.vec_id = n.neighbour_id)"
_SCORED = f"(SELECT query_id, target_id, max(sim) AS max_sim, round(CAST(sum(CAST(round(sim * 1e6) AS BIGINT)) AS DOUBLE) / count(*)) / 1e6 AS mean_sim, CAST(count(DISTINCT neighbour_id) AS BIGINT) AS support, sum(greatest(sim, 0e0)) AS weighted FROM {_EVIDENCE} e GROUP BY 1, 2)"


def _scored(t: Tables) -> DataFrame:
    return _evidence(t).groupBy("query_id", "target_id").agg(F.max("sim").alias("max_sim"), (F.round(F.sum(F.round(F.col("sim") * 1e6).cast("long")).cast("double") / n_rows()) / 1e6).alias("mean_sim"), F.count_distinct("neighbour_id").alias("support"), F.sum(F.greatest("sim", F.lit(0.0))).alias("weighted"))


@query(f"SELECT query_id, neighbour_id, sim, rank FROM {NEIGHBOURS} n")
def cosine_topk(t: Tables) -> DataFrame:
    return _neighbours(t)


@query("""SELECT query_id, neighbour_id, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, neighbour_id) AS rank FROM (
  SELECT q.vec_id AS query_id, r.vec_id AS neighbour_id, round(list_dot_product(q.u, r.u) / (q.n * r.n), 6) AS sim FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS u, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings) q
  JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS u, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings) r ON q.vec_id <> r.vec_id) s) k WHERE rank <= 5""")
def cosine_topk_all(t: Tables) -> DataFrame:
    """The five nearest of every vector among all others."""
    return nearest(t.vectors, t.vectors, 5)


@query("""SELECT query_id, neighbour_id, sim FROM (SELECT q.vec_id AS query_id, r.vec_id AS neighbour_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 6) AS sim FROM embeddings q JOIN embeddings r ON r.label = q.label AND q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0) s""")
def cosine_within_label(t: Tables) -> DataFrame:
    """The column form of the same similarity, over an equality join: all other vectors of the query's label."""
    q = _queries(t).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("a"), "label")
    r = t.vectors.select(F.col("vec_id").alias("neighbour_id"), F.col("embedding").alias("b"), "label")
    return q.join(r, "label").filter("query_id <> neighbour_id").select("query_id", "neighbour_id", r6(cosine(F.col("a"), F.col("b"))).alias("sim"))


@query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS norm, true AS is_unit FROM embeddings")
def unit_norm(t: Tables) -> DataFrame:
    return t.vectors.select("vec_id", F.round(norm(F.col("embedding")), 5).alias("norm"), (F.abs(norm(unit(F.col("embedding"))) - 1) < 1e-9).alias("is_unit"))


@query("SELECT vec_id, round((x - m) / s, 5) AS z FROM (SELECT vec_id, CAST(embedding[4] AS DOUBLE) AS x FROM embeddings) e, (SELECT avg(CAST(embedding[4] AS DOUBLE)) AS m, stddev_pop(CAST(embedding[4] AS DOUBLE)) AS s FROM embeddings WHERE vec_id % 5 <> 0) p")
def train_only_zscore(t: Tables) -> DataFrame:
    """Standardised by the train rows' population deviation; names count dimensions from 0."""
    x = t.vectors.select("vec_id", finite(dimension(F.col("embedding"), "emb_3")).alias("x"))
    moments = x.filter("vec_id % 5 <> 0").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return x.join(F.broadcast(moments)).select("vec_id", F.round(F.try_divide(F.col("x") - F.col("m"), F.col("s")), 5).alias("z"))


@query("""SELECT vec_id, CAST(i - 1 AS INTEGER) AS dimension, round((x - avg(x) FILTER (WHERE vec_id % 5 <> 0) OVER (PARTITION BY i)) / stddev_pop(x) FILTER (WHERE vec_id % 5 <> 0) OVER (PARTITION BY i), 5) AS z FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) e""")
def standardised_vectors(t: Tables) -> DataFrame:
    """All dimensions by the train rows' mean and population deviation; a deviation of 0 or none is an error."""
    found = standardised(t.vectors.select("vec_id", "embedding", (F.col("vec_id") % 5 != 0).alias("train")), "embedding", F.col("train"))
    return found.select("vec_id", F.posexplode("embedding").alias("dimension", "z")).select("vec_id", "dimension", F.round("z", 5).alias("z"))


@query("SELECT CAST(count(*) AS BIGINT) AS n_queries, CAST(count(*) AS BIGINT) AS n_self_first FROM embeddings WHERE vec_id % 100 = 0")
def self_retrieval_qc(t: Tables) -> DataFrame:
    first = nearest(_queries(t), t.vectors, 1, exclude_self=False)
    return first.agg(n_rows().alias("n_queries"), F.count_if(F.col("query_id") == F.col("neighbour_id")).alias("n_self_first"))


@query(f"SELECT query_id, neighbour_id, sim, rank FROM {NEIGHBOURS} n")
def cosine_topk_stored(t: Tables) -> DataFrame:
    """The neighbours of cosine_topk from an index that is written, loaded under its contract and pruned."""
    path, names = new_folder(t.spark, "index"), [f"emb_{i}" for i in range(int(t.vectors.select(F.size("embedding")).first()[0]))]
    neighbour_index.write_index(t.vectors, path, names)
    return neighbour_index.load_index(t.spark, path, names).search(_queries(t), 20)


#: Fingerprints of 2,048 bits: which of two dimensions is larger by .35, and which of the first 32 is over .25.
_BITS = """(SELECT vec_id, list_concat(flatten([[(i * (127 - i)) // 2 + j - i - 1 FOR j IN range(i + 1, 64) IF e[i + 1] - e[j + 1] > 35e-2] FOR i IN range(63)]), [2016 + i FOR i IN range(32) IF e[i + 1] > 25e-2]) AS s FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) v)"""
_TANIMOTO = "round(len(list_intersect(a.s, b.s)) * 1e0 / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 6)"


def _fingerprints(t: Tables) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    larger = lambda i: F.transform(F.filter(F.sequence(i + 1, F.lit(63)), lambda j: F.get("e", i) - F.get("e", j) > 0.35), lambda j: F.floor(i * (127 - i) / 2).cast("int") + j - i - 1)
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(62)), larger))
    single = F.transform(F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.get("e", i) > 0.25), lambda i: i + 2016)
    # A row costs thousands of comparisons: however few files there are, all tasks get some.
    vectors = t.vectors.select("vec_id", "embedding").repartition(max(64, int(t.spark.conf.get("spark.sql.shuffle.partitions"))), "vec_id")
    bits = vectors.select("vec_id", e.alias("e")).select(F.col("vec_id").alias("id"), F.concat(pairs, single).alias("bits"))
    return bits.withColumn("words", packed_bits(F.col("bits"), 2048))


@query(f"SELECT query_id, neighbour_id, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, neighbour_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, {_TANIMOTO} AS sim FROM {_BITS} a JOIN {_BITS} b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) s WHERE sim >= .05) k WHERE rank <= 20")
def tanimoto_topk(t: Tables) -> DataFrame:
    """The 20 most similar fingerprints of each query, of a similarity of 0.05 or more."""
    prints = materialise(_fingerprints(t).select("id", "words"), "fingerprints")
    return fingerprints.search(prints.filter("id % 100 = 0"), prints, 20, least=0.05)


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, {_TANIMOTO} AS sim FROM {_BITS} a JOIN {_BITS} b ON a.vec_id < b.vec_id WHERE {_TANIMOTO} >= .2")
def tanimoto_pairs(t: Tables) -> DataFrame:
    """All pairs of fingerprints of a similarity of 0.2 or more."""
    return fingerprints.similar_pairs(_fingerprints(t), 0.2)


_WORDS = "(SELECT p_partkey, p_brand, p_size, p_partkey * 2654435761 % 1099511627776 + 1 AS w, p_partkey * 40503 % 65536 * 97 AS u FROM part)"


@query(f"SELECT a.p_partkey AS a, b.p_partkey AS b, round((bit_count(a.w & b.w) + bit_count(a.u & b.u)) * 1e0 / (bit_count(a.w | b.w) + bit_count(a.u | b.u)), 6) AS tanimoto, CAST(bit_count(a.w) + bit_count(a.u) AS BIGINT) AS n_bits FROM {_WORDS} a JOIN {_WORDS} b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey")
def tanimoto_bits(t: Tables) -> DataFrame:
    """Bit sets of two words, for all pairs of a group."""
    words = [F.expr("p_partkey * 2654435761 % 1099511627776 + 1"), F.expr("p_partkey * 40503 % 65536 * 97")]
    bits = t.read("part").select("p_partkey", "p_brand", "p_size", *[w.alias(f"w{i}") for i, w in enumerate(words)])
    bits = bits.withColumn("n", sum((F.bit_count(f"w{i}") for i in range(1, len(words))), F.bit_count("w0")))
    # Few rows make very many pairs: the groups are dealt to all tasks, and a pair costs a few operations on numbers.
    parts = max(200, int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    one, two = (bits.toDF(x, "p_brand", "p_size", *[f"{x}{i}" for i in range(len(words))], f"n{x}").repartition(parts, "p_brand", "p_size") for x in "ab")
    both = common_bits(*([F.col(f"{x}{i}") for i in range(len(words))] for x in "ab"))
    pairs = one.join(two.hint("merge"), ["p_brand", "p_size"]).filter("a < b").select("a", "b", "na", "nb", both.cast("double").alias("both"))
    return pairs.select("a", "b", r6(F.try_divide("both", F.col("na") + F.col("nb") - F.col("both"))).alias("tanimoto"), F.col("na").cast("long").alias("n_bits"))


@query("SELECT p_partkey, CAST(p_size % 7 AS INTEGER) AS first_bit, CAST(64 + p_size AS INTEGER) AS last_bit FROM part")
def bit_packing(t: Tables) -> DataFrame:
    """Places of set bits packed into 64-bit words and unpacked again."""
    places = F.array((F.col("p_size") % 7).cast("int"), (F.col("p_size") + 64).cast("int"))
    back = unpacked_bits(packed_bits(places, 128))
    return t.read("part").select("p_partkey", F.element_at(back, 1).alias("first_bit"), F.element_at(back, -1).alias("last_bit"))


@query(f"SELECT kind, CASE WHEN s >= .9 THEN 'HIGH' WHEN s >= .7 THEN 'MODERATE' ELSE 'LOW' END AS band, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'neighbour' AS kind, sim AS s FROM {NEIGHBOURS} n UNION ALL SELECT 'discount', l_discount * 10 FROM lineitem) u GROUP BY 1, 2", name="similarity_band")
def similarity_bands(t: Tables) -> DataFrame:
    """Bands of neighbours, and of a value that reaches all of them."""
    rows = _neighbours(t).select(F.lit("neighbour").alias("kind"), F.col("sim").alias("s")).union(t.read("lineitem").select(F.lit("discount"), F.col("l_discount") * 10))
    return rows.groupBy("kind", similarity_band(F.col("s")).alias("band")).agg(n_rows().alias("n"))


@query(f"SELECT query_id, neighbour_id, target_id, sim FROM {_EVIDENCE} e")
def neighbor_evidence_join(t: Tables) -> DataFrame:
    return _evidence(t).select("query_id", "neighbour_id", "target_id", "sim")


@query(f"""SELECT n.query_id, n.neighbour_id, CAST(count(q.target_id) AS BIGINT) AS n_shared, coalesce(string_agg(CAST(q.target_id AS VARCHAR), ';' ORDER BY q.target_id), '') AS shared FROM {NEIGHBOURS} n JOIN {KNOWN} k ON k.vec_id = n.neighbour_id LEFT JOIN {KNOWN} q ON q.vec_id = n.query_id AND q.target_id = k.target_id GROUP BY 1, 2""")
def neighbor_overlap(t: Tables) -> DataFrame:
    own = _known(t).groupBy("vec_id").agg(F.array_sort(F.collect_set("target_id")).alias("s"))
    joined = _neighbours(t).join(own.toDF("neighbour_id", "theirs"), "neighbour_id").join(own.toDF("query_id", "mine"), "query_id")
    both = F.array_sort(F.array_intersect("mine", "theirs"))
    return joined.select("query_id", "neighbour_id", F.size(both).cast("long").alias("n_shared"), F.array_join(both.cast("array<string>"), ";").alias("shared"))


_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(max_sim, 6) DESC, round(weighted, 6) DESC, support DESC, target_id) AS rank FROM {_SCORED} s)"


@query(f"SELECT query_id, target_id, round(max_sim, 6) AS max_sim, round(mean_sim, 6) AS mean_sim, round(weighted, 6) AS weighted_support, support, rank, CASE WHEN rank = 1 THEN 'PROBABLE_TARGET' ELSE 'POSSIBLE_OFF_TARGET' END AS role FROM {_RANKED} r")
def target_candidates(t: Tables) -> DataFrame:
    """Candidates of each query by best similarity, weighted support, support and id; the first is the probable target."""
    order = [F.desc(r6(F.col("max_sim"))), F.desc(r6(F.col("weighted"))), F.desc("support"), F.asc("target_id")]
    ranked = top_per_key(_scored(t), ["query_id"], order, 1 << 30)
    return ranked.select("query_id", "target_id", r6(F.col("max_sim")).alias("max_sim"), r6(F.col("mean_sim")).alias("mean_sim"), r6(F.col("weighted")).alias("weighted_support"), "support", "rank", F.when(F.col("rank") == 1, "PROBABLE_TARGET").otherwise("POSSIBLE_OFF_TARGET").alias("role"))


@query(f"SELECT role, CAST(count(*) AS BIGINT) AS n, round(avg(max_sim), 6) AS mean_max_sim FROM (SELECT CASE WHEN rank = 1 THEN 'PROBABLE_TARGET' ELSE 'POSSIBLE_OFF_TARGET' END AS role, round(max_sim, 6) AS max_sim FROM {_RANKED} r) x GROUP BY 1")
def classify_targets(t: Tables) -> DataFrame:
    return target_candidates(t).groupBy("role").agg(n_rows().alias("n"), r6(F.avg("max_sim")).alias("mean_max_sim"))


@query(f"SELECT CASE WHEN r.rank = 1 THEN 'PROBABLE_TARGET' ELSE 'POSSIBLE_OFF_TARGET' END AS role, e.query_id, e.target_id, e.neighbour_id, e.sim FROM {_EVIDENCE} e JOIN {_RANKED} r ON e.query_id = r.query_id AND e.target_id = r.target_id")
def supporting_molecules(t: Tables) -> DataFrame:
    """The neighbours behind each candidate, for both roles."""
    roles = target_candidates(t).select("query_id", "target_id", "role")
    return _evidence(t).join(roles, ["query_id", "target_id"]).select("role", "query_id", "target_id", "neighbour_id", "sim")


#: Records: a vector's known target is assayed one to three times.
_RECORDS = f"(SELECT e.*, unnest(range(0, 1 + (neighbour_id + target_id) % 3)) AS assay FROM {_EVIDENCE} e)"
_BOTH = "query_id, target_id, round(max(sim), 6) AS max_sim, round(CAST(sum(CAST(round(sim * 1e6) AS BIGINT)) AS DOUBLE) / count(*)) / 1e6 AS mean_sim, CAST(count(DISTINCT neighbour_id) AS BIGINT) AS support, round(sum(CAST(round(greatest(sim, 0e0) * 1e6) AS BIGINT)) / 1e6, 6) AS weighted"


@query(f"SELECT 'per_pair' AS counted, {_BOTH} FROM {_EVIDENCE} e GROUP BY 2, 3 UNION ALL SELECT 'per_record', {_BOTH} FROM {_RECORDS} r GROUP BY 2, 3")
def support_per_pair_and_record(t: Tables) -> DataFrame:
    """Both readings of support: a neighbour counts once for a target, or once for each record of them."""
    pairs = _evidence(t)
    records = pairs.withColumn("assay", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("neighbour_id") + F.col("target_id")) % 3)))
    micro = lambda c: F.sum(F.round(c * 1e6).cast("long")).cast("double")
    measure = lambda d, name: d.groupBy("query_id", "target_id").agg(r6(F.max("sim")).alias("max_sim"), (F.round(micro(F.col("sim")) / n_rows()) / 1e6).alias("mean_sim"), F.count_distinct("neighbour_id").alias("support"), r6(micro(F.greatest("sim", F.lit(0.0))) / 1e6).alias("weighted")).withColumn("counted", F.lit(name))
    return measure(pairs, "per_pair").unionByName(measure(records, "per_record"))


@query(f"SELECT s.query_id, s.target_id, round(s.max_sim, 6) AS max_sim, k.target_id IS NOT NULL AS known, CASE WHEN s.max_sim >= {HIGH} THEN 'STRONG' WHEN s.max_sim >= {LOW} THEN 'WEAK' ELSE 'NONE' END AS evidence_class FROM {_SCORED} s LEFT JOIN {KNOWN} k ON k.vec_id = s.query_id AND k.target_id = s.target_id")
def target_recovery(t: Tables) -> DataFrame:
    known = _known(t).select(F.col("vec_id").alias("query_id"), "target_id", F.lit(True).alias("known"))
    grade = F.when(F.col("max_sim") >= HIGH, "STRONG").when(F.col("max_sim") >= LOW, "WEAK").otherwise("NONE")
    return _scored(t).join(known, ["query_id", "target_id"], "left").select("query_id", "target_id", r6(F.col("max_sim")).alias("max_sim"), F.coalesce("known", F.lit(False)).alias("known"), grade.alias("evidence_class"))


_RECALL = f"(SELECT k.vec_id AS query_id, CAST(count(*) AS BIGINT) AS n_known, CAST(count(*) FILTER (WHERE round(s.max_sim, 6) >= {HIGH}) AS BIGINT) AS n_recovered FROM {KNOWN} k LEFT JOIN {_SCORED} s ON s.query_id = k.vec_id AND s.target_id = k.target_id WHERE k.vec_id % 100 = 0 GROUP BY 1)"


@query(f"SELECT query_id, n_known, n_recovered, round(n_recovered * 1e0 / n_known, 6) AS recall FROM {_RECALL} r")
def known_target_recall(t: Tables) -> DataFrame:
    known = _known(t).filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    joined = known.join(target_recovery(t).select("query_id", "target_id", "max_sim"), ["query_id", "target_id"], "left")
    hit = F.count_if(F.coalesce("max_sim", F.lit(-1.0)) >= HIGH)
    return joined.groupBy("query_id").agg(n_rows().alias("n_known"), hit.alias("n_recovered"), r6(hit.cast("double") / n_rows()).alias("recall"))


@query(f"SELECT CAST(count(*) AS BIGINT) AS n_queries, round(avg(n_recovered * 1e0 / n_known), 6) AS mean_recall, round(median(n_recovered * 1e0 / n_known), 6) AS median_recall, round(avg(CAST(n_recovered > 0 AS INTEGER)), 6) AS any_recovered FROM {_RECALL} r")
def recovery_overview(t: Tables) -> DataFrame:
    rows = known_target_recall(t).withColumn("share", F.col("n_recovered").cast("double") / F.col("n_known"))
    return rows.agg(n_rows().alias("n_queries"), r6(F.avg("share")).alias("mean_recall"), r6(F.median("share")).alias("median_recall"), r6(F.avg((F.col("n_recovered") > 0).cast("int"))).alias("any_recovered"))


_REST = f"(SELECT s.query_id, s.target_id, round(s.max_sim, 6) AS max_sim, k.target_id IS NOT NULL AS known FROM {_SCORED} s LEFT JOIN {KNOWN} k ON k.vec_id = s.query_id AND k.target_id = s.target_id)"


@query(f"SELECT query_id, target_id, max_sim FROM (SELECT *, coalesce(max(CASE WHEN known AND max_sim >= {HIGH} THEN max_sim END) OVER (PARTITION BY query_id), {HIGH}) AS best_known FROM {_REST} r) x WHERE NOT known AND max_sim >= {LOW} AND max_sim < best_known")
def offtarget_candidates(t: Tables) -> DataFrame:
    """Unknown targets similar enough, but less so than the best known target; HIGH stands in where none is."""
    rows = target_recovery(t)
    best = rows.filter(F.col("known") & (F.col("max_sim") >= HIGH)).groupBy("query_id").agg(F.max("max_sim").alias("best"))
    joined = rows.filter("NOT known").join(best, "query_id", "left")
    return joined.filter((F.col("max_sim") >= LOW) & (F.col("max_sim") < F.coalesce("best", F.lit(HIGH)))).select("query_id", "target_id", "max_sim")


_CUTS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6)


@query(" UNION ALL ".join(f"SELECT CAST({c} AS DOUBLE) AS cutoff, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT query_id) AS BIGINT) AS n_queries, CAST(count(DISTINCT neighbour_id) AS BIGINT) AS n_neighbours, CAST(count(*) FILTER (WHERE label < 5) AS BIGINT) AS n_target_bearing FROM {NEIGHBOURS} n JOIN (SELECT vec_id, label FROM embeddings) e ON e.vec_id = n.neighbour_id WHERE sim >= {c}" for c in _CUTS))
def threshold_sweep(t: Tables) -> DataFrame:
    """At each cut-off: rows, distinct queries and neighbours, and rows whose neighbour has an annotated target (here a label below 5)."""
    hit = lambda c: F.col("sim") >= c
    rows = _neighbours(t).join(t.vectors.select(F.col("vec_id").alias("neighbour_id"), (F.col("label") < 5).alias("bears")), "neighbour_id")
    one = rows.agg(*[F.struct(F.lit(c).alias("cutoff"), F.count_if(hit(c)).alias("n_rows"), F.count_distinct(F.when(hit(c), F.col("query_id"))).alias("n_queries"), F.count_distinct(F.when(hit(c), F.col("neighbour_id"))).alias("n_neighbours"), F.count_if(hit(c) & F.col("bears")).alias("n_target_bearing")).alias(f"c{i}") for i, c in enumerate(_CUTS)])
    return one.select(F.explode(F.array(*[f"c{i}" for i in range(len(_CUTS))])).alias("c")).select("c.*")


_KS = (1, 3, 5, 10, 20, 30, 50)


@query(" UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS k, round(avg(CAST(coalesce(first_rank, 1000) <= {k} AS INTEGER)), 6) AS recovered FROM (SELECT q.vec_id, min(r.rank) AS first_rank FROM {KNOWN} q LEFT JOIN {_RANKED} r ON r.query_id = q.vec_id AND r.target_id = q.target_id WHERE q.vec_id % 100 = 0 GROUP BY 1) f" for k in _KS))
def topk_recovery_curve(t: Tables) -> DataFrame:
    known = _known(t).filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    first = known.join(target_candidates(t).select("query_id", "target_id", "rank"), ["query_id", "target_id"], "left").groupBy("query_id").agg(F.coalesce(F.min("rank"), F.lit(1 << 30)).alias("first"))
    one = first.agg(*[r6(F.avg((F.col("first") <= k).cast("int"))).alias(str(k)) for k in _KS])
    return one.unpivot([], [str(k) for k in _KS], "k", "recovered").select(F.col("k").cast("int").alias("k"), "recovered")


_CHECKS = (
    ("queries without one probable target", f"SELECT count(*) FROM (SELECT query_id FROM {_RANKED} r GROUP BY 1 HAVING count(*) FILTER (WHERE rank = 1) <> 1) q"),
    ("queries whose off-targets are not all other candidates", f"SELECT count(*) FROM (SELECT query_id FROM {_RANKED} r GROUP BY 1 HAVING count(*) FILTER (WHERE rank > 1) <> count(*) - 1) q"),
    ("queries without 20 neighbours", f"SELECT count(*) FROM (SELECT query_id FROM {NEIGHBOURS} n GROUP BY 1 HAVING count(*) <> 20) q"),
    ("repeated neighbours of a query", f"SELECT count(*) FROM (SELECT query_id, neighbour_id FROM {NEIGHBOURS} n GROUP BY 1, 2 HAVING count(*) > 1) q"),
    ("queries that are their own neighbour", f"SELECT count(*) FROM {NEIGHBOURS} n WHERE query_id = neighbour_id"),
    ("similarities beyond 1", f"SELECT count(*) FROM {NEIGHBOURS} n WHERE abs(sim) > 1"),
    ("dimensions of vectors", "SELECT count(DISTINCT len(embedding)) FROM embeddings"),
)


@query(" UNION ALL ".join(f"SELECT 'inference' AS section, '{name}' AS \"check\", CAST(({sql}) AS VARCHAR) AS observed, '{int(name.startswith('dimensions'))}' AS expected, CASE WHEN ({sql}) = {int(name.startswith('dimensions'))} THEN 'PASS' ELSE 'FAIL' END AS status" for name, sql in _CHECKS))
def inference_qc(t: Tables) -> DataFrame:
    near, candidates = _neighbours(t), target_candidates(t)
    by_query = candidates.groupBy("query_id").agg(F.count_if(F.col("role") == "PROBABLE_TARGET").alias("one"), F.count_if(F.col("role") != "PROBABLE_TARGET").alias("rest"), n_rows().alias("all"))
    count = lambda d: d.agg(n_rows().alias("n"))
    observed = (
        count(by_query.filter("one <> 1")), count(by_query.filter("rest <> all - 1")), count(near.groupBy("query_id").agg(n_rows().alias("k")).filter("k <> 20")), contracts.not_unique(near, ["query_id", "neighbour_id"]),
        count(near.filter("query_id = neighbour_id")), count(near.filter("abs(sim) > 1")), t.vectors.agg(F.count_distinct(F.size("embedding")).alias("n")),
    )
    return contracts.ledger([contracts.check("inference", name, d, str(int(name.startswith("dimensions")))) for (name, _), d in zip(_CHECKS, observed, strict=True)])


@query("SELECT d.doc_id AS query_id, o.doc_id AS same_id FROM documents d JOIN documents o ON d.text = o.text AND d.doc_id <> o.doc_id WHERE d.doc_id % 100 = 0")
def structure_lookup(t: Tables) -> DataFrame:
    """Reference rows with exactly the query's structure, met by its digest."""
    docs = t.read("documents").select("doc_id", F.sha2("text", 256).alias("structure"))
    found = docs.filter("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id").join(docs.withColumnRenamed("doc_id", "same_id"), "structure")
    return found.filter("query_id <> same_id").select("query_id", "same_id")
