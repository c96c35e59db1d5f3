"""Queries over the operators of this subpackage, by the names they are registered under."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import cotraining, decontaminate, mixing, pieces, pii, prefix_trie, quality_rules, resampling, sst, substring_dedup, suffix_tree, whole_token
from tessera.llm.jaccard_join import jaccard_components
from tessera.llm.oracles import ORACLE_SQL  # noqa: F401  (read by __spark_entry__)
from tessera.session import plain_unions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return plain_unions(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def trained() -> Column:
    """Whether a row's text is learned from: the CRC-32 of its doc_id as text is not 2 modulo 7; rows without one are."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, F.lit(True))


def op1_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op2_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_token.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), limit=512)


def op3_log_ratio_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoding_digests(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op5_sorted_string_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sst.write_shards(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2)
    return sst.read_shards(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = suffix_tree.suffix_tree_scores(docs.withColumn("trained", trained()))
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_seed_and_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"), window=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("key")


def op11_multinomial_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_ALL = (op1_weak_supervision, op2_whole_token_counts, op3_log_ratio_rules, op4_piece_viterbi, op5_sorted_string_tables, op6_suffix_tree_scores, op7_seed_and_extend, op8_fm_index, op9_ngram_jaccard_join, op10_cotraining, op11_multinomial_mix, op12_prefix_trie, op13_importance_resampling)
QUERIES = {f.__name__: f for f in _ALL}
