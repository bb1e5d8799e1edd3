"""The queries of the thirteen operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import centroids, class_lm, decontaminate, language_id, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, sql, substring_dedup, token_files, vector_codes, warc
from weftline.llm.common import crc_mod, table

TOKENIZER, VOCABULARY = "byte_bpe_50k.json", 50_257


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")), "v1")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mixing.plan(table(spark, sf_dir, "documents"))
    return p.select("doc_id", "size", "source_size", "target", "taken")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.withColumn("kept", F.col("tail_probability") >= quality_classifier.LEAST_TAIL)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) == 2)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), VOCABULARY)
    return files.select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 4) == 2)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.codes(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op12_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, final = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return found.withColumn("centroid_sha256", centroids.of_cluster(centroids.digests(final), "string"))


_ALL = [op1_quality_rules, op2_minhash_near_dedup, op3_line_dedup, op4_source_mixing, op5_quality_classifier, op6_substring_dedup, op7_class_lm, op8_benchmark_decontamination, op9_token_files, op10_language_id, op11_vector_codes, op12_warc_normaliser, op13_centroid_clustering]
QUERIES = {f.__name__: f for f in _ALL}
ORACLE: dict[str, str] = {
    "op1_quality_rules": sql.QUALITY_RULES,
    "op2_minhash_near_dedup": sql.NEAR_DEDUP,
    "op4_source_mixing": sql.SOURCE_MIXING,
    "op6_substring_dedup": sql.SUBSTRING_DEDUP,
    "op8_benchmark_decontamination": sql.DECONTAMINATION,
    "op11_vector_codes": sql.VECTOR_CODES,
    "op12_warc_normaliser": sql.WARC,
    "op13_centroid_clustering": sql.CENTROIDS,
}
