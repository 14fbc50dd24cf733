"""The registered query of each corpus operator: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import chroma, decontamination, licenses, packing, periodic_runs, quality, secrets, simhash, spelling, substring_dedup, token_counts, toxicity, url_filters
from quillspark.llm.common import table
from quillspark.llm.token_counts import tokenizer_path


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chroma.grouped(table(spark, sf_dir, "documents"), "doc_id", "text", rate=2000, frame=256, hop=64, sample="u1")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.detect(table(spark, sf_dir, "documents"), planted=F.crc32(F.col("doc_id").cast("string")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), every=199)


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judged(table(spark, sf_dir, "pages"), url_filters.rules_table(spark)).drop("purity")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_chroma_fingerprints, op3_secret_scan, op4_token_counts, op5_decontamination, op6_simhash_golay, op7_substring_dedup, op8_toxicity_neighbours, op9_quality_attention, op10_packing, op11_periodic_runs, op12_spelling_variants, op13_url_filters)}


def oracle_sql() -> dict[str, str]:
    return {op1_license_scan.__name__: licenses.ORACLE_SQL, op12_spelling_variants.__name__: spelling.ORACLE_SQL, op13_url_filters.__name__: url_filters.oracle_sql()}
