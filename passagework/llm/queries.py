"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from passagework.llm import (
    decontaminate, fingerprints, host_rules, language, lexical, line_dedup, near_dedup, packing, pii, quality, sharding, suffix_dedup, whitening,
)
from passagework.llm.sql import SQL  # noqa: F401  (the queries' SQL, where there is one)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(divisor: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(5) == 0)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents")).drop("kept")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path(), added_tokens=True)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"), remainder(3) == 1)


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judged_texts(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))
    as_text = [fingerprints.fingerprint(F.col(c)).alias(name) for c, name in (("vector", "fingerprint"), ("edited_vector", "edited_fingerprint"))]
    return found.select("doc_id", "n_chars", "edited_sha256", *as_text, "near_edited", "near_next")


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_quality, op3_suffix_dedup, op4_sharding, op5_packing,
        op6_language, op7_host_rules, op8_pii, op9_near_dedup, op10_decontamination,
        op11_whitening, op12_lexical_search, op13_fingerprints,
    )
}
