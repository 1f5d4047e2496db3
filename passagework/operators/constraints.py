"""Checks of the stored tables' declared constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework import fixed


def constraint_report(articles: DataFrame, dim: int = fixed.VECTOR_DIM) -> DataFrame:
    """Violation counts of the article table in one pass."""
    vector = F.col("title_vector")
    return articles.agg(
        F.count_if(F.col("id").isNull()).alias("null_ids"),
        (F.count("id") - F.count_distinct("id")).alias("duplicate_ids"),
        F.count_if(F.col("title").isNull()).alias("null_titles"),
        F.count_if(F.length("title") > fixed.TITLE_MAX_CHARS).alias("long_titles"),
        F.count_if(vector.isNotNull() & (F.size(vector) != dim)).alias("wrong_vectors"),
    )


def fk_violations(chunks: DataFrame, articles: DataFrame) -> DataFrame:
    """Article ids that chunks refer to but that do not exist, with their chunk counts.

    Chunks are counted per article before the join, so one article with very
    many chunks costs one row per task.
    """
    used = chunks.where(F.col("article_id").isNotNull()).groupBy("article_id").agg(
        F.count("*").alias("n_chunks")
    )
    known = articles.select(F.col("id").alias("article_id"))
    return used.join(known, "article_id", "left_anti")


def chunk_constraint_report(chunks: DataFrame, articles: DataFrame, dim: int = fixed.VECTOR_DIM) -> DataFrame:
    """Violation counts of the chunk table; `orphans` are chunks whose article does not exist."""
    vector = F.col("content_chunk_vector")
    orphans = fk_violations(chunks, articles).agg(F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n"))
    return chunks.agg(
        F.count_if(F.col("chunk_id").isNull()).alias("null_ids"),
        (F.count("chunk_id") - F.count_distinct("chunk_id")).alias("duplicate_ids"),
        F.count_if(vector.isNotNull() & (F.size(vector) != dim)).alias("wrong_vectors"),
        F.lit(orphans.first()["n"]).cast("bigint").alias("orphans"),
    )
