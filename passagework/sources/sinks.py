"""Appending writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework import schemas


def create_table(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """An empty table at `path`, unless something is stored there already."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """`df` with exactly the columns of `schema`; absent ones are NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def append_articles(rows: DataFrame, path: str) -> DataFrame:
    """Append the storable rows and return the rejects.

    `rows` comes from `ingest.article_rows` with an `id`. The write is one job
    with a task-level commit, which takes the place of a commit per row.
    """
    good = rows.where(F.col("status") == "processed")
    stamped = good.withColumn("processed_timestamp", F.current_timestamp())
    conform(stamped, schemas.ARTICLES).write.mode("append").parquet(path)
    return rows.where(F.col("status") != "processed")


def append_chunks(rows: DataFrame, path: str) -> DataFrame:
    """Append embedded chunks and return the rows that have no vector."""
    good = rows.where(F.col("content_chunk_vector").isNotNull())
    conform(good, schemas.CHUNKS).write.mode("append").parquet(path)
    return rows.where(F.col("content_chunk_vector").isNull())
