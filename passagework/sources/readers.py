"""Readers with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagework import fixed, schemas
from passagework.sources.tsv import read_records


def read_questions_tsv(
    spark: SparkSession,
    path: str,
    prefix: str = fixed.LINK_COLUMN_PREFIX,
    count: int = fixed.LINK_COLUMN_COUNT,
) -> DataFrame:
    """Tab-separated questions with a header; quoted fields may span lines.

    Columns are matched by header name and other columns are left out. Files may have
    fewer link columns; without a `q_id` rows are numbered from 0, over all files in the
    order of their paths. Large files are read in splits, see `tsv`.
    """
    fields = schemas.questions(prefix, count).fields
    raw = read_records(spark, path, [f.name for f in fields])
    named = {"q_id": raw["row_number"], **{c: raw[c] for c in raw.columns}}
    return raw.select(*[named[f.name].cast(f.dataType).alias(f.name) for f in fields if f.name in named])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages: `page_id, url, html`."""
    return spark.read.schema(schemas.PAGES).parquet(path)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ARTICLES).parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CHUNKS).parquet(path)


def scan_articles(articles: DataFrame) -> DataFrame:
    """The columns the chunker needs; the others are not read from the files."""
    return articles.select("id", "content")
