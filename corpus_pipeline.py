"""From raw documents to packed training sequences, in five stages.

Each stage works on all rows that the one before it kept; tables between stages are written.
"""

from __future__ import annotations

from passagework.llm import decontaminate, line_dedup, near_dedup, packing, quality
from passagework.llm.queries import remainder, table, tokenizer_path
from passagework.session import ship_package, write_and_read
from pyspark.sql import DataFrame, SparkSession


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled ones among them, accepts."""
    ship_package(spark)
    return quality.accepted(docs, table(spark, sf_dir, "labels"), remainder(5) == 0)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line equals or nearly equals."""
    ship_package(spark)
    return line_dedup.without_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every group of near copies."""
    ship_package(spark)
    return near_dedup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold passages of the benchmark."""
    ship_package(spark)
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    ship_package(spark)
    return packing.packed(docs, tokenizer_path(), added_tokens=True)


STAGES = [
    ("quality", select_quality),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: The classifier's weights cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the result is that of the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_and_read(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
