"""Tables that only grow by whole, checked batches: write, audit, publish.

A batch is written to a folder of its own, its rows are tested against the table's
constraints together with what is stored, and only then a new manifest names the folder.
Readers see the folders of the newest manifest, so a batch is there whole or not at all, and
one that fails a test, or whose job dies, leaves the table as it was. A manifest is one small
file in a folder of its number; of two writers that want the same number the second fails
and may try again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from passagework import fixed, schemas
from passagework.operators.constraints import fk_violations
from passagework.sources.sinks import conform

_MANIFEST = "version bigint, folder string"

# (staged rows, stored rows) to the number of rows that break each constraint
Audit = Callable[[DataFrame, DataFrame], dict[str, int]]


class Rejected(ValueError):
    """A batch broke constraints; nothing was published. `broken` has the numbers of rows."""

    def __init__(self, broken: dict[str, int]):
        super().__init__(", ".join(f"{name}: {n}" for name, n in broken.items()))
        self.broken = broken


class Conflict(RuntimeError):
    """Another batch was published meanwhile; nothing of this one was."""


def _publish(spark: SparkSession, path: str, version: int, folders: list[str]) -> None:
    rows = spark.createDataFrame([(version, f) for f in folders] or [(version, None)], _MANIFEST)
    try:
        rows.coalesce(1).write.mode("error").parquet(f"{path}/_manifests/version={version:010}")
    except AnalysisException as e:
        raise Conflict(f"version {version} of {path} is there already") from e


def create(spark: SparkSession, path: str) -> None:
    """An empty table; fails if there is one."""
    _publish(spark, path, 0, [])


def _newest(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    manifests = spark.read.schema(_MANIFEST).parquet(f"{path}/_manifests/*")
    newest = manifests.agg(F.max("version").alias("version")).first()["version"]
    folders = manifests.where((F.col("version") == newest) & F.col("folder").isNotNull())
    return newest, sorted(r.folder for r in folders.collect())


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of the newest version."""
    _, folders = _newest(spark, path)
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders])


def append(rows: DataFrame, path: str, schema: T.StructType, audit: Audit) -> int:
    """Publish `rows` as a new version and return its number, or raise `Rejected` or `Conflict`."""
    spark = rows.sparkSession
    version, folders = _newest(spark, path)
    folder = f"data-{uuid.uuid4().hex}"
    conform(rows, schema).write.parquet(f"{path}/{folder}")
    staged = spark.read.schema(schema).parquet(f"{path}/{folder}")
    stored = spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)
    broken = {name: n for name, n in audit(staged, stored).items() if n}
    if broken:
        raise Rejected(broken)
    _publish(spark, path, version + 1, [*folders, folder])
    return version + 1


def _key_audit(staged: DataFrame, stored: DataFrame, key: str, vector: str, dim: int, *more) -> dict[str, int]:
    """Constraints of a keyed table with vectors; reads keys and vector lengths only."""
    facts = staged.agg(
        F.count_if(F.col(key).isNull()).alias("null_keys"),
        (F.count(key) - F.count_distinct(key)).alias("repeated_keys"),
        F.count_if(F.col(vector).isNotNull() & (F.size(vector) != dim)).alias("wrong_vectors"),
        *more,
    ).first()
    again = staged.select(key).join(stored.select(key), key, "left_semi").count()
    return {**facts.asDict(), "stored_keys": again}


def articles_audit(dim: int = fixed.VECTOR_DIM) -> Audit:
    """Unique ids, titles that are there and not too long, vectors of `dim` elements."""

    def audit(staged: DataFrame, stored: DataFrame) -> dict[str, int]:
        titles = [
            F.count_if(F.col("title").isNull()).alias("null_titles"),
            F.count_if(F.length("title") > fixed.TITLE_MAX_CHARS).alias("long_titles"),
        ]
        return _key_audit(staged, stored, "id", "title_vector", dim, *titles)

    return audit


def chunks_audit(articles: DataFrame, dim: int = fixed.VECTOR_DIM) -> Audit:
    """Unique ids, vectors of `dim` elements, and articles that exist."""

    def audit(staged: DataFrame, stored: DataFrame) -> dict[str, int]:
        orphans = fk_violations(staged, articles).agg(F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n")).first()["n"]
        return {**_key_audit(staged, stored, "chunk_id", "content_chunk_vector", dim), "orphans": orphans}

    return audit


def append_articles(rows: DataFrame, path: str, dim: int = fixed.VECTOR_DIM) -> int:
    """Article rows as a checked batch, stamped with the time of the append."""
    stamped = rows.withColumn("processed_timestamp", F.current_timestamp())
    return append(stamped, path, schemas.ARTICLES, articles_audit(dim))


def append_chunks(rows: DataFrame, path: str, articles: DataFrame, dim: int = fixed.VECTOR_DIM) -> int:
    """Chunk rows as a checked batch."""
    return append(rows, path, schemas.CHUNKS, chunks_audit(articles, dim))
