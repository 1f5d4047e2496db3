"""Incremental ingest: new page files become articles and chunks, once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from passagework import fixed, schemas
from passagework.operators.chunk import chunk_documents
from passagework.operators.extract import extract_pages
from passagework.operators.ingest import article_rows, first_pages
from passagework.session import write_and_read

ARTICLE_COLUMNS = "page_id bigint, url string, title string, content string, batch_id bigint"
CHUNK_COLUMNS = (
    "article_id bigint, chunk_no int, content_chunk string, n_tokens bigint, batch_id bigint"
)
REJECT_COLUMNS = "page_id bigint, url string, status string, error string, batch_id bigint"
TABLES = {"articles": ARTICLE_COLUMNS, "chunks": CHUNK_COLUMNS, "rejects": REJECT_COLUMNS}


def stored(spark: SparkSession, target: str, table: str) -> DataFrame:
    """What the ingest has written so far; empty before the first batch."""
    # the folder is partitioned by batch_id; an empty first file set is made by `start`
    return spark.read.schema(TABLES[table]).parquet(f"{target}/{table}")


def _prepare(spark: SparkSession, target: str) -> None:
    """Make all table folders readable before any batch has been written."""
    for table, columns in TABLES.items():
        empty = spark.createDataFrame([], columns)
        empty.write.mode("append").partitionBy("batch_id").parquet(f"{target}/{table}")


def start(
    spark: SparkSession,
    pages: str,
    target: str,
    *,
    budget: int = fixed.CHUNK_TOKENS,
    file_pattern: str | None = None,
    files_per_batch: int | None = None,
    root_id: str | None = fixed.CONTENT_ROOT_ID,
    root_tag: str | None = None,
) -> StreamingQuery:
    """Process all page files that are new since the last run, then stop.

    The stream's checkpoint under `target` is the resume point. Each batch
    writes its own `batch_id` folder with overwrite, so a batch repeated after
    a failure replaces its earlier output, and URLs stored by other batches
    are left out by an anti-join. Pages that cannot be stored go to `rejects`
    with the reason.
    """
    _prepare(spark, target)
    reader = spark.readStream.schema(schemas.PAGES)
    if file_pattern:
        reader = reader.option("pathGlobFilter", file_pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        known = stored(session, target, "articles").where(F.col("batch_id") != batch_id)
        fresh = first_pages(batch).join(known.select("url"), "url", "left_anti")
        wanted = batch.join(fresh, ["url", "page_id"], "left_semi")
        # stored, so that articles and rejects come from one extraction
        rows = write_and_read(article_rows(extract_pages(wanted, root_id=root_id, root_tag=root_tag)), "extracted")
        articles = f"{target}/articles/batch_id={batch_id}"
        rows.where(F.col("status") == "processed").select(
            "page_id", "url", "title", "content"
        ).write.mode("overwrite").parquet(articles)
        rows.where(F.col("status") != "processed").select(
            "page_id", "url", "status", "error"
        ).write.mode("overwrite").parquet(f"{target}/rejects/batch_id={batch_id}")
        written = session.read.parquet(articles)
        chunk_documents(written, id_col="page_id", budget=budget).write.mode("overwrite").parquet(
            f"{target}/chunks/batch_id={batch_id}"
        )

    return (
        reader.parquet(pages)
        .writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", f"{target}/_stream")
        .trigger(availableNow=True)
        .start()
    )


def run(spark: SparkSession, pages: str, target: str, **options) -> None:
    start(spark, pages, target, **options).awaitTermination()
