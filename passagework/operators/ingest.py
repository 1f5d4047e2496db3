"""Link lists to new article rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework import fixed
from passagework.functions.urls import normalize_url, title_from_url
from passagework.operators.extract import readable



def unpivot_links(
    questions: DataFrame,
    row_col: str = "q_id",
    prefix: str = fixed.LINK_COLUMN_PREFIX,
    count: int = fixed.LINK_COLUMN_COUNT,
) -> DataFrame:
    """`(q_id, slot, link)` for every link that is present; missing columns are skipped."""
    names = {f"{prefix}{i}": i for i in range(1, count + 1)}
    present = [c for c in questions.columns if c in names]
    long = questions.unpivot([row_col], present, "_column", "link").where(
        F.col("link").isNotNull()
    )
    slot = F.substring(F.col("_column"), len(prefix) + 1, 9).cast("int")
    return long.select(row_col, slot.alias("slot"), "link")


def normalized_links(links: DataFrame) -> DataFrame:
    """`link` as a full `url`; rows without one are dropped."""
    return links.withColumn("url", normalize_url(F.col("link"))).where(F.col("url").isNotNull())


def first_per_url(
    links: DataFrame, row_col: str = "q_id", most_slots: int = fixed.LINK_COLUMN_COUNT
) -> DataFrame:
    """The first occurrence of every URL in row and slot order.

    A grouped minimum, combined before the shuffle, so a URL that fills a
    third of the rows still sends one row per task. Row and slot are packed
    into one whole number, which keeps the aggregation hash-based.
    """
    stride = F.lit(most_slots + 1)
    place = F.col(row_col).cast("bigint") * stride + F.col("slot")
    first = links.groupBy("url").agg(F.min(place).alias("_place"))
    row = F.expr(f"_place div {most_slots + 1}").alias(row_col)
    return first.select("url", row, (F.col("_place") % stride).cast("int").alias("slot"))


def new_urls(links: DataFrame, existing: DataFrame, row_col: str = "q_id") -> DataFrame:
    """First occurrences whose URL is not stored yet (exact text comparison)."""
    return first_per_url(links, row_col).join(
        existing.select("url").distinct(), "url", "left_anti"
    )


def first_pages(pages: DataFrame) -> DataFrame:
    """The smallest `page_id` of every captured URL; reads no page bodies."""
    return pages.where(F.col("url").isNotNull()).groupBy("url").agg(F.min("page_id").alias("page_id"))


def outcome(title: Column, content: Column) -> Column:
    """'processed' rows can be stored; 'no content' and 'error' rows are rejects."""
    return (
        F.when(~readable(content), F.lit("no content"))
        .when(F.length(title) > fixed.TITLE_MAX_CHARS, F.lit("error"))
        .otherwise(F.lit("processed"))
    )


def article_rows(extracted: DataFrame) -> DataFrame:
    """Extraction output as article candidates: `title` from the URL, and a `status`."""
    titled = extracted.withColumn("title", title_from_url(F.col("url")))
    return titled.withColumn("status", outcome(F.col("title"), F.col("content")))


def ingest_summary(outcomes: DataFrame) -> DataFrame:
    """Rows per outcome."""
    return outcomes.groupBy("status").agg(F.count("*").alias("n_rows"))


def _bucket(key: Column) -> Column:
    """A uniform place in 0..4095 from the key's md5."""
    return F.conv(F.substring(F.md5(key), 1, 3), 16, 10).cast("int")


def with_serial(df: DataFrame, key: str, start: int, out: str = "id") -> DataFrame:
    """Dense numbers from `start + 1`, the same on every run for the same unique keys.

    Rows are numbered inside 4096 hash buckets; a bucket's first number comes
    from the bucket counts, a table of at most 4096 rows. Unique keys spread
    evenly over the buckets. Rows are shuffled and sorted, so number narrow
    rows and join wide columns afterwards.
    """
    placed = df.withColumn("_bucket", _bucket(F.col(key)))
    counts = placed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    # at most 4096 rows reach this un-partitioned window
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    return (
        placed.withColumn("_place", inside)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(out, F.lit(start) + F.col("_before") + F.col("_place"))
        .drop("_bucket", "_place", "_before")
    )


def next_serial(df: DataFrame, id_col: str = "id") -> int:
    """Highest number in use, 0 for an empty table."""
    return df.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("n")).first()["n"]


def with_chunk_ids(rows: DataFrame, start: int) -> DataFrame:
    """Unique `chunk_id` above `start`, from `(article_id, chunk_no, part_no)`.

    A formula over the largest chunk and part number, so wide chunk rows are
    not shuffled to number them. Ids rise with the three columns; they have gaps.
    """
    most = rows.agg(
        F.min("article_id").alias("low"),
        (F.max("chunk_no") + 1).alias("chunks"),
        (F.max("part_no") + 1).alias("parts"),
    ).first()
    article = F.col("article_id").cast("bigint") - F.lit(most["low"])
    place = (article * F.lit(most["chunks"]) + F.col("chunk_no")) * F.lit(most["parts"])
    return rows.withColumn("chunk_id", F.lit(start + 1) + place + F.col("part_no"))
