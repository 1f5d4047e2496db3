"""Documents to token-budget chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework import fixed
from passagework.functions import chunking
from passagework.functions.arrays import slices

CHUNK_TYPE = "array<struct<chunk_no:int,content_chunk:string,n_tokens:bigint>>"
ARROW_CHUNKS = pa.list_(
    pa.struct([("chunk_no", pa.int32()), ("content_chunk", pa.string()), ("n_tokens", pa.int64())])
)


def chunker(budget: int, count: chunking.TokenCounter = chunking.estimate_counts):
    """A UDF: text to the array of its chunks (non-deterministic: never run twice)."""

    def cut(text):
        if text is None:
            return None
        return [
            {"chunk_no": number, "content_chunk": body, "n_tokens": tokens}
            for number, body, tokens in chunking.chunks(text, budget, count)
        ]

    @F.arrow_udf(CHUNK_TYPE)
    def cut_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for (part,) in slices(batch):
                yield pa.array([cut(text) for text in part.to_pylist()], type=ARROW_CHUNKS)

    return cut_batches.asNondeterministic()


def chunk_documents(
    articles: DataFrame,
    *,
    id_col: str = "id",
    text_col: str = "content",
    budget: int = fixed.CHUNK_TOKENS,
    count: chunking.TokenCounter = chunking.estimate_counts,
) -> DataFrame:
    """`(article_id, chunk_no, content_chunk, n_tokens)`; the first two columns are the key."""
    source = articles.select(F.col(id_col).alias("article_id"), text_col)
    cut = source.select("article_id", chunker(budget, count)(F.col(text_col)).alias("_chunks"))
    return cut.select("article_id", F.inline("_chunks"))


def rechunk_oversize(
    chunks: DataFrame,
    limit: int,
    *,
    budget: int = fixed.CHUNK_TOKENS // 2,
    count: chunking.TokenCounter = chunking.estimate_counts,
) -> DataFrame:
    """Cut chunks above `limit` tokens again at `budget`; each piece keeps its own row.

    One pass: rows within the limit send NULL to the UDF and stay as they are.
    """
    keep = [c for c in chunks.columns if c not in ("content_chunk", "n_tokens")]
    over = F.col("n_tokens") > limit
    text = F.when(over, F.col("content_chunk"))
    whole = F.array(
        F.struct(
            F.lit(0).alias("chunk_no"), F.col("content_chunk"), F.col("n_tokens").cast("bigint")
        )
    ).cast(CHUNK_TYPE)
    cut = chunks.withColumn("_again", chunker(budget, count)(text))
    pieces = F.inline(F.coalesce("_again", whole)).alias("part_no", "content_chunk", "n_tokens")
    return cut.select(*keep, pieces)


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Chunks and tokens per article."""
    return chunks.groupBy("article_id").agg(
        F.count("*").alias("n_chunks"),
        F.sum("n_tokens").alias("sum_tokens"),
        F.max("n_tokens").alias("max_tokens"),
    )
