"""Declared table schemas."""

from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType(), True)

ARTICLES = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("content", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("processed_timestamp", T.TimestampType()),
        T.StructField("title_vector", VECTOR),
    ]
)

CHUNKS = T.StructType(
    [
        T.StructField("chunk_id", T.LongType(), False),
        T.StructField("article_id", T.LongType()),
        T.StructField("content_chunk_vector", VECTOR),
        T.StructField("content_chunk", T.StringType()),
    ]
)

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

TOOL_INPUT = T.StructType(
    [
        T.StructField("query", T.StringType()),
        T.StructField("top_k", T.IntegerType()),
    ]
)


def questions(prefix: str, count: int) -> T.StructType:
    """Row number plus `count` nullable link columns."""
    links = [T.StructField(f"{prefix}{i}", T.StringType()) for i in range(1, count + 1)]
    return T.StructType([T.StructField("q_id", T.LongType()), *links])
