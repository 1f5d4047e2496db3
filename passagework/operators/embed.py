"""Attach vectors to texts through an embedding provider, and find what is still to do."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework import fixed
from passagework.functions import chunking
from passagework.functions.arrays import slices
from passagework.functions.embedding import Provider, TooLong
from passagework.operators.chunk import chunk_documents

RESULT_TYPE = "struct<vector:array<float>,error:string>"
ARROW_RESULT = pa.struct([("vector", pa.list_(pa.float32())), ("error", pa.string())])
EMBEDDED_TYPE = "array<struct<part_no:int,text:string,n_tokens:bigint,vector:array<float>,error:string>>"


def _ask(provider: Provider, texts: list[str]) -> list[dict]:
    """One request; a failing request marks its own texts only."""
    try:
        vectors = provider.embed(texts)
        if len(vectors) != len(texts):
            raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
        return [{"vector": vector, "error": None} for vector in vectors]
    except TooLong:
        if len(texts) > 1:  # find out which of them it was
            return [result for text in texts for result in _ask(provider, [text])]
        return [{"vector": None, "error": fixed.TOO_LONG}]
    except Exception as problem:
        return [{"vector": None, "error": f"{type(problem).__name__}: {problem}"}] * len(texts)


def _ask_all(provider: Provider, texts: list[str]) -> list[dict]:
    """All texts, in requests of up to `provider.batch_size`."""
    size = provider.batch_size
    return [r for start in range(0, len(texts), size) for r in _ask(provider, texts[start : start + size])]


def embedder(provider: Provider):
    """A UDF: text to vector or error. Requests hold up to `provider.batch_size` texts.

    Marked non-deterministic so that no request is made twice.
    """

    @F.arrow_udf(RESULT_TYPE)
    def embed_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for (part,) in slices(batch, step=provider.batch_size):
                texts = part.to_pylist()
                out: list[dict | None] = [None] * len(texts)
                present = [i for i, text in enumerate(texts) if text is not None]
                for place, result in zip(present, _ask_all(provider, [texts[i] for i in present])):
                    out[place] = result
                yield pa.array(out, type=ARROW_RESULT)

    return embed_batches.asNondeterministic()


def embed(
    df: DataFrame,
    text_col: str,
    provider: Provider,
    *,
    vector_col: str = "vector",
) -> DataFrame:
    """`df` plus the vector of `text_col` and an `error` column."""
    result = embedder(provider)(F.col(text_col))
    return df.withColumn("_embedded", result).select(
        *df.columns, F.col("_embedded.vector").alias(vector_col), "_embedded.error"
    )


def chunk_and_embed(
    articles: DataFrame,
    provider: Provider,
    *,
    id_col: str = "id",
    text_col: str = "content",
    budget: int = fixed.CHUNK_TOKENS,
    count: chunking.TokenCounter = chunking.estimate_counts,
) -> DataFrame:
    """Articles to chunk rows with vectors; failures stay on their rows as `error`.

    A chunk the provider finds too long is cut again at half the budget and
    every piece is embedded on its own row, told apart by `part_no`.
    """
    cut = chunk_documents(articles, id_col=id_col, text_col=text_col, budget=budget, count=count)

    def settle(texts: list[str], tokens: list[int]) -> list[list[dict]]:
        """One list of parts for each text; the pieces of all too long ones are asked together."""
        results = _ask_all(provider, texts)
        pieces = [
            (row, *cut_again)
            for row, result in enumerate(results)
            if result["error"] == fixed.TOO_LONG
            for cut_again in chunking.chunks(texts[row], budget // 2, count)
        ]
        parts: list[list[dict]] = [
            [] if result["error"] == fixed.TOO_LONG else [{"part_no": 0, "text": text, "n_tokens": n, **result}]
            for text, n, result in zip(texts, tokens, results)
        ]
        answers = _ask_all(provider, [piece for _, _, piece, _ in pieces])
        for (row, part, piece, size), answer in zip(pieces, answers):
            parts[row].append({"part_no": part, "text": piece, "n_tokens": size, **answer})
        return parts

    arrow = pa.list_(
        pa.struct(
            [
                ("part_no", pa.int32()),
                ("text", pa.string()),
                ("n_tokens", pa.int64()),
                ("vector", pa.list_(pa.float32())),
                ("error", pa.string()),
            ]
        )
    )

    @F.arrow_udf(EMBEDDED_TYPE)
    def embed_chunks(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts, tokens in slices(*batch, step=provider.batch_size):
                yield pa.array(settle(texts.to_pylist(), tokens.to_pylist()), type=arrow)

    embed_once = embed_chunks.asNondeterministic()
    done = cut.select(
        "article_id", "chunk_no", embed_once("content_chunk", "n_tokens").alias("_parts")
    )
    names = ("part_no", "content_chunk", "n_tokens", "content_chunk_vector", "error")
    return done.select("article_id", "chunk_no", F.inline("_parts").alias(*names))


def pending_titles(articles: DataFrame) -> DataFrame:
    """Articles whose title has no vector yet."""
    return articles.where(F.col("title_vector").isNull()).select("id", "title")


def fill_title_vectors(articles: DataFrame, provider: Provider) -> DataFrame:
    """`articles` with the missing title vectors computed in place, and `error`.

    One narrow pass: rows that have a vector send NULL to the provider's UDF,
    and nothing is joined or shuffled.
    """
    pending = F.when(F.col("title_vector").isNull(), F.col("title"))
    filled = F.coalesce("title_vector", "_embedded.vector").alias("title_vector")
    return articles.withColumn("_embedded", embedder(provider)(pending)).select(
        *[filled if c == "title_vector" else c for c in articles.columns], "_embedded.error"
    )


def attach_title_vectors(articles: DataFrame, vectors: DataFrame) -> DataFrame:
    """New snapshot of `articles` with `(id, vector)` put in by key; other rows keep theirs.

    An id with more than one vector fails the job: its article would be stored twice. The
    test groups by the join's own key, so it adds no shuffle and reads `vectors` once.
    """
    several = F.raise_error(F.concat(F.lit("more than one vector for id "), F.col("id").cast("string")))
    fresh = (
        vectors.where(F.col("vector").isNotNull())
        .groupBy("id")
        .agg(F.first("vector").alias("_one"), F.count("*").alias("_n"))
        .select("id", F.when(F.col("_n") > 1, several.cast("array<float>")).otherwise(F.col("_one")).alias("_fresh"))
    )
    joined = articles.join(fresh, "id", "left")
    merged = F.coalesce("_fresh", "title_vector").alias("title_vector")
    return joined.select(*[merged if c == "title_vector" else c for c in articles.columns])


def resume_watermark(articles: DataFrame, chunks: DataFrame) -> DataFrame:
    """Articles above the highest chunked id.

    The maximum is one value, fetched first, so that the filter is a literal
    which reaches the scan. It never revisits gaps; `articles_without_chunks` does.
    """
    last = chunks.agg(F.coalesce(F.max("article_id"), F.lit(0)).alias("last_id")).first()
    return articles.where(F.col("id") > last["last_id"])


def articles_without_chunks(articles: DataFrame, chunks: DataFrame) -> DataFrame:
    """Articles no chunk refers to; chunk rows are reduced to distinct ids before the join."""
    done = chunks.select(F.col("article_id").alias("id")).distinct()
    return articles.join(done, "id", "left_anti")
