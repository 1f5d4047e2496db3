"""Whole retrieval flows: question to prompt, and recorded tool calls to transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework import fixed
from passagework.functions.embedding import Provider
from passagework.operators import context
from passagework.operators.embed import embed
from passagework.operators.retrieve import search, search_one
from passagework.session import write_and_read

CHUNKS = {
    "id_col": "chunk_id",
    "vector_col": "content_chunk_vector",
    "payload": ("article_id", "content_chunk"),
}
ARTICLES = {"id_col": "id", "vector_col": "title_vector", "payload": ("title", "content")}


def _text(kind: dict) -> str:
    return kind["payload"][-1]


def _search_text(corpus, text: str, provider: Provider, k: int, kind: dict) -> DataFrame:
    (vector,) = provider.embed([text])
    return search_one(corpus, vector, k, **kind)


def similar_chunks(
    chunks: DataFrame, query: str, provider: Provider, top_k: int | None = None
) -> DataFrame:
    """The endpoint `(articleId, chunkContent, similarity)` of one query, best first."""
    k = fixed.TOP_K_CHUNKS if top_k is None else top_k
    return _search_text(chunks, query, provider, k, CHUNKS).select(
        F.col("article_id").alias("articleId"),
        F.col("content_chunk").alias("chunkContent"),
        "similarity",
    )


def similar_articles(
    articles: DataFrame, query: str, provider: Provider, top_k: int | None = None
) -> DataFrame:
    """The endpoint `(id, title, content, similarity)` of one query, best first."""
    k = fixed.TOP_K_ARTICLES_TOOL if top_k is None else top_k
    return _search_text(articles, query, provider, k, ARTICLES)


def embedded_queries(queries: DataFrame, provider: Provider) -> DataFrame:
    """`queries` with the vector `q` of their `query` text.

    A query that cannot be embedded fails its task, which Spark retries, and in
    the end the job: a prompt without its context would look like an answer.
    """
    failed = F.raise_error(F.concat(F.lit("query not embedded: "), "error")).cast("array<float>")
    vector = F.when(F.col("error").isNotNull(), failed).otherwise(F.col("q"))
    return embed(queries, "query", provider, vector_col="q").withColumn("q", vector).drop("error")


def contexts_of(
    asked: DataFrame, corpus: DataFrame, kind: dict, provider: Provider
) -> DataFrame:
    """`asked(query, top_k)` to one context for each different pair.

    A text that is asked many times, with whatever limits, is embedded and scored once, for
    the greatest of them; shorter contexts take the first of its hits. Texts are told apart
    by their digest, `asked_key`.
    """
    texts = asked.groupBy("query").agg(F.max("top_k").alias("top_k"))
    vectors = embedded_queries(texts.withColumn("qid", F.md5("query")), provider)
    hits = search(corpus, vectors, F.col("top_k"), **kind)
    limits = asked.select(F.md5("query").alias("qid"), "top_k").distinct()
    own = hits.join(limits, "qid").where(F.col("rank") <= F.col("top_k"))
    return context.context_blocks(own, _text(kind), "qid", "top_k").withColumnRenamed("qid", "asked_key")


def with_context(asked: DataFrame, contexts: DataFrame) -> DataFrame:
    """Rows with `query` and `top_k`, and their `context`; without a hit it is NULL."""
    keyed = asked.withColumn("asked_key", F.md5("query"))
    return keyed.join(contexts, ["asked_key", "top_k"], "left").drop("asked_key")


def naive_prompts(
    queries: DataFrame, corpus: DataFrame, kind: dict, provider: Provider, k: int
) -> DataFrame:
    """`(qid, prompt)`: every question with its k best hits as context."""
    asked = queries.select("qid", "query", F.lit(k).alias("top_k"))
    found = with_context(asked, contexts_of(asked, corpus, kind, provider))
    return found.select("qid", context.prompt(F.col("context"), F.col("query")).alias("prompt"))


def naive_prompts_chunks(queries, chunks, provider, k: int = fixed.TOP_K_CHUNKS) -> DataFrame:
    return naive_prompts(queries, chunks, CHUNKS, provider, k)


def naive_prompts_articles(queries, articles, provider, k: int = fixed.TOP_K_ARTICLES) -> DataFrame:
    return naive_prompts(queries, articles, ARTICLES, provider, k)


def tool_transcripts(
    questions: DataFrame,
    calls: DataFrame,
    corpus: DataFrame,
    kind: dict,
    provider: Provider,
    default_k: int,
) -> DataFrame:
    """Transcripts of multi-round retrieval from recorded tool calls.

    `questions(conv_id, query)`, `calls(conv_id, seq, input_json)`. Rounds
    depend on each other only through the recorded calls, so all of them, in
    all conversations, are answered by one search, each different text once.
    """
    rounds = context.tool_rounds(calls).join(
        questions.select("conv_id", F.col("query").alias("question")), "conv_id", "left"
    )
    rounds = context.parse_tool_input(rounds, F.col("question"), default_k)
    # stored: the texts to ask, their limits and the transcript are made from it
    rounds = write_and_read(rounds, "tool-rounds")
    answered = with_context(rounds, contexts_of(rounds, corpus, kind, provider))
    return context.transcript(questions, answered)


def tool_transcripts_chunks(questions, calls, chunks, provider) -> DataFrame:
    return tool_transcripts(questions, calls, chunks, CHUNKS, provider, fixed.TOP_K_CHUNKS)


def tool_transcripts_articles(questions, calls, articles, provider) -> DataFrame:
    return tool_transcripts(
        questions, calls, articles, ARTICLES, provider, fixed.TOP_K_ARTICLES_TOOL
    )
