"""Queries: words, chunks, vectors of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework import fixed, schemas
from passagework.functions import text, vectors
from passagework.operators import chunk, embed, table_functions
from passagework.plans import loading
from passagework.session import new_path
from passagework.sources import readers, sinks
from workload import sql, views
from workload.ingest import millionths
from workload.registry import query

SMALL_BUDGET = views.SMALL_BUDGET
DOCS = "docs AS (SELECT doc_id AS id, text FROM documents)"
CUT_COLUMNS = "id AS article_id, chunk_no, content_chunk, n_tokens"


@query(
    f"""WITH w AS (SELECT doc_id AS id, {sql.word_lists('text')} AS ws FROM documents)
    SELECT id, generate_subscripts(ws, 1) - 1 AS word_no, unnest(ws) AS word FROM w"""
)
def word_tokens(spark, sf):
    docs = views.documents(spark, sf, heavy_work=True)
    return docs.select(
        "id", F.posexplode(text.words(F.col("content"))).alias("word_no", "word")
    ).withColumn("word_no", F.col("word_no").cast("bigint"))


@query(
    f"""SELECT doc_id AS id, len({sql.word_lists('text')})::BIGINT AS n_words,
           {sql.text_tokens('text')} AS n_tokens FROM documents"""
)
def token_counts(spark, sf):
    content = F.col("content")
    return views.documents(spark, sf, heavy_work=True).select(
        "id",
        F.size(text.words(content)).cast("bigint").alias("n_words"),
        text.text_tokens(content).alias("n_tokens"),
    )


@query(f"WITH RECURSIVE {DOCS}, {sql.chunked('docs', SMALL_BUDGET)} SELECT {CUT_COLUMNS} FROM cut")
def chunk_documents(spark, sf):
    return chunk.chunk_documents(views.documents(spark, sf, heavy_work=True), budget=SMALL_BUDGET)


@query(
    f"WITH RECURSIVE {DOCS}, {sql.chunked('docs', fixed.CHUNK_TOKENS)} SELECT {CUT_COLUMNS} FROM cut"
)
def chunk_documents_full_budget(spark, sf):
    return chunk.chunk_documents(views.documents(spark, sf, heavy_work=True))


@query(
    f"""WITH RECURSIVE {DOCS}, {sql.chunked('docs', SMALL_BUDGET)}
    SELECT id AS article_id, count(*) AS n_chunks, sum(n_tokens)::BIGINT AS sum_tokens,
           max(n_tokens) AS max_tokens FROM cut GROUP BY id"""
)
def chunk_stats(spark, sf):
    return chunk.chunk_stats(chunk_documents(spark, sf))


@query(
    f"""WITH RECURSIVE {DOCS}, long AS (SELECT id, text FROM docs WHERE {sql.text_tokens('text')} > {SMALL_BUDGET}),
    {sql.chunked('long', SMALL_BUDGET // 2)}
    SELECT id AS article_id, chunk_no AS part_no, content_chunk, n_tokens FROM cut
    UNION ALL
    SELECT id, 0, text, {sql.text_tokens('text')} FROM docs
    WHERE {sql.text_tokens('text')} <= {SMALL_BUDGET}"""
)
def rechunk_oversize(spark, sf):
    """Whole documents as chunks, those above the limit cut again at half of it."""
    whole = views.documents(spark, sf, heavy_work=True).select(
        F.col("id").alias("article_id"),
        F.col("content").alias("content_chunk"),
        text.text_tokens(F.col("content")).alias("n_tokens"),
    )
    return chunk.rechunk_oversize(whole, SMALL_BUDGET, budget=SMALL_BUDGET // 2)


@query(f"WITH RECURSIVE {DOCS}, {sql.chunked('docs', SMALL_BUDGET)} SELECT {CUT_COLUMNS} FROM cut")
def udtf_chunk_text(spark, sf):
    table_functions.register_chunk_text(spark)
    views.documents(spark, sf, heavy_work=True).createOrReplaceTempView("chunk_source")
    return spark.sql(
        f"""SELECT id AS article_id, chunk_no, content_chunk, n_tokens
        FROM chunk_text(TABLE(SELECT id, content FROM chunk_source), {SMALL_BUDGET})"""
    )


@query(
    f"""WITH {DOCS}, {sql.hashed('docs')}
    SELECT id, array_to_string(list_transform(v, lambda x: round(x::DOUBLE * 1000000)::BIGINT), ',') AS vector,
           NULL::VARCHAR AS error FROM hashed"""
)
def embed_documents(spark, sf):
    done = embed.embed(views.documents(spark, sf, heavy_work=True), "content", views.provider())
    return done.select("id", millionths("vector").alias("vector"), "error")


@query(
    f"""WITH RECURSIVE {DOCS}, {sql.chunked('docs', SMALL_BUDGET)},
    numbered AS (SELECT id * 1000000 + chunk_no AS id, content_chunk AS text FROM cut),
    {sql.hashed('numbered')}
    SELECT c.id AS article_id, c.chunk_no, 0 AS part_no, c.content_chunk, c.n_tokens,
           array_to_string(list_transform(h.v, lambda x: round(x::DOUBLE * 1000000)::BIGINT), ',') AS vector,
           NULL::VARCHAR AS error
    FROM cut c JOIN hashed h ON h.id = c.id * 1000000 + c.chunk_no"""
)
def chunk_and_embed(spark, sf):
    rows = embed.chunk_and_embed(
        views.documents(spark, sf, heavy_work=True), views.provider(), budget=SMALL_BUDGET
    )
    return rows.withColumn("vector", millionths("content_chunk_vector")).drop(
        "content_chunk_vector"
    )


@query(
    f"""WITH RECURSIVE {DOCS}, {sql.chunked('docs', SMALL_BUDGET)},
    numbered AS (
      SELECT (id - min(id) OVER ()) * (max(chunk_no) OVER () + 1) + chunk_no + 1 AS chunk_id,
             id AS article_id, content_chunk FROM cut),
    texts AS (SELECT chunk_id AS id, content_chunk AS text FROM numbered), {sql.hashed('texts')}
    SELECT n.chunk_id, n.article_id, n.content_chunk,
           array_to_string(list_transform(h.v, lambda x: round(x::DOUBLE * 1000000)::BIGINT), ',') AS vector
    FROM numbered n JOIN hashed h ON h.id = n.chunk_id"""
)
def embed_new_articles(spark, sf):
    """Two runs: the second finds every article done."""
    articles = views.documents(spark, sf, heavy_work=True)
    path = new_path(spark, "chunks")
    sinks.create_table(spark, path, schemas.CHUNKS)
    for _ in range(2):
        stored = readers.read_chunks(spark, path)
        loading.embed_new_articles(articles, stored, path, views.provider(), budget=SMALL_BUDGET)
    return readers.read_chunks(spark, path).select(
        "chunk_id", "article_id", "content_chunk", millionths("content_chunk_vector").alias("vector")
    )


@query(
    """SELECT vec_id, TRUE AS same, len(embedding)::INT AS dim,
           round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings"""
)
def vector_literal_roundtrip(spark, sf):
    vector = F.col("embedding")
    back = vectors.from_literal(vectors.to_literal(vector), views.DIM)
    total = F.aggregate("back", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return (
        views.table(spark, sf, "embeddings")
        .withColumn("back", back)
        .select(
            "vec_id",
            (F.col("back") == vector).alias("same"),
            F.size("back").alias("dim"),
            F.round(total, 6).alias("total"),
        )
    )
