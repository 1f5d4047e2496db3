"""Queries: top-k, context, prompts, tool rounds, keyword search."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework import fixed
from passagework.operators import context, retrieve, table_functions
from passagework.operators.predicates import predicate
from passagework.operators.tables import select_many
from passagework.plans import answering
from workload import sql, views
from workload.registry import query

SEARCH_TEXT = "What is the theory of relativity?"
ONE = f"one AS (SELECT 0 AS id, '{SEARCH_TEXT}' AS text)"
BENCHMARK = "asked AS (SELECT item_id AS id, text FROM benchmark)"
TERM = "the tion"

ONE_HASHED = f"{ONE}, {sql.hashed('one')}"
ASKED_HASHED = f"{BENCHMARK}, {sql.hashed('asked')}"


def _search_vector():
    return views.provider().embed([SEARCH_TEXT])[0]


def _asked(spark, sf):
    return answering.embedded_queries(views.questions(spark, sf), views.provider())


@query(
    f"""WITH {ONE_HASHED}
    SELECT vec_id, round(list_inner_product(e.embedding::DOUBLE[], h.v::DOUBLE[]), 6) AS similarity
    FROM embeddings e, hashed h"""
)
def inner_product(spark, sf):
    scored = retrieve.similarity_to(
        views.table(spark, sf, "embeddings"),
        _search_vector(),
        id_col="vec_id",
        vector_col="embedding",
    )
    return scored.withColumn("similarity", F.round("similarity", 6))


@query(
    f"""WITH {ONE_HASHED}, {sql.CHUNKS}, {sql.ranked('chunks', 'chunk_id', 'content_chunk_vector', str(fixed.TOP_K_CHUNKS))}
    SELECT h.id AS chunk_id, c.article_id, c.content_chunk, round(h.similarity, 6) AS similarity
    FROM hits h JOIN chunks c ON c.chunk_id = h.id"""
)
def topk_chunks(spark, sf):
    found = retrieve.search_one(
        views.chunks(spark, sf), _search_vector(), fixed.TOP_K_CHUNKS, **answering.CHUNKS
    )
    return found.select(
        F.col("id").alias("chunk_id"),
        "article_id",
        "content_chunk",
        F.round("similarity", 6).alias("similarity"),
    )


@query(
    f"""WITH {ONE_HASHED}, {sql.ARTICLES}, {sql.ranked('articles', 'id', 'title_vector', str(fixed.TOP_K_ARTICLES))}
    SELECT h.id, a.title, a.content, round(h.similarity, 6) AS similarity
    FROM hits h JOIN articles a ON a.id = h.id"""
)
def topk_articles(spark, sf):
    found = retrieve.search_one(
        views.articles(spark, sf), _search_vector(), fixed.TOP_K_ARTICLES, **answering.ARTICLES
    )
    return found.withColumn("similarity", F.round("similarity", 6))


@query(
    f"""WITH {ONE_HASHED}, {sql.CHUNKS}, {sql.ranked('chunks', 'chunk_id', 'content_chunk_vector', str(fixed.TOP_K_CHUNKS))}
    SELECT c.article_id AS "articleId", c.content_chunk AS "chunkContent", round(h.similarity, 6) AS similarity
    FROM hits h JOIN chunks c ON c.chunk_id = h.id"""
)
def similar_chunks(spark, sf):
    found = answering.similar_chunks(views.chunks(spark, sf), SEARCH_TEXT, views.provider())
    return found.withColumn("similarity", F.round("similarity", 6))


@query(
    f"""WITH {ONE_HASHED}, {sql.ARTICLES}, {sql.ranked('articles', 'id', 'title_vector', str(fixed.TOP_K_ARTICLES_TOOL))}
    SELECT h.id, a.title, a.content, round(h.similarity, 6) AS similarity
    FROM hits h JOIN articles a ON a.id = h.id"""
)
def similar_articles(spark, sf):
    found = answering.similar_articles(views.articles(spark, sf), SEARCH_TEXT, views.provider())
    return found.withColumn("similarity", F.round("similarity", 6))


# the whole corpus: every document cut and embedded
ALL_CHUNKS = f"""docs AS (SELECT doc_id AS id, text FROM documents), {sql.chunked('docs', views.SMALL_BUDGET)},
    cut_texts AS (SELECT id * {views.CHUNK_STRIDE} + chunk_no AS id, id AS article_id, content_chunk AS text FROM cut),
    {sql.hashed('cut_texts', 'cut_vectors')},
    chunks AS (SELECT t.id AS chunk_id, t.article_id, t.text AS content_chunk, h.v AS content_chunk_vector
               FROM cut_texts t JOIN cut_vectors h USING (id))"""
ALL_TITLES = f"""titled AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS text, text AS content FROM documents),
    {sql.hashed('titled', 'title_vectors')},
    articles AS (SELECT t.id, t.text AS title, t.content, h.v AS title_vector FROM titled t JOIN title_vectors h USING (id))"""


@query(
    f"""WITH RECURSIVE {ONE_HASHED}, {ALL_CHUNKS}, {sql.ranked('chunks', 'chunk_id', 'content_chunk_vector', str(fixed.TOP_K_CHUNKS))}
    SELECT h.id AS chunk_id, c.article_id, c.content_chunk, round(h.similarity, 6) AS similarity
    FROM hits h JOIN chunks c ON c.chunk_id = h.id"""
)
def topk_all_chunks(spark, sf):
    found = retrieve.search_one(
        views.all_chunks(spark, sf), _search_vector(), fixed.TOP_K_CHUNKS, **answering.CHUNKS
    )
    return found.withColumnRenamed("id", "chunk_id").withColumn("similarity", F.round("similarity", 6))


@query(
    f"""WITH RECURSIVE {ONE_HASHED}, {ALL_TITLES}, {sql.ranked('articles', 'id', 'title_vector', str(fixed.TOP_K_ARTICLES))}
    SELECT h.id, a.title, a.content, round(h.similarity, 6) AS similarity
    FROM hits h JOIN articles a ON a.id = h.id"""
)
def topk_all_titles(spark, sf):
    found = retrieve.search_one(
        views.all_titles(spark, sf), _search_vector(), fixed.TOP_K_ARTICLES, **answering.ARTICLES
    )
    return found.withColumn("similarity", F.round("similarity", 6))


def _first_rows(corpus: str, id_col: str, vector_col: str, k: str) -> str:
    similar = f"similar_rows(TABLE(SELECT {id_col}, {vector_col} FROM {corpus}), '{SEARCH_TEXT}', {k})"
    return f"first_rows(TABLE(SELECT * FROM {similar}))"


@query(
    f"""WITH {ONE_HASHED}, {sql.CHUNKS}, {sql.ranked('chunks', 'chunk_id', 'content_chunk_vector', str(fixed.TOP_K_CHUNKS))}
    SELECT c.article_id AS "articleId", c.content_chunk AS "chunkContent", round(h.similarity, 6) AS similarity
    FROM hits h JOIN chunks c ON c.chunk_id = h.id"""
)
def udtf_similar_chunks(spark, sf):
    """The search endpoint called in SQL, with no number of hits given."""
    table_functions.register_search(spark, views.provider(), fixed.TOP_K_CHUNKS)
    views.chunks(spark, sf).createOrReplaceTempView("searched_chunks")
    found = _first_rows("searched_chunks", "chunk_id", "content_chunk_vector", "NULL")
    return spark.sql(
        f"""SELECT c.article_id AS articleId, c.content_chunk AS chunkContent, round(h.similarity, 6) AS similarity
        FROM {found} h JOIN searched_chunks c ON c.chunk_id = h.id"""
    )


@query(
    f"""WITH {ONE_HASHED}, {sql.ARTICLES}, {sql.ranked('articles', 'id', 'title_vector', '7')}
    SELECT h.id, a.title, a.content, round(h.similarity, 6) AS similarity
    FROM hits h JOIN articles a ON a.id = h.id"""
)
def udtf_similar_articles(spark, sf):
    table_functions.register_search(spark, views.provider(), fixed.TOP_K_ARTICLES_TOOL)
    views.articles(spark, sf).createOrReplaceTempView("searched_articles")
    found = _first_rows("searched_articles", "id", "title_vector", "7")
    return spark.sql(
        f"""SELECT a.id, a.title, a.content, round(h.similarity, 6) AS similarity
        FROM {found} h JOIN searched_articles a ON a.id = h.id"""
    )


KNN_SQL = f"""WITH {ASKED_HASHED}, {sql.ranked('embeddings', 'vec_id', 'embedding', '10')}
    SELECT qid, id, round(similarity, 6) AS similarity, rank FROM hits"""


def _knn(spark, sf, **limits):
    hits = retrieve.nearest(
        views.table(spark, sf, "embeddings"),
        _asked(spark, sf),
        10,
        id_col="vec_id",
        vector_col="embedding",
        **limits,
    )
    return hits.rows.withColumn("similarity", F.round("similarity", 6))


@query(KNN_SQL)
def knn_batch(spark, sf):
    return _knn(spark, sf)


@query(KNN_SQL)
def knn_block_pairs(spark, sf):
    """Queries read in many small blocks: same rows."""
    return _knn(spark, sf, query_block_bytes=16 * 8 * views.DIM)


@query(
    f"""WITH {ASKED_HASHED}, {sql.CHUNKS}, {sql.ARTICLES},
    {sql.ranked('chunks', 'chunk_id', 'content_chunk_vector', str(fixed.TOP_K_CHUNKS))}
    SELECT h.qid, h.rank, h.id AS chunk_id, a.id AS article_id, a.title, a.content
    FROM hits h JOIN chunks c ON c.chunk_id = h.id JOIN articles a ON a.id = c.article_id"""
)
def hits_with_article(spark, sf):
    chunks = views.chunks(spark, sf)
    hits = retrieve.nearest(
        chunks,
        _asked(spark, sf),
        fixed.TOP_K_CHUNKS,
        id_col="chunk_id",
        vector_col="content_chunk_vector",
    )
    found = retrieve.hits_with_article(hits, chunks, views.documents(spark, sf))
    return found.select("qid", "rank", "chunk_id", "article_id", "title", "content")


CHUNK_HITS = f"""{ASKED_HASHED}, {sql.CHUNKS},
    {sql.ranked('chunks', 'chunk_id', 'content_chunk_vector', str(fixed.TOP_K_CHUNKS))},
    {sql.contexts('chunks', 'chunk_id', 'content_chunk')}"""
ARTICLE_HITS = f"""{ASKED_HASHED}, {sql.ARTICLES},
    {sql.ranked('articles', 'id', 'title_vector', str(fixed.TOP_K_ARTICLES))},
    {sql.contexts('articles', 'id', 'content')}"""


def _prompt_sql(hits: str) -> str:
    return f"""WITH {hits} SELECT a.id AS qid, {sql.prompt('c.context', 'a.text')} AS prompt
    FROM asked a LEFT JOIN contexts c ON c.qid = a.id"""


@query(f"WITH {CHUNK_HITS} SELECT qid, context FROM contexts")
def context_block(spark, sf):
    hits = retrieve.search(
        views.chunks(spark, sf), _asked(spark, sf), fixed.TOP_K_CHUNKS, **answering.CHUNKS
    )
    return context.context_blocks(hits, "content_chunk")


@query(f"SELECT item_id AS qid, {sql.prompt('text', 'text')} AS prompt FROM benchmark")
def naive_prompt(spark, sf):
    """The prompt frame alone, with each question's own text as its context."""
    questions = views.questions(spark, sf)
    return questions.select("qid", context.prompt(F.col("query"), F.col("query")).alias("prompt"))


@query(_prompt_sql(CHUNK_HITS))
def naive_rag_chunks(spark, sf):
    return answering.naive_prompts_chunks(
        views.questions(spark, sf), views.chunks(spark, sf), views.provider()
    )


@query(
    _prompt_sql(f"""RECURSIVE {ASKED_HASHED}, {ALL_CHUNKS},
    {sql.ranked('chunks', 'chunk_id', 'content_chunk_vector', str(fixed.TOP_K_CHUNKS))},
    {sql.contexts('chunks', 'chunk_id', 'content_chunk')}""")
)
def rag_all_chunks(spark, sf):
    """Every question's prompt from the whole corpus."""
    return answering.naive_prompts_chunks(
        views.questions(spark, sf), views.all_chunks(spark, sf), views.provider()
    )


@query(_prompt_sql(ARTICLE_HITS))
def naive_rag_articles(spark, sf):
    return answering.naive_prompts_articles(
        views.questions(spark, sf), views.articles(spark, sf), views.provider()
    )


@query(
    f"""WITH {sql.TOOL_CALLS}, {sql.rounds(fixed.TOP_K_CHUNKS)}
    SELECT conv_id, seq, round FROM rounds"""
)
def tool_rounds(spark, sf):
    return context.tool_rounds(views.tool_calls(spark, sf)).select("conv_id", "seq", "round")


@query(
    f"""WITH {sql.TOOL_CALLS}, {sql.rounds(fixed.TOP_K_ARTICLES_TOOL)}
    SELECT conv_id, seq, query, top_k, valid,
      CASE WHEN valid THEN '{{' || chr(10) || '  "query" : ' || to_json(query)::VARCHAR
             || CASE WHEN seq % 3 = 0 THEN ',' || chr(10) || '  "top_k" : 7' ELSE '' END || chr(10) || '}}'
           ELSE '{{' || chr(10) || '  "top_k" : 4' || chr(10) || '}}' END AS pretty
    FROM rounds"""
)
def tool_input_json(spark, sf):
    calls = context.tool_rounds(views.tool_calls(spark, sf)).join(
        views.conversation_questions(spark, sf).withColumnRenamed("query", "question"), "conv_id"
    )
    parsed = context.parse_tool_input(calls, F.col("question"), fixed.TOP_K_ARTICLES_TOOL)
    return parsed.select("conv_id", "seq", "query", "top_k", "valid", "pretty")


def _transcript_sql(corpus: str, default_k: int, name: str, id_col: str, vector: str, text: str):
    return f"""{sql.TOOL_CALLS}, {sql.rounds(default_k)}, {corpus},
    asked AS (SELECT conv_id * {fixed.MAX_TOOL_ROUNDS} + round - 1 AS id, query AS text, top_k FROM rounds),
    {sql.hashed('asked')},
    sized AS (SELECT h.id, h.v, a.top_k FROM hashed h JOIN asked a USING (id)),
    {sql.ranked(name, id_col, vector, 'q.top_k', queries='sized')},
    {sql.contexts(name, id_col, text)}, {sql.TRANSCRIPT}"""


CHUNK_TRANSCRIPT = _transcript_sql(
    sql.CHUNKS, fixed.TOP_K_CHUNKS, "chunks", "chunk_id", "content_chunk_vector", "content_chunk"
)
ARTICLE_TRANSCRIPT = _transcript_sql(
    sql.ARTICLES, fixed.TOP_K_ARTICLES_TOOL, "articles", "id", "title_vector", "content"
)


def _transcript(flow, corpus, spark, sf):
    return flow(
        views.conversation_questions(spark, sf),
        views.tool_calls(spark, sf),
        corpus(spark, sf, heavy_work=True),
        views.provider(),
    )


@query(f"WITH {CHUNK_TRANSCRIPT} SELECT conv_id, seq::INT AS seq, role, content FROM transcript")
def agentic_rag_chunks(spark, sf):
    return _transcript(answering.tool_transcripts_chunks, views.chunks, spark, sf)


@query(f"WITH {ARTICLE_TRANSCRIPT} SELECT conv_id, seq::INT AS seq, role, content FROM transcript")
def agentic_rag_articles(spark, sf):
    return _transcript(answering.tool_transcripts_articles, views.articles, spark, sf)


TOKEN_BUDGET = 4000


@query(
    f"""WITH {CHUNK_TRANSCRIPT},
    counted AS (SELECT conv_id, seq, role, {sql.text_tokens('content')} AS n_tokens FROM transcript),
    total AS (SELECT *, (sum(n_tokens) OVER (PARTITION BY conv_id ORDER BY seq))::BIGINT AS total_tokens FROM counted)
    SELECT conv_id, seq::INT AS seq, role, n_tokens, total_tokens,
           CASE WHEN total_tokens <= {TOKEN_BUDGET} THEN 'ok' ELSE '{fixed.TOO_LONG}' END AS status
    FROM total"""
)
def prompt_budget(spark, sf):
    return context.prompt_budget(agentic_rag_chunks(spark, sf), TOKEN_BUDGET)


def _match_sql(text: str, term: str) -> str:
    words = "['" + "','".join(term.split()) + "']"
    return (
        f"list_has_all(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}_]+'), {words})"
    )


@query(
    f"WITH {sql.ARTICLES} SELECT id, title, content FROM articles WHERE {_match_sql('title', TERM.split()[0])}"
)
def search_titles(spark, sf):
    return retrieve.search_titles(views.documents(spark, sf), TERM.split()[0])


BOTH = "title || ' ' || content"


@query(f"WITH {sql.ARTICLES} SELECT id, title, content FROM articles WHERE {_match_sql(BOTH, TERM)}")
def search_articles(spark, sf):
    return retrieve.search_articles(views.documents(spark, sf), TERM)


@query(
    f"""WITH {sql.ARTICLES} SELECT id, title FROM articles
    WHERE {_match_sql('title', TERM.split()[0])} AND content LIKE '%and%'
    ORDER BY title DESC, id LIMIT 20"""
)
def search_titles_filtered(spark, sf):
    found = retrieve.search_titles(views.documents(spark, sf), TERM.split()[0])
    return select_many(
        found,
        where_={"content": {"_like": "%and%"}},
        order_by=[{"title": "Desc"}, {"id": "Asc"}],
        limit=20,
        fields=["id", "title"],
    )


@query(
    """WITH bound AS (SELECT c_custkey AS binding, c_nationkey AS nation, c_custkey % 4 + 1 AS k FROM customer)
    SELECT b.binding, b.nation, b.k, t.rank, t.s_suppkey, t.s_acctbal FROM bound b JOIN (
      SELECT s_nationkey, s_suppkey, s_acctbal,
             (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey))::INT AS rank
      FROM supplier) t ON t.s_nationkey = b.nation AND t.rank <= b.k"""
)
def batched_bindings(spark, sf):
    """Every customer binds its nation and a limit: that nation's best suppliers."""
    bindings = views.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("binding"),
        F.col("c_nationkey").alias("nation"),
        (F.col("c_custkey") % 4 + 1).alias("k"),
    )
    suppliers = views.table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "nation")
    return retrieve.batched_bindings(
        suppliers,
        bindings,
        key="nation",
        order_by=[F.desc("s_acctbal"), F.asc("s_suppkey")],
        fields=["s_suppkey", "s_acctbal"],
    )


@query(
    f"""SELECT doc_id, text FROM documents WHERE {_match_sql('text', TERM)}"""
)
def where_text_match(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id", "text")
    return docs.where(predicate({"text": {"ts_match_tt": TERM}}))
