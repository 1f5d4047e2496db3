import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from passagework import fixed, schemas
from passagework.functions import vectors
from passagework.functions.embedding import HashingProvider, TooLong
from passagework.functions.text import text_match
from passagework.functions.vectors import LocalTopK
from passagework.operators import context, embed, retrieve, table_functions
from passagework.plans import answering
from passagework.session import new_path
from passagework.sources import readers, sinks


# the providers below are sent to the workers, which cannot import this file
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def brute_force(corpus, queries, k_of):
    out = set()
    for qid, q in queries:
        scored = sorted(
            (-round(float(np.dot(np.float64(q), np.float64(v))), 9), i) for i, v in corpus if v is not None
        )
        out |= {(qid, i, rank) for rank, (_, i) in enumerate(scored[: k_of(qid)], 1)}
    return out


def make(spark, n=400, n_queries=30, dim=8, seed=1):
    """Small whole-number vectors: many equal scores, some equal rows, some NULLs."""
    rng = np.random.default_rng(seed)
    corpus = [
        (i, None if i % 17 == 3 else [float(x) for x in rng.integers(-2, 3, dim)]) for i in range(n)
    ]
    # a third of the rows are copies of one vector
    corpus = [(i, corpus[0][1] if i % 3 == 0 and v is not None else v) for i, v in corpus]
    queries = [(i, [float(x) for x in rng.integers(-2, 3, dim)]) for i in range(n_queries)]
    return (
        corpus,
        queries,
        spark.createDataFrame(corpus, "id long, v array<float>").repartition(5),
        spark.createDataFrame(queries, "qid long, q array<float>"),
    )


@pytest.mark.parametrize("limits", [{}, {"query_block_bytes": 7 * 8 * 8}])
def test_nearest_equals_brute_force(spark, limits):
    corpus, queries, c, q = make(spark)
    hits = retrieve.nearest(c, q, 6, id_col="id", vector_col="v", **limits)
    found = {(r.qid, r.id, r["rank"]) for r in hits.rows.collect()}
    assert found == brute_force(corpus, queries, lambda _: 6)
    assert hits.bound == 180


def test_corpus_blocks_of_one_task(spark):
    corpus, queries, c, q = make(spark)
    store = retrieve.store_queries(q.select("qid", F.col("q").alias("v"), F.lit(6).alias("k")))
    rows = c.where("v IS NOT NULL").coalesce(1).toArrow()
    blocks = list(store.blocks(7 * 8 * 8))
    assert len(blocks) >= 5 and max(b.num_rows for b in blocks) <= 7 and sum(b.num_rows for b in blocks) == 30
    # the task's function, with blocks of few rows
    limit = retrieve.CORPUS_BLOCK_BYTES
    try:
        retrieve.CORPUS_BLOCK_BYTES = 50 * 8 * 8
        found = []

        class Corpus:
            def mapInArrow(self, scan, schema):
                return list(scan(iter(rows.to_batches(max_chunksize=20))))

        found = retrieve._scored(Corpus(), lambda: store.blocks(7 * 8 * 8), 8, "")
    finally:
        retrieve.CORPUS_BLOCK_BYTES = limit
    assert len(found) > len(blocks)  # several corpus blocks met every query block
    best = {}
    for batch in found:
        for r in batch.to_pylist():
            best.setdefault(r["qid"], []).append((-r["similarity"], r["id"]))
    ranked = {(q, i, n) for q, hits in best.items() for n, (_, i) in enumerate(sorted(hits)[:6], 1)}
    assert ranked == brute_force(corpus, queries, lambda _: 6)


def test_the_corpus_is_scored_where_it_lies(spark, plan):
    _, _, c, q = make(spark, n=60)
    path = new_path(spark, "corpus")
    c.write.parquet(path)
    hits = retrieve.nearest(spark.read.parquet(path), q, 3, id_col="id", vector_col="v")
    below = plan(hits.rows).partition("MapInArrow")[2]
    assert "Scan parquet" in below and "Exchange" not in below and "Join" not in below


def test_many_queries_meet_the_corpus_on_all_cores(spark, monkeypatch):
    """However few partitions the vectors lie in, every core gets a share of them."""
    monkeypatch.setattr(retrieve, "MIN_QUERIES_TO_DEAL", 30)
    shares = []
    real = retrieve._scored
    monkeypatch.setattr(retrieve, "_scored", lambda corpus, *more: shares.append(corpus) or real(corpus, *more))
    r = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(r.integers(-2, 3, (90, 4)).astype(float))]
    corpus = spark.createDataFrame(rows, "id long, v array<float>").coalesce(1)
    for n in (29, 30):
        queries = spark.createDataFrame([(i, rows[i][1]) for i in range(n)], "qid int, q array<float>")
        hits = retrieve.nearest(corpus, queries, 3, id_col="id", vector_col="v").rows.collect()
        for q in range(n):
            best = sorted((-float(np.dot(rows[q][1], v)), i) for i, v in rows)[:3]
            assert sorted((h["rank"], h["id"]) for h in hits if h["qid"] == q) == [(k + 1, i) for k, (_, i) in enumerate(best)]
    assert [c.rdd.getNumPartitions() for c in shares] == [1, spark.sparkContext.defaultParallelism]


def test_only_near_pairs_are_scored_in_full(monkeypatch):
    """Few pairs are scored in double precision, and those that single precision cannot tell apart are."""
    from passagework.functions import vectors as helper

    r = np.random.default_rng(8)
    rows, queries = r.normal(size=(20_000, 16)), r.normal(size=(300, 16))
    rows[5000:5400] = rows[4999] * (1 + r.integers(0, 40, (400, 1)) * 1e-9)
    queries[:20] = rows[4999]
    rows[777, 3], rows[778, 3], rows[779, 3] = np.nan, np.inf, 1e200
    k, ids, scored = r.integers(0, 9, 300), r.permutation(20_000), []
    real = helper._Tile._dense
    monkeypatch.setattr(helper._Tile, "_dense", lambda tile, some, i, v: scored.append(len(some) * len(i)) or real(tile, some, i, v))
    best = LocalTopK(queries, k)
    for a in range(0, 20_000, 7000):
        best.add(ids[a : a + 7000], rows[a : a + 7000])
    with np.errstate(invalid="ignore"):
        exact = np.round(queries @ rows.T, 12)
    exact[np.isnan(exact)] = -np.inf
    for q in range(300):
        wanted = [ids[i] for i in np.lexsort((ids, -exact[q]))[: k[q]]]
        assert best.ids[best.q == q].tolist() == wanted
    assert sum(scored) < rows.shape[0] * len(queries) // 8


def test_queries_must_be_unique_and_limits_natural(spark):
    _, _, c, q = make(spark, n=20, n_queries=3)
    for wrong, k in ((q.unionAll(q), 2), (q, -1), (q.withColumn("qid", F.lit(None).cast("long")), 2)):
        with pytest.raises(ValueError):
            retrieve.nearest(c, wrong, k, id_col="id", vector_col="v")


@pytest.mark.parametrize("limits", [{}, {"query_block_bytes": 1}])
def test_k_per_query_and_empty_limits(spark, limits):
    corpus, queries, c, q = make(spark, n=60)
    q = q.withColumn("k", (F.col("qid") % 4).cast("int"))
    hits = retrieve.nearest(c, q, F.col("k"), id_col="id", vector_col="v", **limits)
    found = {(r.qid, r.id, r["rank"]) for r in hits.rows.collect()}
    assert found == brute_force(corpus, queries, lambda qid: qid % 4)


def test_no_queries_and_fewer_rows_than_k(spark):
    corpus, queries, c, q = make(spark, n=5, n_queries=2)
    assert retrieve.nearest(c, q.where("false"), 3, id_col="id", vector_col="v").rows.count() == 0
    hits = retrieve.nearest(c, q, 50, id_col="id", vector_col="v").rows.collect()
    assert {(r.qid, r.id, r["rank"]) for r in hits} == brute_force(corpus, queries, lambda _: 50)


def test_one_query_best_first(spark):
    corpus, queries, c, _ = make(spark, n=90)
    for k in (0, 1, 7, 200):
        found = retrieve.search_one(c, queries[0][1], k, id_col="id", vector_col="v", payload=("v",))
        wanted = sorted((rank, i) for _, i, rank in brute_force(corpus, queries[:1], lambda _: k))
        assert [r.id for r in found.collect()] == [i for _, i in wanted]


def test_text_query_ids(spark):
    corpus, queries, c, q = make(spark, n=50, n_queries=9)
    q = q.withColumn("qid", F.concat(F.lit("q"), "qid"))
    for limits in ({}, {"query_block_bytes": 3 * 8 * 8}):
        hits = retrieve.nearest(c, q, 2, id_col="id", vector_col="v", **limits).rows.collect()
        assert {(r.qid, r.id, r["rank"]) for r in hits} == {
            (f"q{a}", b, n) for a, b, n in brute_force(corpus, queries, lambda _: 2)
        }


def test_wrong_vector_length_fails(spark):
    c = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, v array<float>")
    q = spark.createDataFrame([(1, [1.0, 2.0])], "qid long, q array<float>")
    with pytest.raises(Exception, match="every vector must have 2 elements"):
        retrieve.nearest(c, q, 1, id_col="id", vector_col="v").rows.collect()


@pytest.mark.parametrize("cells", [20, 400, 10_000])
@pytest.mark.parametrize("order", ["rising", "falling", "mixed"])
def test_local_top_k_with_many_copies(monkeypatch, cells, order):
    monkeypatch.setattr(LocalTopK, "MAX_CELLS", cells)
    rng = np.random.default_rng(0)
    rows, queries = rng.integers(-3, 4, (397, 5)), rng.integers(-3, 4, (4, 5)).astype(float)
    rows[rng.random(397) < 0.4] = 3 * np.sign(queries[0])  # the best row of the first query
    ids = {"rising": np.arange(397), "falling": np.arange(397)[::-1], "mixed": rng.permutation(397)}[order]
    best = LocalTopK(queries, np.array([3, 1, 5, 500]))
    for start in range(0, 397, 50):
        span = slice(start, start + 50)
        best.add(ids[span], rows[span].astype(float))
    for q, k in enumerate([3, 1, 5, 397]):
        wanted = sorted((-s, i) for i, s in zip(ids, rows @ queries[q]))[:k]
        mine = [(-s, i) for s, i in zip(best.scores[best.q == q], best.ids[best.q == q])]
        assert mine == wanted


class Fixed:
    """Embeds any text as the vector it names."""

    dim, batch_size = 8, 4

    def embed(self, texts):
        return [np.array([float(x) for x in t.split()], np.float32) for t in texts]


def test_search_as_a_table_function(spark, plan):
    corpus, queries, c, _ = make(spark, n=200)
    c.createOrReplaceTempView("searched")
    table_functions.register_search(spark, Fixed(), 4)
    text = " ".join(map(str, queries[0][1]))

    def found(k):
        rows = f"SELECT * FROM similar_rows(TABLE(searched), '{text}', {k})"
        return spark.sql(f"SELECT * FROM first_rows(TABLE({rows}))")

    for k, wanted in (("NULL", 4), ("0", 0), ("1", 1), ("7", 7), ("1000", 1000)):
        ids = [r.id for r in found(k).collect()]
        assert ids == [i for _, i, _ in sorted(brute_force(corpus, queries[:1], lambda _: wanted), key=lambda x: x[2])]
    # rows are trimmed in the tasks that hold them, before they meet
    assert plan(found("7")).index("SinglePartition") < plan(found("7")).rindex("ArrowEvalPythonUDTF")
    for wrong in ("-1", "'x'"):
        with pytest.raises(Exception):
            found(wrong).collect()
    with pytest.raises(Exception, match="first_rows takes a TABLE of similar_rows"):
        spark.sql("SELECT * FROM first_rows(TABLE(searched))").collect()


def test_each_question_is_scored_once(spark):
    """Calls with one text share one row of the store; each keeps its own limit."""
    corpus, queries, c, _ = make(spark, n=80)
    chunks = c.select(F.col("id").alias("chunk_id"), F.col("v").alias("content_chunk_vector"), F.col("id").alias("article_id"), F.col("id").cast("string").alias("content_chunk"))
    text = " ".join(map(str, queries[0][1]))
    asked = spark.createDataFrame([(1, text, 2), (2, text, 5), (3, text, 2), (4, None, 2), (5, text, 0)], "n int, query string, top_k int")
    contexts = answering.contexts_of(asked.where("query IS NOT NULL"), chunks, answering.CHUNKS, Fixed())
    assert {r.top_k for r in contexts.collect()} == {2, 5} and contexts.count() == 2
    rows = {r.n: r.context for r in answering.with_context(asked, contexts).collect()}
    assert rows[1] == rows[3] and rows[2].startswith(rows[1]) and rows[4] is None and rows[5] is None


def test_a_negative_number_of_hits_is_not_valid(spark):
    calls = spark.createDataFrame([(1, '{"query": "a", "top_k": -3}'), (2, '{"query": "a", "top_k": 0}')], "n int, input_json string")
    rows = {r.n: (r.valid, r.top_k) for r in context.parse_tool_input(calls, F.lit("q"), 5).collect()}
    assert rows == {1: (False, 5), 2: (True, 0)}


def test_the_last_document_is_found(spark, sf):
    """The corpus of the whole-corpus queries leaves no document out."""
    from workload import views

    documents = views.documents(spark, sf)
    last = documents.orderBy(F.desc("id")).first()
    chunks = views.all_chunks(spark, sf)
    assert chunks.select("article_id").distinct().count() == documents.where("trim(content) <> ''").count()
    words = " ".join(last.content.split()[:40])
    hits = answering.similar_chunks(chunks, words, views.provider(), 3).collect()
    assert last.id in {r.articleId for r in hits}
    titles = answering.similar_articles(views.all_titles(spark, sf), last.title, views.provider(), 3).collect()
    assert last.title in {r.title for r in titles}


def test_search_reads_text_only_for_hits(spark, plan, sf):
    from workload import views

    chunks = spark.read.parquet(f"{sf}/documents.parquet").join(
        spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("doc_id") == F.col("vec_id")
    )
    q = spark.createDataFrame([(0, [0.1] * views.DIM)], "qid long, q array<float>")
    hits = retrieve.nearest(chunks, q, 3, id_col="doc_id", vector_col="embedding")
    assert "text" not in plan(hits.rows)
    assert "Cartesian" not in plan(hits.rows) and "NestedLoop" not in plan(hits.rows)


def test_inner_product_and_literals(spark):
    df = spark.createDataFrame([([1.5, -2.0, 0.25],)], "v array<float>")
    row = df.select(
        vectors.inner_product(F.col("v"), F.col("v")).alias("p"),
        vectors.to_literal(F.col("v")).alias("t"),
        vectors.from_literal(F.lit("[1.5,-2,0.25]"), 3).alias("back"),
        vectors.from_literal(F.lit("[1.5,-2]"), 3).alias("short"),
    ).first()
    assert (row.p, row.t, row.back, row.short) == (6.3125, "[1.5,-2.0,0.25]", [1.5, -2.0, 0.25], None)


def test_text_match(spark):
    df = spark.createDataFrame(
        [("The Theory, of relativity",), ("theoryx the",), (None,), ("(the)theory",), ("été the_theory",)],
        "t string",
    )

    def found(term):
        return [i for i, r in enumerate(df.select(text_match(F.col("t"), term)).collect()) if r[0]]

    assert found("theory THE") == [0, 3]
    assert found("") == found("  ,") == []
    assert found("ÉTÉ") == [4]
    assert found("a.b") == []


def test_search_articles_takes_words_from_title_or_text(spark):
    df = spark.createDataFrame(
        [(1, "big cat", "a dog"), (2, None, "cat dog"), (3, "cat", None), (4, "catdog", "dog")],
        "id int, title string, content string",
    )
    assert [r.id for r in retrieve.search_articles(df, "dog cat").collect()] == [1, 2]
    assert [r.id for r in retrieve.search_titles(df, "cat").collect()] == [1, 3]
    assert retrieve.search_articles(df, "").count() == 0


def test_bindings_of_a_hot_key_are_spread(spark):
    table = spark.range(200).selectExpr("id % 20 key", "id")
    bindings = spark.range(0, 3000, 1, 6).selectExpr("id b", "if(id % 3 = 0, 7L, if(id % 500 = 1, null, id % 40)) key", "cast(id % 4 as int) k")
    assert [key for key, shares in retrieve.key_shares(bindings, "key")] == [7]
    out = retrieve.batched_bindings(table, bindings, key="key", order_by=[F.desc("id")], fields=["id"])
    wanted = set()
    for b in range(3000):
        key, k = 7 if b % 3 == 0 else None if b % 500 == 1 else b % 40, b % 4
        if key is not None and key < 20:
            wanted |= {(b, key, k, rank + 1, 200 - 20 * (rank + 1) + key) for rank in range(k)}
    assert {(r.b, r.key, r.k, r["rank"], r.id) for r in out.collect()} == wanted and out.count() == len(wanted)
    # shuffled on the key alone, one task would have all rows of the hot key
    forced = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {name: spark.conf.get(name) for name in forced}
    try:
        for name, value in forced.items():
            spark.conf.set(name, value)
        out = retrieve.batched_bindings(table, bindings, key="key", order_by=[F.desc("id")], fields=["id"])
        sizes = [r["count"] for r in out.where("key = 7").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(sizes) > 2 and max(sizes) < 0.75 * sum(sizes)


def test_bindings_trim_a_hot_key_before_the_shuffle(spark, plan):
    table = spark.range(900).selectExpr("if(id % 3 = 0, 'hot', cast(id as string)) key", "id")
    bindings = spark.createDataFrame(
        [(1, "hot", 2), (2, "hot", 5), (3, "1", 4), (4, "none", 3)], "b int, key string, k int"
    )
    out = retrieve.batched_bindings(
        table, bindings, key="key", order_by=[F.desc("id")], fields=["id"]
    )
    rows = sorted((r.b, r["rank"], r.id) for r in out.collect())
    assert rows == [
        (1, 1, 897), (1, 2, 894), *((2, n + 1, 897 - 3 * n) for n in range(5)), (3, 1, 1),
    ]
    assert "row_number(), 5, Partial" in plan(out)


class Picky(HashingProvider):
    """Finds texts of more than two words too long and fails on one word."""

    def __reduce__(self):
        return (Picky, (self.dim, self.batch_size))

    def embed(self, texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        if any(len(t.split()) > 2 for t in texts):
            raise TooLong()
        return super().embed(texts)


def test_failures_stay_on_their_rows(spark):
    df = spark.createDataFrame(
        [(1, "a"), (2, "a b c"), (3, None), (4, "bad"), (5, "b")], "id int, t string"
    ).coalesce(1)
    rows = {r.id: r for r in embed.embed(df, "t", Picky(4, 2)).collect()}
    assert rows[1].vector and rows[1].error is None
    assert rows[2].vector is None and rows[2].error == fixed.TOO_LONG
    assert rows[3].vector is None and rows[3].error is None
    assert rows[4].error == rows[5].error == "RuntimeError: no"  # one request


def test_too_long_chunks_are_cut_at_half_the_budget(spark):
    df = spark.createDataFrame([(1, "aaaa bbbb cccc dddd"), (2, "x y")], "id int, content string")
    rows = embed.chunk_and_embed(df, Picky(4, 20), budget=4).collect()
    kept = sorted((r.article_id, r.chunk_no, r.part_no, r.content_chunk, r.error) for r in rows)
    assert kept == [
        (1, 0, 0, "aaaa bbbb", None), (1, 0, 1, "cccc dddd", None), (2, 0, 0, "x y", None),
    ]
    assert all(len(r.content_chunk_vector) == 4 for r in rows)


def test_a_failed_article_is_taken_up_again(spark, monkeypatch):
    from passagework.plans import loading

    articles = spark.createDataFrame(
        [(1, "fine one"), (2, "xx yy bad zz"), (3, "fine two")], "id long, content string"
    )
    for most in (0, 10):
        monkeypatch.setattr(loading, "MAX_BROADCAST_FAILURES", most)
        path = new_path(spark, "chunks")
        sinks.create_table(spark, path, schemas.CHUNKS)

        def run(provider):
            stored = readers.read_chunks(spark, path)
            return loading.embed_new_articles(articles, stored, path, provider, budget=2)

        assert {r.content_chunk for r in run(Picky(4, 1)).collect()} == {"bad zz"}
        stored = readers.read_chunks(spark, path)
        assert {r.article_id for r in stored.collect()} == {1, 3}
        assert run(HashingProvider(4, 1)).count() == 0
        stored = readers.read_chunks(spark, path)
        assert {r.article_id for r in stored.collect()} == {1, 2, 3}
        assert stored.select("chunk_id").distinct().count() == stored.count() == 4


def test_title_vectors(spark):
    articles = spark.createDataFrame(
        [(1, "a", [1.0, 0.0]), (2, "b", None), (3, "c", None)],
        "id int, title string, title_vector array<float>",
    )
    provider = HashingProvider(2, 100)
    pending = embed.pending_titles(articles)
    assert [r.id for r in pending.orderBy("id").collect()] == [2, 3]
    joined = embed.attach_title_vectors(articles, embed.embed(pending, "title", provider))
    filled = embed.fill_title_vectors(articles, provider).drop("error")
    assert joined.columns == filled.columns == articles.columns
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, filled.collect()))
    assert embed.pending_titles(filled).count() == 0


def test_hashing_provider():
    a, b, c = HashingProvider(16, 10).embed(["The the tree", "tree THE the!", ""])
    assert np.array_equal(a, b) and abs(np.linalg.norm(a) - 1) < 1e-6
    assert not c.any()


class OneHot(HashingProvider):
    def __reduce__(self):
        return (OneHot, (self.dim, self.batch_size))

    def embed(self, texts):
        return [np.eye(self.dim)["abc".index(t[0])] for t in texts]


def corpora(spark):
    chunks = spark.createDataFrame(
        [(1, 10, [0.5, 0.0, 0.0], "first"), (2, 10, [0.1234, 1.0, 0.0], "second"), (3, 11, None, "third")],
        "chunk_id long, article_id long, content_chunk_vector array<float>, content_chunk string",
    )
    articles = spark.createDataFrame(
        [(10, "t", "ten", [0.0, 0.5, 0.5]), (11, "u", "eleven", [0.0, 0.5, 0.25]), (12, "v", "twelve", None)],
        "id long, title string, content string, title_vector array<float>",
    )
    return chunks, articles


def test_naive_prompt_text(spark):
    chunks, articles = corpora(spark)
    asked = spark.createDataFrame([(7, "a question")], "qid long, query string")
    (row,) = answering.naive_prompts_chunks(asked, chunks, OneHot(3, 5)).collect()
    assert row.prompt == (
        "Here is some relevant context that might help answer the query:\n\n"
        "Related content 1 (similarity: 0.50):\nfirst\n\n"
        "Related content 2 (similarity: 0.12):\nsecond\n\n"
        "Based on the above context and your knowledge, please answer this query:\na question"
    )
    asked = spark.createDataFrame([(7, "b question")], "qid long, query string")
    (row,) = answering.naive_prompts_articles(asked, articles, OneHot(3, 5)).collect()
    assert row.prompt.index("1 (similarity: 0.50):\nten") < row.prompt.index("2 (similarity: 0.50):\neleven")


def test_a_query_that_cannot_be_embedded_fails_the_job(spark):
    chunks, _ = corpora(spark)
    asked = spark.createDataFrame([(7, "bad question")], "qid long, query string")
    with pytest.raises(Exception, match="query not embedded: RuntimeError: no"):
        answering.naive_prompts_chunks(asked, chunks, Picky(3, 5)).collect()


def test_prompt_without_hits(spark):
    chunks, _ = corpora(spark)
    asked = spark.createDataFrame([(7, "a question")], "qid long, query string")
    (row,) = answering.naive_prompts_chunks(asked, chunks.where("false"), OneHot(3, 5)).collect()
    assert row.prompt.startswith(fixed.PROMPT_OPENING + "\n\n\n\n" + fixed.PROMPT_REQUEST)


def test_transcript_rounds_defaults_and_cap(spark):
    _, articles = corpora(spark)
    questions = spark.createDataFrame([(1, "b?"), (2, "c?"), (3, "a?")], "conv_id long, query string")
    calls = [(1, n, '{"query":"b","top_k":1}') for n in range(7)]
    calls += [(2, 4, "{}"), (2, 2, '{"query":"c more"}'), (2, 9, "not json")]
    calls = spark.createDataFrame(calls, "conv_id long, seq int, input_json string")
    out = answering.tool_transcripts_articles(questions, calls, articles, OneHot(3, 5))
    rows = {(r.conv_id, r.seq): (r.role, r.content) for r in out.collect()}
    assert len(rows) == (1 + 2 * 5 + 1) + (1 + 2 * 3) + 1
    assert rows[1, 0] == ("user", "b?") and rows[3, 0] == ("user", "a?")
    assert rows[1, 15] == ("user", fixed.ROUND_LIMIT_MESSAGE)
    assert rows[1, 14] == ("user", "Related content 1 (similarity: 0.50):\nten")
    assert rows[2, 1] == ("assistant", '{"query":"c more"}') and rows[2, 4] == ("assistant", "{}")
    assert rows[2, 5][1].count("Related content") == 2  # three asked for, two have vectors
    assert rows[2, 8] == rows[2, 5]  # unreadable input: the question is searched instead


def test_vectors_that_are_no_numbers_take_no_part():
    import numpy as np
    import pyarrow as pa

    from passagework.functions.vectors import LocalTopK, matrix

    top = LocalTopK(np.array([[1.0, 0.0]]), np.array([2]))
    top.add(np.arange(4), np.array([[np.nan, 0], [np.nan, 1], [1, 0], [2, 0]]))
    assert sorted(top.ids) == [2, 3]
    with pytest.raises(ValueError):
        matrix(pa.array([[1.0, 2.0, 3.0], [4.0]]), 2)


def test_two_vectors_for_one_article_are_refused(spark):
    articles = spark.createDataFrame([(1, "a", None)], "id int, title string, title_vector array<float>")
    vectors = spark.createDataFrame([(1, [1.0]), (1, [2.0])], "id int, vector array<float>")
    with pytest.raises(Exception, match="more than one vector for id 1"):
        embed.attach_title_vectors(articles, vectors).collect()


def test_one_query_sends_its_ids_to_the_scan(spark, sf, plan):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("v", F.array(F.col("doc_id").cast("float")))
    found = retrieve.search_one(docs, [1.0], 3, id_col="doc_id", vector_col="v", payload=("text",))
    assert "PushedFilters: [" in plan(found) and "In(doc_id" in plan(found)
    top = sorted((r.doc_id for r in docs.select("doc_id").collect()), reverse=True)[:3]
    assert [r.id for r in found.collect()] == top


def test_candidates_are_trimmed_before_the_shuffle(spark, plan):
    _, _, c, q = make(spark, n=40, n_queries=3)
    assert "row_number(), 6, Partial" in plan(retrieve.nearest(c, q, 6, id_col="id", vector_col="v").rows)
