"""Exact top-k retrieval by inner product, and keyword search."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import parquet
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions.text import text_match, text_match_any
from passagework.functions.vectors import LocalTopK, inner_product, matrix
from passagework.session import new_path

# What a task holds at once of the corpus and of the stored queries, in bytes of vectors.
CORPUS_BLOCK_BYTES = 32 << 20
QUERY_BLOCK_BYTES = 8 << 20
# Queries from which on scoring costs far more than dealing the corpus's vectors to all cores.
MIN_QUERIES_TO_DEAL = 2_000
# Rows of one stored file of queries.
QUERY_FILE_ROWS = 50_000
# Hits joined back to their text are broadcast up to this many rows.
MAX_BROADCAST_HITS = 200_000
# Hits that may be fetched so that their ids become a filter of the scan for text, and the
# number of ids up to which that filter is a list; beyond it is a range.
MAX_FETCHED_HITS = 20_000
MAX_LISTED_IDS = 1_000

# Keys of bindings that are looked out for, and the counters of the sketch that finds them.
MAX_HEAVY_KEYS, SKETCHED_KEYS = 200, 10_000

# Hits of one query are merged in this many groups first.
MERGE_GROUPS = 32

_HIT = "qid:{qid},id:bigint,similarity:double,k:int"


class Hits(NamedTuple):
    """`(qid, id, similarity, rank)` rows, and their greatest possible number if known."""

    rows: DataFrame
    bound: int | None

    def to_join(self) -> DataFrame:
        """The rows, marked for broadcast when their number is known to be small."""
        small = self.bound is not None and self.bound <= MAX_BROADCAST_HITS
        return F.broadcast(self.rows) if small else self.rows


def _read_queries(table: pa.Table, dim: int):
    qids = table.column("qid").combine_chunks()
    vectors = matrix(table.column("v"), dim)
    k = table.column("k").to_numpy().astype(np.int64)
    return qids, vectors, k


def _hits(best: LocalTopK, qids: pa.Array) -> dict:
    return {
        "qid": qids.take(pa.array(best.q)),
        "id": pa.array(best.ids),
        "similarity": pa.array(best.scores),
        "k": pa.array(best.k[best.q].astype(np.int32)),
    }


def _vectors_of(corpus: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return corpus.where(F.col(vector_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v")
    )


class QueryStore(NamedTuple):
    """Queries `(qid, v, k)` written to the shared folder, which tasks read block by block."""

    files: list[str]
    rows: int
    dim: int
    k_sum: int
    k_max: int

    def blocks(self, block_bytes: int) -> Iterator[pa.Table]:
        rows = max(1, block_bytes // (8 * self.dim))
        held, n = [], 0
        for uri in self.files:
            files, path = FileSystem.from_uri(uri)
            with files.open_input_file(path) as source:
                for batch in parquet.ParquetFile(source).iter_batches(rows):
                    if n + batch.num_rows > rows:
                        yield pa.Table.from_batches(held)
                        held, n = [], 0
                    held.append(batch)
                    n += batch.num_rows
        if n:
            yield pa.Table.from_batches(held)


def store_queries(queries: DataFrame) -> QueryStore:
    """Write `queries(qid, v, k)` once, so that scoring and retries do not embed them again.

    Every qid must be there once, k must not be negative or NULL.
    """
    path = new_path(queries.sparkSession, "queries")
    queries.write.option("maxRecordsPerFile", QUERY_FILE_ROWS).parquet(path)
    stored = queries.sparkSession.read.schema(queries.schema).parquet(path)
    facts = stored.agg(
        F.count("*").alias("rows"),
        F.count_distinct("qid").alias("qids"),
        F.max(F.size("v")).alias("dim"),
        F.count("k").alias("limits"),
        F.min("k").alias("least"),
        F.coalesce(F.sum("k"), F.lit(0)).alias("k_sum"),
        F.coalesce(F.max("k"), F.lit(0)).alias("k_max"),
    ).first()
    if facts.qids != facts.rows:
        raise ValueError("a qid is NULL or stands for several queries")
    if facts.limits != facts.rows or (facts.rows and facts.least < 0):
        raise ValueError("the number of hits of a query must not be negative or NULL")
    return QueryStore(list(stored.inputFiles()), facts.rows, facts.dim or 0, facts.k_sum, facts.k_max)


def _scored(corpus: DataFrame, blocks: Callable[[], Iterable[pa.Table]], dim: int, schema: str) -> DataFrame:
    """Each task's rows against all query blocks; only the best rows of each leave it.

    A task gathers rows up to a block of limited size, reads all queries against it, block
    by block, and goes on. The corpus is scanned once, where it lies, and memory holds a
    block of either side however many there are.
    """

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n * dim * 8 >= CORPUS_BLOCK_BYTES:
                yield pa.Table.from_batches(held)
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in gathered(batches):
            ids, vectors = rows.column("id").to_numpy(), matrix(rows.column("v"), dim)
            for block in blocks():
                qids, asked, k = _read_queries(block, dim)
                best = LocalTopK(asked, k)
                best.add(ids, vectors)
                yield pa.RecordBatch.from_pydict(_hits(best, qids))

    return corpus.mapInArrow(scan, schema)


def _merge(found: DataFrame, most: int) -> DataFrame:
    """The tasks' candidates to final ranks, in two steps.

    A query has candidates from every task; they are first cut to `k` in
    groups by id, so that no task sorts all of them at once. The greatest `k`
    as a literal lets Spark trim every task's rows before each shuffle.
    """
    group = F.pmod("id", F.lit(MERGE_GROUPS))
    for keys in (["qid", group], ["qid"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("similarity"), "id")
        found = found.withColumn("rank", F.row_number().over(order)).where(
            (F.col("rank") <= most) & (F.col("rank") <= F.col("k"))
        )
    return found.drop("k")


def nearest(
    corpus: DataFrame,
    queries: DataFrame,
    k: int | Column,
    *,
    id_col: str,
    vector_col: str,
    query_id: str = "qid",
    query_vector: str = "q",
    query_block_bytes: int = QUERY_BLOCK_BYTES,
) -> Hits:
    """The `k` best rows for every query, ranked; ties go to the smaller id.

    `k` may be a column of `queries`; NULL vectors take no part. Queries are stored and
    read by the tasks that hold the corpus, which is not copied; at most corpus blocks x
    queries x k narrow rows are shuffled, trimmed by Spark in every task. Few queries meet
    the corpus where it lies. For many its ids and vectors are first dealt evenly, a task
    for each core: a narrow table lies in a few partitions, and its tasks would do all the
    work. Texts are joined to the final hits, see `search`.
    """
    corpus = _vectors_of(corpus, id_col, vector_col)
    k = F.lit(k) if isinstance(k, int) else k
    queries = queries.where(F.col(query_vector).isNotNull()).select(
        F.col(query_id).alias("qid"), F.col(query_vector).alias("v"), k.cast("int").alias("k")
    )
    schema = _HIT.format(qid=dict(queries.dtypes)["qid"])
    store = store_queries(queries)
    if not store.k_sum:
        none = corpus.sparkSession.createDataFrame([], schema)
        return Hits(none.drop("k").withColumn("rank", F.lit(0)), 0)
    if store.rows >= MIN_QUERIES_TO_DEAL:
        corpus = corpus.repartition(corpus.sparkSession.sparkContext.defaultParallelism)
    found = _scored(corpus, partial(store.blocks, query_block_bytes), store.dim, schema)
    return Hits(_merge(found, store.k_max), store.k_sum)


def with_payload(
    hits: Hits, table: DataFrame, payload: Sequence[str], *, id_col: str = "id"
) -> DataFrame:
    """Hit rows with columns of the table they were found in.

    The scoring pass reads ids and vectors only; wide text columns are read
    here, against the few hits. A known small number of hits is fetched, and their ids
    filter this scan, which then skips the row groups that cannot hold them.
    """
    texts = table.select(F.col(id_col).alias("id"), *payload)
    rows = hits.to_join()
    if hits.bound is not None and hits.bound <= MAX_FETCHED_HITS:
        texts, rows = _filtered_by(texts, hits.rows)
    return texts.join(rows, "id").select("qid", "rank", "id", *payload, "similarity")


def _filtered_by(texts: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Few hits, fetched, and the rows of `texts` that their ids may name."""
    fetched = hits.toArrow()
    ids = fetched.column("id").unique().to_pylist()
    if len(ids) <= MAX_LISTED_IDS:
        texts = texts.where(F.col("id").isin(ids))
    else:
        texts = texts.where(F.col("id").between(min(ids), max(ids)))
    return texts, F.broadcast(hits.sparkSession.createDataFrame(fetched))


def search(
    corpus: DataFrame,
    queries: DataFrame,
    k: int | Column,
    *,
    id_col: str,
    vector_col: str,
    payload: Sequence[str],
) -> DataFrame:
    """`nearest` over `queries(qid, q)`, then the hit rows' `payload` columns."""
    hits = nearest(corpus, queries, k, id_col=id_col, vector_col=vector_col)
    return with_payload(hits, corpus, payload, id_col=id_col)


def search_one(
    corpus: DataFrame,
    vector: Sequence[float],
    k: int,
    *,
    id_col: str,
    vector_col: str,
    payload: Sequence[str],
) -> DataFrame:
    """Top-k of a single query vector, best first: `(id, *payload, similarity)`.

    One query needs no grouping: every task's best rows meet in one ordered
    limit, which keeps `k` rows in memory however many tasks there are. Few hits
    are fetched, and their ids filter the second scan, which then reads text only
    from the row groups that can hold them.
    """
    sent = pa.table({"qid": pa.array([0]), "v": [list(map(float, vector))], "k": pa.array([k])})
    best_first = [F.desc("similarity"), F.asc("id")]
    found = _scored(
        _vectors_of(corpus, id_col, vector_col), lambda: [sent], len(vector), _HIT.format(qid="bigint")
    )
    hits = found.orderBy(*best_first).limit(k).select("id", "similarity")
    texts = corpus.select(F.col(id_col).alias("id"), *payload)
    if k <= MAX_FETCHED_HITS:
        texts, hits = _filtered_by(texts, hits)
    elif k <= MAX_BROADCAST_HITS:
        hits = F.broadcast(hits)
    return texts.join(hits, "id").select("id", *payload, "similarity").orderBy(*best_first)


def similarity_to(
    corpus: DataFrame, vector: Sequence[float], *, id_col: str, vector_col: str
) -> DataFrame:
    """Similarity of every row to one vector, as a plain expression."""
    literal = F.array(*[F.lit(float(x)) for x in vector])
    score = inner_product(F.col(vector_col), literal).alias("similarity")
    return corpus.select(id_col, score)


def hits_with_article(hits: Hits, chunks: DataFrame, articles: DataFrame) -> DataFrame:
    """Chunk hits with the title and text of the article they belong to.

    An article can own many hits, never the reverse, so the joins do not grow
    them, and each is a broadcast of the hits while their number allows it.
    """
    owned = Hits(with_payload(hits, chunks, ("article_id",), id_col="chunk_id"), hits.bound)
    owner = articles.select(F.col("id").alias("article_id"), "title", "content")
    return owner.join(owned.to_join().withColumnRenamed("id", "chunk_id"), "article_id")


def search_titles(articles: DataFrame, term: str) -> DataFrame:
    """Articles whose title holds every word of `term`."""
    return articles.where(text_match(F.col("title"), term)).select("id", "title", "content")


def search_articles(articles: DataFrame, term: str) -> DataFrame:
    """Articles whose title and text together hold every word of `term`."""
    match = text_match_any([F.col("title"), F.col("content")], term)
    return articles.where(match).select("id", "title", "content")


def batched_bindings(
    table: DataFrame,
    bindings: DataFrame,
    *,
    key: str,
    order_by: Sequence[Column],
    fields: Sequence[str],
    limit_col: str = "k",
) -> DataFrame:
    """The query `key = $value ORDER BY … LIMIT $k`, once per row of `bindings`.

    The table is first cut to the top rows of every key, for the largest limit
    in use. With that limit as a literal Spark trims each task's rows before
    the shuffle, so a key owning a third of the table, or bound many times,
    stays cheap. Bindings multiply only these few rows. The bindings of a key that is bound
    more often than a task's share are dealt to several tasks, which all get its few rows.
    """
    most = bindings.agg(F.max(limit_col).alias("most")).first()["most"] or 0
    order = Window.partitionBy(key).orderBy(*order_by)
    top = (
        table.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= most)
        .select(key, "rank", *[f for f in fields if f != key])
    )
    shares = key_shares(bindings, key)
    if shares:
        kind = bindings.schema[key].dataType.simpleString()
        # at most MAX_HEAVY_KEYS rows
        heavy = F.broadcast(bindings.sparkSession.createDataFrame(shares, f"`{key}` {kind}, _shares int"))
        own = F.coalesce("_shares", F.lit(1))
        bindings = bindings.join(heavy, key, "left").withColumn("_share", F.pmod(F.xxhash64(F.monotonically_increasing_id()), own))
        top = top.join(heavy, key, "left").withColumn("_share", F.explode(F.sequence(F.lit(0).cast("bigint"), own.cast("bigint") - 1)))
        bindings, top = bindings.drop("_shares"), top.drop("_shares")
    keys = [key, "_share"] if shares else [key]
    return bindings.join(top, keys).where(F.col("rank") <= F.col(limit_col)).drop("_share")


def key_shares(rows: DataFrame, key: str) -> list[tuple[object, int]]:
    """Keys with more rows than an even share of a shuffle's tasks, and by how many shares.

    A frequency sketch, merged from the tasks', finds them in one pass; it never misses a key
    that has more than one in a few hundred rows.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sketch = F.expr(f"approx_top_k(`{key}`, {MAX_HEAVY_KEYS}, {SKETCHED_KEYS})")
    facts = rows.where(F.col(key).isNotNull()).agg(F.count("*").alias("n"), sketch.alias("top")).first()
    share = max(1, -(-facts["n"] // tasks))
    return [(r["item"], -(-r["count"] // share)) for r in facts["top"] or [] if r["count"] > share]
