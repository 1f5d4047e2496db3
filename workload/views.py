"""The library's input tables, derived from the given test tables with Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework import fixed
from passagework.functions.embedding import HashingProvider
from passagework.operators.embed import chunk_and_embed, fill_title_vectors
from passagework.session import spread, write_and_read

# declared, so that no job is started to infer them
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
DIM = 64
CHUNKS_PER_ARTICLE = 5
SMALL_BUDGET = 512
# Chunk numbers of an article stay below this.
CHUNK_STRIDE = 1_000_000


def provider(batch_size: int = fixed.CHUNK_EMBED_BATCH) -> HashingProvider:
    return HashingProvider(DIM, batch_size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def heavy(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table whose rows are about to be worked on in Python."""
    return spread(table(spark, sf_dir, name), key)


def articles(spark: SparkSession, sf_dir: str, *, heavy_work: bool = False) -> DataFrame:
    """One article per document; the title is its first line, its vector that of the same number."""
    docs = table(spark, sf_dir, "documents")
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("title_vector")
    )
    return (
        (spread(docs, "doc_id") if heavy_work else docs)
        .join(vectors, "doc_id", "left")
        .select(
            F.col("doc_id").alias("id"),
            F.substring_index("text", "\n", 1).alias("title"),
            F.col("text").alias("content"),
            F.concat(F.lit("https://example.org/wiki/"), "source", F.lit("/"), "doc_id").alias("url"),
            "title_vector",
        )
    )


def documents(spark: SparkSession, sf_dir: str, *, heavy_work: bool = False) -> DataFrame:
    """Articles without the vector: a plain scan."""
    docs = table(spark, sf_dir, "documents")
    return (spread(docs, "doc_id") if heavy_work else docs).select(
        F.col("doc_id").alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("content"),
        F.concat(F.lit("https://example.org/wiki/"), "source", F.lit("/"), "doc_id").alias("url"),
    )


def chunks(spark: SparkSession, sf_dir: str, *, heavy_work: bool = False) -> DataFrame:
    """Every vector is a chunk; five consecutive ones belong to one article."""
    docs = table(spark, sf_dir, "documents")
    owner = (spread(docs, "doc_id") if heavy_work else docs).select(
        F.col("doc_id").alias("article_id"), F.col("text").alias("content_chunk")
    )
    return (
        table(spark, sf_dir, "embeddings")
        .select(
            F.col("vec_id").alias("chunk_id"),
            F.floor(F.col("vec_id") / CHUNKS_PER_ARTICLE).alias("article_id"),
            F.col("embedding").alias("content_chunk_vector"),
        )
        .join(owner, "article_id")
        .select("chunk_id", "article_id", "content_chunk_vector", "content_chunk")
    )


def all_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and embedded by the library itself, stored: no part of the corpus is left out."""
    rows = chunk_and_embed(documents(spark, sf_dir, heavy_work=True), provider(), budget=SMALL_BUDGET)
    numbered = rows.select(
        (F.col("article_id") * CHUNK_STRIDE + F.col("chunk_no")).alias("chunk_id"), "article_id", "content_chunk_vector", "content_chunk"
    )
    return write_and_read(numbered, "all-chunks")


def all_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an article whose title is embedded."""
    pending = documents(spark, sf_dir, heavy_work=True).withColumn("title_vector", F.lit(None).cast("array<float>"))
    return write_and_read(fill_title_vectors(pending, provider(fixed.TITLE_EMBED_BATCH)), "all-titles")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("qid"), F.col("text").alias("query")
    )


def questions_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven page links per question, every link once without its http scheme and once as it is."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    row = F.floor(F.col("page_id") / fixed.LINK_COLUMN_COUNT)
    slot = F.col("page_id") % fixed.LINK_COLUMN_COUNT + 1
    bare = pages.select(
        row.alias("q_id"), slot.alias("slot"), F.regexp_replace("url", "^http://", "").alias("link")
    )
    again = pages.select(
        (row + 1_000_000_000).alias("q_id"), slot.alias("slot"), F.col("url").alias("link")
    )
    links = [
        F.max(F.when(F.col("slot") == i, F.col("link"))).alias(f"{fixed.LINK_COLUMN_PREFIX}{i}")
        for i in range(1, fixed.LINK_COLUMN_COUNT + 1)
    ]
    return bare.unionByName(again).groupBy("q_id").agg(*links)


def conversation_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opening text of every conversation."""
    return (
        table(spark, sf_dir, "conversations")
        .groupBy("conv_id")
        .agg(F.min_by("text", "turn").alias("query"))
    )


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a recorded call: user turns ask their text, others only set top_k."""
    wanted = F.when(F.col("turn") % 3 == 0, F.lit(7)).cast("int")
    call = F.when(
        F.col("role") == "user", F.to_json(F.struct(F.col("text").alias("query"), wanted.alias("top_k")))
    ).otherwise(F.lit('{"top_k":4}'))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("seq"), call.alias("input_json")
    )


def _escaped(text):
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def _text(*pieces):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in pieces])


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an encyclopedia-like page with kept and skipped sections."""
    body = _text(
        '<html><body><nav><p>menu</p></nav><div id="mw-content-text"><p>lead ',
        F.col("lang"),
        '</p><div class="navbox"><p>box</p></div>'
        '<div class="mw-heading mw-heading2"><h2>',
        F.col("source"),
        "</h2><span>edit</span></div><p>",
        _escaped(F.col("text")),
        '</p><div class="mw-heading"><h2>References</h2></div><ul><li>note</li></ul>'
        '<div class="mw-heading"><h3>Citations</h3></div><p>hidden</p>'
        '<div class="mw-heading"><h2>Legacy</h2></div><p>document ',
        F.col("doc_id"),
        "</p></div></body></html>",
    )
    return heavy(spark, sf_dir, "documents", "doc_id").select("doc_id", body.alias("html"))


def part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a page that holds one table with column and row spans."""
    body = _text(
        '<div id="mw-content-text"><table><caption>',
        F.col("p_name"),
        '</caption><tr><th colspan="2">',
        F.col("p_brand"),
        '</th></tr><tr><td rowspan="2">',
        F.col("p_type"),
        "<td>",
        F.col("p_size"),
        "</td></tr><tr><td>",
        F.col("p_retailprice").cast("decimal(15,2)"),
        '</td></tr><tr><td></td><td> </td></tr><tr class="sortbottom"><td colspan="2">part ',
        F.col("p_partkey"),
        "</td></tr></table></div>",
    )
    return heavy(spark, sf_dir, "part", "p_partkey").select("p_partkey", body.alias("html"))


def customer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a page that holds one nested list."""
    body = _text(
        '<div id="mw-content-text"><ul><li>',
        F.col("c_name"),
        "<ol><li>",
        F.col("c_mktsegment"),
        "<li> </li><li>nation ",
        F.col("c_nationkey"),
        "</ol></li><li><b>balance</b> ",
        F.col("c_acctbal").cast("decimal(15,2)"),
        "</li></ul></div>",
    )
    return heavy(spark, sf_dir, "customer", "c_custkey").select("c_custkey", body.alias("html"))


def customer_wikitext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a short article in wiki markup."""
    raw = _text(
        "'''",
        F.col("c_name"),
        "''' lives in [[nation ",
        F.col("c_nationkey"),
        '|the nation]].<ref name="a">seen</ref>{{reflist|{{inner|x}}}}'
        "[[File:a.png|thumb|see [[b]]]]\n<!-- gone -->\n== Segment ==\n[[",
        F.col("c_mktsegment"),
        "]] with [https://example.org/x balance] ",
        F.col("c_acctbal").cast("decimal(15,2)"),
        "\n=== Empty ===\n{{notelist}}\n",
    )
    return heavy(spark, sf_dir, "customer", "c_custkey").select("c_custkey", raw.alias("raw"))
