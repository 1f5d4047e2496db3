"""Whole loading flows: questions to stored articles, and articles to stored chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework import fixed
from passagework.functions import chunking
from passagework.functions.embedding import Provider
from passagework.operators import embed, extract, ingest
from passagework.session import write_and_read
from passagework.sources import sinks

MAX_BROADCAST_FAILURES = 100_000


def load_articles(
    questions: DataFrame, pages: DataFrame, existing: DataFrame, path: str, **root
) -> DataFrame:
    """Store the articles behind all links not stored yet; returns rows per outcome.

    `pages(page_id, url, html)` are the captured pages, the smallest page_id
    counting where a URL was captured more than once; a link without a page
    has no content. Running it again over its own output adds nothing.

    Choosing URLs, numbering them and picking their pages is done on narrow
    tables; page bodies are read and moved once, for the chosen pages only.
    """
    links = ingest.normalized_links(ingest.unpivot_links(questions))
    # stored, because numbering reads it twice
    fresh = write_and_read(ingest.new_urls(links, existing).select("url"), "urls")
    numbered = ingest.with_serial(fresh, "url", ingest.next_serial(existing))
    wanted = write_and_read(numbered.join(ingest.first_pages(pages), "url", "left"), "wanted")

    bodies = pages.select("page_id", "url", "html").join(wanted, ["url", "page_id"])
    extracted = extract.extract_pages(bodies, **root)
    missing = wanted.where(F.col("page_id").isNull()).select(
        *[c if c in wanted.columns else F.lit(None).cast("string").alias(c) for c in extracted.columns]
    )
    rows = ingest.article_rows(extracted.unionByName(missing))
    rows = write_and_read(rows, "extracted")
    sinks.append_articles(rows, path)
    return ingest.ingest_summary(rows)


def embed_new_articles(
    articles: DataFrame,
    chunks: DataFrame,
    path: str,
    provider: Provider,
    *,
    budget: int = fixed.CHUNK_TOKENS,
    count: chunking.TokenCounter = chunking.estimate_counts,
) -> DataFrame:
    """Store the chunks of all articles that have none; returns the chunks without a vector.

    `chunks` is what `path` holds so far. An article is stored with all its
    chunks or not at all, so the next run takes up every failed one again.
    """
    pending = embed.articles_without_chunks(articles.select("id", "content"), chunks)
    rows = embed.chunk_and_embed(pending, provider, budget=budget, count=count)
    rows = write_and_read(rows, "chunks")
    lost = rows.where(F.col("content_chunk_vector").isNull())
    failed = lost.select("article_id").distinct()
    n_failed = failed.limit(MAX_BROADCAST_FAILURES + 1).count()
    if n_failed:  # the usual case has none and joins nothing
        small = n_failed <= MAX_BROADCAST_FAILURES
        rows = rows.join(F.broadcast(failed) if small else failed, "article_id", "left_anti")
    numbered = ingest.with_chunk_ids(rows, ingest.next_serial(chunks, "chunk_id"))
    sinks.append_chunks(numbered, path)
    return lost
