"""Ranked lexical search by dense blocked matrix multiplication.

Terms are runs of digits, ASCII letters (A-Z lower-cased) and characters beyond ASCII. An
item's score of a document sums weight times impact over the item's distinct terms; weights
fall with the number of documents that hold a term, impacts grow with its occurrences and
fall with the document's length. All but the weights' logarithm is integer arithmetic.

One pass cuts documents into terms and stores the items' terms in each with their
occurrences; counts over that table give the weights. Then tiles of documents and items
meet: the terms that both have are a tile's vocabulary, cut into pieces so short that no sum
of products reaches 2**53, and impacts (documents x terms) times weights (terms x items) is
one float64 multiplication for each piece, exact whatever the order of additions. Every task
keeps its best rows of each item; equal scores keep the smaller doc_ids, so cuts are
repeatable. They are merged in two steps, so one item's candidates never meet in one sort.

Items are read in blocks of about `BLOCK_TERMS` terms, each a stated query set of its own
that is sent to the tasks; documents are never collected. Terms are compared by a 64-bit hash
and their length in bytes.

Null, empty and term-less texts hold nothing and count nowhere. Documents with an equal
doc_id are ranked one by one; a null doc_id comes after all others with its score. Items with
an equal item_id (null too) are one item with the terms of all; items without a hit have no
row. Columns other than doc_id, text and item_id are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from passagework.llm import blocks
from passagework.session import write_and_read
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 10
BLOCK_TERMS = 1 << 20
#: Sides of a tile: documents, items, and at most so many terms at once.
TILE_DOCS, TILE_ITEMS, TILE_TERMS = 1024, 256, 2048
EXACT = 1 << 53
#: A document's impact of a term is below this.
MOST_IMPACT = 1_000_000
MERGE_GROUPS = 32
NO_ID = np.iinfo(np.int64).max

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HELD = "doc_id long, n long, terms array<int>, counts array<int>"
_BEST = "item_id long, doc_id long, score long"


class Items(NamedTuple):
    """A block of items: ids, and each one's terms as numbers in `terms`, cut at `bounds`."""

    ids: list[int | None]
    bounds: np.ndarray
    terms: np.ndarray


class Vocabulary(NamedTuple):
    """Distinct terms, ordered by their hash."""

    hashes: np.ndarray
    lengths: np.ndarray


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_TERM), F.lit(0))


def _vocabulary(terms: list[str]) -> tuple[Vocabulary, dict[str, int]]:
    raw = [t.encode() for t in terms]
    ends = np.cumsum([0, *map(len, raw)])
    hashes = blocks.span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends[:-1], ends[1:])
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], np.diff(ends)[order]), {terms[j]: i for i, j in enumerate(order.tolist())}


def _item_blocks(benchmark: DataFrame, block_terms: int) -> Iterator[tuple[Items, Vocabulary]]:
    """Items and their vocabulary, at most about `block_terms` terms of items at once."""
    terms = blocks.narrowed(benchmark, "item_id", "text").select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term"))
    terms = write_and_read(terms.distinct(), "item-terms")
    n = max(1, -(-terms.count() // block_terms))
    for block in range(n):
        part = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == block)
        held: dict[int | None, list[str]] = {}
        for row in part.toLocalIterator():
            held.setdefault(row.item_id, []).append(row.term)
        if held:
            vocabulary, number = _vocabulary(sorted({t for own in held.values() for t in own}))
            lists = [np.array(sorted(number[t] for t in own), np.int64) for own in held.values()]
            yield Items(list(held), np.cumsum([0, *map(len, lists)]), np.concatenate(lists)), vocabulary


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values.astype(np.int32)))


def _held_terms(shared):
    """doc_id, n (all terms), and the vocabulary's terms with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: Vocabulary = shared.value
        size = len(vocabulary.hashes)
        for batch in batches:
            for part in blocks.slices(batch, "text"):
                data, offsets = blocks.text_bytes(part.column("text"))
                words = blocks.Words(blocks.lowered()[data], offsets, blocks.alphanumeric())
                hashes = words.hashes()
                at = np.minimum(np.searchsorted(vocabulary.hashes, hashes), size - 1)
                known = (vocabulary.hashes[at] == hashes) & (vocabulary.lengths[at] == words.ends - words.starts)
                row = np.repeat(np.arange(part.num_rows), words.counts)
                pairs, counts = np.unique(row[known] * size + at[known], return_counts=True)
                each = np.bincount(pairs // size, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(words.counts.astype(np.int64)), _lists(pairs % size, each), _lists(counts, each)],
                    names=["doc_id", "n", "terms", "counts"],
                )

    return run


class Best:
    """The `top` best documents of every item among those seen; memory follows items, not documents."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.item = self.score = self.doc = np.empty(0, np.int64)
        self.floor, self.floor_doc = np.zeros(items, np.int64), np.full(items, np.iinfo(np.int64).min)

    def add(self, first: int, scores: np.ndarray, docs: np.ndarray) -> None:
        """scores: documents x items, of the items from `first` on."""
        own = slice(first, first + scores.shape[1])
        floor, floor_doc = self.floor[own], self.floor_doc[own]
        if len(docs) > self.top:
            kth = np.partition(scores, len(docs) - self.top, axis=0)[len(docs) - self.top]
            floor_doc = np.where(kth > floor, NO_ID, floor_doc)
            floor = np.maximum(floor, kth)
        wins = (scores > floor) | ((scores == floor) & (docs[:, None] <= floor_doc) & (scores > 0))
        doc, item = np.nonzero(wins)
        self.item = np.concatenate([self.item, item + first])
        self.score = np.concatenate([self.score, scores[doc, item]])
        self.doc = np.concatenate([self.doc, docs[doc]])
        order = np.lexsort((self.doc, -self.score, self.item))
        item = self.item[order]
        keep = order[np.arange(len(item)) - np.searchsorted(item, item) < self.top]
        self.item, self.score, self.doc = self.item[keep], self.score[keep], self.doc[keep]
        full = np.flatnonzero(np.bincount(self.item, minlength=len(self.floor)) == self.top)
        last = np.searchsorted(self.item, full, side="right") - 1
        self.floor[full], self.floor_doc[full] = self.score[last], self.doc[last]


def impacts(counts: np.ndarray, sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Impacts of terms that occur `counts` times in documents of `sizes` terms."""
    if 90 * n_docs * int(sizes.max(initial=0)) > NO_ID:
        share = np.array([90 * int(n) * n_docs // n_terms for n in sizes], np.int64)
    else:
        share = 90 * sizes * n_docs // n_terms
    return (1_000_000_000 * counts) // (1000 * counts + 8 * (10 + share))


def tile_scores(rows: np.ndarray, terms: np.ndarray, impact: np.ndarray, n_rows: int, item_of: np.ndarray, item_terms: np.ndarray, n_items: int, weights: np.ndarray) -> np.ndarray:
    """Scores of n_rows documents for n_items items from (row, term, impact) and (item, term) entries."""
    total = np.zeros((n_rows, n_items), np.int64)
    common = np.intersect1d(terms, item_terms)
    if not len(common):
        return total
    step = max(1, min(TILE_TERMS, (EXACT - 1) // (MOST_IMPACT * max(1, int(weights[common].max())))))
    for start in range(0, len(common), step):
        piece = common[start : start + step]
        places = []
        for values in (terms, item_terms):
            at = np.minimum(np.searchsorted(piece, values), len(piece) - 1)
            places.append((at, piece[at] == values))
        (doc_at, in_doc), (item_at, in_item) = places
        left = np.zeros((n_rows, len(piece)))
        left[rows[in_doc], doc_at[in_doc]] = impact[in_doc]
        right = np.zeros((len(piece), n_items))
        right[item_at[in_item], item_of[in_item]] = weights[item_terms[in_item]]
        total += (left @ right).astype(np.int64)
    return total


def _search(shared, n_docs: int, n_terms: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        best = Best(len(items.ids), top)
        for batch in batches:
            for start in range(0, batch.num_rows, TILE_DOCS):
                part = batch.slice(start, TILE_DOCS)
                docs = part.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
                held = part.column("terms")
                sizes = held.value_lengths().to_numpy(zero_copy_only=False)
                rows = np.repeat(np.arange(part.num_rows), sizes)
                terms, counts = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "counts"))
                n = part.column("n").to_numpy(zero_copy_only=False)
                impact = impacts(counts, n[rows], n_docs, n_terms)
                for first in range(0, len(items.ids), TILE_ITEMS):
                    bounds = items.bounds[first : first + TILE_ITEMS + 1]
                    own = items.terms[bounds[0] : bounds[-1]]
                    item_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                    best.add(first, tile_scores(rows, terms, impact, part.num_rows, item_of, own, len(bounds) - 1, weights), docs)
        ids = pa.array(items.ids, pa.int64())
        docs = pa.array(best.doc, mask=best.doc == NO_ID)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(best.item)), docs, pa.array(best.score)], names=["item_id", "doc_id", "score"])

    return run


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["item_id", F.pmod("doc_id", F.lit(MERGE_GROUPS))], ["item_id"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return found.select("item_id", "rank", "doc_id", "score")


def ranked_documents(documents: DataFrame, benchmark: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of every item; see the module's text."""
    spark = documents.sparkSession
    texts = blocks.narrowed(documents, "doc_id", "text")
    out = spark.createDataFrame([], _BEST).select("item_id", F.lit(0).alias("rank"), "doc_id", "score")
    for items, vocabulary in _item_blocks(benchmark, block_terms):
        sent = spark.sparkContext.broadcast(vocabulary)
        held = write_and_read(texts.mapInArrow(_held_terms(sent), _HELD).where("n > 0"), "held-terms")
        sent.destroy()
        size = held.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not size.docs:
            break
        df = np.zeros(len(vocabulary.hashes), np.int64)
        for row in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[row.term] = row["count"]
        weights = np.array([math.floor(1000 * math.log((2 * size.docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        found = held.where(F.size("terms") > 0).mapInArrow(_search(spark.sparkContext.broadcast((items, weights)), size.docs, size.terms, top), _BEST)
        out = out.unionByName(_ranked(found, top))
    return out
