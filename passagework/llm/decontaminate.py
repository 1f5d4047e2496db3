"""Benchmark passages inside documents, by Wu-Manber search over words.

Items are cut into windows of `width` words (a shorter item is one window). Windows of
one length m are one pattern set: the shift table says for a hashed block of two words
(one, for m = 1) how far the search may move on, so most words are never looked at; where
the shift is 0 the block's bucket names the patterns that end there, and the words
themselves are compared. A slice of documents is searched in many lanes at once.

The item tables are broadcast in blocks of about `ITEM_BYTES` of text, and documents pass the
blocks one after the other and are written in between, so a task holds the tables of one block.
The driver builds each block's tables; items with one text are in one block, however many.

Null, empty and word-less texts have no words and no hits; word-less items no windows.
Rows with an equal doc_id are judged one by one, items with equal text all count. Null
item_ids are left out of the items. Columns other than doc_id, text, item_id are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from passagework.llm import blocks
from passagework.session import write_and_read
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 13
ITEM_BYTES = 16 << 20
LANE = 256
TABLE_BITS = 18

_FOUND = "doc_id long, text string, spans binary, items array<long>"
_RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words_of(text: str) -> list[bytes]:
    data = blocks.lowered()[np.frombuffer(text.encode(), np.uint8)]
    words = blocks.Words(data, np.array([0, len(data)]), blocks.alphanumeric())
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(words.starts, words.ends)]


class PatternSet:
    """The shift and bucket tables of windows of one length."""

    def __init__(self, patterns: list[tuple[bytes, ...]], items: list[list[int]]):
        self.m = len(patterns[0])
        self.block = min(2, self.m)
        self.items = items
        self.raw = [b" ".join(p) for p in patterns]
        flat = b"".join(w for p in patterns for w in p)
        sizes = np.array([len(w) for p in patterns for w in p])
        ends = np.cumsum(sizes)
        data = np.frombuffer(flat, np.uint8)
        words = blocks.Words(data, np.concatenate([[0], ends]), np.ones(256, bool))
        self.hashes = words.hashes().reshape(len(patterns), self.m)
        self.shift = np.full(1 << TABLE_BITS, self.m - self.block + 1, np.int32)
        for end in range(self.block, self.m + 1):
            slot = self.slots(self.hashes[:, end - self.block : end])
            np.minimum.at(self.shift, slot, self.m - end)
        last = self.slots(self.hashes[:, self.m - self.block :])
        self.order = np.argsort(last, kind="stable")
        self.bucket = np.searchsorted(last[self.order], np.arange((1 << TABLE_BITS) + 1))

    def slots(self, block: np.ndarray) -> np.ndarray:
        key = block[:, 0] if self.block == 1 else block[:, 0] * np.uint64(blocks.BASE) + block[:, 1]
        return (blocks.mix(key) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of last words, and patterns, whose word hashes agree there."""
        at, stop = self._lanes(bounds)
        found_at, found = [], []
        while len(at):
            block = np.stack([hashes[at - j] for j in range(self.block - 1, -1, -1)], axis=1)
            slot = self.slots(block)
            step = self.shift[slot]
            hit = np.flatnonzero(step == 0)
            if len(hit):
                low, n = self.bucket[slot[hit]], self.bucket[slot[hit] + 1] - self.bucket[slot[hit]]
                pattern = self.order[np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
                where = np.repeat(at[hit], n)
                same = np.ones(len(where), bool)
                for j in range(self.m):
                    same &= hashes[where - self.m + 1 + j] == self.hashes[pattern, j]
                found_at.append(where[same])
                found.append(pattern[same])
            at = at + np.maximum(step, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(found_at), np.concatenate(found)

    def _lanes(self, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and stop positions of window ends: at most LANE of them in a lane."""
        first, stop = bounds[:-1] + self.m - 1, bounds[1:]
        n = np.maximum(0, -(-(stop - first) // LANE))
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(first, n) + nth * LANE
        return start, np.minimum(start + LANE, np.repeat(stop, n))


def pattern_sets(items: list[tuple[int | None, str | None]], width: int) -> list[PatternSet]:
    found: dict[int, dict[tuple[bytes, ...], set]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        words = words_of(text or "")
        m = min(width, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            found[m][tuple(words[i : i + m])].add(item)
    return [PatternSet(list(p), [sorted(x for x in v if x is not None) for v in p.values()]) for _, p in sorted(found.items())]


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = shared.value
        for batch in batches:
            for part in blocks.slices(batch, "text"):
                data, offsets = blocks.text_bytes(part.column("text"))
                words = blocks.Words(blocks.lowered()[data], offsets, blocks.alphanumeric())
                hashes = words.hashes()
                spans: dict[int, list] = defaultdict(list)
                items: dict[int, set] = defaultdict(set)
                for one in sets:
                    where, pattern = one.search(hashes, words.bounds)
                    rows = np.searchsorted(words.bounds, where, side="right") - 1
                    for end, p, row in zip(where.tolist(), pattern.tolist(), rows.tolist()):
                        a = end - one.m + 1
                        if b" ".join(words.data[words.starts[i] : words.ends[i]].tobytes() for i in range(a, end + 1)) == one.raw[p]:
                            spans[row] += (a - words.bounds[row], end + 1 - words.bounds[row])
                            items[row].update(one.items[p])
                n = part.num_rows
                before_spans, before_items = part.column("spans").to_pylist(), part.column("items").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        part.column("text").cast(pa.string()),
                        pa.array([(before_spans[i] or b"") + np.array(spans.get(i, ()), np.int64).tobytes() for i in range(n)], pa.binary()),
                        pa.array([(before_items[i] or []) + sorted(items.get(i, ())) for i in range(n)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text", "spans", "items"],
                )

    return run


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in blocks.slices(batch, "text"):
            data, offsets = blocks.text_bytes(part.column("text"))
            counts = blocks.Words(data, offsets, blocks.alphanumeric()).counts
            rows = []
            for n, spans, items in zip(counts.tolist(), part.column("spans").to_pylist(), part.column("items").to_pylist()):
                ends = np.frombuffer(spans, np.int64)
                hit = 0
                if len(ends):
                    change = np.zeros(n + 1, np.int64)
                    np.add.at(change, ends[::2], 1)
                    np.add.at(change, ends[1::2], -1)
                    hit = int(np.count_nonzero(np.cumsum(change)))
                named = sorted(map(str, set(items)))
                rows.append((n, hit, len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), hit > 0 and 20 * hit >= n))
            columns = list(zip(*rows))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )


def _item_blocks(spark: SparkSession, benchmark: DataFrame, width: int, item_bytes: int):
    """Broadcast tables of the benchmark, at most about `item_bytes` of text in each."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // item_bytes))
    for block in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == block)
        sets = pattern_sets([(r.item_id, r.text) for r in part.toLocalIterator()], width)
        if sets:
            yield spark.sparkContext.broadcast(sets)


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row; see the module's text."""
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    state = texts.select("doc_id", "text", F.lit(b"").alias("spans"), F.lit(None).cast("array<long>").alias("items"))
    last = None
    for shared in _item_blocks(documents.sparkSession, benchmark, width, item_bytes):
        if last:
            state = write_and_read(state, "searched")
            last.destroy()
        state, last = state.mapInArrow(_search(shared), _FOUND), shared
    state = state.withColumn("items", F.coalesce("items", F.array().cast("array<long>")))
    return state.mapInArrow(_verdicts, _RESULT)


def without_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `documents` that are not contaminated; other columns stay.

    Rows that share a doc_id with a contaminated row go with it; rows without doc_id stay.
    """
    bad = contamination(documents, benchmark).where("contaminated").select(F.col("doc_id").alias("bad_id")).distinct()
    return documents.join(bad, documents["doc_id"] == bad["bad_id"], "left_anti")
