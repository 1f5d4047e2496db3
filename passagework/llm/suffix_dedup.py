"""Removal of long byte strings that an earlier document also has, by suffix arrays.

A byte is removed when it lies in a string of `length` bytes that also starts in a document
with a smaller doc_id; documents are judged as they came in, matches stay inside documents.

1. Every string of `length` bytes is known by its minimizer, the least hash of its 16-byte
   substrings, so equal strings have equal minimizers at equal places. Next to the minimizer
   they also share half of the string's other bytes, before it or after it. Runs of strings
   with one minimizer have a key for either; keys are dealt into buckets as compact arrays,
   and a bucket tells which runs have a key that two documents share. Everything else occurs
   once and is out.
2. The texts of documents with such runs are read again, and the runs' bytes go to shards by
   minimizer, about `SHARD_BYTES` each, every different piece once. Runs that reach from a
   common passage into the text around it differ in every document, so minimizers with more
   than `HOT_BYTES` of different runs, judged by a sample, have their strings dealt one by one,
   by a hash of the string. Equal strings meet in both cases. Shards travel in groups of about
   `GROUP_BYTES`, so rows of pieces stay large when the input, and with it the number of shards,
   grows.
3. Every shard builds its suffix array by induced sorting and the permuted common prefixes;
   neighbours with `length` bytes in common are one group of strings, whose smallest doc_id
   decides. The removed ranges are then cut out of the documents.

Tasks combine what they see of one key before they send it: a passage in a third of all
documents reaches its shard once from every task, and copies inside a task are decided there. What a step
hands on is written and its shuffle files are removed, so the disk holds one step's at a time.
Where most of the text is shared, pieces are several times as long as the texts; then the groups
of shards are sent and judged in turns, each over all marked texts.

Null texts are empty. Rows with an equal doc_id are rows of the same age, neither removes from
the other. Rows without doc_id are left alone and remove nothing. Columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa

from passagework.llm import blocks
from passagework.llm.suffix_array import neighbours, suffix_array
from passagework.session import shuffles_removed, write_and_read
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTH = 50
GRAM = 16
#: Runs and documents kept in a task before they are sent, keys in a bucket, pieces kept in a task.
CHUNK_RUNS = 600_000
CHUNK_DOCS = 60_000
BUCKET_KEYS = 2_000_000
CHUNK_PIECES = 250_000
SHARD_BYTES = 1 << 20
#: Bytes of the pieces that travel together; there may be a group for every shuffle partition.
GROUP_BYTES = 8 << 20
#: Bytes of pieces on disk at a time, as times the texts' bytes; more are sent and judged in turns.
TURN_SHARE = 1.5
#: Different runs of one minimizer that may go to one shard, and one in how many texts is asked for them.
HOT_BYTES = SHARD_BYTES // 4
HOT_SAMPLE = 16

_RUNS = "bucket long, chunk long, keys binary, runs binary, shared binary, docs binary"
_MARKED_RUNS = "chunk long, runs binary, docs binary"
_SHARED = "doc_id long, n_runs long, ordinals binary"
_SEEN = "key long, piece long"
_GROUPED = "shard_group long, doc_id long, row_hash long, ranges binary, pieces binary, owners binary"
_PIECES = "doc_id long, row_hash long, ranges binary, pieces binary, sizes binary, docs binary, hashes binary, starts binary, which binary"
_RANGES = "doc_id long, row_hash long, ranges binary"
_CUT = "doc_id long, row_hash long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_LOW = np.uint64((1 << 32) - 1)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    if have < width:
        x = np.minimum(x[: len(x) - width + have], x[width - have :])
    return x


def _minimized(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Stretches of strings with one minimizer at one place: minimizers, their places, first strings, rows."""
    if len(data) < length:
        return np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3
    grams = np.arange(len(data) - GRAM + 1)
    hashes = blocks.span_hashes(data, grams, grams + GRAM)
    # the least upper half, and of equal ones the leftmost
    least = _sliding_min((hashes & ~_LOW) | grams.astype(np.uint64), length - GRAM + 1)
    at = (least & _LOW).astype(np.int64)
    inside = np.zeros(len(at) + 1, np.int64)
    sizes = np.diff(offsets)
    long_ = sizes >= length
    np.add.at(inside, offsets[:-1][long_], 1)
    np.add.at(inside, offsets[1:][long_] - length + 1, -1)
    begins = np.cumsum(inside[:-1]) > 0
    begins[1:] &= at[1:] != at[:-1]
    begins[offsets[:-1][long_]] = True
    first = np.flatnonzero(begins)
    return hashes[at[first]], at[first], first, np.searchsorted(offsets, first, side="right") - 1


def _new_runs(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which stretches begin a run."""
    return np.append(True, (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])) if len(keys) else np.empty(0, bool)


def string_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of strings with one minimizer: minimizers, first and stop positions, rows."""
    keys, _, first, rows = _minimized(data, offsets, length)
    new = _new_runs(keys, rows)
    keys, first, rows = keys[new], first[new], rows[new]
    stop = np.append(first[1:], 0)[: len(first)]
    last = np.append(rows[1:] != rows[:-1], True)[: len(rows)]
    stop[last] = offsets[rows[last] + 1] - length + 1
    return keys, first, stop, rows


def run_keys(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Rows of the runs of `string_runs`, and the keys by which runs with a common string are found, with their runs' numbers.

    Equal strings have the same minimizer at the same place, so they share the `half` bytes before
    it or those after it: of the others, `length - GRAM` in all, at least half stand on one side.
    """
    keys, at, _, rows = _minimized(data, offsets, length)
    new = _new_runs(keys, rows)
    run, half = np.cumsum(new) - 1, (length - GRAM) // 2
    sides = []
    for begin, end in ((at - half, at + GRAM), (at, at + GRAM + half)):
        whole = (begin >= offsets[rows]) & (end <= offsets[rows + 1])
        sides.append((begin[whole], end[whole], run[whole]))
    begin, end, run = (np.concatenate(x) for x in zip(*sides))
    found = blocks.span_hashes(data, begin, end)
    found[len(sides[0][0]) :] ^= _LOW
    again = np.zeros(len(run), bool)  # a repeating text has the same key at every place
    again[1:] = (found[1:] == found[:-1]) & (run[1:] == run[:-1])
    return rows[new], found[~again], run[~again]


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _find_runs(length: int, buckets: int):
    """Chunks of keys, dealt into buckets; runs that two documents of the chunk share are known.

    A run is named by its chunk and its number there. Every chunk also has a row with its
    documents, their numbers of runs and the runs that are known, which a bucket hands on.
    """

    def flush(name: str, held: list[tuple], docs: list[int]) -> Iterator[pa.RecordBatch]:
        keys, owners, runs, counts = (np.concatenate(x) for x in zip(*held))
        if not len(keys):
            return
        doc_ids = np.array(docs, np.int64)
        digest = hashlib.blake2b(b"%d " % len(docs) + doc_ids.tobytes() + counts.tobytes() + name.encode(), digest_size=8)
        chunk = int.from_bytes(digest.digest(), "little", signed=True)
        order = np.argsort(keys)
        keys, ids, runs = keys[order], doc_ids[owners[order]], runs[order]
        first = _firsts(keys)
        sizes = np.diff(np.append(first, len(keys)))
        shared = np.repeat(np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first), sizes)
        known = np.unique(runs[shared])
        keep = ~shared
        keep[first] = True  # a shared key goes on once for the others to see
        bucket = _bucket(keys, buckets)
        keys, runs, shared, bucket = (x[keep] for x in (keys, runs, shared, bucket))
        order = np.argsort((bucket << 32) | runs)
        keys, runs, shared = keys[order].astype(np.uint32), runs[order], shared[order]
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
        rows = [
            (b, chunk, keys[i:j].tobytes(), _pressed_numbers(runs[i:j]), np.packbits(shared[i:j]).tobytes() if shared[i:j].any() else b"", None)
            for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j
        ]
        rows.append((chunk % buckets, chunk, None, _pressed_numbers(known), None, _pressed_numbers(doc_ids, counts)))
        yield _batch(rows, _RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sent = TaskContext.get(), 0
        held, docs, count = [], [], 0
        for batch in batches:
            for part in blocks.slices(batch, "text"):
                data, offsets = blocks.text_bytes(part.column("text"))
                rows, keys, runs = run_keys(data, offsets, length)
                held.append((keys, rows[runs] + len(docs), runs + count, np.bincount(rows, minlength=part.num_rows)))
                docs += part.column("doc_id").to_pylist()
                count += len(rows)
                if count >= CHUNK_RUNS or len(docs) >= CHUNK_DOCS - 20_000:
                    yield from flush(f"{task and task.partitionId()}/{sent}", held, docs)
                    sent += 1
                    held, docs, count = [], [], 0
        if held:
            yield from flush(f"{task and task.partitionId()}/{sent}", held, docs)

    return run


def _share(table: pa.Table) -> pa.Table:
    """For one bucket: the runs with a key that two documents have, by chunk, and the rows of documents."""
    out, rows = [], []
    for row in table.select(["chunk", "keys", "runs", "shared", "docs"]).to_pylist():
        if row["keys"] is None:
            out.append((row["chunk"], row["runs"], row["docs"]))
        else:
            rows.append(row)
    if rows:
        keys = [np.frombuffer(r["keys"], np.uint32) for r in rows]
        sizes = np.array([len(k) for k in keys])
        runs = np.concatenate([_numbers(r["runs"])[0] for r in rows])
        known = np.concatenate([np.unpackbits(np.frombuffer(r["shared"], np.uint8), count=n).view(bool) if r["shared"] else np.zeros(n, bool) for r, n in zip(rows, sizes.tolist())])
        keys, at = np.concatenate(keys), np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
        order = np.argsort(keys)
        keys, ordered = keys[order], at[order]
        first = _firsts(keys)
        several = (np.minimum.reduceat(ordered, first) != np.maximum.reduceat(ordered, first)) | np.logical_or.reduceat(known[order], first)
        marked = np.zeros(len(keys), bool)
        marked[order] = np.repeat(several, np.diff(np.append(first, len(keys))))
        marked &= ~known  # those are in their chunk's row
        cuts = np.searchsorted(at[marked], np.arange(len(rows) + 1)).tolist()
        runs = runs[marked]
        out += [(r["chunk"], _pressed_numbers(runs[i:j]), None) for r, i, j in zip(rows, cuts, cuts[1:]) if i < j]
    return _table(out, _MARKED_RUNS)


def _by_document(table: pa.Table) -> pa.Table:
    """For one chunk: a row for each document that has marked runs, with their numbers in it."""
    rows = table.select(["runs", "docs"]).to_pylist()
    documents = [r["docs"] for r in rows if r["docs"] is not None]
    if len(documents) != 1:
        raise ValueError(f"a chunk of runs came with {len(documents)} lists of documents; the input changed between two readings")
    docs, counts = _numbers(documents[0])
    runs = np.unique(np.concatenate([_numbers(r["runs"])[0] for r in rows]))
    stops = np.cumsum(counts)
    own = np.searchsorted(stops, runs, side="right")
    first = _firsts(own)
    parts = np.split((runs - (stops - counts)[own]).astype(np.uint32), first[1:]) if len(own) else []
    return _table([(int(docs[own[i]]), len(p), p.tobytes()) for i, p in zip(first.tolist(), parts)], _SHARED)


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where a sorted array has a new value."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, np.int64)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows of the kinds that a schema's text names."""
    kinds = [pa.int64() if c.endswith(" long") else pa.binary() for c in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_names(schema))


def _table(rows: list[tuple], schema: str) -> pa.Table:
    return pa.Table.from_batches([_batch(rows, schema)])


_PLAIN = 1 << 63


def _pressed(x: bytes | np.ndarray) -> bytes:
    """Compressed bytes after their length, or the bytes themselves where that is shorter."""
    raw = x if isinstance(x, bytes) else x.tobytes()
    packed = pa.compress(raw, "zstd", asbytes=True)
    return len(raw).to_bytes(8, "little") + packed if len(packed) < len(raw) else _plain(raw)


def _plain(x: bytes | np.ndarray) -> bytes:
    raw = x if isinstance(x, bytes) else x.tobytes()
    return (len(raw) | _PLAIN).to_bytes(8, "little") + raw


def _unpressed(x: bytes) -> bytes:
    size = int.from_bytes(x[:8], "little")
    return x[8:] if size & _PLAIN else pa.decompress(x[8:], size, "zstd", asbytes=True)


def _pressed_numbers(*lists: np.ndarray) -> bytes:
    """Lists of whole numbers as their steps, the bytes of one weight together."""
    out = []
    for x in lists:
        step = np.diff(x.astype(np.int64), prepend=np.int64(0))
        step = ((step << 1) ^ (step >> 63)).view(np.uint64)
        width = -(-int(step.max(initial=0)).bit_length() // 8)
        out += [np.array([len(x), width], np.uint32).tobytes(), step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return _pressed(b"".join(out))


def _numbers(x: bytes) -> list[np.ndarray]:
    """The lists of `_pressed_numbers`."""
    raw, at, out = np.frombuffer(_unpressed(x), np.uint8), 0, []
    while at < len(raw):
        n, width = raw[at : at + 8].view(np.uint32).tolist()
        step = np.zeros((n, 8), np.uint8)
        step[:, :width] = raw[at + 8 : at + 8 + n * width].reshape(width, n).T
        step = step.view("<u8").ravel()
        out.append(np.cumsum((step >> np.uint64(1)).view(np.int64) ^ -(step & np.uint64(1)).view(np.int64)))
        at += 8 + n * width
    return out


def _ranges(first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The numbers from every `first` up to its `stop`."""
    sizes = stop - first
    before = np.cumsum(sizes) - sizes
    return np.repeat(first - before, sizes) + np.arange(sizes.sum())


def _chosen(lists: list[bytes], begin: int, end: int) -> np.ndarray:
    """A text's marked runs, of those from `begin` to `end`."""
    ordinals = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in lists])).astype(np.int64)
    return begin + ordinals[ordinals < end - begin]


def _see_runs(length: int):
    """Minimizer and hash of every marked run, different ones once a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks.slices(batch, "text"):
                data, offsets = blocks.text_bytes(part.column("text"))
                keys, first, stop, rows = string_runs(data, offsets, length)
                bounds = np.searchsorted(rows, np.arange(part.num_rows + 1))
                chosen = np.concatenate([_chosen(x, bounds[i], bounds[i + 1]) for i, x in enumerate(part.column("ordinals").to_pylist())])
                pieces = blocks.span_hashes(data, first[chosen], stop[chosen] + length - 1)
                pairs = np.unique(np.stack([keys[chosen], pieces], axis=1).astype(np.uint64), axis=0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["key", "piece"])

    return run


def _hot_keys(marked: DataFrame, length: int) -> tuple[np.ndarray, int]:
    """Minimizers with too many different runs for a shard, in order, and about how many runs they have.

    Only the balance of the shards depends on the sample. There is less than one such minimizer
    for every `HOT_BYTES` of runs.
    """
    sample = marked.where(F.pmod(F.xxhash64("doc_id", "row_hash"), F.lit(HOT_SAMPLE)) == 0)
    seen = sample.mapInArrow(_see_runs(length), _SEEN).distinct().groupBy("key").count()
    bytes_each = length + (length - GRAM) // 2
    hot = seen.where(F.col("count") * F.lit(HOT_SAMPLE * bytes_each) > HOT_BYTES).collect()
    return np.sort(np.array([r["key"] for r in hot], np.int64).view(np.uint64)), sum(r["count"] for r in hot) * HOT_SAMPLE


def _send_pieces(length: int, shards: int, groups: int, hot: np.ndarray, turn: int = 0, turns: int = 1):
    """The marked runs' bytes, each different piece once a chunk, dealt to shards by minimizer and sent by groups of shards.

    Runs of a minimizer in `hot` are cut into their strings, each dealt by its own hash.
    Of a piece that several documents of the chunk have, the smallest doc_id's goes on; in the
    others the piece is removed, which is sent as ranges in rows without a piece. A turn has
    every `turns`-th group.
    """

    def flush(index: dict[bytes, int], held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not index:
            return
        pieces, sizes = list(index), np.fromiter(map(len, index), np.int64, len(index))
        piece, shard, docs, hashes, starts = (np.concatenate(x) for x in zip(*held))
        oldest = np.full(len(pieces), np.iinfo(np.int64).max)
        np.minimum.at(oldest, piece, docs)
        late = docs > oldest[piece]
        rows = []
        if late.any():
            ranges = _merged(docs[late], hashes[late], starts[late], starts[late] + sizes[piece[late]])
            for row in _ranges_table(*ranges).to_pylist():
                rows.append((row["doc_id"] % groups, row["doc_id"], row["row_hash"], row["ranges"], None, None))
        piece, shard, docs, hashes, starts = (x[~late] for x in (piece, shard, docs, hashes, starts))
        order = np.lexsort((hashes, piece, shard, shard % groups))
        piece, shard, docs, hashes, starts = (x[order] for x in (piece, shard, docs, hashes, starts))
        # rows of one doc_id have a piece each
        first = np.flatnonzero(np.append(True, (piece[1:] != piece[:-1]) | (hashes[1:] != hashes[:-1])))
        counts = np.diff(np.append(first, len(piece)))
        piece, shard, docs, hashes = (x[first] for x in (piece, shard, docs, hashes))
        cuts = np.searchsorted(shard % groups, np.arange(groups + 1)).tolist()
        bounds = np.append(first, len(starts))
        for group, (i, j) in enumerate(zip(cuts, cuts[1:])):
            if i < j:
                lists = shard[i:j], sizes[piece[i:j]], docs[i:j], hashes[i:j], counts[i:j], starts[bounds[i] : bounds[j]]
                rows.append((group, None, None, None, _pressed(b"".join([pieces[k] for k in piece[i:j].tolist()])), _pressed_numbers(*lists)))
        yield _batch(rows, _GROUPED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[bytes, int] = {}
        held: list[tuple] = []
        seen = 0
        for batch in batches:
            for part in blocks.slices(batch, "text"):
                data, offsets = blocks.text_bytes(part.column("text"))
                keys, first, stop, rows = string_runs(data, offsets, length)
                raw, bounds = data.tobytes(), np.searchsorted(rows, np.arange(part.num_rows + 1))
                chosen = np.concatenate([_chosen(x, bounds[i], bounds[i + 1]) for i, x in enumerate(part.column("ordinals").to_pylist())])
                cut = np.isin(keys[chosen], hot)
                whole, cut = chosen[~cut], chosen[cut]
                singles = _ranges(first[cut], stop[cut])
                begins = np.concatenate([first[whole], singles])
                ends = np.concatenate([stop[whole] + length - 1, singles + length])
                dealt_by = np.concatenate([keys[whole], blocks.span_hashes(data, singles, singles + length)])
                row = np.concatenate([rows[whole], np.repeat(rows[cut], stop[cut] - first[cut])])
                shard = (blocks.mix(dealt_by) % np.uint64(shards)).astype(np.int64)
                mine = shard % groups % turns == turn
                begins, ends, row, shard = (x[mine] for x in (begins, ends, row, shard))
                piece = [index.setdefault(raw[a:b], len(index)) for a, b in zip(begins.tolist(), ends.tolist())]
                docs, hashes = (part.column(c).to_numpy()[row] for c in ("doc_id", "row_hash"))
                held.append((np.array(piece, np.int64), shard, docs, hashes, begins - offsets[row]))
                seen += len(piece)
                if seen >= CHUNK_PIECES:
                    yield from flush(index, held)
                    index, held, seen = {}, [], 0
        yield from flush(index, held)

    return run


def _merged(docs: np.ndarray, hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of a row that touch or overlap are one."""
    order = np.lexsort((begins, hashes, docs))
    docs, hashes, begins, ends = docs[order], hashes[order], begins[order], ends[order]
    new_row = np.append(True, (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1]))
    shift = (np.cumsum(new_row) - 1) << 32  # ends so far never reach into the next row
    reach = np.maximum.accumulate(ends + shift)
    first = np.flatnonzero(new_row | np.append(True, begins[1:] + shift[1:] > reach[:-1]))
    return docs[first], hashes[first], begins[first], (reach - shift)[np.append(first[1:], len(docs)) - 1]


def _ranges_table(docs: np.ndarray, hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Table:
    order = np.lexsort((begins, hashes, docs))
    docs, hashes, begins, ends = docs[order], hashes[order], begins[order], ends[order]
    first = np.flatnonzero(np.append(True, (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1]))) if len(docs) else np.empty(0, np.int64)
    pairs = np.stack([begins, ends], axis=1)
    parts = np.split(pairs, first[1:]) if len(docs) else []
    return pa.table({"doc_id": pa.array(docs[first], pa.int64()), "row_hash": pa.array(hashes[first], pa.int64()), "ranges": blocks.binary(parts)})


def _judge_shard(length: int):
    """The removed ranges of a shard's occurrences, and those that arrive decided."""

    def run(table: pa.Table) -> pa.Table:
        index: dict[bytes, int] = {}
        oldest, piece_of, docs, hashes, starts = [], [], [], [], []
        decided = []
        for row in table.to_pylist():
            if row["pieces"] is None:
                decided.append((row["doc_id"], row["row_hash"], np.frombuffer(row["ranges"], np.int64).reshape(-1, 2)))
                continue
            sizes, pieces = np.frombuffer(_unpressed(row["sizes"]), np.uint32), _unpressed(row["pieces"])
            own_docs, own_hashes = np.frombuffer(_unpressed(row["docs"]), np.int64), np.frombuffer(row["hashes"], np.int32)
            own, at = np.empty(len(sizes), np.int64), 0
            for k, (size, doc) in enumerate(zip(sizes.tolist(), own_docs.tolist())):
                place = own[k] = index.setdefault(pieces[at : at + size], len(index))
                if place == len(oldest):
                    oldest.append(doc)
                elif doc < oldest[place]:
                    oldest[place] = doc
                at += size
            which = np.frombuffer(_unpressed(row["which"]), np.uint32)
            piece_of.append(own[which])
            docs.append(own_docs[which])
            hashes.append(own_hashes[which])
            starts.append(np.frombuffer(_unpressed(row["starts"]), np.uint32).astype(np.int64))
        out = [(np.full(len(r), d, np.int64), np.full(len(r), h, np.int64), r[:, 0], r[:, 1]) for d, h, r in decided]
        if index:
            out.append(_removed(list(index), np.array(oldest), *(np.concatenate(x) for x in (piece_of, docs, hashes, starts)), length))
        return _ranges_table(*(np.concatenate(x) for x in zip(*out)))

    return run


def _judge_group(length: int):
    """The removed ranges of a group's shards, judged one after the other."""
    judge = _judge_shard(length)

    def run(table: pa.Table) -> pa.Table:
        decided, pieces, owners = [], {}, []
        for row in table.select(_names(_GROUPED)[1:]).to_pylist():
            if row["pieces"] is None:
                decided.append((row["doc_id"], row["row_hash"], row["ranges"], *[None] * 6))
                continue
            lists, raw = _numbers(row["owners"]), _unpressed(row["pieces"])
            owners.append(lists)
            first = _firsts(lists[0])
            stops = np.cumsum(lists[1])
            begins = (stops - lists[1])[first]
            for shard, a, b in zip(lists[0][first].tolist(), begins.tolist(), np.append(begins[1:], stops[-1]).tolist()):
                pieces.setdefault(shard, []).append(raw[a:b])
        out = [judge(_table(decided, _PIECES))] if decided else []
        if owners:
            shard, sizes, docs, hashes, counts, starts = (np.concatenate(x) for x in zip(*owners))
            shard_of_start = np.repeat(shard, counts)
            order, order_of_starts = np.argsort(shard, kind="stable"), np.argsort(shard_of_start, kind="stable")
            numbers = np.array(sorted(pieces))
            cuts, start_cuts = (np.append(np.searchsorted(x, numbers), len(x)) for x in (shard[order], shard_of_start[order_of_starts]))
            for k, number in enumerate(numbers.tolist()):
                own, own_starts = order[cuts[k] : cuts[k + 1]], order_of_starts[start_cuts[k] : start_cuts[k + 1]]
                which = np.repeat(np.arange(len(own), dtype=np.uint32), counts[own])
                out.append(judge(_table([(
                    None, None, None, _plain(b"".join(pieces.pop(number))), _plain(sizes[own].astype(np.uint32)), _plain(docs[own]),
                    hashes[own].astype(np.int32).tobytes(), _plain(starts[own_starts].astype(np.uint32)), _plain(which),
                )], _PIECES)))
        return pa.concat_tables(out)

    return run


def _removed(pieces: list[bytes], oldest: np.ndarray, piece_of, docs, hashes, starts, length: int) -> tuple[np.ndarray, ...]:
    """doc_id, row hash, begin and end of every removed range."""
    sizes = np.array([len(p) for p in pieces])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    s = _with_gaps(pieces)
    order = suffix_array(s, length)
    prefix = neighbours(s, order, length)
    n_strings = sizes - length + 1
    string_at = np.repeat(begin - np.concatenate([[0], np.cumsum(n_strings)[:-1]]), n_strings) + np.arange(n_strings.sum())
    owner = np.repeat(np.arange(len(pieces)), n_strings)
    is_string = np.zeros(len(s), bool)
    is_string[string_at] = True
    # groups: neighbours in order that share `length` bytes; bytes of a string never hold a gap
    group_start = prefix[order] < length
    group = np.cumsum(group_start) - 1
    least = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    owner_at = np.zeros(len(s), np.int64)
    owner_at[string_at] = owner
    real = is_string[order]
    np.minimum.at(least, group[real], oldest[owner_at[order[real]]])
    by_position = np.empty(len(s), np.int64)
    by_position[order] = least[group]
    oldest_of_string = by_position[string_at]
    # strings of every occurrence, as runs of neighbours that an older document has
    base = np.concatenate([[0], np.cumsum(n_strings)])[:-1]
    each = n_strings[piece_of]
    total = np.concatenate([[0], np.cumsum(each)])
    occurrence = np.repeat(np.arange(len(piece_of)), each)
    offset = np.arange(total[-1]) - total[:-1][occurrence]
    old = oldest_of_string[base[piece_of][occurrence] + offset] < docs[occurrence]
    edge = np.diff(old.astype(np.int8), prepend=0)
    new = np.diff(occurrence, prepend=-1) != 0
    first = np.flatnonzero(old & ((edge == 1) | new))
    last = np.flatnonzero(old & np.append((~old[1:]) | new[1:], True)) if len(old) else first
    at = starts[occurrence[first]]
    return docs[occurrence[first]], hashes[occurrence[first]], at + offset[first], at + offset[last] + length


def _with_gaps(pieces: list[bytes]) -> np.ndarray:
    """The pieces one after the other, parted by 1 and ended by 0; UTF-8 bytes are at most 244, so 2 can be added."""
    return np.frombuffer(b"\xff".join(pieces) + b"\xff\xfe", np.uint8) + np.uint8(2)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, row_hash, text, lists in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row_hash", "text", "ranges"))):
            raw = np.frombuffer(text, np.uint8)
            pairs = np.concatenate([np.frombuffer(x, np.int64) for x in lists]).reshape(-1, 2)
            change = np.zeros(len(raw) + 1, np.int64)
            np.add.at(change, pairs[:, 0], 1)
            np.add.at(change, pairs[:, 1], -1)
            gone = np.cumsum(change[:-1]) > 0
            kept = raw[~gone].tobytes()
            spans = int(np.count_nonzero(gone & ~np.append(False, gone[:-1])))
            rows.append((doc, row_hash, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_names(_CUT))


def _row_hash(text: Column) -> Column:
    """Tells rows with an equal doc_id apart; 31 bits of a hash of the text."""
    return F.pmod(F.xxhash64(text), F.lit(1 << 31)).alias("row_hash")


def removed_ranges(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, row_hash, text (binary), ranges (list of binary pairs) of rows that lose bytes."""
    with shuffles_removed(documents.sparkSession):
        marked, ranges = _marked_and_judged(documents, length)
    ranges = ranges.groupBy("doc_id", "row_hash").agg(F.collect_list("ranges").alias("ranges"))
    return marked.select("doc_id", "row_hash", "text").dropDuplicates(["doc_id", "row_hash"]).join(ranges, ["doc_id", "row_hash"])


def _marked_and_judged(documents: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Texts with runs that others may have, and the ranges that are removed from them, both written."""
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), _row_hash(F.col("text")), F.col("text").cast("binary").alias("text")
    )
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total * 4 // ((length - GRAM + 2) * BUCKET_KEYS)))  # a run has two keys
    runs = texts.mapInArrow(_find_runs(length, buckets), _RUNS)
    shared = runs.groupBy("bucket").applyInArrow(_share, _MARKED_RUNS)
    shared = write_and_read(shared.groupBy("chunk").applyInArrow(_by_document, _SHARED), "shared-runs", compression="zstd")
    shared = shared.groupBy("doc_id").agg(F.sum("n_runs").alias("n_runs"), F.collect_list("ordinals").alias("ordinals"))
    marked = write_and_read(texts.join(shared, "doc_id"), "shared-texts", compression="zstd")
    runs_marked = marked.agg(F.sum("n_runs")).first()[0] or 0
    # a run's piece has as many bytes as strings, and length - 1 more
    hot, hot_runs = _hot_keys(marked, length)
    strings_each = (length - GRAM) // 2 + 1
    in_pieces = runs_marked * (length + strings_each - 1) + hot_runs * strings_each * length
    shards = max(1, -(-in_pieces // SHARD_BYTES))
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = min(shards, max(partitions, -(-in_pieces // GROUP_BYTES)))
    turns = min(groups, max(1, math.ceil(in_pieces / (TURN_SHARE * max(total, 1)))))
    judged = []
    for turn in range(turns):
        pieces = marked.mapInArrow(_send_pieces(length, shards, groups, hot, turn, turns), _GROUPED)
        judged.append(write_and_read(pieces.groupBy("shard_group").applyInArrow(_judge_group(length), _RANGES), "removed-ranges", compression="zstd"))
    return marked, reduce(DataFrame.union, judged)


def deduplicated(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept for every row; see the module's text.

    `kept` holds the remaining bytes of rows that lost some, and is null for the others.
    """
    text = F.coalesce("text", F.lit(""))
    whole = documents.select("doc_id", _row_hash(text), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("whole"))
    cut = removed_ranges(documents, length).mapInArrow(_cut, _CUT)
    none = F.lit(0).cast("long")
    return whole.join(cut, ["doc_id", "row_hash"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"), "kept",
    )
