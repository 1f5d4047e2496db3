"""Token sequences of fixed length from documents, by first-fit decreasing.

Every text becomes its token ids and one closing id, cut into pieces of at most `capacity`
ids. Documents are dealt at random into groups of about `GROUP_DOCS`; in each group the
pieces, longest first, go into the first sequence with room, found in a tournament tree
whose nodes hold the greatest room below them. Groups are independent tasks.

Token ids come from the `tokenizers` library. Its splitting rule is applied to whole slices
of text with numpy, and the library is asked once for every different split, for many of
them in one text (see `SplitIds.ask`); the ids it gave are kept per worker, `KEPT_SPLITS` at
most, then the store starts anew.

The tokenizer file's added tokens ("<|endoftext|>") are plain text by default. With
`added_tokens` texts are cut at them first and they get their own ids, as a call of the
tokenizer without flags does; the queries and the pipeline ask for that.

Null and empty texts are one piece with the closing id only. Rows with an equal doc_id are
packed one by one. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex

from passagework.llm import blocks
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
CLOSING_ID = 0
GROUP_DOCS = 2048
KEPT_SPLITS = 300_000
ASKED_TOGETHER = 1000

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, pack_key long"
_PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

SPACE, OTHER, LETTER, NUMBER = 0, 1, 2, 3


@cache
def char_classes() -> np.ndarray:
    """The class of every code point: white space, letter, number or other."""
    table = np.full(0x110000, OTHER, np.uint8)
    planes = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((SPACE, r"\p{White_Space}"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        table[[ord(c) for c in regex.findall(pattern, planes)]] = kind
    return table


def split_starts(chars: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where the byte-level splitting rule starts a new split; `edges` are the starts of rows.

    Runs of one class are splits. The last white space before a run is split off, and joins
    the run when it is a blank. An apostrophe at the start of a run takes s, t, m, d, re,
    ve or ll after it along, and what follows is a new split.
    """
    n = len(chars)
    kind = char_classes()[chars]
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start[edges] = True
    word_start = start & (kind != SPACE)
    row_start = np.zeros(n + 1, bool)
    row_start[edges] = True
    before = np.zeros(n, bool)
    before[:-1] = word_start[1:]
    last_space = (kind == SPACE) & before & ~row_start[1:]
    start |= last_space
    joined = np.zeros(n, bool)
    joined[1:] = last_space[:-1] & (chars[:-1] == 32)
    start &= ~joined
    quote = np.flatnonzero(start & (chars == 39))
    if len(quote):
        row_end = np.append(edges[1:], n)[np.searchsorted(edges, quote, side="right") - 1]
        padded = np.concatenate([chars, [0, 0]])
        one, two = padded[quote + 1], padded[quote + 2]
        one = np.where(quote + 1 < row_end, one, 0)
        two = np.where(quote + 2 < row_end, two, 0)
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for a, b in ("re", "ve", "ll"):
            size = np.where((one == ord(a)) & (two == ord(b)), 2, size)
        hit, size = quote[size > 0], size[size > 0]
        start[hit + 1] = False
        after = hit + size + 1
        rest = after[after < n]
        start[rest] = start[rest] | ((kind[rest] == LETTER) & ~row_start[rest])
    return start


class SplitIds:
    """Token ids of splits, by hash of their bytes; asks the tokenizer for new ones."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True
        self._clear()
        self.added = self._added_tokens()
        # the byte-level alphabet has a letter for every byte; tokens added later do not count
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.token_bytes = np.zeros(1 + max([*vocabulary.values(), *self.tokenizer.get_added_tokens_decoder()]), np.int64)
        self.token_bytes[list(vocabulary.values())] = [len(token) for token in vocabulary]

    def _added_tokens(self) -> tuple[regex.Pattern, dict[str, int]] | None:
        """A pattern of the tokens that the file adds, the longest first, and their ids."""
        tokens = self.tokenizer.get_added_tokens_decoder()
        if not tokens:
            return None
        for token in tokens.values():
            if token.lstrip or token.rstrip or token.single_word or (token.normalized and self.tokenizer.normalizer):
                raise ValueError(f"added tokens with options are not supported: {token.content}")
        contents = sorted((t.content for t in tokens.values()), key=len, reverse=True)
        return regex.compile("|".join(map(regex.escape, contents)).encode()), {t.content.encode(): i for i, t in tokens.items()}

    def _clear(self):
        self.keys = np.empty(0, np.uint64)
        self.place = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)
        self.bounds = np.zeros(1, np.int64)

    def ask(self, splits: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all splits and how many each has.

        Most of a call for one split is overhead, so splits are asked together, with a line
        feed before those that do not begin with a blank. A split counts only if the splitting
        rule finds just it in that text and tokens begin and end with it; the others, such as
        white space, are asked alone.
        """
        fed = [s if s.startswith(b" ") else b"\n" + s for s in splits]
        joined = [b"".join(fed[a : a + ASKED_TOGETHER]) for a in range(0, len(fed), ASKED_TOGETHER)]
        found = self.tokenizer.encode_batch_fast([j.decode() for j in joined], add_special_tokens=False)
        ids = np.concatenate([np.empty(0, np.uint32), *(np.array(e.ids, np.uint32) for e in found)])
        data = np.frombuffer(b"".join(joined), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, fed), np.int64, len(fed)))
        begins = ends - np.fromiter(map(len, splits), np.int64, len(splits))
        edges = np.append(0, ends)[:-1:ASKED_TOGETHER]
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        char_at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        cuts = np.append(char_at[np.flatnonzero(split_starts(chars, np.searchsorted(char_at, edges)))], len(data))
        token_at = np.concatenate([[0], np.cumsum(self.token_bytes[ids])])
        at, first, last = np.searchsorted(cuts, begins), np.searchsorted(token_at, begins), np.searchsorted(token_at, ends)
        good = np.zeros(len(splits), bool)
        if token_at[-1] == len(data):
            good = (cuts[at] == begins) & (cuts[np.minimum(at + 1, len(cuts) - 1)] == ends) & (token_at[first] == begins) & (token_at[last] == ends)
        counts = np.where(good, last - first, 0)
        alone = np.flatnonzero(~good)
        own = [e.ids for e in self.tokenizer.encode_batch_fast([splits[i].decode() for i in alone], add_special_tokens=False)]
        counts[alone] = list(map(len, own))
        total = np.cumsum(counts)
        out = np.empty(int(total[-1]) if len(total) else 0, np.uint32)
        from_joined = np.repeat(good, counts)
        pick = np.repeat(first - (total - counts), counts) + np.arange(len(out))
        out[from_joined] = ids[pick[from_joined]]
        out[~from_joined] = [x for found in own for x in found]
        return out, counts

    def lookup(self, hashes: np.ndarray, split_of) -> np.ndarray:
        """For every hash the place of its ids; `split_of(i)` is the split with index i."""
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > KEPT_SPLITS:
            self._clear()
        at = np.searchsorted(self.keys, distinct)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == distinct[known]
        new = np.flatnonzero(~known)
        if len(new):
            ids, sizes = self.ask([split_of(i) for i in first[new].tolist()])
            place = len(self.bounds) - 1 + np.arange(len(new))
            self.ids = np.concatenate([self.ids, ids])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
            self.keys = np.insert(self.keys, at[new], distinct[new])
            self.place = np.insert(self.place, at[new], place)
            at = np.searchsorted(self.keys, distinct)
        return self.place[at][inverse]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows and the bounds of each row."""
        rows = len(offsets) - 1
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(rows + 1, np.int64)
        raw = data.tobytes()
        chars = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        char_at = np.flatnonzero((data & 0xC0) != 0x80)
        edges = np.unique(np.searchsorted(char_at, offsets[:-1][offsets[:-1] < len(data)]))
        starts = char_at[np.flatnonzero(split_starts(chars, edges))]
        ends = np.append(starts[1:], len(data))
        place = self.lookup(blocks.span_hashes(data, starts, ends), lambda i: raw[starts[i] : ends[i]])
        sizes = np.diff(self.bounds)[place]
        total = np.concatenate([[0], np.cumsum(sizes)])
        pick = np.repeat(self.bounds[place] - total[:-1], sizes) + np.arange(total[-1])
        return self.ids[pick], total[np.searchsorted(starts, offsets)]

    def encode_added(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Like `encode`, but the tokenizer's added tokens have their own ids."""
        raw = data.tobytes()
        if not self.added or not (any(t in raw for t in self.added[1])):
            return self.encode(data, offsets)
        pattern, id_of = self.added
        found = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            found += [m.span() for m in pattern.finditer(raw, a, b)]
        if not found:  # only across the bounds of rows
            return self.encode(data, offsets)
        begins, ends = np.array(found, np.int64).T
        # rows are cut before and after every token; the pieces that are tokens are emptied
        edges = np.unique(np.concatenate([offsets, begins, ends]))
        gone = np.zeros(len(data) + 1, np.int64)
        np.add.at(gone, begins, 1)
        np.add.at(gone, ends, -1)
        kept = np.cumsum(gone[:-1]) == 0
        before = np.concatenate([[0], np.cumsum(kept)])
        ids, bounds = self.encode(data[kept], before[edges])
        at = bounds[np.searchsorted(edges, begins)]
        out = np.insert(ids, at, np.array([id_of[raw[a:b]] for a, b in found], np.uint32))
        plain = bounds[np.searchsorted(edges, offsets)]
        return out, plain + np.searchsorted(begins, offsets)


_ENCODERS: dict[str, SplitIds] = {}


def encoder(tokenizer_json: str) -> SplitIds:
    """One encoder for each worker process and tokenizer."""
    key = f"{len(tokenizer_json)}-{zlib.crc32(tokenizer_json.encode())}"
    if key not in _ENCODERS:
        _ENCODERS[key] = SplitIds(tokenizer_json)
    return _ENCODERS[key]


def _pieces(shared, capacity: int, added_tokens: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(shared.value)
        encode = ids_of.encode_added if added_tokens else ids_of.encode
        for batch in batches:
            for part in blocks.slices(batch, "text"):
                ids, bounds = encode(*blocks.text_bytes(part.column("text")))
                doc, start, length, crc, tokens, key = [], [], [], [], [], []
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(CLOSING_ID)).astype("<u4")
                    n, whole = len(own), zlib.crc32(own.tobytes())
                    for a in range(0, n, capacity):
                        cut = own[a : a + capacity]
                        doc.append(doc_id)
                        start.append(a)
                        length.append(len(cut))
                        crc.append(zlib.crc32(cut.tobytes()))
                        tokens.append(n)
                        key.append(whole)
                columns = (doc, start, length, crc, tokens, key)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "pack_key"])

    return run


class Rooms:
    """A tournament tree over sequences: every node knows the greatest room below it."""

    def __init__(self, sequences: int, capacity: int):
        self.leaves = 1 << max(0, (sequences - 1).bit_length())
        self.most = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """The first sequence with room for `size` and the offset there; takes the room."""
        node, most = 1, self.most
        while node < self.leaves:
            node *= 2
            if most[node] < size:
                node += 1
        room = most[node]
        sequence = node - self.leaves
        most[node] = room - size
        while node > 1:
            node //= 2
            most[node] = max(most[2 * node], most[2 * node + 1])
        return sequence, room


def _first_fit(capacity: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
        rooms = Rooms(len(group), capacity)
        places = [rooms.put(n) for n in group["length"].tolist()]
        sequence = np.array([s for s, _ in places], np.int64) + (int(key[0]) << 32)
        offset = capacity - np.array([room for _, room in places], np.int64)
        out = group[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].copy()
        out["sequence_id"], out["offset"] = sequence, offset
        return out

    return run


def packed(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, added_tokens: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece; see the module's text."""
    spark = documents.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    groups = max(1, -(-documents.count() // group_docs))
    pieces = texts.mapInArrow(_pieces(shared, capacity, added_tokens), _PIECES)
    dealt = pieces.withColumn("dealt", F.pmod(F.xxhash64("doc_id", "pack_key", "doc_tokens"), F.lit(groups)))
    return dealt.groupBy("dealt").applyInPandas(_first_fit(capacity), _PACKED)
