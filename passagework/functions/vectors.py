"""Vector expressions and the array kernel used inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Scores closer than this are ties and go to the smaller id, so the order does
# not depend on how rows were blocked for the matrix product.
SCORE_DIGITS = 12


def inner_product(left: Column, right: Column) -> Column:
    """Inner product of two float arrays, summed in double precision."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def to_literal(vector: Column) -> Column:
    """`[a,b,c]` text form of a vector."""
    return F.concat(
        F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]")
    )


def from_literal(text: Column, dim: int | None = None) -> Column:
    """Vector of a `[a,b,c]` text; NULL when it does not parse or has another length."""
    vector = F.from_json(text, "array<float>")
    return vector if dim is None else F.when(F.size(vector) == dim, vector)


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of an Arrow list column as a double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) and pc.any(pc.not_equal(pc.list_value_length(column), dim)).as_py():
        raise ValueError(f"every vector must have {dim} elements")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != len(column) * dim:
        raise ValueError(f"every vector must have {dim} elements")
    return flat.reshape(len(column), dim)


class LocalTopK:
    """Best `k[q]` rows per query over the row blocks one task sees.

    Queries are taken a few hundred at a time, rows in blocks of limited size, and between
    blocks at most `k` candidates per query are held, so memory does not grow with the rows
    read. A product in single precision tells which pairs may win at all: it is off by less
    than a bound that follows from the lengths of the vectors. Only these pairs are scored, in
    double precision. Queries with many of them in a block (at first all) are scored against
    the whole of it. Many copies of one vector stay cheap: of equal scores only those that can
    still win by their id are kept.
    """

    MAX_CELLS = 1 << 20
    TILE_QUERIES = 512
    FIRST_ROWS = 256
    NO_ID = np.iinfo(np.int64).max

    def __init__(self, queries: np.ndarray, k: np.ndarray):
        self.queries = queries
        self.k = k
        starts = range(0, len(queries), self.TILE_QUERIES)
        self._tiles = [_Tile(queries[a : a + self.TILE_QUERIES], k[a : a + self.TILE_QUERIES], a) for a in starts]

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        single, finite, longest = _single(vectors)
        if not finite.all():  # such rows may win or be no numbers; they are scored without a screen
            self._add(ids[~finite], vectors[~finite], single[~finite], np.inf)
            ids, vectors, single = ids[finite], vectors[finite], single[finite]
        self._add(ids, vectors, single, longest)

    def _add(self, ids: np.ndarray, vectors: np.ndarray, single: np.ndarray, longest: float) -> None:
        for tile in self._tiles:
            if tile.k_max < 1:
                continue
            most = max(1, self.MAX_CELLS // len(tile.queries))
            # the first rows give every query something to beat
            start, size = 0, self.FIRST_ROWS if tile.open else most
            while start < len(ids):
                end = start + min(size, most)
                tile.add(ids[start:end], vectors[start:end], single[start:end], longest)
                start, size = end, 2 * size

    def _joined(self, name: str, dtype) -> np.ndarray:
        return np.concatenate([np.empty(0, dtype), *(getattr(tile, name) for tile in self._tiles)])

    @property
    def q(self) -> np.ndarray:
        return np.concatenate([np.empty(0, np.int64), *(tile.q + tile.first for tile in self._tiles)])

    @property
    def ids(self) -> np.ndarray:
        return self._joined("ids", np.int64)

    @property
    def scores(self) -> np.ndarray:
        return self._joined("scores", np.float64)


def _single(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The vectors in single precision, which of them are finite there, the greatest length of those."""
    with np.errstate(over="ignore", invalid="ignore"):
        single = vectors.astype(np.float32)
        finite = np.isfinite(single).all(axis=1)
        squares = np.einsum("ij,ij->i", vectors, vectors)
    return single, finite, float(np.sqrt(squares[finite].max(initial=0.0)))


def _places(marks: np.ndarray) -> np.ndarray:
    """`flatnonzero` of a table with few marks, looked through eight at a time where its size allows it."""
    flat = marks.reshape(-1)
    if len(flat) % 8:
        return np.flatnonzero(flat)
    eights = np.flatnonzero(flat.view(np.uint64))
    row, place = np.nonzero(flat.reshape(-1, 8)[eights])
    return eights[row] * 8 + place


class _Tile:
    """The candidates of some of the queries of a `LocalTopK`; the first of them has number `first`."""

    def __init__(self, queries: np.ndarray, k: np.ndarray, first: int):
        self.queries = queries
        self.k = k
        self.first = first
        self.k_max = int(k.max(initial=0))
        self.single, finite, longest = _single(queries)
        self.longest = longest if finite.all() else np.inf
        # a full query's last kept row: what a newcomer has to beat
        self.floor = np.where(k > 0, -np.inf, np.inf)
        self.floor_id = np.full(len(queries), LocalTopK.NO_ID)
        self.q = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int64)
        self.scores = np.empty(0)

    @property
    def open(self) -> bool:
        return bool(np.isneginf(self.floor).any())

    def _screen(self, longest: float) -> float | None:
        """How far a product in single precision may be off; None when it tells nothing.

        Each element and product is rounded, and sums of `dim` products, by 2^-24 of the product
        of the lengths at most; the bound is twice that. It also covers the rounded digits.
        """
        with np.errstate(invalid="ignore"):
            off = (self.queries.shape[1] + 8) * 2.0**-23 * self.longest * longest + 10.0**-SCORE_DIGITS
        return off if off < 1e18 else None

    def add(self, ids: np.ndarray, vectors: np.ndarray, single: np.ndarray, longest: float) -> None:
        every, screen, found = np.arange(len(self.queries)), self._screen(longest), []
        if screen is None:
            found.append(self._dense(every, ids, vectors))
        else:
            with np.errstate(over="ignore"):
                least = np.nextafter((self.floor - screen).astype(np.float32), np.float32(-np.inf))
            near = _places(self.single @ single.T >= least[:, None])
            q, col = np.divmod(near, len(ids))
            many = np.bincount(q, minlength=len(every)) > 4 * self.k_max + 64
            if many.any():
                found.append(self._dense(every[many], ids, vectors))
                q, col = q[~many[q]], col[~many[q]]
            if len(q):
                found.append(self._scored(q, col, ids, vectors))
        if sum(len(q) for q, _, _ in found):
            self._keep(found)

    def _scored(self, q: np.ndarray, col: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        """Single pairs of a query and a row that can still win."""
        score = np.einsum("ij,ij->i", self.queries[q], vectors[col])
        score = np.round(score, SCORE_DIGITS) + 0.0
        wins = (score > self.floor[q]) | ((score == self.floor[q]) & (ids[col] <= self.floor_id[q]))
        return q[wins], ids[col[wins]], score[wins]

    def _dense(self, some: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        """Some queries against all rows of a block; of many that can win the best."""
        # + 0.0 turns a negative zero into zero
        scores = np.round(self.queries[some] @ vectors.T, SCORE_DIGITS) + 0.0
        # vectors with elements that are no numbers take no part
        scores[np.isnan(scores)] = -np.inf
        floor, floor_id = self.floor[some], self.floor_id[some]
        if scores.shape[1] > self.k_max:
            kth = np.partition(scores, scores.shape[1] - self.k_max, axis=1)[:, -self.k_max]
            floor_id = np.where(kth > floor, LocalTopK.NO_ID, floor_id)
            floor = np.maximum(floor, kth)
        better = scores > floor[:, None]
        even = (scores == floor[:, None]) & (ids[None, :] <= floor_id[:, None]) & (scores > -np.inf)
        if np.count_nonzero(even) > 4 * self.k_max * len(some):
            even = self._smallest_ids(even, ids)
        q, col = np.nonzero(better | even)
        return some[q], ids[col], scores[q, col]

    def _smallest_ids(self, even: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Of the equal scores, the `k` rows with the smallest ids per query."""
        order = np.argsort(ids, kind="stable")
        sorted_even = even[:, order]
        kept = np.zeros_like(even)
        kept[:, order] = sorted_even & (np.cumsum(sorted_even, axis=1) <= self.k_max)
        return kept

    def _keep(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """The candidates so far and those found, cut to the best of each query."""
        all_q, ids, scores = map(np.concatenate, zip((self.q, self.ids, self.scores), *found))
        order = np.lexsort((ids, -scores, all_q))
        q = all_q[order]
        first = np.searchsorted(q, q, side="left")
        place = np.arange(len(q)) - first
        keep = order[place < self.k[q]]
        self.q, self.ids, self.scores = all_q[keep], ids[keep], scores[keep]
        # kept rows are sorted by query, falling score and rising id
        counts = np.bincount(self.q, minlength=len(self.queries))
        last = np.cumsum(counts) - 1
        full = (counts >= self.k) & (counts > 0)
        self.floor[full] = self.scores[last[full]]
        self.floor_id[full] = self.ids[last[full]]
