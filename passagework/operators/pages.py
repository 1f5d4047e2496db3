"""Pages of an ordered table at any depth, found by order statistics over the keys.

Spark's own offset moves every row up to the page's end through one task. Here both ends of
a page are looked up first: a random sample of the keys proposes borders about the wanted
position, one aggregate counts the rows up to each exactly, and the closest borders on
either side stay; each round leaves a small share of the rows between them, until they are
few enough for one task. The page is then a filter on the keys, with only the rows between
the borders at its ends sorted and cut. Wide columns are read for the page alone, nothing is
stored, and filters on the first key reach the scan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

# Rows about the end of a page that one task may sort.
EDGE_ROWS = 10_000
SAMPLED_KEYS = 4096
COUNTED_BORDERS = 48
# Parts rows whose keys are equal, by a hash of all their columns.
TIE = "_row_hash"

Order = Sequence[tuple[str, str]]


class Border(NamedTuple):
    """Rows up to and including `key` number `rows`; no key stands for the table's start or end."""

    key: Row | None
    rows: int


def sort_columns(order: Order) -> list[Column]:
    """NULLs come last ascending and first descending."""
    return [F.col(c).asc_nulls_last() if way == "Asc" else F.col(c).desc_nulls_first() for c, way in order]


def _beyond(column: Column, way: str, value) -> Column:
    if way == "Asc":
        return F.lit(False) if value is None else (column > F.lit(value)) | column.isNull()
    return column.isNotNull() if value is None else column.isNotNull() & (column < F.lit(value))


def after(order: Order, key: Row) -> Column:
    """Whether a row comes after `key` in the order; never NULL."""
    found = F.lit(False)
    for name, way in reversed(order):
        column = F.col(name)
        found = F.coalesce(_beyond(column, way, key[name]), F.lit(False)) | (column.eqNullSafe(F.lit(key[name])) & found)
    return found


def between(df: DataFrame, order: Order, low: Border, high: Border) -> DataFrame:
    """The rows after `low` up to and including `high`."""
    if low.key is not None:
        df = df.where(after(order, low.key))
        name, way = order[0]
        if low.key[name] is not None and way == "Desc":
            df = df.where(F.col(name) <= F.lit(low.key[name]))  # the scan can skip by this one
    if high.key is not None:
        df = df.where(~after(order, high.key))
        name, way = order[0]
        if high.key[name] is not None and way == "Asc":
            df = df.where(F.col(name) <= F.lit(high.key[name]))
    return df


def borders(df: DataFrame, order: Order, position: int, low: Border, high: Border, edge_rows: int) -> tuple[Border, Border]:
    """Borders about a position: `low.rows <= position < high.rows`, at most `edge_rows` apart.

    Further apart only if the rows between them have one key.
    """
    names = [name for name, _ in order]
    wide = False
    while high.rows - low.rows > edge_rows:
        inside = between(df, order, low, high).select(*names)
        drawn = inside.orderBy(F.rand()).limit(SAMPLED_KEYS).orderBy(*sort_columns(order)).collect()
        # the sample's rank of the position, and how far the true one may be from it
        middle = (position - low.rows) / (high.rows - low.rows) * len(drawn)
        reach = len(drawn) if wide else 2 * math.sqrt(len(drawn)) + 1
        steps = [middle + reach * (2 * i / (COUNTED_BORDERS - 1) - 1) for i in range(COUNTED_BORDERS)]
        tried = list(dict.fromkeys(drawn[min(max(round(s), 0), len(drawn) - 1)] for s in steps))
        counts = inside.agg(*[F.count_if(~after(order, key)).alias(f"n{i}") for i, key in enumerate(tried)]).first()
        found = [Border(key, low.rows + n) for key, n in zip(tried, counts)]
        closer_low = max([low, *(b for b in found if b.rows <= position)], key=lambda b: b.rows)
        closer_high = min([high, *(b for b in found if b.rows > position)], key=lambda b: b.rows)
        if (closer_low.rows, closer_high.rows) == (low.rows, high.rows):
            if wide:
                break
            wide = True
        low, high = closer_low, closer_high
    return low, high


def page(df: DataFrame, order: Order, offset: int, limit: int | None, edge_rows: int = EDGE_ROWS) -> DataFrame:
    """Rows `offset + 1` to `offset + limit` of the order, in that order.

    Of rows with equal keys a hash of all columns decides; rows equal in all of them are
    interchangeable, and are the only ones that one task may get many of.
    """
    end = math.inf if limit is None else offset + limit
    if end <= edge_rows or (not offset and limit is None):
        out = df.orderBy(*sort_columns(order)) if order else df
        out = out.offset(offset) if offset else out
        return out if limit is None else out.limit(limit)

    rows = df.count()
    whole = Border(None, 0), Border(None, rows)
    if offset >= rows:
        return df.limit(0)
    total = list(order)
    ends = _ends(df, total, offset, end, whole, edge_rows) if order else None
    if ends is None or any(high.rows - low.rows > edge_rows for low, high in ends):
        # keys that many rows share
        df, total = df.withColumn(TIE, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])), [*order, (TIE, "Asc")]
        ends = _ends(df, total, offset, end, whole, edge_rows)
    (low, first), (last, high) = ends
    if last.rows < first.rows:
        return _cut(between(df, total, low, high), total, offset - low.rows, int(end) - offset).drop(TIE)
    out = _cut(between(df, total, low, first), total, offset - low.rows, first.rows - offset)
    if last.rows > first.rows:
        out = out.unionByName(between(df, total, first, last))
    if last.rows < min(end, rows):
        out = out.unionByName(_cut(between(df, total, last, high), total, 0, int(end) - last.rows))
    return out.orderBy(*sort_columns(total)).drop(TIE)


def _ends(df: DataFrame, order: Order, offset: int, end: float, whole: tuple[Border, Border], edge_rows: int):
    start = borders(df, order, offset, *whole, edge_rows)
    if end >= whole[1].rows:
        return start, (whole[1], whole[1])
    return start, borders(df, order, int(end), *whole, edge_rows)


def _cut(df: DataFrame, order: Order, skipped: int, taken: int) -> DataFrame:
    out = df.orderBy(*sort_columns(order))
    return (out.offset(skipped) if skipped else out).limit(taken)
