"""Declarative table queries: filter, order, page, aggregate, permissions, named views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.operators.pages import page, sort_columns
from passagework.operators.predicates import where

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType)


def order_of(spec: Sequence[Mapping[str, str]]) -> list[tuple[str, str]]:
    """`[{column: 'Asc'|'Desc'}, …]` as pairs."""
    pairs = [pair for entry in spec for pair in entry.items()]
    for name, direction in pairs:
        if direction not in ("Asc", "Desc"):
            raise ValueError(f"direction of {name!r} must be Asc or Desc")
    return pairs


def ordering(spec: Sequence[Mapping[str, str]]) -> list[Column]:
    """`[{column: 'Asc'|'Desc'}, …]`: NULLs come last ascending and first descending."""
    return sort_columns(order_of(spec))


def select_many(
    df: DataFrame,
    *,
    where_: Mapping | None = None,
    order_by: Sequence[Mapping[str, str]] = (),
    limit: int | None = None,
    offset: int | None = None,
    fields: Sequence[str] | None = None,
) -> DataFrame:
    """Rows of a model, cut to a page of any depth by `pages.page`."""
    out = page(where(df, where_), order_of(order_by), offset or 0, limit)
    return out.select(*fields) if fields else out


def select_by_id(df: DataFrame, key: object, id_col: str = "id") -> DataFrame:
    return df.where(F.col(id_col) == key).limit(1)


def keyset_page(df: DataFrame, last: object, rows: int, id_col: str = "id") -> DataFrame:
    """The next page after `last`; the id test reaches the scan as a filter."""
    return df.where(F.col(id_col) > last).orderBy(id_col).limit(rows)


def _as_number(name: str, kind: T.DataType) -> Column:
    """Statistics of whole and decimal numbers are taken in double precision."""
    return F.col(name).cast("double") if not isinstance(kind, T.DoubleType) else F.col(name)


def _sum(name: str, kind: T.DataType) -> Column:
    """int sums to bigint, bigint to a wide decimal that cannot overflow."""
    if isinstance(kind, INTEGRAL):
        return F.sum(F.col(name).cast("bigint"))
    if isinstance(kind, T.LongType):
        return F.sum(F.col(name).cast("decimal(28,0)"))
    return F.sum(name)


AGGREGATES = {
    "_count": lambda name, kind: F.count(name),
    "_count_distinct": lambda name, kind: F.count_distinct(name),
    "min": lambda name, kind: F.min(name),
    "max": lambda name, kind: F.max(name),
    "sum": _sum,
    "avg": lambda name, kind: F.avg(_as_number(name, kind)),
    "stddev": lambda name, kind: F.stddev_samp(_as_number(name, kind)),
    "stddev_pop": lambda name, kind: F.stddev_pop(_as_number(name, kind)),
    "stddev_samp": lambda name, kind: F.stddev_samp(_as_number(name, kind)),
    "variance": lambda name, kind: F.var_samp(_as_number(name, kind)),
    "var_pop": lambda name, kind: F.var_pop(_as_number(name, kind)),
    "var_samp": lambda name, kind: F.var_samp(_as_number(name, kind)),
    "bit_and": lambda name, kind: F.bit_and(name),
    "bit_or": lambda name, kind: F.bit_or(name),
    "bit_xor": lambda name, kind: F.bit_xor(name),
}


def aggregate(
    df: DataFrame, spec: Mapping[str, object], filter_input: Mapping | None = None
) -> DataFrame:
    """One row of aggregates over the model or over the subset `filter_input` selects.

    `spec` is `{"_count": True, column: [function, …]}`; results are named
    `_count` and `column_function`. A limit applies before aggregation.
    """
    if filter_input:
        df = select_many(df, **filter_input)
    out = []
    for name, functions in spec.items():
        if name == "_count":
            out.append(F.count("*").alias("_count"))
            continue
        kind = df.schema[name].dataType
        for function in functions:
            label = f"{name}_{function.lstrip('_')}"
            out.append(AGGREGATES[function](name, kind).alias(label))
    return df.agg(*out)


def permission_view(
    df: DataFrame, fields: Sequence[str], row_filter: Mapping | None = None
) -> DataFrame:
    """What a role may see: allowed columns of allowed rows."""
    return where(df, row_filter).select(*fields)


def number_strings(df: DataFrame) -> DataFrame:
    """Wide numbers (bigint, decimal) as text, the form in which the API hands them out."""
    wide = {
        f.name for f in df.schema if isinstance(f.dataType, (T.LongType, T.DecimalType))
    }
    return df.select(
        *[F.col(c).cast("string").alias(c) if c in wide else F.col(c) for c in df.columns]
    )


def query_views(
    spark: SparkSession, views: Mapping[str, DataFrame], sql: str, **args: object
) -> DataFrame:
    """Run SQL over named DataFrames; `args` fill the `:name` markers."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=args or None)
