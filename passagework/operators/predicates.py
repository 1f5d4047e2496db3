"""Filter dictionaries to column expressions."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions.text import java_regex, like_pattern, similar_regex, text_match

COMPARISONS = {
    "_eq": lambda c, x: c == x,
    "_neq": lambda c, x: c != x,
    "_gt": lambda c, x: c > x,
    "_gte": lambda c, x: c >= x,
    "_lt": lambda c, x: c < x,
    "_lte": lambda c, x: c <= x,
    "_in": lambda c, x: c.isin(list(x)),
    "_like": lambda c, x: c.like(like_pattern(x)),
    "_nlike": lambda c, x: ~c.like(like_pattern(x)),
    "_ilike": lambda c, x: c.ilike(like_pattern(x)),
    "_nilike": lambda c, x: ~c.ilike(like_pattern(x)),
    "_regex": lambda c, x: c.rlike(java_regex(x)),
    "_nregex": lambda c, x: ~c.rlike(java_regex(x)),
    "_iregex": lambda c, x: c.rlike("(?iu)" + java_regex(x)),
    "_niregex": lambda c, x: ~c.rlike("(?iu)" + java_regex(x)),
    "_similar": lambda c, x: c.rlike(similar_regex(x)),
    "_nsimilar": lambda c, x: ~c.rlike(similar_regex(x)),
    "_is_null": lambda c, x: c.isNull() if x else c.isNotNull(),
    "starts_with": lambda c, x: c.startswith(x),
    "ts_match_tt": lambda c, x: text_match(c, x),
}


def predicate(spec: Mapping) -> Column:
    """The condition of a filter dictionary; several entries must all hold.

    Keys are column names, each with `{operator: operand}`, or `_and` / `_or`
    (a list of filters) and `_not` (one filter). NULL follows SQL rules.
    """
    terms = []
    for key, value in spec.items():
        if key == "_and":
            terms.append(reduce(lambda a, b: a & b, map(predicate, value), F.lit(True)))
        elif key == "_or":
            terms.append(reduce(lambda a, b: a | b, map(predicate, value), F.lit(False)))
        elif key == "_not":
            terms.append(~predicate(value))
        else:
            column = F.col(key)
            for name, operand in value.items():
                if name not in COMPARISONS:
                    raise ValueError(f"unknown operator {name!r} on {key!r}")
                terms.append(COMPARISONS[name](column, operand))
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def where(df: DataFrame, spec: Mapping | None) -> DataFrame:
    return df.where(predicate(spec)) if spec else df
