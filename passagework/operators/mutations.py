"""Insert, update and delete as new snapshots of a table.

Nothing is changed in place: each call returns the next snapshot, the rows
that were touched, and their number. A failed check leaves the table as it
was. Store the snapshot at a new path, never over the one being read.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.operators.ingest import next_serial, with_serial
from passagework.operators.predicates import predicate
from passagework.session import write_and_read
from passagework.sources.sinks import conform


class Mutation(NamedTuple):
    table: DataFrame
    affected_rows: int
    returning: DataFrame


class CheckFailed(ValueError):
    """A row broke `post_check`; nothing was changed."""


def _holds(check: Mapping | None) -> Column:
    """NULL counts as not holding."""
    return F.coalesce(predicate(check), F.lit(False)) if check else F.lit(True)


def _require(rows: DataFrame, check: Mapping | None) -> None:
    if check and not rows.where(~_holds(check)).isEmpty():
        raise CheckFailed(f"rows break {dict(check)}")


def _keyed(table: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    """`objects` with numbers above all others for those that have none; no number twice."""
    rows = write_and_read(objects.withColumn("_row", F.monotonically_increasing_id().cast("string")), "objects")
    start = max(next_serial(table, key), next_serial(rows, key))
    numbers = with_serial(rows.where(F.col(key).isNull()).select("_row"), "_row", start, "_number")
    kind = table.schema[key].dataType
    keyed = rows.join(numbers, "_row", "left").withColumn(key, F.coalesce(key, F.col("_number").cast(kind)))
    given = rows.where(F.col(key).isNotNull()).select(key)
    if not given.groupBy(key).count().where("count > 1").isEmpty():
        raise CheckFailed(f"{key!r} is given more than once")
    if not table.select(key).join(given, key, "left_semi").isEmpty():
        raise CheckFailed(f"{key!r} is stored already")
    return keyed.select(*table.columns)


def insert(
    table: DataFrame,
    objects: DataFrame,
    post_check: Mapping | None = None,
    *,
    key: str | None = None,
    required: tuple[str, ...] = (),
) -> Mutation:
    """Add all objects, or none when one breaks `post_check`.

    With `key`, that column is unique and never NULL: objects without it get the next numbers,
    and one that is stored already or given twice breaks the insert, like a NULL in `required`.
    """
    aligned = conform(objects, table.schema)
    if key:
        aligned = _keyed(table, aligned, key)
    if required:
        _require(aligned, {"_and": [{name: {"_is_null": False}} for name in required]})
    _require(aligned, post_check)
    return Mutation(table.unionByName(aligned), aligned.count(), aligned)


def update(
    table: DataFrame,
    changes: DataFrame,
    *,
    key: str = "id",
    set_columns: tuple[str, ...],
    pre_check: Mapping | None = None,
    post_check: Mapping | None = None,
) -> Mutation:
    """Set columns by key.

    `changes` holds one row per key (checked); a column `<name>_set` (boolean, optional)
    says whether `<name>` is given at all, so that NULL can be stored.
    `pre_check` looks at the old row, `post_check` at the new one.
    """
    if not changes.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key!r} is listed more than once in the changes")
    given = changes.select(
        key,
        *[F.col(c).alias(f"_new_{c}") for c in set_columns],
        *[
            (F.col(f"{c}_set") if f"{c}_set" in changes.columns else F.lit(True)).alias(f"_set_{c}")
            for c in set_columns
        ],
        F.lit(True).alias("_match"),
    )
    hit = F.coalesce(F.col("_match"), F.lit(False)) & _holds(pre_check)
    joined = table.join(given, key, "left").withColumn("_hit", hit)
    updated = joined.select(
        *[
            F.when(F.col("_hit") & F.col(f"_set_{c}"), F.col(f"_new_{c}").cast(f.dataType))
            .otherwise(F.col(c))
            .alias(c)
            if (c := f.name) in set_columns
            else F.col(c)
            for f in table.schema
        ],
        "_hit",
    )
    touched = updated.where("_hit").drop("_hit")
    _require(touched, post_check)
    return Mutation(updated.drop("_hit"), touched.count(), touched)


def update_by_id(
    table: DataFrame,
    key_id: object,
    update_columns: Mapping[str, object],
    *,
    key: str = "id",
    pre_check: Mapping | None = None,
    post_check: Mapping | None = None,
) -> Mutation:
    """Set columns of one row. Columns not named are kept; a None value stores NULL.

    One key needs no join: the table is rewritten by a narrow projection.
    """
    hit = (F.col(key) == F.lit(key_id)) & _holds(pre_check)

    def new_row(condition: Column) -> list[Column]:
        return [
            F.when(condition, F.lit(update_columns[f.name]).cast(f.dataType))
            .otherwise(F.col(f.name))
            .alias(f.name)
            if f.name in update_columns
            else F.col(f.name)
            for f in table.schema
        ]

    touched = table.where(hit).select(*new_row(F.lit(True)))
    _require(touched, post_check)
    return Mutation(table.select(*new_row(hit)), touched.count(), touched)


def delete(
    table: DataFrame, keys: DataFrame, *, key: str = "id", pre_check: Mapping | None = None
) -> Mutation:
    """Remove rows whose key is listed and that satisfy `pre_check`."""
    listed = keys.select(key).distinct().withColumn("_match", F.lit(True))
    marked = table.join(listed, key, "left").withColumn(
        "_hit", F.coalesce(F.col("_match"), F.lit(False)) & _holds(pre_check)
    )
    gone = marked.where("_hit").select(*table.columns)
    return Mutation(marked.where(~F.col("_hit")).select(*table.columns), gone.count(), gone)


def delete_by_id(
    table: DataFrame, key_id: object, *, key: str = "id", pre_check: Mapping | None = None
) -> Mutation:
    hit = F.coalesce(F.col(key) == F.lit(key_id), F.lit(False)) & _holds(pre_check)
    gone = table.where(hit)
    return Mutation(table.where(~hit), gone.count(), gone)


def response(result: Mutation) -> DataFrame:
    """The touched rows, each with the total number of touched rows."""
    return result.returning.withColumn("affected_rows", F.lit(result.affected_rows).cast("bigint"))
