"""Shards of near equal bytes for groups of rows that must stay together.

Karmarkar-Karp differencing: every group starts as a partial partition with its bytes in one
part and nothing in the others. The two partial partitions with the largest spread (greatest
less smallest part) are combined, the largest part of one with the smallest of the other, until
one is left. Groups are dealt at random into units of about `UNIT`; every unit is differenced
in a task of its own, and what it leaves, again a partial partition, is differenced with those of
the other units in the next round, until one unit is left. The parts' places are then
followed back down. Tables between rounds have one row for each unit.

A row's size is the UTF-8 bytes of its text, none for null, plus 8. Rows with equal texts are
one group, and so are all rows with null text; a group larger than a shard's share fills its
shard alone. Rows with an equal doc_id or none are rows like others. `slot` numbers a shard's
rows without gaps. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd

from passagework.session import write_and_read
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 24
UNIT = 16_384
SLOT_ROWS = 20_000
OVERHEAD = 8

_MOVED = "node binary, unit long, parts array<long>"


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where every node's part i goes, and the bytes of the parts of the whole.

    `sums` has one row of part sizes for each node.
    """
    nodes, parts = sums.shape
    start = np.argsort(sums, axis=1, kind="stable")
    ordered = list(np.take_along_axis(sums, start, axis=1))
    heap = [(-int(s[-1] - s[0]), i) for i, s in enumerate(ordered)]
    heapq.heapify(heap)
    merged: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = ordered[a] + ordered[b][::-1]
        order = np.argsort(both, kind="stable")
        merged.append((a, b, order))
        ordered.append(both[order])
        ordered[a] = ordered[b] = None
        last = ordered[-1]
        heapq.heappush(heap, (-int(last[-1] - last[0]), len(ordered) - 1))
    place = [None] * len(ordered)
    place[-1] = np.arange(parts)
    for i in range(len(merged) - 1, -1, -1):
        a, b, order = merged[i]
        here = place[nodes + i]
        place[a], place[b] = np.empty(parts, np.int64), np.empty(parts, np.int64)
        place[a][order] = here
        place[b][parts - 1 - order] = here
        place[nodes + i] = None
    out = np.empty((nodes, parts), np.int64)
    np.put_along_axis(out, start, np.stack(place[:nodes]), axis=1)
    return out, ordered[-1]


def _unit(parts: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        sums = np.zeros((len(group), parts), np.int64)
        for row, values in zip(sums, group["sums"]):
            row[: len(values)] = values
        given = group["sums"].map(len).to_numpy()
        moved, total = difference(sums)
        out = pd.DataFrame({"node": group["node"].tolist(), "unit": int(key[0]), "parts": [m[:n] for m, n in zip(moved, given)]})
        return pd.concat([out, pd.DataFrame({"node": [None], "unit": [int(key[0])], "parts": [total]})])

    return run


def partition_groups(groups: DataFrame, parts: int = SHARDS, unit: int = UNIT) -> DataFrame:
    """key, part for a table of groups (key binary, size long) with distinct keys."""
    nodes = groups.select(F.col("key").alias("node"), F.array("size").alias("sums"))
    rounds = []
    while True:
        count = nodes.count()
        units = max(1, -(-count // unit))
        dealt = nodes.withColumn("unit", F.pmod(F.xxhash64("node", F.lit(len(rounds))), F.lit(units)))
        moved = write_and_read(dealt.groupBy("unit").applyInPandas(_unit(parts), _MOVED), "shard-units")
        rounds.append(moved.where("node IS NOT NULL"))
        if units == 1:
            break
        tops = moved.where("node IS NULL")
        nodes = tops.select(F.encode(F.col("unit").cast("string"), "UTF-8").alias("node"), F.col("parts").alias("sums"))
    final = rounds.pop()
    while rounds:
        below = rounds.pop()
        above = final.select(F.decode("node", "UTF-8").cast("long").alias("unit"), F.col("parts").alias("up"))
        final = below.join(above, "unit").select("node", F.transform("parts", lambda p: F.col("up")[p.cast("int")]).alias("parts"))
    return final.select(F.col("node").alias("key"), F.col("parts")[0].cast("int").alias("part"))


def sharded(documents: DataFrame, shards: int = SHARDS, unit: int = UNIT) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row; see the module's text."""
    text = F.col("text")
    rows = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(text.cast("binary"), 256)), F.lit(b"null")).alias("key"),
    )
    rows = write_and_read(rows, "shard-rows")
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"))
    placed = rows.join(partition_groups(groups, shards, unit), "key")
    buckets = max(8, -(-rows.count() // (shards * SLOT_ROWS)))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(1)), F.lit(buckets)))
    placed = write_and_read(placed, "shard-places")
    counts = placed.groupBy("part", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("part", "bucket").orderBy("doc_id", "key")
    numbered = placed.withColumn("nth", F.row_number().over(within) - 1).join(counts, ["part", "bucket"])
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("part").alias("shard"),
        (F.col("before") + F.col("nth")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
