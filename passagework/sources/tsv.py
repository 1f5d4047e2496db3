"""Tab-separated files with quoted fields over several lines, read in splits, with row numbers.

Whether a line starts inside a quoted field depends on everything before it in its file. So a
first pass over the lines finds for each split what both beginnings, inside or outside of
quotes, would lead to: the state at its end and the number of records that end in it. From
those few numbers every split's real beginning and the number of its first record follow,
and a second pass cuts all splits into records at once. Records that go on in another split
come as pieces, which are put together. No task reads more than a split, however large a file.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.session import write_and_read

TAB, QUOTE = "\t", '"'
# Facts about splits, and headers of files, that a join may send to every task; more are shuffled.
SENT_BYTES = 32 << 20
SPLIT_BYTES, HEAD_BYTES = 220, 1000

_FACTS = "file string, start long, out_to boolean, in_to boolean, out_records long, in_records long, head string"
_PIECES = "file string, first_row long, record long, piece long, body string"


def inside_after(line: str, inside: bool) -> bool:
    """Whether the text after `line` is inside a quoted field, if its beginning was or was not."""
    if QUOTE not in line:
        return inside
    at = 0
    while True:
        if inside:
            at = line.find(QUOTE, at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == QUOTE:
                at += 2
                continue
            inside = False
        elif line[at : at + 1] == QUOTE:
            inside, at = True, at + 1
            continue
        # only a quote at the start of a field opens one
        at = line.find(TAB, at) + 1
        if not at:
            return False


def _blank(line: str) -> bool:
    return line in ("", "\r")


def _lines(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in ("file", "start", "value", *more)])


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each split does to either beginning. Lines of a split come together and in order."""

    def fact(place, states, records, head):
        return [*place, *states, *records, "\n".join(head) if place[1] == 0 else None]

    out, place = [], None
    for file, start, line in _lines(batches):
        if (file, start) != place:
            if place:
                out.append(fact(place, states, records, head))
            place, states, records, head, in_head = (file, start), [False, True], [0, 0], [], start == 0
        if in_head and (head or not _blank(line)):
            head.append(line)
        for i in (0, 1):
            empty = not states[i] and _blank(line)
            states[i] = inside_after(line, states[i])
            records[i] += not states[i] and not empty
        in_head = in_head and not records[0]
    if place:
        out.append(fact(place, states, records, head))
    columns = list(zip(*out)) or [()] * 7
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.string())
    names = ["file", "start", "out_to", "in_to", "out_records", "in_records", "head"]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of splits whose beginnings are known; `piece` is NULL for those that are whole."""
    held: list[tuple] = []

    def flushed():
        columns = list(zip(*held)) or [()] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "first_row", "record", "piece", "body"])

    place, body = None, []
    for file, start, line, began_inside, before, first_row in _lines(batches, "inside", "before", "first_row"):
        if (file, start) != place:
            if body:
                held.append((place[0], rows, record, place[1], "\n".join(body)))
            place, inside, record, rows, body, cut = (file, start), began_inside, before, first_row, [], began_inside
        if not inside and _blank(line):
            continue
        body.append(line)
        inside = inside_after(line, inside)
        if not inside:
            held.append((file, rows, record, start if cut else None, "\n".join(body)))
            record, body, cut = record + 1, [], False
            if len(held) >= 10_000:
                yield flushed()
    if body:
        held.append((place[0], rows, record, place[1], "\n".join(body)))
    yield flushed()


def fields_of(record: str) -> list[str | None]:
    """The fields of a record; an empty one, quoted or not, is NULL."""
    fields = next(csv.reader([record.removesuffix("\r")], delimiter=TAB, quotechar=QUOTE), [])
    return [f or None for f in fields]


def _parsed(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, list[int | None]] = {}
        for batch in batches:
            found: list[list] = [[] for _ in columns]
            for head, record in zip(batch.column("head").to_pylist(), batch.column("body").to_pylist()):
                if head not in places:
                    names = fields_of(head)
                    places[head] = [names.index(c) if c in names else None for c in columns]
                fields = fields_of(record)
                for out, at in zip(found, places[head]):
                    out.append(fields[at] if at is not None and at < len(fields) else None)
            arrays = [pa.array(f, pa.string()) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("row_number"), *arrays], names=["row_number", *[f"f{i}" for i in range(len(columns))]])

    return run


def _sent(table: DataFrame, row_bytes: int) -> DataFrame:
    return F.broadcast(table) if table.count() * row_bytes <= SENT_BYTES else table


def read_records(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """`row_number` and those of `columns` that any file's header names, as text.

    Rows are numbered from 0, files in the order of their paths, without headers and blank
    lines. A column that one file lacks is NULL there.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        "value",
        F.monotonically_increasing_id().alias("line"),
    )
    facts = lines.select("file", "start", "value").mapInArrow(_facts, _FACTS)
    each = F.sort_array(F.collect_list(F.struct("start", "out_to", "in_to", "out_records", "in_records")))
    files = facts.groupBy("file").agg(each.alias("splits"), F.max("head").alias("head"))
    # a fold over a file's splits: where each begins, and the number of records before it
    begun = F.expr(
        """aggregate(splits, named_struct('inside', false, 'n', 0L, 'begun', cast(array() AS array<struct<start: bigint, inside: boolean, before: bigint>>)),
        (s, x) -> named_struct(
            'inside', if(s.inside, x.in_to, x.out_to),
            'n', s.n + if(s.inside, x.in_records, x.out_records),
            'begun', concat(s.begun, array(named_struct('start', x.start, 'inside', s.inside, 'before', s.n)))))"""
    )
    files = write_and_read(files.select("file", "head", begun.alias("fold")), "tsv-splits")
    # an unclosed quote at the end still ends a record
    size = F.greatest(F.col("fold.n") + F.col("fold.inside").cast("long") - 1, F.lit(0))
    first_rows, rows = [], 0
    for row in files.select("file", size.alias("size")).orderBy("file").toLocalIterator():  # as many as the scan lists
        first_rows.append((row.file, rows))
        rows += row["size"]
    offsets = spark.createDataFrame(first_rows, "file string, first_row long")
    heads = [r.head for r in files.select("head").distinct().collect() if r.head]
    named = {name for head in heads for name in fields_of(head)}
    present = [c for c in columns if c in named]

    begun = files.join(_sent(offsets, SPLIT_BYTES), "file").select("file", "first_row", F.inline("fold.begun"))
    known = lines.join(_sent(begun, SPLIT_BYTES), ["file", "start"])
    if begun.count() * SPLIT_BYTES > SENT_BYTES:
        # lines were dealt anew: a split's come together again, in their order
        known = known.repartition("file", "start").sortWithinPartitions("file", "start", "line")
    pieces = known.mapInArrow(_pieces, _PIECES).where("record > 0")
    whole = pieces.where("piece IS NULL").drop("piece")
    parts = F.sort_array(F.collect_list(F.struct("piece", "body")))
    joined = pieces.where("piece IS NOT NULL").groupBy("file", "first_row", "record").agg(F.array_join(F.transform(parts, lambda p: p["body"]), "\n").alias("body"))
    records = whole.unionByName(joined).join(_sent(files.select("file", "head"), HEAD_BYTES), "file")
    records = records.select((F.col("first_row") + F.col("record") - 1).alias("row_number"), "head", "body")
    schema = ", ".join(["row_number long", *[f"f{i} string" for i in range(len(present))]])
    return records.mapInArrow(_parsed(present), schema).toDF("row_number", *present)
