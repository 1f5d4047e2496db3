"""Near duplicates of whole documents by MinHash bands and odd sketches.

Every text becomes its set of distinct word shingles. `SLOTS` MinHash samples cut into
bands give candidates; the samples, folded into a parity bitmap (an odd sketch), give
an estimate from the number of bits in the XOR of two bitmaps, and candidates that are
surely less similar are dropped; the rest are confirmed on their full sets.

Equal sets are one vertex. In every band bucket the members are first tried against the
smallest one only, so a group of copies costs as many pairs as it has members. Rounds
follow in which each bucket that still holds several components draws `HUBS` members, and
those of other components are tried against them, as long as that links a good part of the
rest; so a group whose copies lie about the threshold costs pairs in proportion to its
members. The members still open are then tried against all members of other components, by
sketches and at last by their full sets, two blocks of a bucket in a task, so that no link
that joins components is lost and no pair is written out but links; these members get finer
odd sketches too, and only those that these leave a partner have their full sets sent.
With a similarity of 0.8 a pair misses all 32 bands of 4 with probability 5e-8.

Null and empty texts have an empty set and stand alone. A text with fewer words than a
shingle is one shingle. Rows with an equal doc_id are separate rows. Rows without doc_id
keep null as component and are kept. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from passagework.llm import blocks
from passagework.llm.components import smallest_reachable
from passagework.session import write_and_read
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
SKETCH_BITS = 512
#: Samples and bits of the finer sketches, made only for members that all others are tried against.
FINE_SLOTS, FINE_BITS = 512, 2048

#: Members that a bucket's others are tried against in one round.
HUBS = 3
#: Rounds end when all pairs left are at most so many for each member, or when one links less
#: than this share of the members it tried.
FEW_COMPARISONS, WORTH = 4, 0.1
#: Members of a bucket, and bytes of their sets, that are one block.
BLOCK_ROWS, BLOCK_BYTES = 2048, 8 << 20

_PROFILE = "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch array<long>"
_SETS = "doc_id long, shingles binary"
_FINE = "id long, fine array<long>"


def shingle_sets(words: blocks.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted in each row, and each row's bounds."""
    hashes, rows = words.hashes(), len(words.counts)
    row = np.repeat(np.arange(rows), words.counts)
    full = blocks.windows(hashes, k)
    keep = row[: len(full)] == row[k - 1 : k - 1 + len(full)]
    values, owner = full[keep], row[: len(full)][keep]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        whole = [blocks.windows(hashes[words.bounds[i] : words.bounds[i + 1]], int(words.counts[i]))[0] ^ np.uint64(words.counts[i]) for i in short]
        values, owner = np.concatenate([values, np.array(whole, np.uint64)]), np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[first], owner[first]
    return values, np.searchsorted(owner, np.arange(rows + 1))


def minhashes(values: np.ndarray, bounds: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """`slots` samples of every row with shingles, in row order."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((slots, len(starts)), np.uint64)
    if not len(starts):
        return out.T
    factors = blocks.counted_hashes(slots, 21) | np.uint64(1)
    shifts = blocks.counted_hashes(slots, 22)
    for j in range(slots):
        # the high half of a product depends on all bits below it
        permuted = (values ^ shifts[j]) * factors[j]
        permuted ^= permuted >> np.uint64(32)
        out[j] = np.minimum.reduceat(permuted, starts)
    return out.T


def odd_sketches(samples: np.ndarray, width: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmaps: every sample flips one bit that its slot and value choose."""
    n, slots = samples.shape
    bits = (blocks.mix(samples + blocks.counted_hashes(slots, 23)) % np.uint64(width)).astype(np.int64)
    odd = np.bincount((bits + np.arange(n)[:, None] * width).ravel(), minlength=n * width) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, width), axis=1).view(np.int64)


def most_odd_bits(similarity: float, slots: int = SLOTS, width: int = SKETCH_BITS) -> int:
    """XOR bits that a pair of at least this similarity stays within: six deviations over the mean.

    The count varies with the samples that differ and with the flips that meet in one bit.
    """
    differ = (1 - similarity) * slots
    even = (1 - 2 / width) ** (2 * differ)
    from_samples = (2 * even) ** 2 * differ * similarity
    from_meetings = 4 * (2 * differ) ** 2 / (2 * width)
    return int(min(width / 2 * (1 - even) + 6 * np.sqrt(from_samples + from_meetings), width))


def _lists(values: np.ndarray, has: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists; empty lists where `has` is false."""
    width = values.shape[1] if values.ndim == 2 else 0
    bounds = np.concatenate([[0], np.cumsum(has * width)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values.reshape(-1).view(np.int64)))


def _profiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks.slices(batch, "text"):
                data, offsets = blocks.text_bytes(part.column("text"))
                values, bounds = shingle_sets(blocks.Words(blocks.lowered()[data], offsets, blocks.spaced()), k)
                sizes = np.diff(bounds)
                samples = minhashes(values, bounds)
                band = blocks.mix(samples)
                keys = np.empty((len(samples), BANDS), np.uint64)
                for b in range(BANDS):
                    key = np.full(len(samples), b, np.uint64)
                    for r in range(ROWS):
                        key = key * np.uint64(blocks.BASE) + band[:, b * ROWS + r]
                    keys[:, b] = blocks.mix(key)
                has = sizes > 0
                key_bytes = [hashlib.blake2b(values[bounds[i] : bounds[i + 1]].tobytes(), digest_size=16).digest() if has[i] else None for i in range(len(sizes))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(key_bytes, pa.binary()), _lists(keys, has), _lists(odd_sketches(samples), has)],
                    names=["doc_id", "n_shingles", "set_key", "bands", "sketch"],
                )

    return run


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks.slices(batch, "text"):
                data, offsets = blocks.text_bytes(part.column("text"))
                values, bounds = shingle_sets(blocks.Words(blocks.lowered()[data], offsets, blocks.spaced()), k)
                sets = [values[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), blocks.binary(sets)], names=["doc_id", "shingles"])

    return run


def _fine_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in blocks.slices(batch, "shingles"):
            data, offsets = blocks.text_bytes(part.column("shingles"))
            values, bounds = np.frombuffer(data.tobytes(), np.uint64), offsets // 8
            bits = odd_sketches(minhashes(values, bounds, FINE_SLOTS), FINE_BITS)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(bits, np.diff(bounds) > 0)], names=["id", "fine"])


def _similar_enough(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(both) - shared)


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("set_a"), batch.column("set_b")):
                keep.append(_similar_enough(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _odd_bits(x: str, y: str):
    return sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; see the module's text."""
    texts = blocks.narrowed(documents, "doc_id", "text")
    profile = write_and_read(texts.mapInArrow(_profiles(k), _PROFILE), "shingle-profiles")
    sets = write_and_read(
        profile.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep")), "equal-sets"
    )
    # one profile row of each set: rows of its smallest doc_id (any, if that doc_id is repeated)
    vertices = (
        profile.select("doc_id", "set_key", "bands", "sketch")
        .join(sets.withColumnRenamed("rep", "doc_id"), ["set_key", "doc_id"])
        .select(F.col("doc_id").alias("id"), "bands", "sketch")
    )
    members = vertices.select("id", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("band", "hub")
    members = write_and_read(members.join(buckets, "band"), "band-members")
    sketches = write_and_read(vertices.select("id", "sketch").join(members.select("id").distinct(), "id"), "sketches")
    limit = most_odd_bits(percent / 100)

    full = _sets_of(texts, members.select(F.col("id").alias("doc_id")).distinct(), k)
    stars = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    labels = smallest_reachable(_confirm(_similar(stars, sketches, limit), full, percent))

    members, turn, again = members.select("band", "id"), 0, True
    while True:
        mixed, tried, left = _open_members(members, labels, turn)
        if not left.rows:
            break
        if not again or left.comparisons <= FEW_COMPARISONS * left.rows:
            labels = _relabelled(labels, _crossing(mixed, vertices, full, sketches, percent))
            break
        links = _confirm(_similar(tried, sketches, limit), full, percent)
        labels = _relabelled(labels, links)
        again = links.count() >= WORTH * left.open
        members, turn = mixed.select("band", "id"), turn + 1

    component = sets.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("found"))
    out = profile.select("doc_id", "n_shingles", "set_key").join(component, "set_key", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _similar(pairs: DataFrame, sketches: DataFrame, limit: int) -> DataFrame:
    """The pairs (a, b) whose odd sketches do not rule the similarity out."""
    found = pairs.join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b").join(
        sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a"
    )
    return write_and_read(found.where(_odd_bits("sa", "sb") <= limit).select("a", "b"), "star-pairs")


def _open_members(members: DataFrame, labels: DataFrame, turn: int) -> tuple[DataFrame, DataFrame, Row]:
    """Members (band, id, c, hc) of buckets with several components; their pairs (a, b) with the turn's
    hubs across components; and the numbers of members, of open ids and of pairs that they are in."""
    labelled = write_and_read(members.join(labels, "id", "left").select("band", "id", F.coalesce("component", "id").alias("c")), "labelled-members")
    drawn = [F.min(F.struct(F.xxhash64("id", F.lit(HUBS * turn + i)).alias("h"), F.col("id").alias("hub"), F.col("c").alias("hc"))).alias(f"hub{i}") for i in range(HUBS)]
    buckets = labelled.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n"), *drawn).where("low < high")
    mixed = labelled.join(buckets.select("band", "n", F.array(*[f"hub{i}" for i in range(HUBS)]).alias("hubs")), "band")
    mixed = write_and_read(mixed.withColumn("hc", F.col("hubs")[0]["hc"]), "open-members")
    is_open = F.col("c") != F.col("hc")
    left = mixed.agg(
        F.count("*").alias("rows"), F.count_distinct(F.when(is_open, F.col("id"))).alias("open"), F.coalesce(F.sum(F.when(is_open, F.col("n"))), F.lit(0)).alias("comparisons")
    ).first()
    tried = mixed.select("id", "c", F.explode("hubs").alias("with")).where("c <> with.hc")
    tried = tried.select(F.least("id", "with.hub").alias("a"), F.greatest("id", "with.hub").alias("b")).distinct()
    return mixed.select("band", "id", "c", "hc"), tried, left


def _crossing(members: DataFrame, vertices: DataFrame, full: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Links of open members with members of other components in one bucket."""
    ids = members.select("id").distinct()
    sets = full.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    fine = write_and_read(sets.mapInArrow(_fine_sketches, _FINE), "fine-sketches")
    sketched = members.join(vertices.select("id", "bands"), "id").join(sketches, "id").join(fine, "id")
    sketched = write_and_read(sketched.withColumn("at", F.array_position("bands", F.col("band"))), "sketched-members")
    partnered = write_and_read(_by_blocks(sketched, F.lit(1), BLOCK_ROWS, _partners(percent), "band long, id long").distinct(), "partnered-members")
    whole = sketched.join(partnered, ["band", "id"]).join(sets.withColumnRenamed("doc_id", "id"), "id")
    links = _by_blocks(whole, F.octet_length("shingles"), BLOCK_BYTES, _linked(percent), "a long, b long")
    return write_and_read(links.distinct(), "links")


def _by_blocks(members: DataFrame, weight: Column, most: int, function, schema: str) -> DataFrame:
    """`function` over groups in which all members of a bucket meet.

    Buckets of more than `most` by weight are cut into blocks and every two blocks are a
    group, so that a task holds two; smaller buckets share groups.
    """
    total = members.agg(F.sum(weight)).first()[0] or 0
    sizes = members.groupBy("band").agg(F.ceil(F.sum(weight) / most).cast("int").alias("cut")).withColumn("cut", F.greatest("cut", F.lit(1)))
    block = F.pmod(F.xxhash64("id"), F.col("cut")).cast("int")
    every = F.sequence(F.lit(0), F.col("cut") - 1)
    pairs = F.expr("array_distinct(concat(transform(every, j -> struct(block AS i, j AS j)), transform(every, i -> struct(i AS i, block AS j))))")
    rows = members.join(sizes, "band").withColumn("block", block).withColumn("every", every)
    rows = rows.withColumn("pair", F.explode(pairs)).drop("every")
    cell = F.when(F.col("cut") > 1, F.col("band")).otherwise(F.pmod(F.xxhash64("band"), F.lit(-(-total // most) + 1)))
    rows = rows.select("*", cell.alias("cell"), "pair.i", "pair.j").drop("pair")
    return rows.groupBy("cell", "cut", "i", "j").applyInArrow(function, schema)


def _rows_of(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def _near_pairs(group: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of open members and of members of other components, in the first bucket that they
    share, that no sketch rules out; bucket by bucket."""
    number = lambda c: group.column(c).to_numpy()
    band, ids, c, hc, at, block = (number(x) for x in ("band", "id", "c", "hc", "at", "block"))
    as_x, as_y = (c != hc) & (block == number("i")), block == number("j")
    bands = _rows_of(group.column("bands"), np.int64)
    bitmaps = [
        (_rows_of(group.column(name), np.int64).view(np.uint64), most_odd_bits(percent / 100, slots, width))
        for name, slots, width in (("sketch", SLOTS, SKETCH_BITS), ("fine", FINE_SLOTS, FINE_BITS))
    ]
    order = np.argsort(band, kind="stable")
    for run in np.split(order, np.flatnonzero(np.diff(band[order])) + 1):
        y = run[as_y[run]]
        for x in np.array_split(run[as_x[run]], -(-len(run) // 64)):
            if not len(x) or not len(y):
                continue
            p, q = np.nonzero((c[x][:, None] != c[y]) & ((c[y] == hc[y]) | (ids[x][:, None] < ids[y])))
            p, q = x[p], y[q]
            for bits, limit in bitmaps:
                near = np.bitwise_count(bits[p] ^ bits[q]).sum(axis=1) <= limit
                p, q = p[near], q[near]
            first = np.argmax(bands[p] == bands[q], axis=1) + 1 == at[p]
            yield p[first], q[first]


def _partners(percent: int):
    def run(group: pa.Table) -> pa.Table:
        found = np.unique(np.concatenate([np.empty(0, np.int64), *[np.concatenate(pair) for pair in _near_pairs(group, percent)]]))
        return group.select(["band", "id"]).take(pa.array(found))

    return run


def _linked(percent: int):
    def run(group: pa.Table) -> pa.Table:
        data, offsets = blocks.text_bytes(group.column("shingles").combine_chunks())
        values, bounds = np.frombuffer(data.tobytes(), np.uint64), offsets // 8
        ids, a, b = group.column("id").to_numpy(), [], []
        for p, q in _near_pairs(group, percent):
            for i, j in zip(p.tolist(), q.tolist()):
                if _similar_enough(values[bounds[i] : bounds[i + 1]], values[bounds[j] : bounds[j + 1]], percent):
                    a.append(ids[i])
                    b.append(ids[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links between ids; ids without a label are their own component."""
    of = lambda end: labels.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = smallest_reachable(ends).select(F.col("id").alias("old"), F.col("component").alias("new"))
    moved = labels.join(merged, labels["component"] == merged["old"], "left").select("id", F.coalesce("new", "component").alias("component"))
    # ids that had no label
    fresh = merged.join(labels, merged["old"] == labels["id"], "left_anti").select(F.col("old").alias("id"), F.col("new").alias("component"))
    return write_and_read(moved.unionByName(fresh), "components")


def _sets_of(texts: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    chosen = texts.join(ids, "doc_id", "left_semi")
    one = chosen.mapInArrow(_full_sets(k), _SETS)
    return write_and_read(one, "shingle-sets").dropDuplicates(["doc_id", "shingles"])


def _confirm(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    both = pairs.join(full.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")), "b").join(
        full.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), "a"
    )
    return write_and_read(both.mapInArrow(_confirmed(percent), "a long, b long").distinct(), "links")


def keep_one(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `documents` that are the smallest doc_id of their group; other columns stay.

    Of rows with an equal doc_id that is kept, all stay. Rows without doc_id stay.
    """
    dropped = near_duplicates(documents, k, percent).where("NOT kept").select(F.col("doc_id").alias("dropped_id")).distinct()
    return documents.join(dropped, documents["doc_id"] == dropped["dropped_id"], "left_anti")
