"""Homomorphic fingerprints of texts as multisets of paragraphs, in SQL functions only.

A text is cut at line breaks, and long paragraphs at the ends of their sentences; blank
parts do not count. Every part is hashed to 256 bits, and a text's vector sums over its
parts: their number and the hash's eight 32-bit words modulo 2**32, and every bit as a sign,
1 or -1, modulo 2**16. So equal multisets have equal fingerprints whatever their order,
`inserted` and `deleted` follow an edit without the rest of the text, and unequal ones agree
with a chance below 2**-200.

The 256 sign sums are random projections: the product of two texts' sums estimates what they
share, and `likeness` sets it against both texts' own squares. It is 1 for equal
fingerprints, near 0 where nothing is shared (with a deviation of about 0.09 for texts of
equal size), and about the share of common parts otherwise.

The document after another is the one with the next smaller doc_id; after the last comes the
first. Documents are cut into ranges of doc_id, and a copy of the next range's first document
closes every range, so texts are shuffled once. A doc_id with very many rows is cut by hash.
The parts of the kept half are hashed once and inserted into both versions' vectors.

Null texts are empty; empty and blank texts have zero vectors, which equal each other. Rows
without doc_id come last. Rows with an equal doc_id follow each other by their hash; equal
rows stand in the order once and have the same result. Columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

from passagework.llm import blocks
from passagework.session import write_and_read
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Bits of a part's hash, and of each word of it that is summed by itself.
HASH_BITS, WORD_BITS = 256, 32
WORD_MASK, SIGN_RANGE = (1 << WORD_BITS) - 1, 1 << 16
#: Parts that are counted together in sums of 7 bits each.
CHUNK = 127
#: Ranges of doc_id hold about so many bytes of text; a broadcast row for each range bounds their number.
RANGE_BYTES = 16 << 20
MOST_RANGES = 1 << 17
_QUANTILES = 128
_PART_ENDS = r"\r?\n|(?<=[.!?])[\x20\t]+"
_BLANKS = " \t\x0b\x0c\r"
_LOWEST = -(1 << 63)


def _pieces(text: Column) -> Column:
    return F.split(text, _PART_ENDS)


def _parts(pieces: Column) -> Column:
    return F.filter(F.transform(pieces, lambda p: F.btrim(p, F.lit(_BLANKS))), lambda p: p != "")


def parts(text: Column) -> Column:
    """The pieces of a text that are hashed, in its order."""
    return _parts(_pieces(text))


def _wrapped(x: Column) -> Column:
    half = F.lit(SIGN_RANGE // 2)
    return (x + half).bitwiseAND(F.lit(SIGN_RANGE - 1)) - half


def _each(places: int) -> int:
    """A long with a bit at every so many places."""
    return sum(1 << i for i in range(0, 64, places))


def vectors(texts: DataFrame, keys: list[str]) -> DataFrame:
    """`keys` and `vector` (n, words, signs) for every key; `texts` has a column `parts`, null is none.

    Rows of one key are one multiset. If the table is dealt by some of the keys already,
    nothing is shuffled.
    """
    each = texts.select(*keys, F.posexplode_outer("parts").alias("nth", "part"))
    each = each.select(*keys, F.expr(f"nth div {CHUNK}").alias("chunk"), "part", F.sha2(F.col("part").cast("binary"), HASH_BITS).alias("digest"))
    longs = range(HASH_BITS // 64)
    bits = [F.conv(F.substring("digest", 1 + 16 * i, 16), 16, -10).cast("long").alias(f"bits{i}") for i in longs]
    each = each.select(*keys, "chunk", "part", *bits)
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    high, low = lambda c: F.shiftrightunsigned(c, 32), lambda c: F.col(c).bitwiseAND(F.lit(WORD_MASK))
    sums, more = [F.count("part").alias("n_parts")], [total("n_parts", "n_parts")]
    for i in longs:
        h = f"bits{i}"
        sums += [total(high(h), f"high{i}"), total(low(h), f"low{i}")]
        more += [total(f"high{i}", f"high{i}"), total(f"low{i}", f"low{i}")]
        for j in range(8):
            # bits 8 places apart, whose sums over a chunk stay in 7 bits; then 32 places apart
            sums.append(total(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_each(8))), f"few{i}_{j}"))
            more += [total(F.shiftrightunsigned(f"few{i}_{j}", 8 * k).bitwiseAND(F.lit(255 * _each(32))), f"pair{i}_{8 * k + j}") for k in range(4)]
    found = each.groupBy(*keys, "chunk").agg(*sums).groupBy(*keys).agg(*more)
    words = [F.col(f"{half}{i}").bitwiseAND(F.lit(WORD_MASK)) for i in longs for half in ("high", "low")]
    signs = [_wrapped(2 * half(f"pair{i}_{j}") - F.col("n_parts")) for i in longs for half in (high, low) for j in reversed(range(32))]
    n = F.col("n_parts").bitwiseAND(F.lit(WORD_MASK))
    return found.select(*keys, F.struct(n.alias("n"), F.array(*words).alias("words"), F.array(*signs).alias("signs")).alias("vector"))


def _lane_by_lane(a: Column, b: Column, both) -> Column:
    word = lambda x, y: both(x, y).bitwiseAND(F.lit(WORD_MASK))
    return F.struct(
        word(a["n"], b["n"]).alias("n"),
        F.zip_with(a["words"], b["words"], word).alias("words"),
        F.zip_with(a["signs"], b["signs"], lambda x, y: _wrapped(both(x, y))).alias("signs"),
    )


def inserted(vector: Column, more: Column) -> Column:
    """The vector of both texts' parts together."""
    return _lane_by_lane(vector, more, lambda x, y: x + y)


def deleted(vector: Column, less: Column) -> Column:
    """The vector that is left when the parts of `less` are taken away."""
    return _lane_by_lane(vector, less, lambda x, y: x - y)


def fingerprint(vector: Column) -> Column:
    """A vector as hexadecimal text."""
    word = lambda x: F.lpad(F.hex(x), WORD_BITS // 4, "0")
    sign = lambda x: F.substring(F.hex(x + F.lit(1 << 32)), -4, 4)
    lists = F.array_join(F.transform(vector["words"], word), ""), F.array_join(F.transform(vector["signs"], sign), "")
    return F.concat(word(vector["n"]), *lists)


def shared(a: Column, b: Column) -> Column:
    """Estimates the sum of products of the parts' numbers in both texts, times HASH_BITS."""
    return F.aggregate(F.zip_with(a["signs"], b["signs"], lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def likeness(a: Column, b: Column, size_a: Column | None = None, size_b: Column | None = None) -> Column:
    """0 to 1; each vector's `shared` with itself may be given where it is at hand."""
    size_a, size_b = (shared(a, a) if size_a is None else size_a), (shared(b, b) if size_b is None else size_b)
    share = F.coalesce(F.lit(2.0) * shared(a, b) / F.nullif(size_a + size_b, F.lit(0).cast("long")), F.lit(0.0))
    return F.when(a == b, 1.0).otherwise(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))


def _distinct_rows(documents: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id, place, h1, h2, text, copies: equal rows once; and whether any doc_id has several rows."""
    rows = blocks.narrowed(documents, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("doc_id", F.lit(_LOWEST)).cast("long").alias("place"), F.coalesce("text", F.lit("")).alias("text")
    )
    repeated = not rows.groupBy("doc_id").count().where("count > 1").isEmpty()
    if not repeated:
        return rows.select("doc_id", "place", F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), "text", F.lit(1).cast("long").alias("copies")), False
    rows = rows.select("doc_id", "place", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    rows = rows.groupBy("doc_id", "place", "h1", "h2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    return write_and_read(rows, "distinct-documents"), True


def _in_ranges(rows: DataFrame) -> DataFrame:
    """`rows` with `range`: a number that rises with (place, h1).

    Quantiles of doc_id are cut into equal steps; a doc_id that fills a quantile by itself is
    cut by hash instead.
    """
    facts = rows.agg(
        F.percentile_approx("place", [i / _QUANTILES for i in range(_QUANTILES + 1)], _QUANTILES * 100).alias("borders"),
        F.sum(F.octet_length("text")).alias("bytes"),
        F.max("place").alias("top"),
    ).first()
    session = rows.sparkSession
    wanted = max(8 * int(session.conf.get("spark.sql.shuffle.partitions")), (facts["bytes"] or 0) // RANGE_BYTES, 1)
    cells = -(-min(wanted, MOST_RANGES) // _QUANTILES)
    listed = facts["borders"] or [0]
    hot = sorted({a for a, b in zip(listed, listed[1:]) if a == b})
    borders = F.array(*[F.lit(b) for b in sorted(set(listed))])
    tops = F.array(*[F.lit(b) for b in [*sorted(set(listed))[1:], max(listed[-1], facts["top"] or 0)]])
    coarse = F.size(F.filter(borders, lambda b: b <= F.col("place")))
    rows = rows.withColumn("coarse", F.greatest(coarse, F.lit(1)))
    is_hot = F.col("place").isin(hot) if hot else F.lit(False)
    low, high = F.get(borders, F.col("coarse") - 1).cast("double"), F.get(tops, F.col("coarse") - 1).cast("double")
    along = (F.col("place").cast("double") - low) / F.greatest(high - low, F.lit(1.0))
    by_hash = F.col("h1").cast("double") / F.lit(2.0**64) + F.lit(0.5)
    cell = F.least(F.greatest(F.floor(F.when(is_hot, by_hash).otherwise(along) * cells), F.lit(0)), F.lit(cells - 1))
    number = (F.col("coarse") * 2 + F.when(is_hot, 0).otherwise(1)) * F.lit(cells) + cell
    return rows.withColumn("range", number.cast("long")).drop("coarse")


def _in_order(*more: str) -> WindowSpec:
    """Falling doc_id inside each range, the guest last."""
    falling = [F.desc(c) for c in ("place", "doc_id", "h1", "h2")]
    return Window.partitionBy("range").orderBy("guest", *falling, *more)


def _closed_ranges(rows: DataFrame) -> DataFrame:
    """`rows` in ranges, each with the first row of the range after it as `guest`."""
    rows = _in_ranges(rows)
    head = F.max(F.struct("place", "doc_id", "h1", "h2")).alias("head")
    heads = rows.groupBy("range").agg(head)
    down = Window.orderBy(F.desc("range"))
    after = F.coalesce(F.lead("head").over(down), F.first("head").over(down))
    # at most a row for each range, of which there are 2 * MOST_RANGES + 2 * _QUANTILES at most
    heads = F.broadcast(heads.select(F.col("range").alias("of"), after.alias("head")))
    same = [rows[c].eqNullSafe(heads["head"][c]) for c in ("place", "doc_id", "h1", "h2")]
    guests = rows.join(heads, (rows["place"] == heads["head"]["place"]) & same[1] & same[2] & same[3])
    guests = guests.select("doc_id", "place", "h1", "h2", "text", "copies", F.col("of").alias("range"), F.lit(True).alias("guest"))
    return rows.withColumn("guest", F.lit(False)).unionByName(guests)


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """For every row doc_id, n_chars, edited_sha256, vector, edited_vector, near_edited, near_next.

    The edited text has the last half of its code points (rounded down) replaced by the first
    as many of the next document; near_next is the likeness to that document's own text.
    """
    rows, repeated = _distinct_rows(documents)
    rows = _closed_ranges(rows).withColumn("next", F.lead("text").over(_in_order()))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    cut = [
        F.expr("substring(text, 1, int(n_chars - n_chars div 2))").alias("head"),
        F.expr("substring(text, int(n_chars - n_chars div 2) + 1)").alias("tail"),
        F.expr("substring(next, 1, int(n_chars div 2))").alias("other"),
    ]
    keys = ["range", "guest", "place", "doc_id", "h1", "h2", "copies", "n_chars", "edited_sha256", "version"]
    rows = rows.select(*keys[:-2], *cut)
    rows = rows.select(*keys[:-2], F.sha2(F.concat("head", "other").cast("binary"), 256).alias("edited_sha256"), _pieces(F.col("head")).alias("pieces"), "tail", "other")
    # the head's last piece may go on in the tail, differently in either version
    last = F.element_at("pieces", -1)
    versions = F.array(
        _parts(F.slice("pieces", 1, F.size("pieces") - 1)), parts(F.concat(last, "tail")), F.when(~F.col("guest"), parts(F.concat(last, "other")))
    )
    rows = rows.select(*keys[:-1], F.posexplode(versions).alias("version", "parts"))
    part_of = vectors(rows, keys)
    lead = lambda c, by, *more: F.lead(c, by).over(_in_order(*more))
    two = part_of.select(*keys, "vector", lead("vector", 1, "version").alias("own"), lead("vector", 2, "version").alias("edited")).where("version = 0")
    two = two.select(*keys, inserted(F.col("vector"), F.col("own")).alias("vector"), inserted(F.col("vector"), F.col("edited")).alias("edited_vector"))
    two = two.withColumn("size", shared(F.col("vector"), F.col("vector")))
    out = two.select(*keys, "vector", "size", "edited_vector", lead("vector", 1).alias("next_vector"), lead("size", 1).alias("next_size"))
    out = out.where("NOT guest")
    if repeated:
        out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "vector", "edited_vector",
        likeness(F.col("vector"), F.col("edited_vector"), F.col("size")).alias("near_edited"),
        likeness(F.col("vector"), F.col("next_vector"), F.col("size"), F.col("next_size")).alias("near_next"),
    )
