"""Line dedup within an edit distance, in SQL functions only.

A line goes when an earlier line (smaller doc_id, then smaller line number) is equal to it or
within `edits` insertions, deletions and substitutions of code points; lines are judged as
they came in. Lines of fewer than `MIN_CHARS` code points must be equal, and blank lines stay.

Segment-partition join: a line of length L falls into `edits` + 1 segments, and a line within
`edits` of it has one of them as a substring at a place that the lengths bound. Every line
gives the segments of all lengths it could meet, with its own substrings at those places, as
hashed keys; only keys that different lines have go on. Their lines meet by key, once for each
pair (at the least key both have), and an edit distance in a band of 2 * `edits` + 1 diagonals,
kept as bits of two integers, is the join's condition, so nothing but links leaves the join.

Equal lines are counted before anything else. Lines with more than one in `HEAVY` of all
lines, fewer than `HEAVY` of them, are broadcast and enter the search once; rarer copies
fall together when the keys are combined.

Null texts have no lines. Rows with an equal doc_id are of the same age: their lines at one
place do not remove each other. Rows without doc_id come before all others. Columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

from passagework.llm import blocks
from passagework.session import write_and_read
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDITS = 2
MIN_CHARS = 16
HEAVY = 10_000
#: Bytes of a table that a join may send to every task; larger ones are shuffled.
SENT_BYTES = 8 << 20
BLANKS = " \t\n\x0b\x0c\r"
#: Characters that candidates are compared by before their distance is taken.
COUNTED = "etaonisrhdluc "


def segment_keys(edits: int) -> Column:
    """Keys of a `line` of `n` code points: for every length it may meet and every segment, its
    substrings there.

    Keys name the shorter line's length, so two lines meet where the shorter one's segment
    is a substring of the longer one.
    """
    parts = edits + 1
    probes = [
        f"named_struct('i', {i}, 'less', {less}, 'shift', {shift})"
        for less in range(edits + 1)
        for i in range(parts)
        for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1)
    ]
    # the last (size mod parts) segments are one longer
    size, plain = "(n - p.less)", f"({parts} - (n - p.less) % {parts})"
    base = f"cast({size} div {parts} AS int)"
    start = f"{base} * p.i + greatest(p.i - {plain}, 0) + p.shift + 1"
    width = f"{base} + CASE WHEN p.i >= {plain} THEN 1 ELSE 0 END"
    return F.expr(f"transform(array({', '.join(probes)}), p -> xxhash64(p.i, {size}, substring(line, {start}, {width})))")


def bounded_distance(a: str, b: str, edits: int) -> str:
    """SQL for the edit distance of two arrays of code points if at most `edits`, else more.

    Columns of the table are walked along the band of diagonals: bit k of `vp` and `vn` says
    that row j - edits + k is one more or one less than the row before. The distance is
    followed down the lowest diagonal and then along the last row. Both arrays must be
    longer than `edits` and their lengths at most `edits` apart.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    start = ((1 << (edits + 1)) - 1) << edits
    equal = " | ".join(f"CASE WHEN get({a}, x.j - {edits - k}) = x.c THEN {1 << k}L ELSE 0L END" for k in range(width))
    steps = f"transform({b}, (c, j) -> named_struct('c', c, 'j', j))"
    with_match = f"named_struct('vp', s.vp, 'vn', s.vn, 'd', s.d, 'm', {equal})"
    # lambdas over one-element arrays name what is used more than once
    let = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    diagonal = f"((((q.m & q.vp) + q.vp) ^ q.vp) | q.m | q.vn) & {full}L"
    row = f"cast(size({a}) - 1 - x.j + {edits} AS int)"
    after = (
        "named_struct("
        f"'vp', (((h.d0 & h.vp) | ~(shiftright(h.d0, 1) | h.hp)) & {full}L), "
        "'vn', (shiftright(h.d0, 1) & h.hp), "
        f"'d', CASE WHEN {row} >= {2 * edits} THEN h.d + 1 - (shiftright(h.d0, {2 * edits}) & 1L) "
        f"ELSE h.d + (shiftright(h.hp, {row}) & 1L) - (shiftright(h.d0 & h.vp, {row}) & 1L) END)"
    )
    across = f"named_struct('vp', q.vp, 'd', q.d, 'd0', z, 'hp', ((q.vn | ~(z | q.vp)) & {full}L))"
    step = let("q", with_match, let("z", diagonal, let("h", across, after)))
    return f"aggregate({steps}, named_struct('vp', {start}L, 'vn', 0L, 'd', {edits}L), (s, x) -> {step}, s -> s.d)"


def _lines(documents: DataFrame, *columns: str) -> DataFrame:
    """One row for each line that is not blank: doc_id, row (a hash of the text), line_no, line, h1, h2."""
    lines = documents.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.where(F.btrim("line", F.lit(BLANKS)) != "")
    return lines.select("doc_id", "row", "line_no", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _place() -> Column:
    return F.struct("doc_id", "line_no")


def sized(table: DataFrame, row_bytes: Column) -> DataFrame:
    """Mark a stored table for broadcast if its rows have at most `SENT_BYTES` together; joins shuffle otherwise."""
    total = table.agg(F.sum(row_bytes.cast("long"))).first()[0] or 0
    return F.broadcast(table) if total <= SENT_BYTES else table


def line_verdicts(documents: DataFrame, edits: int = EDITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All lines (doc_id, row, line_no, h1, h2), distinct ones (h1, h2, first, n), and links between
    those (a, b: h1 and h2 of the older and the younger; ordered: they are not of the same age).

    Keys are gathered by h1 alone: lines that clash there have both lines' keys, which costs
    candidates and no links.
    """
    documents = blocks.narrowed(documents, "doc_id", "text")
    lines = _lines(documents).withColumn("n", F.length("line"))
    keys = F.when(F.col("n") >= MIN_CHARS, segment_keys(edits))
    every = write_and_read(lines.select("doc_id", "row", "line_no", "h1", "h2", keys.alias("keys")), "all-lines")
    known = write_and_read(every.groupBy("h1", "h2").agg(F.min(_place()).alias("first"), F.count("*").alias("n")), "distinct-lines")
    total = known.agg(F.sum("n")).first()[0] or 0
    heavy = F.broadcast(known.where(F.col("n") * HEAVY > total).select("h1", "h2", "first"))
    long_ = every.where("keys IS NOT NULL")
    light = long_.join(heavy.select("h1", "h2"), ["h1", "h2"], "left_anti").select("h1", "keys")
    once = long_.join(heavy, ["h1", "h2"]).where(_place().eqNullSafe(F.col("first"))).select("h1", "keys")
    rows = light.unionAll(once).select("h1", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low < high").select("key")
    shared = sized(write_and_read(shared, "shared-keys"), F.lit(8))
    of_line = rows.join(shared, "key", "left_semi").groupBy("h1").agg(F.collect_set("key").alias("keys"))
    of_line = write_and_read(of_line, "line-keys")

    places = of_line.join(known, "h1").select("h1", "h2", "first", "keys")
    wanted = places.groupBy(F.col("first.doc_id").alias("wanted_id")).agg(F.collect_list(F.struct("first.line_no", "h1", "h2", "keys")).alias("wanted"))
    wanted = write_and_read(wanted, "wanted-lines")
    in_row = F.aggregate("wanted", F.lit(16).cast("long"), lambda n, w: n + 40 + 8 * F.size(w["keys"]))
    texts = documents.where("text IS NOT NULL").join(sized(wanted, in_row), F.col("doc_id").eqNullSafe(F.col("wanted_id")))
    found = texts.select("doc_id", F.split("text", "\n").alias("lines"), F.explode("wanted").alias("w"))
    found = found.select("doc_id", "w.line_no", F.expr("get(lines, w.line_no)").alias("line"), "w.h1", "w.h2", "w.keys")
    found = found.where((F.xxhash64("line") == F.col("h1")) & (F.xxhash64(F.lit(1), "line") == F.col("h2")))  # rows with an equal doc_id hold other lines there
    points = F.transform(F.split("line", ""), lambda c: F.ascii(c))
    counts = F.array(*[F.length("line") - F.length(F.replace("line", F.lit(c))) for c in COUNTED])
    found = found.select("h1", "h2", _place().alias("first"), F.length("line").alias("size"), points.alias("points"), counts.alias("counts"), "keys")
    found = write_and_read(found.dropDuplicates(["h1", "h2"]), "lines-to-compare")

    one = found.select("h1", "h2", "first", "size", "points", "counts", "keys", F.explode("keys").alias("key"))
    a = one.select(*[F.col(c).alias(f"a_{c}") for c in one.columns])
    b = one.select(*[F.col(c).alias(f"b_{c}") for c in one.columns])
    # an edit changes at most two of the counts, by one each
    apart = sum((F.abs(F.col("a_counts")[i] - F.col("b_counts")[i]) for i in range(len(COUNTED))), F.lit(0))
    linked = (
        (F.col("a_key") == F.col("b_key"))
        & ((F.col("a_h1") < F.col("b_h1")) | (F.col("a_h1") == F.col("b_h1")) & (F.col("a_h2") < F.col("b_h2")))
        & (F.abs(F.col("a_size") - F.col("b_size")) <= edits)
        & (apart <= 2 * edits)
        & (F.array_min(F.array_intersect("a_keys", "b_keys")) == F.col("a_key"))
        & F.expr(f"{bounded_distance('a_points', 'b_points', edits)} <= {edits}")
    )
    older = F.col("a_first") < F.col("b_first")
    one_end, other_end = (F.struct(F.col(f"{x}_h1").alias("h1"), F.col(f"{x}_h2").alias("h2")) for x in "ab")
    links = a.join(b, linked).select(
        F.when(older, one_end).otherwise(other_end).alias("a"),
        F.when(older, other_end).otherwise(one_end).alias("b"),
        (F.col("a_first") != F.col("b_first")).alias("ordered"),
    )
    return every, known, write_and_read(links, "line-links")


def removed_lines(documents: DataFrame, edits: int = EDITS) -> DataFrame:
    """removed_id, removed_row, gone (line numbers), n_near, n_links of documents with such lines."""
    every, known, links = line_verdicts(documents, edits)
    ends = links.select("a.h1", "a.h2", F.lit(False).alias("late")).unionAll(links.select("b.h1", "b.h2", F.col("ordered").alias("late")))
    degree = ends.groupBy("h1", "h2").agg(F.count("*").alias("links"), F.max("late").alias("near"))
    judged = known.join(degree, ["h1", "h2"], "left").where("n > 1 OR links IS NOT NULL")
    judged = judged.select("h1", "h2", "first", F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("near", F.lit(False)).alias("near"))
    lines = every.drop("keys").join(judged, ["h1", "h2"])
    verdict = F.struct("line_no", "links", "near", (F.col("near") | ~_place().eqNullSafe(F.col("first"))).alias("go"))
    # a set: a line of two equal rows has one verdict
    lines = lines.groupBy("doc_id", "row").agg(F.collect_set(verdict).alias("verdicts"))
    return lines.select(
        F.col("doc_id").alias("removed_id"),
        F.col("row").alias("removed_row"),
        F.expr("transform(filter(verdicts, v -> v.go), v -> v.line_no)").alias("gone"),
        F.expr("size(filter(verdicts, v -> v.near))").alias("n_near"),
        F.expr("aggregate(verdicts, 0L, (n, v) -> n + v.links)").alias("n_links"),
    )


def _with_removed(documents: DataFrame, edits: int) -> DataFrame:
    """`documents` as columns c0, c1, … in their order, with removed_lines; names cannot clash."""
    columns = documents.columns
    private = documents.toDF(*[f"c{i}" for i in range(len(columns))])
    doc_id, text = (F.col(f"c{columns.index(c)}") for c in ("doc_id", "text"))
    same = doc_id.eqNullSafe(F.col("removed_id")) & (F.xxhash64(text) == F.col("removed_row"))
    return private.join(removed_lines(documents, edits), same, "left")


def _kept_text(text: str) -> Column:
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("gone", i)), "\n")
    return F.when(F.size("gone") > 0, kept).otherwise(F.col(text))


def deduplicated(documents: DataFrame, edits: int = EDITS) -> DataFrame:
    """doc_id, n_lines, n_removed, n_near, n_links, kept_sha256 for every row; see the module's text.

    n_near: lines that are near an older different line. n_links: links of the row's lines to
    different line texts. kept_sha256 is that of the text left.
    """
    own = _with_removed(blocks.narrowed(documents, "doc_id", "text"), edits).withColumnsRenamed({"c0": "doc_id", "c1": "text"})
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return own.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        count(F.col("n_near")).alias("n_near"),
        count(F.col("n_links")).alias("n_links"),
        F.sha2(F.coalesce(_kept_text("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def without_repeats(documents: DataFrame, edits: int = EDITS) -> DataFrame:
    """`documents` without the removed lines; rows that lose all their lines that are not blank go.

    `n_chars`, if there is such a column, follows the text; other columns stay.
    """
    columns = documents.columns
    at = columns.index("text")
    out = _with_removed(documents, edits).withColumn("kept_text", _kept_text(f"c{at}"))
    out = out.where((F.coalesce(F.size("gone"), F.lit(0)) <= 0) | (F.btrim("kept_text", F.lit(BLANKS)) != ""))
    follows = {at: F.col("kept_text")}
    if "n_chars" in columns:
        n = columns.index("n_chars")
        follows[n] = F.when(F.size("gone") > 0, F.length("kept_text").cast("long")).otherwise(F.col(f"c{n}"))
    return out.select(*[follows.get(i, F.col(f"c{i}")).alias(c) for i, c in enumerate(columns)])
