"""Each operator on a small table with nulls, empty, long and repeated texts and clashing names, against its plain version."""

import random
import time
import zlib
from pathlib import Path

import brute
import numpy as np
import pyarrow as pa
import pytest

from passagework.llm import decontaminate, host_rules, language, line_dedup, near_dedup, packing, pii, quality, sharding, suffix_dedup
from passagework.llm.queries import op5_packing, remainder, tokenizer_path
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, shard int, kept boolean, h1 long, band long"


def messy_texts():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(400)]
    line = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    page = lambda: "\n".join(line(r.randint(4, 14)) for _ in range(r.randint(3, 9)))
    base = [page() for _ in range(30)]
    texts = [*base, *base[:6]]
    for text in base[:12]:  # near copies and near lines
        words = text.split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
        at = r.randrange(len(text))
        texts.append(text[:at] + "x" + text[at + 1 :])
        texts.append(text[:at] + text[at + 2 :])
    passage = line(30)
    texts += [line(5) + "\n" + passage + "\n" + line(7) for _ in range(10)]
    texts += [None, None, "", "", " \n\t\n", "one", "One two", "é", "a" * 3000, "ab " * 2000, "a\x00b\x01c " * 20, "it's we'll  \n\n 42!? \U0001f642", "THE END <|endoftext|>"]
    texts += ["mail a.b@c.de or +49 (30) 1234567, 4111 1111 1111 1111, 10.0.0.256 and 10.0.0.25", "@@a@b.c@d.e"]
    texts.append(" ".join(line(2000) for _ in range(3)))  # very long
    return texts


TEXTS = messy_texts()
ROWS = [(i, t, [None, "xx", "yy"][i % 3], None if i % 5 == 0 else f"host{i % 4}", len(t or ""), "k", 1, True, 1, 2) for i, t in enumerate(TEXTS)]
DOCS = [(i, t) for i, t, *_ in ROWS]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(benchmark_items(), "item_id long, text string, spans string")


def benchmark_items():
    words = (TEXTS[0] or "").split()
    return [(1, " ".join(words[2:20]), "x"), (10, " ".join(words[5:30]), "x"), (2, "One", "x"), (3, None, "x"), (None, "one two", "x"), (4, "", "x"), (5, " ".join(words[2:20]), "x")]


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_line_dedup(documents, edits):
    columns = ("doc_id", "n_lines", "n_removed", "n_near", "n_links", "kept_sha256")
    assert rows(line_dedup.deduplicated(documents, edits), *columns) == sorted(brute.line_dedup(DOCS, edits, line_dedup.MIN_CHARS), key=repr)


def test_edit_distance_in_a_band(spark):
    r = random.Random(3)
    pairs = []
    for _ in range(1500):
        a = "".join(r.choice("abc") for _ in range(r.randint(5, 14)))
        b = list(a)
        for _ in range(r.randint(0, 5)):
            at = r.randrange(len(b))
            b[at : at + r.randint(0, 1)] = r.choice(["", "a", "b"])
        pairs.append((a, "".join(b)))
    table = spark.createDataFrame(pairs, "a string, b string")
    points = [F.transform(F.split(c, ""), lambda x: F.ascii(x)).alias(c) for c in "ab"]
    for edits in (1, 2, 3, 4):
        near = [(a, b) for a, b in pairs if abs(len(a) - len(b)) <= edits and min(len(a), len(b)) > edits]
        part = spark.createDataFrame(near, table.schema).select("a", "b", *[p.alias(f"p{c}") for p, c in zip(points, "ab")])
        got = part.select("a", "b", F.expr(line_dedup.bounded_distance("pa", "pb", edits)).alias("d")).collect()
        for x in got:
            d = brute.edit_distance(x.a, x.b)
            assert (x.d == d) if d <= edits else x.d > edits


@pytest.mark.parametrize("length", [20, 50])
def test_suffix_dedup(documents, length):
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows(suffix_dedup.deduplicated(documents, length), *columns) == sorted(brute.suffix_dedup(DOCS, length), key=repr)


def test_suffix_dedup_string_by_string(documents, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", 0)
    monkeypatch.setattr(suffix_dedup, "HOT_SAMPLE", 1)
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows(suffix_dedup.deduplicated(documents), *columns) == sorted(brute.suffix_dedup(DOCS, 50), key=repr)


def sent_shards(table):
    """Rows and bytes that a step of suffix_dedup sends for `table`, and how many rows have pieces."""
    rows_ = table.collect()
    return len(rows_), sum(len(x) for r in rows_ for x in r if isinstance(x, (bytes, bytearray))), sum(r.pieces is not None for r in rows_)


def test_suffix_dedup_sends_shards_in_groups(spark):
    """A row for every task and shard would be a row for every piece, once there are many of both."""
    r = random.Random(11)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    docs = [(i, i, text(400)) for i in range(200)]

    def all_runs(batches):
        for batch in batches:
            numbers = [[np.arange(100, dtype=np.uint32).tobytes()]] * batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.list_(pa.binary()))], names=[*batch.schema.names, "ordinals"])

    df = spark.createDataFrame(docs, "doc_id long, row_hash long, text string").repartition(4)
    marked = df.selectExpr("doc_id", "row_hash", "cast(text as binary) text").mapInArrow(all_runs, "doc_id long, row_hash long, text binary, ordinals array<binary>")
    none = np.empty(0, np.uint64)
    many, few = (sent_shards(marked.mapInArrow(suffix_dedup._send_pieces(50, shards, 5, none), suffix_dedup._GROUPED)) for shards in (5000, 5))
    assert many[0] == few[0] and many[2] <= 4 * 5
    assert many[1] < 1.2 * few[1]


def test_suffix_dedup_marks_no_chance_repeats(spark):
    """Texts that share 20 bytes or 32 have no string of 50 in common; their runs are not sent."""
    r = random.Random(13)
    text = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    short, longer, passage = text(20), text(32), text(60)
    docs = [(i, text(90) + (short, longer)[i % 2] + text(90)) for i in range(60)] + [(i, text(90) + passage + text(90)) for i in (60, 61)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    buckets = 7
    runs = table.mapInArrow(suffix_dedup._find_runs(50, buckets), suffix_dedup._RUNS)
    shared = runs.groupBy("bucket").applyInArrow(suffix_dedup._share, suffix_dedup._MARKED_RUNS)
    shared = shared.groupBy("chunk").applyInArrow(suffix_dedup._by_document, suffix_dedup._SHARED)
    assert sorted(x.doc_id for x in shared.collect()) == [60, 61]


def test_suffix_dedup_in_turns(documents, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "TURN_SHARE", 0.5)
    turns = []
    send = suffix_dedup._send_pieces
    monkeypatch.setattr(suffix_dedup, "_send_pieces", lambda *a: turns.append(a[-2:]) or send(*a))
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows(suffix_dedup.deduplicated(documents), *columns) == sorted(brute.suffix_dedup(DOCS, 50), key=repr)
    assert len(turns) > 1 and turns == [(i, len(turns)) for i in range(len(turns))]


def test_suffix_dedup_leaves_no_shuffle_files(spark, documents):
    """The disk holds the shuffle files of one step at a time."""
    folder = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    held = lambda: sum(f.stat().st_size for f in folder.rglob("shuffle_*.data"))
    before = held()
    suffix_dedup.removed_ranges(documents)
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.2)
    assert held() <= before


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [-(2**63), 2**63 - 1, 0, -1, 1], [3, 2**40, 7], list(range(1000))])
def test_suffix_dedup_numbers_pressed(values):
    x = np.array(values, np.int64)
    a, b = suffix_dedup._numbers(suffix_dedup._pressed_numbers(x, x[::-1]))
    assert a.tolist() == values and b.tolist() == values[::-1]


def test_suffix_dedup_parts_a_common_passage(spark, monkeypatch, tmp_path):
    """A license line in every text, with other text around it each time, is more than one shard takes."""
    r = random.Random(7)
    other = lambda: "".join(r.choice("abcdefgh ") for _ in range(r.randint(60, 90)))
    license_line = "Permission is hereby granted, free of charge, to any person obtaining a copy of this text."
    docs = [(i, other() + license_line + other()) for i in range(1500)]
    judge, limit = suffix_dedup._judge_shard, 20_000
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", limit)
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", limit // 4, raising=False)
    monkeypatch.setattr(suffix_dedup, "HOT_SAMPLE", 2, raising=False)
    folder, unpressed = str(tmp_path), suffix_dedup._unpressed

    def measured(length):
        run = judge(length)

        def measure(table):
            size = sum(len(unpressed(x)) for x in table.column("pieces").to_pylist() if x)
            with open(f"{folder}/{random.SystemRandom().getrandbits(64)}", "w") as file:
                file.write(str(size))
            return run(table)

        return measure

    monkeypatch.setattr(suffix_dedup, "_judge_shard", measured)
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(suffix_dedup.deduplicated(table), *columns) == sorted(brute.suffix_dedup(docs, 50), key=repr)
    sizes = [int(f.read_text()) for f in tmp_path.iterdir()]
    assert max(sizes) < 2 * limit


@pytest.mark.parametrize("k", [2, 4])
def test_near_dedup(documents, k):
    columns = ("doc_id", "n_shingles", "component_id", "kept")
    assert rows(near_dedup.near_duplicates(documents, k, 80), *columns) == sorted(brute.components(DOCS, k, 80), key=repr)


@pytest.mark.parametrize("item_bytes", [decontaminate.ITEM_BYTES, 60])
def test_decontamination(documents, benchmark, item_bytes):
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = brute.contamination(DOCS, [x[:2] for x in benchmark_items()], 13)
    assert rows(decontaminate.contamination(documents, benchmark, item_bytes=item_bytes), *columns) == sorted(want, key=repr)


def test_decontamination_holds_one_block(documents, benchmark):
    """Of several blocks only the last one's search is in the plan; the others' results are written."""
    plan = decontaminate.contamination(documents, benchmark, item_bytes=60)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2


def test_packing(documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    pieces = rows(packing.packed(documents, tokenizer_path()), "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    assert not brute.piece_faults(DOCS, pieces, lambda t: tokenizer.encode(t, add_special_tokens=False).ids, 1024)
    sequences = {p[5] for p in pieces}
    assert sum(p[2] for p in pieces) > 0.9 * 1024 * (len(sequences) - 1)


def test_packing_query_calls_the_tokenizer_without_flags(documents, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    pieces = rows(op5_packing(documents.sparkSession, str(tmp_path)), "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    assert not brute.piece_faults(DOCS, pieces, lambda t: tokenizer.encode(t, add_special_tokens=False).ids, 1024)


@pytest.mark.parametrize("unit", [16, sharding.UNIT])
def test_sharding(documents, unit):
    out = sharding.sharded(documents, shards=5, unit=unit).collect()
    text, by_text, slots, size = dict(DOCS), {}, {}, {}
    assert sorted(r.doc_id for r in out) == sorted(text)
    for r in out:
        raw = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        assert by_text.setdefault(text[r.doc_id], r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
        size[r.shard] = size.get(r.shard, 0) + r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(size) == set(range(5))
    # one text is larger than a share; units of 16 groups leave more to even out than one unit
    others = sorted(size.values())[:-1]
    assert others[-1] - others[0] < (600 if unit > 16 else 8000)


def test_host_rules(documents):
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    judged = host_rules.judged_texts(documents)
    assert rows(judged, *columns) == sorted(((i, *brute.rule_counts(t)) for i, t in DOCS), key=repr)
    assert all(not (r.base_failed and r.kept) for r in judged.collect())


def test_long_texts_have_no_false_repeats(spark):
    """Three million different windows: their hashes would agree without the bits that number them."""
    text = F.expr("array_join(transform(sequence(1L, 3000000L), x -> conv(x, 10, 36)), ' ')")
    table = spark.range(1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("h").alias("source"))
    out = host_rules.text_counts(table).first()
    assert (out.n_words, out.n_repeat_words) == (3_000_000, 0)


def test_host_verdicts(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    rows_ = [(i, good, "fine") for i in range(40)] + [(100 + i, bad if i < 38 else good, "poor") for i in range(40)] + [(200, bad, "tiny"), (201, good, "tiny"), (202, good, None)]
    kept = {r.doc_id: r.kept for r in host_rules.judged_texts(spark.createDataFrame(rows_, "doc_id long, text string, source string")).collect()}
    assert all(kept[i] for i in range(40)) and not any(kept[100 + i] for i in range(40))
    assert kept[201] and kept[202] and not kept[200]


def test_pii(documents):
    out = {r.doc_id: r for r in pii.personal_data(documents).collect()}
    for i, text in DOCS:
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in brute.base_spans(text))
        assert out[i].base_sha256 == brute.sha(base)
        assert set(filter(None, base.split(","))) <= set(out[i].spans.split(","))


def test_language(documents):
    out = {r.doc_id: r for r in language.languages(documents, remainder(3) == 1).collect()}
    assert len(out) == len(DOCS)
    for i, text in DOCS:
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= out[i].score <= 1
        assert out[i].lang_pred in (("xx", "yy") if any(c.isalpha() for c in text or "") else ("und",))


def test_quality(documents, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, len(DOCS), 2)] + [(2, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.quality_scores(documents, labels, remainder(5) == 0).collect()}
    assert len(out) == len(DOCS)
    for i, _ in DOCS:
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= out[i].score <= 1
        assert out[i].predicted == int(out[i].score >= 0.3)


def test_empty_tables(none, documents, benchmark, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    no_items = spark.createDataFrame([], "item_id long, text string")
    for df in (
        line_dedup.deduplicated(none), suffix_dedup.deduplicated(none), near_dedup.near_duplicates(none), sharding.sharded(none),
        packing.packed(none, tokenizer_path()), language.languages(none, remainder(3) == 1), host_rules.judged_texts(none), pii.personal_data(none),
        quality.quality_scores(none, labels, remainder(5) == 0), decontaminate.contamination(none, benchmark),
    ):
        assert df.count() == 0
    assert decontaminate.contamination(documents, no_items).where("contaminated OR n_hit > 0").count() == 0
    assert {r.score for r in quality.quality_scores(documents, labels, remainder(5) == 0).collect()} == {0.5}


def test_repeated_and_missing_doc_ids(spark):
    long_ = "some words that are long enough to count as a repeated string of bytes"
    rows_ = [(1, long_), (1, long_), (1, long_ + " more"), (None, long_), (None, None), (2, long_), (3, None)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    cut = rows(suffix_dedup.deduplicated(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert cut == sorted(brute.suffix_dedup(rows_, 50), key=repr)
    near = rows(near_dedup.near_duplicates(docs), "doc_id", "component_id", "kept")
    assert near == sorted([(1, 1, True)] * 3 + [(None, None, True)] * 2 + [(2, 1, False), (3, 3, True)], key=repr)
    lines = rows(line_dedup.deduplicated(docs), "doc_id", "n_removed")
    assert lines == sorted([(None, 0), (None, 0), (1, 1), (1, 1), (1, 0), (2, 1), (3, 0)], key=repr)
    for df in (packing.packed(docs, tokenizer_path()), sharding.sharded(docs), host_rules.judged_texts(docs.withColumn("source", F.lit(None).cast("string"))), pii.personal_data(docs)):
        assert df.count() == len(rows_)
