"""Fingerprints against plain sums of hashes on messy tables, and their algebra."""

import hashlib
import random
import re

import pytest

from passagework.llm import fingerprints
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, place long, h1 long, guest boolean, copies int, part string, range int, version string"
ENDS = re.compile(r"\r?\n|(?<=[.!?])[\x20\t]+")


def vector(text):
    n, words, signs = 0, [0] * 8, [0] * 256
    for part in (p.strip(" \t\x0b\x0c\r") for p in ENDS.split(text)):
        if part:
            digest = hashlib.sha256(part.encode()).digest()
            n += 1
            words = [(w + int.from_bytes(digest[4 * i : 4 * i + 4])) % (1 << 32) for i, w in enumerate(words)]
            bits = int.from_bytes(digest)
            signs = [s + (1 if bits >> (255 - i) & 1 else -1) for i, s in enumerate(signs)]
    return n, words, [(s + 32768) % 65536 - 32768 for s in signs]


def shown(v):
    n, words, signs = v
    return f"{n:08X}" + "".join(f"{w:08X}" for w in words) + "".join(f"{s % 65536:04X}" for s in signs)


def likeness(a, b):
    if a == b:
        return 1.0
    dot = lambda x, y: sum(p * q for p, q in zip(x[2], y[2]))
    size = dot(a, a) + dot(b, b)
    return min(max(2.0 * dot(a, b) / size, 0.0), 1.0) if size else 0.0


def signed(h):
    return (h + (1 << 63)) % (1 << 64) - (1 << 63)


def plain(rows, order_of):
    """Results for (doc_id, text) rows; `order_of` gives the hashes that part rows of one doc_id."""
    rows = [(i, t or "") for i, t in rows]
    distinct = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, *order_of[r[1]]), reverse=True)
    out = {}
    for (i, text), (_, after) in zip(distinct, distinct[1:] + distinct[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = vector(text), vector(edited), vector(after)
        out[i, text] = (i, len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), likeness(a, b), likeness(a, c))
    return sorted((out[r] for r in rows), key=repr)


def result(documents):
    found = fingerprints.edited_fingerprints(documents)
    text = [fingerprints.fingerprint(F.col(c)).alias(c) for c in ("vector", "edited_vector")]
    found = found.select("doc_id", "n_chars", "edited_sha256", *text, "near_edited", "near_next")
    return sorted((tuple(r) for r in found.collect()), key=repr)


def hashes(spark, texts):
    rows = spark.createDataFrame([(t,) for t in set(texts)], "text string").select("text", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    return {r.text: (r.a, r.b) for r in rows.collect()}


def messy(seed, n):
    r = random.Random(seed)
    sentence = lambda: " ".join(r.choice(["one", "deux", "Жар", "𝔘x", "né"]) for _ in range(r.randint(1, 9))) + r.choice([".", "! ", "?", "", "\t", " \r"])
    page = lambda: "".join(sentence() + r.choice([" ", "\n", "\r\n", "\n\n", "  "]) for _ in range(r.randint(1, 30)))
    texts = [page() for _ in range(n)]
    return [*texts, *texts[:5], "", None, " \n\t", "x", ". . .", "same.\n" * 400, page() * 60]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, True, 3, "p", 4, "v") for i, t in rows], SCHEMA).repartition(3)


def test_unique_ids(spark):
    texts = messy(1, 60)
    ids = random.Random(2).sample(range(-(10**12), 10**12), len(texts) - 3) + [-(1 << 63), (1 << 63) - 1, 0]
    rows = list(zip(ids, texts))
    assert result(frame(spark, rows)) == plain(rows, dict.fromkeys([t or "" for t in texts], (0, 0)))


def test_repeated_and_missing_ids(spark):
    texts = messy(3, 40)
    r = random.Random(4)
    rows = [(r.choice([7, 7, 7, None, 8, 9, -5]), t) for t in texts] + [(7, texts[0])] * 4 + [(None, None), (None, ""), (None, texts[1])]
    assert result(frame(spark, rows)) == plain(rows, hashes(spark, [t or "" for t in texts]))


@pytest.mark.parametrize("rows", [[], [(1, "alone. and\nso")], [(None, None)], [(1, "a"), (1, "a")]])
def test_smallest_tables(spark, rows):
    assert result(frame(spark, rows)) == plain(rows, {t or "": (0, 0) for _, t in rows})


def test_insert_delete_and_order(spark):
    pieces = [f"Paragraph {i % 37}." for i in range(300)]
    shuffled = random.Random(6).sample(pieces, len(pieces))
    rows = [("all", "\n".join(pieces)), ("shuffled", " ".join(shuffled)), ("first", "\n".join(pieces[:120])), ("rest", "\n".join(pieces[120:])), ("other", "\n".join(pieces[:299])), ("none", "")]
    table = spark.createDataFrame(rows, "name string, text string").select("name", fingerprints.parts(F.col("text")).alias("parts"))
    wide = fingerprints.vectors(table, ["name"]).groupBy().pivot("name", [n for n, _ in rows]).agg(F.first("vector"))
    c = {n: F.col(f"`{n}`") for n, _ in rows}
    checks = wide.select(
        (c["all"] == c["shuffled"]).alias("a"),
        (fingerprints.inserted(c["first"], c["rest"]) == c["all"]).alias("b"),
        (fingerprints.deleted(c["all"], c["first"]) == c["rest"]).alias("c"),
        (fingerprints.deleted(c["all"], c["all"]) == c["none"]).alias("d"),
        (c["all"] != c["other"]).alias("e"),
        (fingerprints.deleted(c["none"], c["rest"]) != c["none"]).alias("f"),
        (fingerprints.inserted(fingerprints.deleted(c["none"], c["rest"]), c["all"]) == c["first"]).alias("g"),
    )
    assert all(checks.first())
    near = wide.select(fingerprints.likeness(c["all"], c["shuffled"]).alias("a"), fingerprints.likeness(c["all"], c["other"]).alias("b"), fingerprints.likeness(c["all"], c["none"]).alias("c")).first()
    assert near.a == 1 and 0.9 < near.b < 1 and near.c == 0


def test_texts_are_shuffled_once(spark, sf, plan):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    shuffles = [line for line in plan(fingerprints.edited_fingerprints(docs)).splitlines() if "Exchange hashpartitioning" in line]
    # the other one deals the ranges' heads: ids only
    assert len(shuffles) == 2
