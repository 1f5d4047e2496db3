"""Language of texts by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters becomes a gap, and the 1-, 2- and 3-grams of
code points are hashed into `BUCKETS` counts for each language. The log probabilities, one
small matrix, are broadcast; a slice of texts is scored at once, by gathering the rows of
its grams and summing them over each text.

Learning uses at most about `SAMPLE` texts of each language (rows are chosen by a hash of
doc_id, at a rate that follows from the language's count); every class has the same prior.
Null texts and texts without a letter are `und` with score 0, and so is everything if nothing
could be learnt. Ties go to the language that sorts first. Rows with an equal doc_id are
scored one by one; rows without doc_id are neither held out nor learnt from. Columns
other than doc_id, text and lang are ignored, lang is used for learning only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from passagework.llm import blocks
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
GRAMS = (1, 2, 3)
SAMPLE = 3000
SMOOTHING = 0.5
#: A text's score counts as that of so many grams at most, so that long texts are not all at 1.
EVIDENCE = 100

_COUNTS = "lang string, bucket int, n long"
_SCORED = "doc_id long, held_out boolean, lang_pred string, score double"


@cache
def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(part: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For every n the buckets of all n-grams and the row of each; whether rows have a letter."""
    texts = [(t or "").lower() for t in part.column("text").to_pylist()]
    bounds = np.cumsum([0, *map(len, texts)])
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    letters = letter_table()[chars]
    has = np.bincount(row[letters], minlength=len(texts)) > 0
    chars = np.where(letters, chars, 0).astype(np.uint64)
    found, rows = [], []
    for n in GRAMS:
        if len(chars) < n:
            found.append(np.empty(0, np.int64))
            rows.append(np.empty(0, np.int64))
            continue
        last = len(chars) - n + 1
        keep = row[:last] == row[n - 1 :]
        keep &= letters[n // 2 : n // 2 + last]  # the middle is a letter
        hashed = blocks.windows(chars, n)[keep]
        found.append((hashed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))
        rows.append(row[:last][keep])
    return found, rows, has


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in blocks.slices(batch, "text"):
            names = part.column("lang").to_pylist()
            known = {name: i for i, name in enumerate(sorted(set(names)))}
            which = np.array([known[n] for n in names])
            for buckets, rows, _ in (x for x in [grams(part)] for x in zip(x[0], x[1], [x[2]] * 3)):
                joint = np.bincount(which[rows] * BUCKETS + buckets, minlength=len(known) * BUCKETS).reshape(-1, BUCKETS)
                for name, i in known.items():
                    total[name] = total.get(name, 0) + joint[i]
    for name, counts in total.items():
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], names=["lang", "bucket", "n"]
        )


def learn(documents: DataFrame, usable: Column, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """The languages and a matrix of log probabilities, languages by buckets."""
    labelled = documents.where(usable & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    per_lang = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator()}
    if not per_lang:
        return [], np.zeros((0, BUCKETS), np.float32)
    rate = F.coalesce(*[F.when(F.col("lang") == name, F.lit(min(1.0, sample / n))) for name, n in sorted(per_lang.items())])
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000)) < rate * 1_000_000)
    counted = chosen.select("text", "lang").mapInArrow(_counts, _COUNTS).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    names = sorted(per_lang)
    counts = np.zeros((len(names), BUCKETS))
    for r in counted.toLocalIterator():
        counts[names.index(r.lang), r.bucket] = r.n
    seen = counts.sum(axis=1) > 0
    names, counts = [n for n, s in zip(names, seen) if s], counts[seen] + SMOOTHING
    return names, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        for batch in batches:
            for part in blocks.slices(batch, "text"):
                found, rows, has = grams(part)
                total = np.zeros((part.num_rows, len(names)))
                size = sum(np.bincount(r, minlength=part.num_rows) for r in rows)
                for i in range(len(names)):
                    for buckets, row in zip(found, rows):
                        total[:, i] += np.bincount(row, weights=matrix[i][buckets], minlength=part.num_rows)
                if names:
                    best = np.argmax(total, axis=1)
                    scaled = (total - total.max(axis=1, keepdims=True)) * (np.minimum(size, EVIDENCE) / np.maximum(size, 1))[:, None]
                    score = np.where(has, 1 / np.exp(scaled).sum(axis=1), 0.0)
                else:
                    best, score = np.zeros(part.num_rows, int), np.zeros(part.num_rows)
                guess = [names[b] if h and names else "und" for b, h in zip(best, has)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(guess, pa.string()), pa.array(score)],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    return run


def languages(documents: DataFrame, held_out: Column, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; see the module's text."""
    spark = documents.sparkSession
    own = blocks.narrowed(documents, "doc_id", "text", "lang")
    shared = spark.sparkContext.broadcast(learn(own, F.coalesce(~held_out, F.lit(False)), sample))
    return own.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out")).mapInArrow(_scores(shared), _SCORED)
