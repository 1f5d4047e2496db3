"""Quality of texts by attention-based multiple-instance learning.

A text is a bag of passages of `PASSAGE` words. Every passage is described by counts of
character classes, word shapes and repetition and by hashed words; a small layer encodes it,
gated attention weighs the encoded passages, and the weighted mean is scored. Only the
texts' labels train the weights: which passages speak for the label is learnt.

Learning uses about `SAMPLE` labelled texts, chosen by a hash of doc_id, each with its first
`BAG` passages of a hashed order at most; scoring uses every passage of every text. What
comes to the driver are the passages' numbers, `SAMPLE * BAG` rows at most.

Null, empty and word-less texts are one passage of zeros and are scored like others. Rows
with an equal doc_id are scored one by one; if labels repeat a doc_id, the smallest label
counts. Without labelled rows every score is 0.5. Rows without doc_id are neither held
out nor learnt from. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from passagework.llm import blocks
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSAGE = 64
SAMPLE = 6000
BAG = 24
HASHED = 32
HIDDEN = 24
GATE = 12
EPOCHS = 30
STEP = 0.01
THRESHOLD = 0.3

_BAGS = "doc_id long, label int, passages binary"
_SCORED = "doc_id long, held_out boolean, score double, predicted int"

_CLASSES = ("lower", "upper", "digit", "blank", "newline", "sentence", "symbol", "bang", "other", "high")


def _class_table() -> np.ndarray:
    table = np.full(256, _CLASSES.index("other"), np.uint8)
    table[128:] = _CLASSES.index("high")
    for name, members in (
        ("lower", range(97, 123)),
        ("upper", range(65, 91)),
        ("digit", range(48, 58)),
        ("blank", (9, 11, 12, 13, 32)),
        ("newline", (10,)),
        ("sentence", b".,;:?"),
        ("symbol", b"#*$%&|<>"),
        ("bang", b"!"),
    ):
        table[list(members)] = _CLASSES.index(name)
    return table


_TABLE = _class_table()
FEATURES = len(_CLASSES) + 8 + HASHED


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of numbers for every passage, and the bounds of each text's passages."""
    rows = len(offsets) - 1
    words = blocks.Words(data, offsets, blocks.spaced())
    hashes = words.hashes()
    per_row = np.maximum(1, -(-words.counts // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(per_row)])
    out = np.zeros((bounds[-1], FEATURES), np.float32)
    if not len(words.starts):
        return out, bounds
    row = np.repeat(np.arange(rows), words.counts)
    nth = np.arange(len(row)) - words.bounds[row]
    passage = bounds[row] + nth // PASSAGE
    n = np.bincount(passage, minlength=len(out)).astype(float)
    safe = np.maximum(n, 1)

    # a passage's bytes: from its first word to the next passage of the text
    first = np.flatnonzero(np.diff(passage, prepend=-1))
    begins = words.starts[first]
    ends = np.append(begins[1:], len(data))
    ends = np.minimum(ends, offsets[1:][row[first]])
    edges = np.stack([begins, ends], axis=1).ravel()
    for c in range(len(_CLASSES)):
        sums = np.concatenate([[0], np.cumsum(_TABLE[data] == c, dtype=np.int64)])
        count = sums[edges].reshape(-1, 2)
        out[passage[first], c] = (count[:, 1] - count[:, 0]) / np.maximum(ends - begins, 1)

    size = words.ends - words.starts
    mean = lambda x: np.bincount(passage, weights=x, minlength=len(out)) / safe
    at = len(_CLASSES)
    average = mean(size)
    out[:, at] = average / 10
    out[:, at + 1] = np.sqrt(np.maximum(mean(size.astype(float) ** 2) - average**2, 0)) / 10
    upper = np.concatenate([[0], np.cumsum(_TABLE[data] == 1, dtype=np.int64)])
    capital = upper[words.ends] - upper[words.starts]
    out[:, at + 2] = mean((capital > 1) & (2 * capital >= size))
    out[:, at + 3] = mean(np.isin(data[words.ends - 1], [33, 46, 63]))
    out[:, at + 4] = mean((size == 1) & (_TABLE[data[words.starts]] >= 6))
    same = np.zeros(len(row), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    out[:, at + 5] = mean(same)
    order = np.lexsort((hashes, passage))
    again = np.zeros(len(row), bool)
    again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (passage[order[1:]] == passage[order[:-1]])
    out[:, at + 6] = mean(again)
    out[:, at + 7] = np.log1p(n) / 5
    slot = (hashes >> np.uint64(59)).astype(np.int64)
    hashed = np.bincount(passage * HASHED + slot, minlength=len(out) * HASHED).reshape(-1, HASHED)
    out[:, at + 8 :] = hashed / safe[:, None]
    return out, bounds


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in blocks.slices(batch, "text"):
            x, bounds = passages(*blocks.text_bytes(part.column("text")))
            bags = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                pick = np.sort(np.argsort(blocks.counted_hashes(b - a, 31))[:BAG])
                bags.append(x[a:b][pick])
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("label").cast(pa.int32()), blocks.binary(bags)], names=["doc_id", "label", "passages"])


def _sum(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Encoder, gated attention and score; `forward` keeps what `step` needs for gradients."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        near = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float64)
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.p = {
            "w": near(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "v": near(HIDDEN, GATE), "u": near(HIDDEN, GATE),
            "a": near(GATE, 1), "c": near(HIDDEN, 1), "d": np.zeros(1),
        }

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        p, starts, sizes = self.p, bounds[:-1], np.diff(bounds)
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (t * g) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes, axis=0))
        weight = e / np.repeat(_sum(e, starts), sizes, axis=0)
        z = _sum(weight * h, starts)
        self.kept = (x, h, t, g, weight, z, starts, sizes)
        return _sigmoid(z @ p["c"] + p["d"])[:, 0]

    def gradients(self, error: np.ndarray) -> dict[str, np.ndarray]:
        """`error`: the loss's derivative by each bag's score before the sigmoid."""
        p, (x, h, t, g, weight, z, starts, sizes) = self.p, self.kept
        error = error[:, None]
        dz = np.repeat(error @ p["c"].T, sizes, axis=0)
        along = (dz * h).sum(axis=1, keepdims=True)
        de = weight * (along - np.repeat(_sum(weight * along, starts), sizes, axis=0))
        dt, dg = (de @ p["a"].T) * g * (1 - t * t), (de @ p["a"].T) * t * g * (1 - g)
        dh = (weight * dz + dt @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
        return {"w": x.T @ dh, "b": dh.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "c": z.T @ error, "d": error.sum(axis=0)}


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model | None:
    """Weights by Adam on the log loss; None if there is nothing to learn from."""
    if not len(bags):
        return None
    model, r = Model(seed), np.random.default_rng(seed)
    every = np.concatenate(bags)
    model.mean, model.scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    n, k = 128, 0
    for _ in range(EPOCHS):
        order = r.permutation(len(bags))
        for at in range(0, len(order), n):
            pick = order[at : at + n]
            x = np.concatenate([bags[i] for i in pick])
            bounds = np.cumsum([0, *(len(bags[i]) for i in pick)])
            score = model.forward(x, bounds)
            k += 1
            for name, slope in model.gradients((score - labels[pick]) / len(pick)).items():
                slope = slope + 1e-4 * model.p[name]
                first[name] += 0.1 * (slope - first[name])
                second[name] += 0.001 * (slope * slope - second[name])
                model.p[name] -= STEP * (first[name] / (1 - 0.9**k)) / (np.sqrt(second[name] / (1 - 0.999**k)) + 1e-8)
    model.kept = None
    return model


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in blocks.slices(batch, "text"):
                x, bounds = passages(*blocks.text_bytes(part.column("text")))
                score = model.forward(x, bounds) if model else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    return run


def learn(documents: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> Model | None:
    """A model of `labels` (doc_id, quality), from at most about `sample` usable rows."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(usable).groupBy("doc_id").agg(F.min("quality").alias("label"))
    total = known.count()
    part = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(total, 1)))
    # both sides are thinned by the same rule of doc_id before they meet
    bags = documents.where(part).join(known.where(part), "doc_id").select("doc_id", "text", "label").mapInArrow(_bags, _BAGS)
    rows = sorted(((r.doc_id, r.label, r.passages) for r in bags.toLocalIterator()), key=lambda r: (r[0], bytes(r[2])))
    return fit([np.frombuffer(r[2], np.float32).reshape(-1, FEATURES) for r in rows], np.array([r[1] for r in rows], float))


def quality_scores(documents: DataFrame, labels: DataFrame, held_out: Column, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; see the module's text."""
    own = blocks.narrowed(documents, "doc_id", "text")
    model = learn(own, labels.select("doc_id", "quality"), F.coalesce(~held_out, F.lit(False)), sample)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return own.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out")).mapInArrow(_scores(shared), _SCORED)


def _accepted(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in blocks.slices(batch, text):
                if model:
                    x, bounds = passages(*blocks.text_bytes(part.column(text)))
                    part = part.filter(pa.array(model.forward(x, bounds) >= THRESHOLD))
                yield part

    return run


def accepted(documents: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """The rows of `documents` that the classifier accepts; other columns stay.

    Rows are scored and filtered in one pass, under private column names. Rows that share a
    doc_id with a rejected row go with it, which takes a join only where doc_ids repeat; rows
    without doc_id stay or go by themselves.
    """
    own = blocks.narrowed(documents, "doc_id", "text")
    model = learn(own, blocks.narrowed(labels, "doc_id", "quality"), F.coalesce(~held_out, F.lit(False)))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    columns = documents.columns
    private = documents.toDF(*[f"c{i}" for i in range(len(columns))])
    kept = private.mapInArrow(_accepted(shared, f"c{columns.index('text')}"), private.schema).toDF(*columns)
    repeated = own.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.isEmpty():
        scored = own.join(repeated, "doc_id", "left_semi").withColumn("held_out", F.lit(False)).mapInArrow(_scores(shared), _SCORED)
        bad = scored.where("predicted = 0").select(F.col("doc_id").alias("bad_id")).distinct()
        kept = kept.join(bad, kept["doc_id"] == bad["bad_id"], "left_anti")
    return kept
