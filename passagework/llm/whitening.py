"""Whitening of integer-scaled embeddings by the exact characteristic polynomial of their scatter.

Entries become floor(256 * c) as 64-bit integers (beyond that range the nearest such integer);
every distinct vector counts once. Tasks sum products of entries exactly, so
M = n * sum(x x') - S S' is an integer matrix and M / n**2 the covariance, centred without
rounding. M's characteristic polynomial is found modulo primes, by a similar matrix in
Hessenberg form for each, in Spark tasks, and put together by Chinese remaindering.

All its roots are real and none is negative, so the number of sign changes of its Taylor
shift by t is the number of roots above t (repeated ones included): the largest roots are
followed bit by bit to `ROOT_BITS` significant bits. A component is the null vector of
M - root, by inverse iteration in fixed-point arithmetic with as many bits; vectors of one
repeated root are made orthogonal to each other. Only what a table's dimension bounds comes
to the driver, and work there grows with its fourth power: the method is for some hundred
dimensions at most.

Vectors that are null or hold null or non-finite entries are left out, as are those whose
length differs from the commonest one (the smaller of ties; empty vectors have none).
Components stop at the covariance's rank: a root of zero has nothing to be divided by; so
no rows come from an empty table or one distinct vector. Rows with an equal or null vec_id are
separate rows. A deviation that no long can hold is null. Columns other than vec_id and
embedding are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from passagework.llm import blocks
from passagework.session import write_and_read
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPONENTS = 4
SCALE = 256
ROOT_BITS = 160
#: Rows and bits of entries whose products are exact sums in float64.
EXACT_ROWS, LIMB_BITS = 4096, 20
#: Sums go to Spark in limbs, which a table's tasks add up without overflow.
SUM_LIMBS, SUM_BITS = 5, 40

_USABLE = "vec_id long, size int, x binary"
_SUMS = ", ".join(["at int", *[f"limb{i} long" for i in range(SUM_LIMBS)]])
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Components(NamedTuple):
    """Unit eigenvectors of the covariance, with the scatter's eigenvalues."""

    n: int
    sums: np.ndarray  # objects: S
    vectors: np.ndarray  # doubles, one component a row
    roots: list[Fraction]
    explained: list[float]


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("embedding").cast(pa.list_(pa.float64()))
        batch = pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), column], names=["vec_id", "embedding"])
        batch = batch.filter(pc.is_valid(column))
        column = batch.column("embedding")
        sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        entries = column.flatten()
        values = entries.to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])  # a null entry reads as NaN
        good = np.flatnonzero(bad[bounds[1:]] == bad[bounds[:-1]])
        with np.errstate(invalid="ignore", over="ignore"):
            scaled = np.floor(np.where(np.isfinite(values), values, 0.0) * SCALE)
        # the greatest double below 2**63 is 1024 less
        x = np.where(scaled >= 2.0**63, np.iinfo(np.int64).max, np.clip(scaled, -(2.0**63), 2.0**63 - 1024).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id").take(pa.array(good)), pa.array(sizes[good], pa.int32()), blocks.binary([x[bounds[i] : bounds[i + 1]] for i in good])],
            names=["vec_id", "size", "x"],
        )


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    data, _ = blocks.text_bytes(column)
    return np.frombuffer(data.tobytes(), np.int64).reshape(-1, size)


def products(x: np.ndarray) -> np.ndarray:
    """Exact sums of products of columns, as Python integers."""
    size = x.shape[1]
    total = np.zeros((size, size), object)
    for start in range(0, len(x), EXACT_ROWS):
        part, limbs = x[start : start + EXACT_ROWS], []
        while True:
            last = len(part) == 0 or max(abs(int(part.max())), abs(int(part.min()))) < 1 << LIMB_BITS
            low = part if last else part & ((1 << LIMB_BITS) - 1)
            limbs.append(low.astype(np.float64))
            if last:
                break
            part = part >> LIMB_BITS
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) << (LIMB_BITS * (i + j))
    return total


def _sums(size: int):
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, np.zeros(size, object), np.zeros((size, size), object)
        for batch in batches:
            x = _matrix(batch.column("x"), size)
            n, squares = n + len(x), squares + products(x)
            # halves of the entries, so that no sum overflows
            sums += ((x >> 32).sum(axis=0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        values = [n, *sums.tolist(), *squares[upper].tolist()]
        limbs = [[v >> SUM_BITS * k & (1 << SUM_BITS) - 1 if k < SUM_LIMBS - 1 else v >> SUM_BITS * k for v in values] for k in range(SUM_LIMBS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), *[pa.array(c, pa.int64()) for c in limbs]], names=["at", *[f"limb{k}" for k in range(SUM_LIMBS)]])

    return run


def scatter(fit: DataFrame, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """n, S and n * sum(x x') - S S' of all rows of `fit`, exact."""
    names = [f"limb{k}" for k in range(SUM_LIMBS)]
    rows = fit.mapInArrow(_sums(size), _SUMS).groupBy("at").agg(*[F.sum(c).alias(c) for c in names]).collect()
    values = [0] * (1 + size + size * (size + 1) // 2)
    for row in rows:
        values[row["at"]] = sum(row[c] << SUM_BITS * k for k, c in enumerate(names))
    n, sums = values[0], np.array(values[1 : size + 1], object)
    squares = np.zeros((size, size), object)
    squares[np.triu_indices(size)] = values[size + 1 :]
    squares += np.triu(squares, 1).T
    return n, sums, n * squares - np.multiply.outer(sums, sums)


def polynomial_modulo(matrix: np.ndarray, prime: int) -> list[int]:
    """Coefficients of the characteristic polynomial, constant first, modulo a prime below 2**31."""
    h = (matrix % prime).astype(np.int64)
    size = len(h)
    for k in range(1, size - 1):
        rows = np.flatnonzero(h[k:, k - 1])
        if not len(rows):
            continue
        pivot = k + int(rows[0])
        if pivot != k:
            h[[k, pivot]] = h[[pivot, k]]
            h[:, [k, pivot]] = h[:, [pivot, k]]
        factor = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, prime) % prime
        h[k + 1 :] = (h[k + 1 :] - factor[:, None] * h[k] % prime) % prime
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * factor % prime).sum(axis=1)) % prime
    # polynomials of the leading blocks, each from those before it
    found = np.zeros((size + 1, size + 1), np.int64)
    found[0, 0] = 1
    for k in range(size):
        below = np.zeros(k + 1, np.int64)  # h[i, k] times the subdiagonal entries from i + 1 to k
        product = 1
        for i in range(k, -1, -1):
            below[i] = int(h[i, k]) * product % prime
            product = product * int(h[i, i - 1]) % prime if i else product
        found[k + 1, 1:] = found[k, :-1]
        found[k + 1] = (found[k + 1] - (below[:, None] * found[: k + 1] % prime).sum(axis=0)) % prime
    return found[size].tolist()


def primes_below(top: int, product_over: int) -> list[int]:
    """The largest primes below `top` whose product is greater than `product_over`."""
    found, product, candidate = [], 1, top - 1 - top % 2
    while product <= product_over:
        # these bases decide for all numbers below 3 * 10**9
        if all(_passes(candidate, base) for base in (2, 3, 5, 7)):
            found.append(candidate)
            product *= candidate
        candidate -= 2
    return found


def _passes(n: int, base: int) -> bool:
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    x = pow(base, odd, n)
    return x in (1, n - 1) or any((x := x * x % n) == n - 1 for _ in range(twos - 1))


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Integer coefficients, constant first, of a symmetric matrix without negative eigenvalues."""
    size, trace = len(matrix), int(np.trace(matrix))
    # elementary symmetric functions are largest where all eigenvalues are equal
    bound = max(math.comb(size, k) * trace**k // size**k for k in range(size + 1)) + 1
    primes = primes_below(1 << 31, 2 * bound)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"prime": part["prime"], "found": [polynomial_modulo(matrix, int(p)) for p in part["prime"]]})

    table = spark.createDataFrame([(p,) for p in primes], "prime long")
    table = table.repartition(min(len(primes), spark.sparkContext.defaultParallelism), "prime")
    rows = table.mapInPandas(run, "prime long, found array<long>").collect()
    product = math.prod(primes)
    total = [0] * (size + 1)
    for row in rows:
        others = product // row.prime
        unit = others * pow(others, -1, row.prime)
        total = [t + unit * c for t, c in zip(total, row.found)]
    total = [t % product for t in total]
    return [t - product if 2 * t > product else t for t in total]


def _shifted(coefficients: list[int], bits: int) -> list[int]:
    """Coefficients of p(x + 2**bits)."""
    out = list(coefficients)
    for i in range(len(out) - 1):
        for j in range(len(out) - 2, i - 1, -1):
            out[j] += out[j + 1] << bits
    return out


def _changes(coefficients: list[int]) -> int:
    signs = [c > 0 for c in coefficients if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(coefficients: list[int], most: int, bits: int = ROOT_BITS) -> list[Fraction]:
    """The greatest positive roots, falling, repeated ones as often as they occur.

    All roots must be real and none negative. Each is within 2**-bits of its size below the true one.
    """
    degree = len(coefficients) - 1
    positive = degree - next(i for i, c in enumerate(coefficients) if c)
    # no root exceeds the sum of all
    top = max(1, -coefficients[-2]).bit_length() if degree else 0
    roots: list[Fraction] = []
    for rank in range(1, min(most, positive) + 1):
        scale = bits
        while True:
            shifted = [c << scale * (degree - i) for i, c in enumerate(coefficients)]
            whole = 0
            for bit in range(top + scale, -1, -1):
                beyond = _shifted(shifted, bit)
                if _changes(beyond) >= rank:
                    shifted, whole = beyond, whole + (1 << bit)
                if whole and bit < whole.bit_length() - bits:
                    break
            if whole.bit_length() >= min(bits, 32):
                break
            scale *= 2
        roots.append(Fraction(whole, 1 << scale))
    return roots


def _fixed(value: Fraction, bits: int) -> int:
    return (value.numerator << bits) // value.denominator


def null_vector(matrix: np.ndarray, root: Fraction, apart: list[np.ndarray], bits: int) -> np.ndarray:
    """The unit vector v of (matrix - root) v = 0, orthogonal to `apart`, as integers times 2**bits."""
    size = len(matrix)
    a = matrix << bits
    a[np.diag_indices(size)] -= _fixed(root, bits)
    order, factors = np.arange(size), np.zeros((size, size), object)
    for k in range(size):
        pivot = k + int(np.argmax(np.abs(a[k:, k])))
        if pivot != k:
            for rows in (a, factors, order):
                rows[[k, pivot]] = rows[[pivot, k]]
        if a[k, k] == 0:
            a[k, k] = 1
        factors[k + 1 :, k] = (a[k + 1 :, k] << bits) // a[k, k]
        a[k + 1 :, k:] -= (factors[k + 1 :, k, None] * a[k, k:]) >> bits
    v = (blocks.counted_hashes(size, 31 + len(apart)) >> np.uint64(32)).astype(object) << bits
    for _ in range(4):
        v = v[order]
        for k in range(size):
            v[k + 1 :] -= (factors[k + 1 :, k] * v[k]) >> bits
        for k in range(size - 1, -1, -1):
            v[k] = (int(v[k] - (sum((a[k, k + 1 :] * v[k + 1 :]).tolist()) >> bits)) << bits) // a[k, k]
        # the solution is huge along the null vector: bring it back to unit length
        for _ in range(2):
            length = math.isqrt(sum((v * v).tolist()))
            v = (v << bits) // max(1, length)
            for u in apart:
                v = v - ((u * (sum((u * v).tolist()) >> bits)) >> bits)
    return v


def components(spark: SparkSession, fit: DataFrame, size: int, most: int) -> Components:
    n, sums, matrix = scatter(fit, size)
    trace = int(np.trace(matrix)) if n else 0
    if not trace:
        return Components(n, sums, np.zeros((0, size)), [], [])
    roots = largest_roots(characteristic_polynomial(spark, matrix), most)
    bits = 2 * ROOT_BITS + max(0, -min(r.numerator.bit_length() - r.denominator.bit_length() for r in roots))
    vectors: list[np.ndarray] = []
    for i, root in enumerate(roots):
        same = [v for v, r in zip(vectors, roots) if r == root]
        vectors.append(null_vector(matrix, root, same, bits))
    # doubles of the fixed-point entries; the largest entry of each component is positive
    rows = [np.array([float(Fraction(int(x), 1 << bits)) for x in v]) for v in vectors]
    rows = [v / np.linalg.norm(v) * np.sign(v[np.argmax(np.abs(v))]) for v in rows]
    return Components(n, sums, np.array(rows), roots, [float(r / trace) for r in roots])


def _deviations(x: np.ndarray, fitted: Components) -> np.ndarray:
    """n * x - S, as 64-bit integers where they fit."""
    most = max((abs(int(s)) for s in fitted.sums), default=0)
    if fitted.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + most < 1 << 62:
        return x * fitted.n - fitted.sums.astype(np.int64)
    return x.astype(object) * fitted.n - fitted.sums


def _whitened(deviations: np.ndarray, fitted: Components) -> np.ndarray:
    lengths = np.array([math.sqrt(r) if r < 1 << 1000 else float(math.isqrt(int(r))) for r in fitted.roots])
    return deviations.astype(np.float64) @ fitted.vectors.T / lengths


def _square_sums(deviations: np.ndarray) -> list[int | None]:
    most = max(abs(int(deviations.max(initial=0))), abs(int(deviations.min(initial=0))))
    if most * most * deviations.shape[1] < 1 << 63:
        return (deviations * deviations).sum(axis=1).tolist()
    wide = deviations.astype(object)
    return [v if v < 1 << 63 else None for v in (wide * wide).sum(axis=1).tolist()]


def _moments(fitted: Components):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            w = _whitened(_deviations(_matrix(batch.column("x"), len(fitted.sums)), fitted), fitted)
            mean = w.mean(axis=0)
            about = (w - mean).T @ (w - mean)
            values = [*(mean * len(w)), *about.ravel(), *(np.outer(mean, mean) * len(w)).ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values, pa.float64())], names=["at", "value"])

    return run


def identity_error(fit: DataFrame, fitted: Components) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    k = len(fitted.roots)
    rows = fit.mapInArrow(_moments(fitted), "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    values = np.zeros(k + 2 * k * k)
    for row in rows:
        values[row["at"]] = row["value"]
    sums, within, between = values[:k], values[k : k + k * k].reshape(k, k), values[k + k * k :].reshape(k, k)
    covariance = (within + between - np.outer(sums, sums) / fitted.n) / fitted.n
    return float(np.abs(covariance - np.eye(k)).max())


def _rows(fitted: Components, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(fitted.roots)
        for batch in batches:
            deviations = _deviations(_matrix(batch.column("x"), len(fitted.sums)), fitted)
            each = np.repeat(np.arange(batch.num_rows), k)
            rows = len(each)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1), batch.num_rows), pa.int32()),
                    pa.array(np.full(rows, fitted.n), pa.int64()),
                    pa.array(_square_sums(deviations), pa.int64()).take(pa.array(each)),
                    pa.array(_whitened(deviations, fitted).ravel()),
                    pa.array(np.tile(fitted.explained, batch.num_rows), pa.float64()),
                    pa.array(np.full(rows, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whitened(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """A row for every usable vector and component; see the module's text."""
    spark = embeddings.sparkSession
    usable = write_and_read(blocks.narrowed(embeddings, "vec_id", "embedding").mapInArrow(_usable, _USABLE), "usable-vectors")
    sizes = usable.where("size > 0").groupBy("size").count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return spark.createDataFrame([], _OUT)
    usable = usable.where(F.col("size") == sizes["size"])
    fit = write_and_read(usable.select("x").distinct(), "fit-list")
    fitted = components(spark, fit, sizes["size"], most)
    if not fitted.roots:
        return spark.createDataFrame([], _OUT)
    return usable.mapInArrow(_rows(fitted, identity_error(fit, fitted)), _OUT)
