"""Whitening of embeddings through an exact characteristic polynomial.

Vectors become whole numbers, so the scatter matrix of the distinct ones is
exact. Its characteristic polynomial comes from Hessenberg reductions modulo
many primes (dealt over tasks) and the Chinese remainder theorem. All its roots
are real, so the sign changes of the shifted polynomial count the roots above
any point exactly: the largest ones are isolated by that count and refined to
far more bits than a double has. Components are null vectors of the scatter
less its root, by fixed-point elimination and inverse iteration (a task for
each root). Rows are projected in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import materialize

#: Entries are kept in steps of 1 / SCALE, moved by OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Scaled entries of this size or more are an error: doubles of that size have no steps of 1.
LARGEST = 2**52
#: Most components of a row.
COMPONENTS = 16
#: Bits to which roots and null vectors are refined beyond the scatter's own size.
BITS = 128
#: Primes of one task, and their size: products of two residues fit a 64-bit word.
PRIMES_A_TASK, PRIME_BITS = 16, 31


# ---------------------------------------------------------------- vectors
def whole_vectors(vectors: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, x): the usable rows. x holds floor(scale * c) + offset of each entry c as a double.

    Rows go whose vector is null, empty, or holds null or non-finite entries;
    so do rows of another length than most rows have (of equally frequent
    lengths the longest), whose other entries are missing.
    """
    value = F.col("embedding")
    finite = F.forall(value, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    usable = vectors.select("vec_id", "embedding").filter(value.isNotNull() & (F.size(value) > 0) & finite)
    lengths = usable.groupBy(F.size(value).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    usable = usable.filter(F.size(value) == (lengths["d"] if lengths else 0))

    def step(c: Column) -> Column:
        scaled = F.floor(c.cast("double") * scale)
        return F.when(F.abs(c.cast("double")) * scale < float(LARGEST), scaled.cast("long") + offset).otherwise(F.raise_error(F.lit("an entry is too large to be kept as a whole number")))

    return usable.select("vec_id", F.transform("embedding", step).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(rows: DataFrame, of: str, kind: str) -> list:
    """Sums by place over ``rows`` (array column v): added up in tasks before the shuffle; as many sums come back as the array is long."""
    places = rows.select(F.posexplode("v").alias("i", "y")).groupBy("i").agg(F.sum(F.col("y").cast(kind)).alias(of))
    return [r[of] for r in places.orderBy("i").collect()]


def _total(x: np.ndarray) -> list[str]:
    """Sums of columns in whole numbers, as text: high and low halves are summed apart, so none overflows."""
    high, low = x >> 32, x & 0xFFFFFFFF
    return [str((int(h) << 32) + int(v)) for h, v in zip(high.sum(axis=0), low.sum(axis=0), strict=True)]


def _products(y: np.ndarray) -> np.ndarray:
    """y'y in whole numbers: in doubles where no sum passes 2^53, else in Python's integers."""
    top = int(np.abs(y).max(initial=0))
    if top * top * max(1, len(y)) < 2**53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    big = y.astype(object)
    return big.T @ big


@dataclass(frozen=True)
class Scatter:
    """n distinct vectors: sums S by dimension, and the exact scatter n * sum(x x') - S S', n squared times their covariance."""

    n: int
    sums: list[int]
    matrix: list[list[int]]

    @property
    def centre(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """S - n * centre: at least 0, less than n."""
        return np.array([s % self.n for s in self.sums], np.int64)


def scatter(fit: DataFrame) -> Scatter:
    """The exact scatter of distinct vectors (column x). Products are of differences from the floor of the mean."""
    n = fit.count()
    if not n:
        return Scatter(0, [], [])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([_total(_matrix(batch.column(0)))], pa.list_(pa.string()))], names=["v"])

    sums = [int(s) for s in _summed(fit.select("x").mapInArrow(totals, "v array<string>"), "s", "decimal(38,0)")]
    centre = np.array([s // n for s in sums], np.int64)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                y = _matrix(batch.column(0)) - centre
                total = _products(y).astype(object) if total is None else total + _products(y)
        if total is not None:
            upper = total[np.triu_indices(len(centre))].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([[str(v) for v in upper]], pa.list_(pa.string()))], names=["v"])

    upper = [int(v) for v in _summed(fit.select("x").mapInArrow(products, "v array<string>"), "s", "decimal(38,0)")]
    d, rest = len(sums), [s % n for s in sums]
    matrix = [[0] * d for _ in range(d)]
    for (i, j), v in zip(zip(*np.triu_indices(d), strict=True), upper, strict=True):
        matrix[i][j] = matrix[j][i] = n * v - rest[i] * rest[j]
    return Scatter(n, sums, matrix)


# ---------------------------------------------------------------- the polynomial
def _is_prime(n: int) -> bool:
    """Miller-Rabin for odd numbers above 61; these bases decide every number below 4.7e9."""
    twos = (n - 1 & 1 - n).bit_length() - 1
    for base in (2, 7, 61):
        x = pow(base, n - 1 >> twos, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(bits: int) -> list[int]:
    """Primes below 2^31, largest first, whose product passes ``bits`` bits."""
    out, have, n = [], 0.0, 2**PRIME_BITS - 1
    while have <= bits:
        if _is_prime(n):
            out.append(n)
            have += np.log2(n) - 1e-9
        n -= 2
    return out


def polynomial_mod(residues: np.ndarray, prime: int) -> np.ndarray:
    """Coefficients, highest first, of det(x - A) modulo ``prime``, by similarity to an upper Hessenberg matrix."""
    a, p = residues.astype(np.int64) % prime, prime
    d = len(a)
    for j in range(d - 2):
        below = np.flatnonzero(a[j + 1 :, j])
        if not len(below):
            continue
        i = j + 1 + int(below[0])
        if i != j + 1:
            a[[i, j + 1]] = a[[j + 1, i]]
            a[:, [i, j + 1]] = a[:, [j + 1, i]]
        u = a[j + 2 :, j] * pow(int(a[j + 1, j]), -1, p) % p
        a[j + 2 :] = (a[j + 2 :] - u[:, None] * a[j + 1][None] % p) % p
        a[:, j + 1] = (a[:, j + 1] + (a[:, j + 2 :] * u[None] % p).sum(axis=1)) % p
    polys = [np.array([1], np.int64)]  # of the leading blocks, lowest coefficient first
    for k in range(d):
        new = np.zeros(k + 2, np.int64)
        new[1:] = polys[k]
        new[:-1] = (new[:-1] - polys[k] * a[k, k]) % p
        t = 1
        for i in range(k - 1, -1, -1):
            t = t * int(a[i + 1, i]) % p
            if not t:
                break
            new[: i + 1] = (new[: i + 1] - polys[i] * (t * int(a[i, k]) % p)) % p
        polys.append(new)
    return polys[d][::-1] % p


def characteristic(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients, highest first, of det(x - M) of a positive semidefinite whole matrix.

    Each coefficient is a sum of products of roots, so the mean of the roots
    bounds it; primes are dealt over tasks, only residues come back.
    """
    d = len(matrix)
    mean = -(-sum(matrix[i][i] for i in range(d)) // d) + 1
    primes = primes_for(d * (mean.bit_length() + 1) + 2)  # C(d, k) * mean^k is at most (2 * mean)^d; one bit for the sign

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"prime": pdf["prime"], "c": [polynomial_mod(np.array([[v % p for v in row] for row in matrix], np.int64), p).tolist() for p in pdf["prime"].tolist()]})

    tasks = max(1, -(-len(primes) // PRIMES_A_TASK))
    found = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(tasks).mapInPandas(reduce, "prime long, c array<long>").collect()
    product, total = 1, [0] * (d + 1)
    for p, coefficients in found:
        inverse = pow(product, -1, p)
        total = [t + product * ((c - t) * inverse % p) for t, c in zip(total, coefficients, strict=True)]
        product *= p
    return [t - product if 2 * t > product else t for t in total]


# ---------------------------------------------------------------- roots
def _scaled(poly: list[int], shift: int) -> list[int]:
    """The polynomial whose roots are 2^shift times those of ``poly``."""
    return [c << (shift * i) for i, c in enumerate(poly)]


def roots_above(poly: list[int], at: int) -> int:
    """Roots greater than ``at``, repeats counted: the sign changes of the shifted polynomial, exact as all roots are real."""
    c = list(poly)
    for end in range(len(c), 1, -1):
        for i in range(1, end):
            c[i] += at * c[i - 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _value(poly: list[int], at: int) -> int:
    v = 0
    for c in poly:
        v = v * at + c
    return v


def _narrowed(poly: list[int], low: int, high: int) -> int:
    """The end of the unit step in which the only root in (low, high] lies, a simple one: sign changes lead to it."""
    sign = _value(poly, high)
    if not sign:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        v = _value(poly, mid)
        if not v:
            return mid
        low, high = (low, mid) if (v > 0) == (sign > 0) else (mid, high)
    return high


def largest_roots(poly: list[int], most: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(root in units of 2^-bits, its multiplicity), falling, of the largest positive roots until ``most`` are counted.

    No root may be negative. Roots that a stretch of 2^-bits still holds together count as one repeated root.
    """
    while len(poly) > 1 and poly[-1] == 0:  # roots at zero
        poly = poly[:-1]
    if len(poly) == 1:
        return []
    scaled = {0: poly, bits: _scaled(poly, bits)}
    found: list[tuple[int, int]] = []
    have = 0
    waiting = [(0, 1 << abs(poly[1]).bit_length(), len(poly) - 1, 0)]  # low, high, roots in (low, high], bits of the unit; the second coefficient is the roots' sum
    while waiting and have < most:
        low, high, count, unit = waiting.pop()
        if unit == bits and (count == 1 or high - low == 1):
            found.append((_narrowed(scaled[bits], low, high) if count == 1 else high, count))
            have += count
        elif unit == 0 and (count == 1 or high - low == 1):
            waiting.append((low << bits, high << bits, count, bits))
        else:
            mid = (low + high) // 2
            above = roots_above(scaled[unit], mid) - have  # all larger roots have been found
            waiting += [(low, mid, count - above, unit)] * (count > above) + [(mid, high, above, unit)] * (above > 0)
    return found


# ---------------------------------------------------------------- components
def null_vectors(matrix: list[list[int]], root: int, multiplicity: int, bits: int) -> list[list[float]]:
    """Unit vectors, as many as the root repeats, that the symmetric matrix less root * 2^-bits sends to about nothing.

    Elimination with complete pivoting in fixed point leaves a last block of
    about nothing, of the size of the multiplicity. It counts as the smallest
    step, so each of two solutions of inverse iteration enlarges the null
    space by 2^bits against all else. The vectors are made orthogonal in fixed
    point: a double's precision stays whole while roots differ by 2^-60 of the largest.
    """
    d, rank, one = len(matrix), len(matrix) - multiplicity, 1 << bits
    m = np.array([[(v << bits) - root * (i == j) for j, v in enumerate(row)] for i, row in enumerate(matrix)], dtype=object)
    lower, rows, columns = np.zeros((d, d), dtype=object), np.arange(d), np.arange(d)
    for k in range(rank):
        i, j = (k + v for v in divmod(int(np.abs(m[k:, k:]).argmax()), d - k))
        for by_row in (m, lower, rows):
            by_row[[k, i]] = by_row[[i, k]]
        m[:, [k, j]] = m[:, [j, k]]
        columns[[k, j]] = columns[[j, k]]
        lower[k + 1 :, k] = [(int(v) << bits) // m[k, k] for v in m[k + 1 :, k]]
        m[k + 1 :, k:] -= (lower[k + 1 :, k, None] * m[k, k:]) >> bits

    def solved(right: np.ndarray) -> np.ndarray:
        """A unit vector along the solution; ``right`` is in the order of ``rows``."""
        b = right.copy()
        for k in range(rank):
            b[k + 1 :] -= (lower[k + 1 :, k] * b[k]) >> bits
        x = np.zeros(d, dtype=object)
        x[rank:] = b[rank:] << bits
        for k in range(rank - 1, -1, -1):
            x[k] = ((b[k] << bits) - (m[k, k + 1 :] * x[k + 1 :]).sum()) // m[k, k]
        out = np.zeros(d, dtype=object)
        out[columns] = x
        return unit(out)

    def unit(v: np.ndarray) -> np.ndarray:
        return (v << bits) // isqrt(int((v * v).sum()))

    basis: list[np.ndarray] = []
    for f in range(multiplicity):
        start = np.array([one * (q == rank + f) for q in range(d)], dtype=object)
        v = solved(solved(start)[rows])
        for other in basis * 2:
            v = v - ((int((v * other).sum()) >> bits) * other >> bits)
        basis.append(unit(v))
    return [[int(c) * (1 if max(v, key=abs) > 0 else -1) / one for c in v] for v in basis]


@dataclass(frozen=True)
class Components:
    """Eigenvalues of the covariance, falling, their unit vectors, and each one's share of the trace."""

    values: list[float]
    vectors: list[list[float]]
    explained: list[float]


def components(spark: SparkSession, found: Scatter, most: int = COMPONENTS, bits: int = BITS) -> Components:
    """The ``most`` largest components with a positive eigenvalue (fewer where the vectors span fewer dimensions)."""
    trace = sum(found.matrix[i][i] for i in range(len(found.matrix)))
    if not trace:
        return Components([], [], [])
    roots = largest_roots(characteristic(spark, found.matrix), most, bits)
    matrix = found.matrix

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(i, v) for i, root, m in zip(pdf["i"], pdf["root"], pdf["m"], strict=True) for v in null_vectors(matrix, int(root), int(m), bits)], columns=["i", "v"])

    dealt = spark.createDataFrame([(i, str(root), m) for i, (root, m) in enumerate(roots)], "i int, root string, m int").repartition(len(roots), "i")
    by_root: dict[int, list[list[float]]] = {}
    for i, v in dealt.mapInPandas(vectors, "i int, v array<double>").collect():
        by_root.setdefault(i, []).append(v)
    values, out, explained = [], [], []
    for i, (root, _) in enumerate(roots):
        for v in by_root[i]:
            values.append(root / (found.n**2 << bits))
            out.append(v)
            explained.append(root / (trace << bits))
    return Components(values[:most], out[:most], explained[:most])


# ---------------------------------------------------------------- the operator
def _projected(rows: DataFrame, found: Scatter, parts: Components, keep: list[str]) -> DataFrame:
    """``keep``, z (whitened components), q and m: with y = x - centre and r = rest, sum of y squared and of y * r, as text."""
    centre, rest = found.centre, found.rest
    towards = np.array(parts.vectors).T.reshape(len(centre), -1) / np.sqrt(np.array(parts.values))
    shift = rest.astype(np.float64) / found.n

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = _matrix(batch.column(batch.num_columns - 1)) - centre
            z = (y - shift) @ towards
            small = int(np.abs(y).max(initial=0)) * y.shape[1] * max(found.n, int(np.abs(y).max(initial=0))) < 2**62
            w = y if small else y.astype(object)
            q, m = (w * w).sum(axis=1), (w * (rest if small else rest.astype(object))).sum(axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists, pa.array([str(v) for v in q]), pa.array([str(v) for v in m])], names=[*keep, "z", "q", "m"])

    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.select(*keep, "x").mapInArrow(project, f"{kinds}z array<double>, q string, m string")


def identity_error(fit: DataFrame, found: Scatter, parts: Components) -> float:
    """Largest entry of the whitened fit list's covariance, as measured, minus the identity."""
    k = len(parts.values)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, square = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                z = _matrix(batch.column(0))
                n, mean, square = n + len(z), mean + z.sum(axis=0), square + z.T @ z
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([[*mean.tolist(), *square.ravel().tolist()]], pa.list_(pa.float64()))], names=["v"])

    # Whitened values are differences from the mean already, so sums and products of what is left lose nothing.
    total = _summed(_projected(fit, found, parts, []).select("z").mapInArrow(products, "v array<double>"), "s", "double")
    mean, square = np.array(total[:k]) / found.n, np.array(total[k:]).reshape(k, k) / found.n
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, most: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET, bits: int = BITS) -> DataFrame:
    """One row for each usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    n counts the distinct vectors, deviation is the exact sum over dimensions
    of (n * x - S) squared (a decimal), whitened the centred vector's
    projection over the root of the eigenvalue. Rows that ``whole_vectors``
    leaves out have no result; repeated rows and ids each have their own;
    where all vectors are equal, or none is usable, there is no component and
    no row. An entry of 2^52 or more once scaled is an error.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, scale, offset)
    fit = materialize(rows.select("x").distinct())
    found = scatter(fit)
    parts = components(spark, found, most, bits) if found.n else Components([], [], [])
    names = "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    if not parts.values:
        kinds = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        none = spark.createDataFrame([], f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, {kinds}")
        return none.select(*names)
    error = identity_error(fit, found, parts)
    big = lambda v: F.lit(str(v)).cast("decimal(38,0)")
    fixed = sum(int(r) ** 2 for r in found.rest)
    exact: Column = (big(found.n**2) * F.col("q").cast("decimal(38,0)")).cast("decimal(38,0)") - (big(2 * found.n) * F.col("m").cast("decimal(38,0)")).cast("decimal(38,0)") + big(fixed)
    shares = F.array(*[F.lit(e) for e in parts.explained])
    out = _projected(rows, found, parts, ["vec_id"]).select("vec_id", exact.cast("decimal(38,0)").alias("deviation"), F.posexplode("z").alias("i", "whitened"))
    return out.select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(shares, F.col("i") + 1).alias("explained"), F.lit(error).alias("identity_error")
    )
