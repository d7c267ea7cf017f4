"""Embedding whitening through the exact characteristic polynomial of the scatter matrix.

Entries become whole numbers x = floor(64 * c) + 1000000. The fit list holds each distinct x vector
once; with n vectors and their sums S, the integer matrix A = n * sum(x x') - S S' is n * n times their
covariance, whatever number is taken off every x first. Tasks add up the fit list's products as exact
whole numbers, and what reaches the driver is one number for each two dimensions.

The characteristic polynomial of A is found modulo primes, a Spark row each, by reduction to Hessenberg
form, and put together by Chinese remaindering. All roots are real, so the changes of sign of the polynomial
moved by ``a`` count the roots above ``a`` exactly, repeated ones included. Bisection by these counts
isolates the largest roots and the sign of the polynomial refines each alone. Components come from
inverse iteration on A minus the root, in fixed point of several hundred bits; vectors of roots too
close to tell apart are made orthogonal to each other.

Null vectors and those with null, NaN or infinite entries are dropped, and so are those with an
entry beyond 2^40 / 64, where products outgrow the exact sums, and those of another length than the
most common one (of equally common ones, the longest). Repeated rows and null ids: a result each.
Components of eigenvalue 0 (fewer distinct vectors than dimensions, constant dimensions) have no
whitened value and are left out; with less than two distinct vectors nothing is left. ``deviation`` is
null where it exceeds 64 bits. Vectors are as long as their dimension, so there are no long texts to
bound; the driver holds matrices of dimension squared. Empty table: no rows. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walletlens.session import materialize

SCALE, OFFSET = 64.0, 1_000_000
#: Largest size of 64 * c, so that sums of products of 10^12 vectors fit into 38 digits.
MOST = float(1 << 40)
COMPONENTS = 16
#: Bits of a limb. Products of limbs of ``CHUNK`` rows add up below 2^53.
LIMB_BITS, CHUNK = 16, 1 << 20
#: Bits behind the point of a root, beyond those of the matrix's trace.
ROOT_BITS = 128
#: Roots nearer than this share of the trace belong to one cluster, whose vectors are made orthogonal.
CLUSTER_BITS = 64

_SUMS = "i int, j int, part decimal(38,0)"
_RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


# --- whole numbers ----------------------------------------------------------------------------


def integer_vectors(embeddings: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, y) with y = x - 1000000, for the rows that are kept whatever their length is."""
    rows = embeddings.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("c"))
    fits = F.forall("c", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c * SCALE) <= MOST), F.lit(False)))
    rows = rows.filter(F.col("c").isNotNull() & fits)
    return rows.select("vec_id", F.transform("c", lambda c: F.floor(c * SCALE)).alias("y"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """Parts of 16 bits with a sign, lowest first, whose weighted sum is ``y``."""
    half, parts = 1 << (LIMB_BITS - 1), []
    while True:
        low = ((y + half) & ((1 << LIMB_BITS) - 1)) - half
        parts.append(low.astype(np.float64))
        y = (y - low) >> LIMB_BITS
        if not y.any():
            return parts


def _products(y: np.ndarray) -> np.ndarray:
    """The exact sum of y y' over the rows, as Python's whole numbers."""
    parts = _limbs(y)
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for a, left in enumerate(parts):
        for b, right in enumerate(parts):
            total += (left.T @ right).astype(np.int64).astype(object) << (LIMB_BITS * (a + b))
    return total


def _task_sums(size: int):
    """Sums of products (i <= j), of entries (i, -1) and the number of rows (-1, -1) of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums, count = np.zeros((size, size), object), np.zeros(size, object), 0
        for batch in batches:
            for first in range(0, batch.num_rows, CHUNK):
                y = _matrix(batch.column(0).slice(first, CHUNK), size)
                products += _products(y)
                sums += y.sum(axis=0).astype(object)
                count += len(y)
        if count:
            rows = [(i, j, products[i, j]) for i in range(size) for j in range(i, size)]
            rows += [(i, -1, sums[i]) for i in range(size)] + [(-1, -1, count)]
            i, j, part = zip(*rows, strict=True)
            values = pa.array([Decimal(int(x)) for x in part], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), values], ["i", "j", "part"])

    return run


def scatter(fit: DataFrame, size: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums of each dimension, and n * sum(y y') - S S', all exact."""
    rows = fit.select("y").mapInArrow(_task_sums(size), _SUMS).groupBy("i", "j").agg(F.sum("part").alias("part"))
    found = {(row.i, row.j): int(row.part) for row in rows.collect()}  # a row for each two dimensions
    n = found.get((-1, -1), 0)
    sums = [found.get((i, -1), 0) for i in range(size)]
    both = [[found.get((min(i, j), max(i, j)), 0) for j in range(size)] for i in range(size)]
    return n, sums, [[n * both[i][j] - sums[i] * sums[j] for j in range(size)] for i in range(size)]


# --- the characteristic polynomial ------------------------------------------------------------


def _is_prime(number: int) -> bool:
    """Miller's test with the bases that decide all numbers below 3.4e14."""
    if number % 2 == 0:
        return number == 2
    odd, twos = number - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7, 11, 13, 17):
        x = pow(base, odd, number)
        if x not in (0, 1, number - 1) and all((x := x * x % number) != number - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_below(top: int, bits: float) -> list[int]:
    """The largest primes below ``top``, until their product has ``bits`` bits."""
    out, have, number = [], 0.0, top - 1
    while have < bits:
        if _is_prime(number):
            out.append(number)
            have += math.log2(number)
        number -= 2 if number % 2 else 1
    return out


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """det(t - matrix) modulo the prime p < 2^31, lowest coefficient first, through its Hessenberg form."""
    h = matrix % p
    size = len(h)
    for k in range(size - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            h[[pivot, k + 1]] = h[[k + 1, pivot]]
            h[:, [pivot, k + 1]] = h[:, [k + 1, pivot]]
        factor = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factor[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factor % p).sum(axis=1)) % p
    leading = np.zeros((size + 1, size + 1), np.int64)  # row k: polynomial of the first k rows and columns
    leading[0, 0] = 1
    for k in range(1, size + 1):
        row = np.zeros(size + 1, np.int64)
        row[1:] = leading[k - 1, :-1]
        row = (row - h[k - 1, k - 1] * leading[k - 1]) % p
        chain = 1
        for i in range(k - 1, 0, -1):
            chain = chain * int(h[i, i - 1]) % p
            if not chain:
                break
            row = (row - (chain * int(h[i - 1, k - 1]) % p) * leading[i - 1]) % p
        leading[k] = row
    return leading[size]


def _residues(matrix):
    """The polynomial modulo each prime of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array([[int(x) for x in row] for row in matrix.value], object)
        for batch in batches:
            primes = batch.column(0).to_pylist()
            rows = [polynomial_mod((whole % p).astype(np.int64), p) for p in primes]
            yield pa.RecordBatch.from_arrays(
                [pa.array(primes, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], ["p", "residues"]
            )

    return run


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(t - matrix), lowest first, for a matrix without negative eigenvalues.

    The k-th elementary symmetric sum of d such eigenvalues is at most binomial(d, k) * (trace / d)^k.
    """
    size = len(matrix)
    mean = max(1.0, sum(matrix[i][i] for i in range(size)) / size)
    bits = max(math.log2(math.comb(size, k)) + k * math.log2(mean) for k in range(size + 1)) + 8
    primes = primes_below(1 << 31, bits)
    shared = spark.sparkContext.broadcast([[str(x) for x in row] for row in matrix])
    tasks = min(len(primes), max(1, spark.sparkContext.defaultParallelism))
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks)
    found = {row.p: row.residues for row in rows.mapInArrow(_residues(shared), "p long, residues array<long>").collect()}
    shared.destroy()
    product = math.prod(primes)
    parts = [(p, product // p * pow(product // p, -1, p)) for p in primes]
    coefficients = [sum(found[p][k] * part for p, part in parts) % product for k in range(size + 1)]
    return [c - product if c > product // 2 else c for c in coefficients]


# --- roots and components ---------------------------------------------------------------------


def roots_above(polynomial: list[int], a: int) -> int:
    """How many roots exceed ``a``, repeated ones included; the polynomial has real roots only.

    Descartes' rule is exact for such polynomials: the changes of sign after moving it by ``a``.
    """
    moved = list(polynomial)
    if a:
        for k in range(len(moved) - 1):
            for i in range(len(moved) - 2, k - 1, -1):
                moved[i] += a * moved[i + 1]
    signs = [c > 0 for c in moved if c]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def _value(polynomial: list[int], a: int) -> int:
    total = 0
    for c in reversed(polynomial):
        total = total * a + c
    return total


def largest_roots(polynomial: list[int], trace: int, most: int) -> tuple[list[int], int]:
    """The largest positive roots, falling and repeated as often as they occur, and the bits behind their point.

    A root is the upper end of an interval of width 1 in that scale.
    """
    size = len(polynomial) - 1
    top = trace.bit_length() + 1
    bits = max(0, ROOT_BITS - top)
    scaled = [c << (bits * (size - k)) for k, c in enumerate(polynomial)]
    found: list[int] = []
    # Intervals (low, high] with the number of roots above either end, the highest on top.
    open_parts = [(0, 1 << (top + bits), roots_above(polynomial, 0), 0)]
    while open_parts and len(found) < most:
        low, high, over_low, over_high = open_parts.pop()
        count = over_low - over_high
        if not count:
            continue
        if count == 1:
            below = _value(scaled, low)
            while high - low > 1:
                middle = (low + high) // 2
                if below:
                    at = _value(scaled, middle)
                    beyond = at != 0 and (at > 0) == (below > 0)
                else:  # the next root lies on the lower end
                    beyond = roots_above(scaled, middle) > over_high
                low, high = (middle, high) if beyond else (low, middle)
            found.append(high)
        elif high - low == 1:
            found += [high] * count
        else:
            middle = (low + high) // 2
            over_middle = roots_above(scaled, middle)
            open_parts.append((low, middle, over_low, over_middle))
            open_parts.append((middle, high, over_middle, over_high))
    return found[:most], bits


def _solve(matrix: np.ndarray, right: np.ndarray, bits: int, tiny: int) -> np.ndarray:
    """matrix x = right in fixed point, by elimination with the largest pivots; a zero pivot counts as ``tiny``."""
    m = np.concatenate([matrix, right[:, None]], axis=1)
    size = len(m)
    for k in range(size):
        pivot = k + max(range(size - k), key=lambda i: abs(m[k + i, k]))
        if pivot != k:
            m[[k, pivot]] = m[[pivot, k]]
        if abs(m[k, k]) < tiny:
            m[k, k] = tiny
        factor = (m[k + 1 :, k] << bits) // m[k, k]
        m[k + 1 :, k:] -= (factor[:, None] * m[k, k:]) >> bits
    x = np.zeros(size, object)
    for k in range(size - 1, -1, -1):
        rest = m[k, size] - (int((m[k, k + 1 : size] * x[k + 1 :]).sum()) >> bits if k + 1 < size else 0)
        x[k] = (rest << bits) // m[k, k]
    return x


def _unit(x: np.ndarray, bits: int) -> np.ndarray:
    length = math.isqrt(int((x * x).sum()))
    return (x << bits) // max(1, length)


def components(matrix: list[list[int]], roots: list[int], root_bits: int) -> np.ndarray:
    """Unit eigenvectors, a row per root, as doubles. Equal roots get orthogonal vectors of their space."""
    size = len(matrix)
    trace = max(1, sum(matrix[i][i] for i in range(size)))
    # Relative to the trace the matrix is at most 1; a root is known to about 2^-ROOT_BITS of it.
    bits = 3 * ROOT_BITS
    whole = np.array([[(x << bits) // trace for x in row] for row in matrix], object)
    close = max(1, (trace << root_bits) >> CLUSTER_BITS)
    start = np.random.default_rng(13).integers(1, 1 << 30, (len(roots), size))
    out: list[np.ndarray] = []
    cluster: list[int] = []
    for k, root in enumerate(roots):
        cluster = [*cluster, k - 1] if k and roots[k - 1] - root <= close else []
        shift = ((root << bits) // trace) >> root_bits
        moved = whole - np.diag(np.full(size, shift, object))
        x = _unit(start[k].astype(object) << (bits - 30), bits)
        for _ in range(2):
            x = _unit(_solve(moved, x, bits, 1 << ROOT_BITS), bits)
            for other in cluster:
                x = x - ((int((x * out[other]).sum()) >> bits) * out[other] >> bits)
            x = _unit(x, bits)
        out.append(x)
    return np.array([[int(v) / (1 << bits) for v in x] for x in out], np.float64).reshape(len(out), size)


# --- the whitened rows ------------------------------------------------------------------------


def _whitened(y: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    return (y - mean) @ projection.T


def _spread(size: int, mean: np.ndarray, projection: np.ndarray):
    """Sums over a task of whitened values and of their products, as decimals, which add up alike in any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = len(projection)
        products, sums = np.zeros((count, count)), np.zeros(count)
        for batch in batches:
            z = _whitened(_matrix(batch.column(0), size), mean, projection)
            products += z.T @ z
            sums += z.sum(axis=0)
        rows = [(i, j, products[i, j]) for i in range(count) for j in range(i, count)]
        rows += [(i, -1, sums[i]) for i in range(count)]
        i, j, part = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(part)], ["i", "j", "part"])

    return run


def _identity_error(fit: DataFrame, size: int, n: int, mean: np.ndarray, projection: np.ndarray) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity, as measured."""
    parts = fit.select("y").mapInArrow(_spread(size, mean, projection), "i int, j int, part double")
    total = F.sum(F.col("part").cast("decimal(38,14)")).cast("double")
    rows = parts.groupBy("i", "j").agg(total.alias("part")).collect()  # a row for each two components
    found = {(row.i, row.j): row.part for row in rows}
    count = len(projection)
    centre = [found[i, -1] / n for i in range(count)]
    return max(
        abs(found[i, j] / n - centre[i] * centre[j] - (i == j)) for i in range(count) for j in range(i, count)
    )


def _deviations(y: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Per row the sum of (n * y - S)^2, null beyond 64 bits."""
    most = max((abs(int(y.min())), abs(int(y.max())))) * n + max(map(abs, sums)) if y.size else 0
    if most * most * y.shape[1] < 1 << 63:
        apart = n * y - np.array(sums, np.int64)
        return pa.array((apart * apart).sum(axis=1), pa.int64())
    apart = n * y.astype(object) - np.array(sums, object)
    return pa.array([int(v) if v < 1 << 63 else None for v in (apart * apart).sum(axis=1)], pa.int64())


def _results(size: int, n: int, sums: list[int], mean, projection, explained: list[float], error: float):
    names = [part.split()[0] for part in _RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = len(projection)
        for batch in batches:
            y = _matrix(batch.column(1), size)
            rows = len(y)
            of_row = pa.array(np.repeat(np.arange(rows), count))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(of_row),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * count, n)),
                    _deviations(y, n, sums).take(of_row),
                    pa.array(_whitened(y, mean, projection).ravel()),
                    pa.array(np.tile(np.array(explained), rows)),
                    pa.array(np.full(rows * count, error)),
                ],
                names,
            )

    return run


def whitened(
    embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", most: int = COMPONENTS
) -> DataFrame:
    """Per kept row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = embeddings.sparkSession
    rows = materialize(integer_vectors(embeddings, id_column, vector_column), "whitening-rows")
    nothing = spark.createDataFrame([], _RESULT)
    lengths = rows.groupBy(F.size("y").alias("size")).agg(F.count("*").alias("rows"))
    common = lengths.orderBy(F.col("rows").desc(), F.col("size").desc()).limit(1).collect()
    if not common or not common[0].size:
        return nothing
    size = common[0].size
    rows = rows.filter(F.size("y") == size)
    fit = materialize(rows.select("y").distinct(), "whitening-fit")
    n, sums, matrix = scatter(fit, size)
    divisor = math.gcd(*(abs(x) for row in matrix for x in row)) or 1
    reduced = [[x // divisor for x in row] for row in matrix]
    trace = sum(reduced[i][i] for i in range(size))
    if not trace:
        return nothing
    roots, root_bits = largest_roots(characteristic_polynomial(spark, reduced), trace, most)
    vectors = components(reduced, roots, root_bits)
    with localcontext() as context:
        context.prec = 60
        exact = [Decimal(root) / Decimal(1 << root_bits) for root in roots]
        explained = [float(e / trace) for e in exact]
        deviation = [float((e * divisor / (Decimal(n) * n)).sqrt()) for e in exact]
    projection = vectors / np.array(deviation)[:, None]
    mean = np.array([s / n for s in sums])
    error = _identity_error(fit, size, n, mean, projection)
    return rows.select("vec_id", "y").mapInArrow(_results(size, n, sums, mean, projection, explained, error), _RESULT)
