"""Whitening embeddings along the leading components of their exact covariance.

Vectors become whole numbers, so their scatter matrix is exact.  Its characteristic polynomial
is found modulo many primes, one task each, by reducing the matrix to Hessenberg form, and put
together by Chinese remaindering.  All roots of that polynomial are real, so signs of shifted
coefficients count the roots above any point, which isolates the leading ones; they are refined
to many digits.  A component is then the null space of the matrix less its root, by inverse
iteration in the same precision.

Only sums cross to the driver: the scatter matrix and the polynomial, whose sizes depend on the
number of dimensions alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm.frames import written

#: What an entry is multiplied by before it is rounded down.
SCALE = 256
COMPONENTS = 4
#: Digits of roots and of inverse iteration.
DIGITS = 120
#: Roots that agree to so many digits count as one.
SAME = 60
#: Vectors that a task multiplies at once.
BATCH = 8192
_LIMB = 60


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """vec_id and x, the entries as whole numbers, of the rows whose vector can be one.

    Dropped are null and empty vectors, those with null or non-finite entries or with one that
    leaves the range of a long, and those whose length is not the most frequent one (the
    longest, if several are).
    """
    entry = F.transform(F.col(vector_col), lambda c: c.cast("double") * F.lit(float(scale)))
    rows = rows.select(F.col(id_col).alias("vec_id"), entry.alias("entries"))
    fine = F.forall("entries", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**62))
    rows = rows.filter(F.coalesce(fine & (F.size("entries") > 0), F.lit(False)))
    sizes = rows.groupBy(F.size("entries").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    usual = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    rows = rows.filter(F.size("entries") == (usual.size if usual else 0))
    return rows.select("vec_id", F.transform("entries", lambda c: F.floor(c).cast("long")).alias("x"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Vectors of one length as rows."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def _products(x: np.ndarray) -> np.ndarray:
    """Exact sum of products of every two columns, as Python's whole numbers."""
    most = int(np.abs(x).max(initial=0))
    if most * most * len(x) < 1 << 53:
        y = x.astype(np.float64)
        return (y.T @ y).astype(np.int64).astype(object)
    if most * most * len(x) < 1 << 62:
        return (x.T @ x).astype(object)
    y = x.astype(object)
    return y.T @ y


@dataclass(frozen=True)
class Scatter:
    """n vectors, their sums and n * (sum of products) - (products of sums): n^2 times the
    covariance, all exact."""

    n: int
    sums: list[int]
    matrix: list[list[int]]


def scatter(fit: DataFrame) -> Scatter:
    """The exact scatter of ``fit`` (x, an array of longs; all of one length).

    Each task adds up its own products; these sums are added by position, so what is shuffled
    and collected depends on the number of dimensions and tasks alone.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                x = _matrix(batch["x"].slice(a, BATCH))
                x = np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1)
                own = _products(x)
                total = own if total is None else total + own
        if total is not None:
            i, j = np.triu_indices(len(total))
            both = [divmod(int(v), 1 << _LIMB) for v in total[i, j]]
            wide = pa.decimal128(38)
            arrays = [pa.array(i, "int32"), pa.array(j, "int32")]
            arrays += [pa.array([Decimal(v[k]) for v in both], wide) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(arrays, ["i", "j", "high", "low"])

    parts = fit.select("x").mapInArrow(add, "i int, j int, high decimal(38,0), low decimal(38,0)")
    sums = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    found = {(r.i, r.j): (int(r.high) << _LIMB) + int(r.low) for r in sums.collect()}
    if not found:
        return Scatter(0, [], [])
    size = max(j for _, j in found)
    n, s = found[0, 0], [found[0, j] for j in range(1, size + 1)]
    matrix = [
        [n * found[min(i, j) + 1, max(i, j) + 1] - s[i] * s[j] for j in range(size)] for i in range(size)
    ]
    return Scatter(n, s, matrix)


def _is_prime(n: int) -> bool:
    """Miller and Rabin's test, exact below 3.2 * 10^9 with these bases."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        if n % base == 0:
            return n == base
        y = pow(base, odd, n)
        if y not in (1, n - 1) and all((y := y * y % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes(bits: int) -> list[int]:
    """The largest primes below 2^31 whose product has more than ``bits`` bits."""
    out, n, have = [], (1 << 31) - 1, 0.0
    while have <= bits:
        if _is_prime(n):
            out.append(n)
            have += math.log2(n) - 1e-9
        n -= 2
    return out


def polynomial_mod(matrix: Sequence[Sequence[int]], p: int) -> np.ndarray:
    """Coefficients, from the constant one up, of det(t - matrix) modulo the prime ``p``."""
    h = np.array([[v % p for v in row] for row in matrix], np.int64)
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
    poly = np.zeros((size + 1, size + 1), np.int64)
    poly[0, 0] = 1
    for k in range(1, size + 1):
        out = np.zeros(size + 1, np.int64)
        out[1:] = poly[k - 1, :-1]
        out -= h[k - 1, k - 1] * poly[k - 1] % p
        product = 1
        for i in range(1, k):
            product = product * int(h[k - i, k - i - 1]) % p
            out -= product * int(h[k - i - 1, k - 1]) % p * poly[k - i - 1] % p
            if i % 64 == 0:
                out %= p
        poly[k] = out % p
    return poly[size]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients, from the constant one up, of det(t - matrix) for a symmetric matrix
    without negative eigenvalues.

    The k-th elementary function of such eigenvalues is at most binomial(d, k) * (trace / d)^k,
    which says how many primes are enough.  Each prime is a row, dealt over the cluster.
    """
    size, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    mean = trace // size + 1
    bits = 2 + max((math.comb(size, k) * mean**k).bit_length() for k in range(size + 1))
    chosen = primes(bits)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch["prime"].to_pylist()
            rest = [polynomial_mod(matrix, p).tolist() for p in own]
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch["prime"], pa.array(rest, kind)], ["prime", "rest"])

    slices = min(len(chosen), 2 * spark.sparkContext.defaultParallelism)
    table = spark.range(0, len(chosen), 1, slices).select(
        F.element_at(F.lit(chosen).cast("array<long>"), (F.col("id") + 1).cast("int")).alias("prime")
    )
    found = table.mapInArrow(solve, "prime long, rest array<long>").collect()
    product, values = 1, [0] * (size + 1)
    for row in found:
        inverse = pow(product, -1, row.prime)
        values = [v + product * ((r - v) * inverse % row.prime) for v, r in zip(values, row.rest, strict=True)]
        product *= row.prime
    return [v - product if 2 * v > product else v for v in values]


def _shifted(poly: list[int], by: int) -> list[int]:
    """Coefficients of poly(t + by)."""
    out = list(poly)
    for k in range(len(out) - 1):
        for i in range(len(out) - 2, k - 1, -1):
            out[i] += by * out[i + 1]
    return out


def roots_above(poly: list[int], at: int, bits: int) -> int:
    """How many roots exceed at / 2^bits, each as often as it is one.

    For a polynomial whose roots are all real, that is the number of sign changes between the
    coefficients of the polynomial moved there (Descartes' rule, exact in that case).
    """
    size = len(poly) - 1
    wide = [c << (bits * (size - k)) for k, c in enumerate(poly)]
    signs = [c > 0 for c in _shifted(wide, at) if c]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _sign(poly: list[int], at: int, bits: int) -> int:
    """Sign of the polynomial at at / 2^bits."""
    value, size = 0, len(poly) - 1
    for k in range(size, -1, -1):
        value = value * at + (poly[k] << (bits * (size - k)))
    return (value > 0) - (value < 0)


def leading_roots(poly: list[int], count: int, digits: int = DIGITS) -> list[Decimal]:
    """The ``count`` largest roots, falling, with repetitions, to ``digits`` digits.

    All roots must be real and none negative.  Zeros are left out.
    """
    zeros = next(k for k, c in enumerate(poly) if c)
    poly = poly[zeros:]
    size = len(poly) - 1
    out: list[Decimal] = []
    top = 1
    while size and roots_above(poly, top, 0):
        top *= 2
    while len(out) < min(count, size):
        rank, low, high, bits = len(out), 0, top, 0
        inside, above = size, 0  # roots above low and above high, in units of 2^-bits
        # narrow down until the root of this rank is alone, or in a cluster as narrow as asked
        while inside - above > 1 and (high.bit_length() - (high - low).bit_length()) < 4 * digits:
            if high - low == 1:
                low, high, bits = 2 * low, 2 * high, bits + 1
            middle = (low + high) // 2
            n = roots_above(poly, middle, bits)
            if n > rank:
                low, inside = middle, n
            else:
                high, above = middle, n
        alone = inside - above == 1
        sign = _sign(poly, high, bits) if alone else 0
        if alone and sign == 0:  # the root is the edge itself
            alone = False
        while (high.bit_length() - (high - low).bit_length()) < 4 * digits:
            if high - low == 1:
                low, high, bits = 2 * low, 2 * high, bits + 1
            middle = (low + high) // 2
            if alone:
                here = _sign(poly, middle, bits)
                exceeds = here != sign and here != 0
            else:
                exceeds = roots_above(poly, middle, bits) > rank
            if exceeds:
                low = middle
            else:
                high = middle
        with localcontext(prec=digits):
            out.append(Decimal(high) / Decimal(2) ** bits)
    return out


def _eliminated(matrix: list[list[int]], root: Decimal) -> tuple[np.ndarray, list[int]]:
    """LU factors of matrix - root with the rows' order."""
    a = np.array([[Decimal(v) for v in row] for row in matrix], object)
    a[np.diag_indices(len(a))] -= root
    order = list(range(len(a)))
    least = max(abs(v) for v in a.ravel()) * Decimal(10) ** -(DIGITS - 10) or Decimal(1)
    for k in range(len(a)):
        pivot = k + max(range(len(a) - k), key=lambda i: abs(a[k + i, k]))
        if pivot != k:
            a[[pivot, k]] = a[[k, pivot]]
            order[pivot], order[k] = order[k], order[pivot]
        if abs(a[k, k]) < least:
            a[k, k] = least
        a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
    return a, order


def _unit(v: np.ndarray, against: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for u in against:
            v = v - u * (u @ v)
    return v / (v @ v).sqrt()


def components(matrix: list[list[int]], roots: list[Decimal]) -> list[np.ndarray]:
    """A unit eigenvector for each of ``roots``, orthogonal where roots coincide, as decimals."""
    out: list[np.ndarray] = []
    factors = None
    with localcontext(prec=DIGITS):
        for k, root in enumerate(roots):
            same = [out[i] for i in range(k) if abs(roots[i] - root) <= root * Decimal(10) ** -SAME]
            if factors is None or not same:
                factors = _eliminated(matrix, root)
            (a, order), size = factors, len(matrix)
            # starts that no component is likely to be orthogonal to
            start = [1 + Decimal((i * i * 7919 + 104729 * (k + 1)) % 997) / 997 for i in range(size)]
            v = _unit(np.array(start, object), same)
            for _ in range(4):
                y = v[order].copy()
                for i in range(1, size):
                    y[i] -= a[i, :i] @ y[:i]
                for i in range(size - 1, -1, -1):
                    y[i] = (y[i] - (a[i, i + 1 :] @ y[i + 1 :] if i + 1 < size else 0)) / a[i, i]
                v = _unit(y, same)
            out.append(v)
    return out


@dataclass(frozen=True)
class Whitening:
    """n, sums, and per component its unit vector, the root of n^2 times the covariance and its
    share of the trace.  A component without variance has root 0 and share 0."""

    n: int
    sums: list[int]
    vectors: list[list[float]]
    roots: list[float]
    shares: list[float]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: longs where they fit, else Python's whole numbers."""
        room = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if room < 1 << 62:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def white(self, centred: np.ndarray) -> np.ndarray:
        """The whitened vector's entries, one column per component (NaN: no variance)."""
        unit = np.array(self.vectors, np.float64).T
        deviation = np.sqrt(np.array(self.roots, np.float64))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(deviation > 0, (centred.astype(np.float64) @ unit) / deviation, np.nan)


def fitted(spark: SparkSession, total: Scatter, count: int = COMPONENTS) -> Whitening:
    """The first ``count`` components of ``total``, or as many as there are dimensions."""
    size = len(total.matrix)
    trace = sum(total.matrix[i][i] for i in range(size))
    roots: list[Decimal] = []
    if trace:
        roots = leading_roots(characteristic_polynomial(spark, total.matrix), count)
    vectors = [[float(v) for v in c] for c in components(total.matrix, roots)]
    none = min(count, size) - len(roots)
    return Whitening(
        total.n,
        total.sums,
        vectors + [[0.0] * size] * none,
        [float(r) for r in roots] + [0.0] * none,
        [float(r / trace) for r in roots] + [0.0] * none,
    )


def identity_error(fit: DataFrame, white: Whitening) -> float | None:
    """Largest absolute entry of the covariance of the whitened ``fit`` minus the identity,
    over the components with variance; null if there is none."""
    used = [k for k, r in enumerate(white.roots) if r > 0]
    if not used:
        return None

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(used) + 1, len(used) + 1))
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                w = white.white(white.centred(_matrix(batch["x"].slice(a, BATCH))))[:, used]
                w = np.concatenate([np.ones((len(w), 1)), w], axis=1)
                total += w.T @ w
        i, j = np.indices(total.shape).reshape(2, -1)
        arrays = [pa.array(i, "int32"), pa.array(j, "int32"), pa.array(total.ravel())]
        yield pa.RecordBatch.from_arrays(arrays, ["i", "j", "v"])

    parts = fit.select("x").mapInArrow(add, "i int, j int, v double")
    total = np.zeros((len(used) + 1, len(used) + 1))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r.i, r.j] = r.v
    mean = total[0, 1:] / total[0, 0]
    covariance = total[1:, 1:] / total[0, 0] - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(len(used))).max())


def whitened(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
    count: int = COMPONENTS,
) -> DataFrame:
    """A row per usable row of ``rows`` and component: vec_id, component (from 1), n, deviation
    (decimal; null beyond 38 digits), whitened, explained and identity_error.

    ``whole_vectors`` says which rows are usable.  The covariance is that of the distinct
    vectors, n of them, so copies weigh nothing more.  Components are numbered by falling
    variance; one without variance has whitened null and explained 0.  Null and repeated ids
    are carried along; without usable rows the result is empty.
    """
    spark = rows.sparkSession
    vectors = whole_vectors(rows, id_col, vector_col, scale)
    fit = written(vectors.select("x").distinct(), "whitening-fit")
    white = fitted(spark, scatter(fit), count)
    error = identity_error(fit, white)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(white.roots)
        for whole in batches:
            for a in range(0, whole.num_rows, BATCH):
                batch = whole.slice(a, BATCH)
                if not batch.num_rows or not k:
                    continue
                y = white.centred(_matrix(batch["x"]))
                if y.dtype != object and int(np.abs(y).max()) ** 2 * y.shape[1] >= 1 << 62:
                    far = (y.astype(object) ** 2).sum(axis=1).tolist()
                else:
                    far = (y**2).sum(axis=1).tolist()
                far = [Decimal(v) if v < 10**38 else None for v in far]
                each = np.repeat(np.arange(len(y)), k)
                w = white.white(y).ravel()
                arrays = [
                    batch["vec_id"].take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))),
                    pa.array(np.full(len(each), white.n, np.int64)),
                    pa.array(far, pa.decimal128(38)).take(pa.array(each)),
                    pa.array(w, mask=np.isnan(w)),
                    pa.array(np.tile(white.shares, len(y))),
                    pa.array([error] * len(each), "float64"),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names)

    kinds = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    return vectors.mapInArrow(project, kinds)
