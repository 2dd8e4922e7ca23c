from __future__ import annotations

import math
import os
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pytest

from postlake.llm import whitening
from postlake.llm.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
KINDS = "vec_id long, embedding array<float>, label int, x string, `size` int, entries int"


def table(spark, vectors):
    rows = [(k, None if v is None else [None if c is None else float(c) for c in v], 0, "x", 1, 2) for k, v in vectors]
    return spark.createDataFrame(rows, KINDS)


def check(got, vectors, count=4):
    """Compare with a plain version on doubles; ``vectors`` are the usable (id, entries)."""
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for _, v in vectors]
    fit = np.array(sorted(set(map(tuple, x))), object)
    n, s = len(fit), fit.sum(axis=0)
    centred = np.array(fit - np.array([Fraction(v, n) for v in s]), object)
    covariance = (centred.T @ centred / n).astype(float)
    e, v = np.linalg.eigh(covariance)
    e, v = e[::-1], v[:, ::-1]
    assert len(got) == len(vectors) * min(count, len(s))
    assert set(got.n) == {n}
    for c in range(min(count, len(s))):
        own = got[got.component == c + 1].set_index("vec_id")
        far = [int(sum((n * a - b) ** 2 for a, b in zip(row, s))) for row in x]
        assert [int(own.deviation[k]) for k, _ in vectors] == far
        white = own.whitened[[k for k, _ in vectors]].to_numpy(float)
        y = np.array([[float(a - Fraction(b, n)) for a, b in zip(row, s)] for row in x])
        want = y @ v[:, c] / np.sqrt(e[c])
        assert min(abs(white - want).max(), abs(white + want).max()) < 1e-7
        assert abs(own.explained - e[c] / e.sum()).max() < 1e-9
    assert got.identity_error.max() < 1e-9


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_query_over_the_table(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    check(QUERIES["op11_whitening"](spark, SF_DIR).toPandas(), [(r.vec_id, r.embedding) for r in rows])


def test_unusable_rows_and_copies(spark):
    rng = np.random.default_rng(3)
    good = [(k, rng.normal(size=6).astype(np.float32)) for k in range(40)]
    copies = [(100 + k, good[0][1]) for k in range(60)]
    inf, nan = float("inf"), float("nan")
    bad = [(200, None), (201, []), (202, [None, 1, 2, 3, 4, 5]), (203, [nan, 1, 2, 3, 4, 5])]
    bad += [(204, [inf, 1, 2, 3, 4, 5]), (205, [-inf] * 6), (206, [3e38] * 6), (207, [1, 2, 3])]
    got = whitening.whitened(table(spark, good + copies + bad)).toPandas()
    check(got, good + copies)
    repeated = whitening.whitened(table(spark, good + good + [(None, good[1][1])])).toPandas()
    assert (repeated.n == 40).all() and len(repeated) == 4 * 81


def test_wide_numbers_stay_exact(spark):
    rng = np.random.default_rng(4)
    for scale in (1e6, 1e12):
        check(whitening.whitened(table(spark, v := [(k, rng.normal(size=3) * scale) for k in range(30)])).toPandas(), v)


def test_few_dimensions_and_few_vectors(spark):
    check(whitening.whitened(table(spark, v := [(k, [k * k / 7, -k]) for k in range(9)])).toPandas(), v)
    one = whitening.whitened(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).toPandas()
    assert list(one.component) == [1, 2, 1, 2] and one.whitened.isna().all() and (one.explained == 0).all()
    flat = whitening.whitened(table(spark, [(k, [k, 2 * k, 3 * k]) for k in range(5)])).toPandas()
    assert (flat[flat.component == 1].explained == 1).all() and flat[flat.component > 1].whitened.isna().all()
    assert whitening.whitened(table(spark, [])).count() == 0
    assert whitening.whitened(table(spark, [(1, None)])).count() == 0


def test_equal_variances(spark):
    unit = np.eye(4) * 3
    vectors = [(k, v) for k, v in enumerate([*unit, *-unit])]
    got = whitening.whitened(table(spark, vectors)).toPandas()
    assert got.identity_error.max() < 1e-12 and (abs(got.explained - 0.25) < 1e-12).all()


def test_polynomial_is_exact(spark):
    rng = np.random.default_rng(1)
    for size in (1, 2, 5, 9):
        a = rng.integers(-50, 50, (size, size))
        matrix = (a @ a.T).tolist()
        poly = whitening.characteristic_polynomial(spark, matrix)
        for t in range(-3, size):
            m = [[Fraction((t if i == j else 0) - matrix[i][j]) for j in range(size)] for i in range(size)]
            value = Fraction(1)
            for k in range(size):
                p = next((i for i in range(k, size) if m[i][k]), None)
                if p is None:
                    value = Fraction(0)
                    break
                if p != k:
                    m[p], m[k], value = m[k], m[p], -value
                value *= m[k][k]
                for i in range(k + 1, size):
                    f = m[i][k] / m[k][k]
                    m[i] = [x - f * y for x, y in zip(m[i], m[k])]
            assert sum(c * t**k for k, c in enumerate(poly)) == value


def test_roots():
    # (t - 9)^2 (t - 8) (t - 3) t^2 and (t^2 - 6 t + 7) = (t - 3 - sqrt 2)(t - 3 + sqrt 2)
    def product(*roots):
        poly = [1]
        for r in roots:
            poly = [a - r * b for a, b in zip([0, *poly], [*poly, 0])]
        return poly

    def near(got, want):
        return len(got) == len(want) and all(abs(r - w) < Decimal(10) ** -100 for r, w in zip(got, want))

    with localcontext(prec=140):
        assert near(whitening.leading_roots(product(9, 9, 8, 3, 0, 0), 5), [9, 9, 8, 3])
        both = [3 + Decimal(2).sqrt(), 3 - Decimal(2).sqrt()]
        assert near(whitening.leading_roots([7, -6, 1], 4), both)
        much = 10**12
        assert near(whitening.leading_roots(product(much, much + 1, much - 1, 5), 4), [much + 1, much, much - 1, 5])
        assert near(whitening.leading_roots(product(16, 15, 2, 1), 3), [16, 15, 2])
    assert whitening.primes(200)[0] == 2**31 - 1 and len(whitening.primes(200)) == 7
