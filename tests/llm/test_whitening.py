import math

import numpy as np
import pytest

from weftline.llm import sums, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component int, n long"
RNG = np.random.default_rng(4)


def table(spark, vectors, parts=3):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, 9, 9) for i, v in vectors], SCHEMA).repartition(parts)


def exact(vectors):
    """Mean, covariance and its spectrum by a plain decomposition of the whole."""
    x = np.floor(np.array(vectors, dtype=np.float32).astype(float) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    values, vecs = np.linalg.eigh(y.T @ y / n)
    return x, n, s, y, values[::-1], vecs[:, ::-1]


def check(rows, ids, vectors, k, tolerance=1e-8):
    x, n, s, y, values, vecs = exact(vectors)
    by = {}
    for r in rows:
        by.setdefault((r.vec_id, r.component), []).append(r)
    assert len(by) == len(set(ids)) * k and len(rows) == len(ids) * k
    want = y @ vecs[:, :k] / np.sqrt(values[:k])
    for c in range(k):
        got = np.array([by[i, c + 1][0].whitened for i in ids])
        sign = np.sign((got * want[:, c]).sum())
        assert np.abs(got * sign - want[:, c]).max() < tolerance
        assert all(abs(by[i, c + 1][0].explained - values[c] / values.sum()) <= 1e-9 for i in ids)
    for i, row in zip(ids, x.tolist()):
        r = by[i, 1][0]
        assert r.n == n and r.deviation == sum((n * a - int(b)) ** 2 for a, b in zip(row, s))
        assert r.identity_error <= 1e-9


def test_equals_eigenvectors_of_the_whole(spark):
    vectors = RNG.normal(size=(400, 12)) @ np.diag(2.0 ** -np.arange(12)) + 3
    ids = list(range(400))
    rows = whitening.whiten(table(spark, zip(ids, vectors))).collect()
    check(rows, ids, vectors, 8)
    assert {r.component for r in rows} == set(range(1, 9))
    few = whitening.whiten(table(spark, zip(ids, vectors[:, :5]))).collect()
    check(few, ids, vectors[:, :5], 5)


def test_ill_conditioned_rows(spark):
    """Spreads of eight orders of magnitude, and directions that others repeat: a plain Gram matrix has no factor then."""
    base = RNG.normal(size=(300, 4)) * [1e5, 1e3, 10, 0.01]
    vectors = np.column_stack([base, base[:, 0], base[:, 1] * 2])
    rows = whitening.whiten(table(spark, enumerate(vectors))).collect()
    x, n, s, y, values, vecs = exact(vectors)
    found = {r.component: r.explained for r in rows}
    assert np.allclose([found[c] for c in (1, 2)], values[:2] / values.sum(), rtol=1e-9)
    assert max(r.identity_error for r in rows) < 1e-4
    repeated = RNG.normal(size=(200, 3))
    flat = whitening.whiten(table(spark, enumerate(np.column_stack([repeated, repeated, np.ones(200)])))).collect()
    assert {r.component for r in flat} == {1, 2, 3} and max(r.identity_error for r in flat) < 1e-9


def test_rows_that_do_not_count(spark):
    good = RNG.normal(size=(50, 3))
    bad = [None, [1, None, 2], [math.nan, 0, 0], [math.inf, 0, 0], [1e30, 0, 0], [], [1, 2], [1, 2, 3, 4]]
    rows = whitening.whiten(table(spark, [*enumerate(good), *[(1000 + i, v) for i, v in enumerate(bad)]])).collect()
    check(rows, list(range(50)), good, 3)


def test_repeated_rows_and_null_keys(spark):
    vectors = [*RNG.normal(size=(20, 3))]
    pairs = [*enumerate(vectors), (3, vectors[3]), (None, vectors[5])]
    rows = whitening.whiten(table(spark, pairs)).collect()
    assert len(rows) == 22 * 3 and {r.n for r in rows} == {22}
    twice = [r.whitened for r in rows if r.vec_id == 3 and r.component == 1]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert sorted(r.whitened for r in rows if r.vec_id is None) == pytest.approx(sorted(r.whitened for r in rows if r.vec_id == 5))


def test_nothing_to_learn(spark):
    for vectors in ([], [(1, None)], [(1, [1, 2])], [(1, [1, 2]), (2, [1, 2])]):
        assert whitening.whiten(table(spark, vectors)).count() == 0


def test_deviations_are_exact_or_null():
    x = np.array([[100_000, 100_010], [99_990, 100_003]])
    sums_ = tuple(int(v) for v in x.sum(axis=0))
    want = [sum((2 * int(a) - b) ** 2 for a, b in zip(row, sums_)) for row in x]
    assert whitening.deviations(x, 2, sums_) == want
    n = 10**13
    huge = whitening.deviations(x, n, tuple(n * 100_000 + 5 for _ in range(2)))
    assert huge == [v if v < 1 << 63 else None for v in (sum((n * int(a) - n * 100_000 - 5) ** 2 for a in row) for row in x)] and None in huge
    near = tuple(n * int(a) + 7 for a in x[0])
    assert whitening.deviations(x[:1], n, near) == [98]


def test_sums_over_many_tasks(spark):
    df = spark.range(1000).repartition(40)
    assert sums.summed(df, lambda b: np.array([b.num_rows, sum(b.column(0).to_pylist())]), np.int64).tolist() == [1000, 499500]
    assert sums.summed(df.where("id < 0"), lambda b: np.zeros(1)) is None
