"""Whitening against a dense eigen solver and exact integers."""

import numpy as np
import pytest

from panelcast.llm import whitening
from panelcast.llm.common import read
from panelcast.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, component string, n string, v string"


def rows_of(pairs):
    return [(i, None if v is None else [None if c is None else float(c) for c in v], "c", "n", "v") for i, v in pairs]


def expected(vectors, k=16):
    """Of the usable vectors, as (n, deviations, e, components, whitened, trace)."""
    x = np.floor(64 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    c = u - s / n
    e, q = np.linalg.eigh(c.T @ c / n)
    return n, deviation, e[::-1][:k], q[:, ::-1][:, :k], (x - s / n) @ q[:, ::-1][:, :k] / np.sqrt(np.maximum(e[::-1][:k], 1e-300)), e.sum()


def compare(rows, ids, vectors, k=16, within=1e-7):
    n, deviation, e, _, y, trace = expected(vectors, k)
    at = {d: i for i, d in enumerate(ids)}
    got = np.full(y.shape, np.nan)
    for r in rows:
        i = at[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation[i])
        assert r.explained == pytest.approx(e[r.component - 1] / trace, rel=1e-9)
        assert 0 <= r.identity_error <= 1e-9
        got[i, r.component - 1] = r.whitened
    sign = np.sign((got * y).sum(0))
    assert np.abs(got * sign - y).max() < within


@pytest.mark.parametrize("n,d,k", [(400, 40, 16), (300, 8, 16), (200, 64, 5), (30, 64, 16)])
def test_whitening_equals_dense_solver(spark, n, d, k):
    rng = np.random.default_rng(n + d)
    v = (rng.standard_normal((n, d)) * np.linspace(3, 0.5, d) + rng.standard_normal(d)).astype(np.float32)
    v = np.vstack((v, v[:50], v[:1].repeat(40, 0)))  # copies don't weigh in the fit
    docs = spark.createDataFrame(rows_of(enumerate(v.tolist())), SCHEMA).repartition(7)
    out = whitening.whitened(docs, k=k)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = out.collect()
    assert len(rows) == len(v) * min(k, d)
    compare(rows, range(len(v)), v, min(k, d))


def test_the_filter_finds_a_flat_spectrum():
    rng = np.random.default_rng(5)
    c = rng.standard_normal((5000, 64))
    v = c.T @ c / len(c)
    calls = []
    values, q, worst, passes = whitening.leading_eigenpairs(lambda x: calls.append(1) or v @ x, 64, 16, 32, 2e-14)
    e, u = np.linalg.eigh(v)
    assert len(calls) == passes < 200 and worst < 1e-12
    assert np.allclose(values, e[::-1][:16], rtol=1e-12)
    assert np.abs(np.abs((u[:, ::-1][:, :16] * q).sum(0)) - 1).max() < 1e-12


@pytest.mark.parametrize("values", [np.r_[1e8, np.ones(39)], np.r_[1e6, 1e3, np.linspace(1, 0.1, 38)], np.r_[np.ones(20), np.zeros(20)]])
def test_steep_equal_and_zero_eigenvalues(values):
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((40, 40)))[0]
    v = (q * values) @ q.T
    found, u, worst, _ = whitening.leading_eigenpairs(lambda x: v @ x, 40, 10, 20, 2e-14)
    assert np.allclose(found, np.sort(values)[::-1][:10], rtol=1e-9)
    assert np.abs(u.T @ u - np.eye(10)).max() < 1e-12 and worst < 1e-12


def test_unusable_vectors_are_left_out(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((60, 6)).astype(np.float32).tolist()
    odd = [(100, None), (101, []), (102, [1.0] * 5 + [None]), (103, [float("nan")] * 6), (104, [float("inf")] + [0.0] * 5),
           (105, [1e30] + [0.0] * 5), (106, [1.0] * 5)]
    pairs = list(enumerate(v)) + [(3, v[3])] + odd + [(None, v[5])]
    rows = whitening.whitened(spark.createDataFrame(rows_of(pairs), SCHEMA)).collect()
    assert {r.vec_id for r in rows} == {*range(60), None} and len(rows) == 62 * 6
    compare([r for r in rows if r.vec_id is not None], range(60), v, 6)


def test_deviation_beyond_a_long_is_null(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((40, 4)).astype(np.float32)
    v[0] = 3e6
    v[1] = 6e5  # between 2^62 and 2^63: worked out in whole numbers
    rows = whitening.whitened(spark.createDataFrame(rows_of(enumerate(v.tolist())), SCHEMA)).collect()
    _, deviation, *_ = expected(v)
    for r in rows:
        assert r.deviation == (deviation[r.vec_id] if deviation[r.vec_id] < 1 << 63 else None)
    assert {r.vec_id for r in rows if r.deviation is None} == {0} and 1 << 62 < deviation[1] < 1 << 63


def test_few_and_no_vectors(spark):
    for pairs, components in (([], 0), ([(1, [1.0, 2.0])], 0), ([(1, [1.0, 2.0]), (2, [1.0, 2.0])], 0), ([(1, [1.0, 2.0]), (2, [3.0, 2.0])], 1)):
        rows = whitening.whitened(spark.createDataFrame(rows_of(pairs), SCHEMA)).collect()
        assert len(rows) == len(pairs) * components
    assert sorted(round(r.whitened, 9) for r in rows) == [-1.0, 1.0]
    assert {r.deviation for r in rows} == {128 * 128}  # n * x - S is -128 and 128


def test_registered_query(spark):
    sf = "/root/testdata/sf0.01"
    table = read(spark, sf, "embeddings").toPandas()
    rows = QUERIES["op13_embedding_whitening"](spark, sf).collect()
    assert len(rows) == 16 * len(table)
    compare(rows, table["vec_id"].tolist(), np.stack(table["embedding"].tolist()))
