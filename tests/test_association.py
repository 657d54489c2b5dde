import math
from itertools import product

import numpy as np
import pytest

from panelcast.operators import association_grid, contingency, cramers_v, top_associations


def chi2_brute(xs, ys):
    rows, cols = sorted(set(xs)), sorted(set(ys))
    obs = np.zeros((len(rows), len(cols)))
    for x, y in zip(xs, ys):
        obs[rows.index(x), cols.index(y)] += 1
    n = obs.sum()
    exp = np.outer(obs.sum(1), obs.sum(0)) / n
    chi2 = ((obs - exp) ** 2 / exp).sum()
    m = min(len(rows), len(cols)) - 1
    return chi2, (math.sqrt(chi2 / n / m) if m > 0 else None), n


def _v(df):
    return df.first()


def test_cramers_v_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    xs = rng.choice(["a", "b", "c"], 400).tolist()
    ys = [("p" if x == "a" else rng.choice(["p", "q", "r", "s"])) for x in xs]
    df = spark.createDataFrame(list(zip(xs, ys)), "x string, y string")
    chi2, v, n = chi2_brute(xs, ys)
    got = _v(cramers_v(df, "x", "y"))
    assert got.chi2 == pytest.approx(chi2, rel=1e-9)
    assert got.v == pytest.approx(v, rel=1e-9)
    assert got.n == n and got.dof == 2 * 3


def test_cramers_v_symmetric_copy_and_constant(spark):
    rows = [(i % 3, i % 3, 1) for i in range(30)] + [(None, 1, 1)]
    df = spark.createDataFrame(rows, "x int, y int, c int")
    assert _v(cramers_v(df, "x", "y")).v == pytest.approx(1.0)
    assert _v(cramers_v(df, "y", "x")).v == pytest.approx(_v(cramers_v(df, "x", "y")).v)
    assert _v(cramers_v(df, "x", "c")).v is None  # constant column: NULL, not NaN
    cells = contingency(df, "x", "y").collect()
    assert sum(r.cnt for r in cells) == 30  # NULL rows left out


def test_grid_includes_zero_cells_and_unknown_labels(spark):
    xs = ["e1"] * 6 + ["e2"] * 4 + ["e3"] * 5
    ys = ["t1"] * 6 + ["t2"] * 4 + ["t2"] * 3 + ["t3"] * 2
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(xs, ys))], "id long, x string, y string")
    g = association_grid(df, "id", "x", "y", ["e1", "e2", "zz"], ["t1", "t2"])
    got = {(r.feature, r.target): r for r in g.collect()}
    assert len(got) == 6
    assert got[("e2", "t1")].n11 == 0  # never co-occur, still present
    assert got[("zz", "t1")].v is None  # unknown feature label
    n = len(xs)
    for f, t in product(["e1", "e2"], ["t1", "t2"]):
        fx = ["1" if x == f else "0" for x in xs]
        ty = ["1" if y == t else "0" for y in ys]
        _chi2, v, _n = chi2_brute(fx, ty)
        assert got[(f, t)].v == pytest.approx(v, rel=1e-9), (f, t)
        assert got[(f, t)].n == n
    vs = [r.v for r in g.collect() if r.v is not None]
    assert all(0 <= v <= 1 + 1e-12 for v in vs)
    top = top_associations(g, 3).collect()
    assert [r.v for r in top] == sorted(vs, reverse=True)[:3]


def test_grid_multi_valued_counts_entities(spark):
    rows = [(1, "a", "t"), (1, "b", "t"), (2, "a", "u"), (3, "b", "t"), (3, "b", "t")]
    df = spark.createDataFrame(rows, "id long, x string, y string")
    g = {(r.feature, r.target): (r.n11, r.r, r.k, r.n) for r in
         association_grid(df, "id", "x", "y", ["a", "b"], ["t", "u"], multi_valued=True).collect()}
    assert g[("a", "t")] == (1, 2, 2, 3)
    assert g[("b", "t")] == (2, 2, 2, 3)
    assert g[("b", "u")] == (0, 2, 1, 3)


def test_top_associations_nulls_last(spark):
    g = spark.createDataFrame([("a", "x", None), ("b", "x", 0.5), ("c", "x", 0.7)], "feature string, target string, v double")
    assert [r.feature for r in top_associations(g, 3).collect()] == ["c", "b", "a"]


def test_cramers_v_of_nothing(spark):
    r = cramers_v(spark.createDataFrame([], "x string, y string"), "x", "y").first()
    assert (r.chi2, r.dof, r.n, r.v) == (0.0, 0, 0, None)
