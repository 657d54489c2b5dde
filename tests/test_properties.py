"""Property tests on random small tables."""

from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelcast.functions import Missing
from panelcast.operators import (
    Bridge,
    adoption_vs_demand,
    collapse_small,
    cramers_v,
    fanout_base,
    grouped_avg,
    group_share,
    histogram,
    pair_flows,
)

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
label = st.sampled_from(["a", "b", "c", "NA", None])


@SETTINGS
@given(st.lists(st.tuples(label, label), min_size=1, max_size=40))
def test_answered_shares_add_to_100(spark, rows):
    df = spark.createDataFrame(rows, "g string, a string")
    s = group_share(df, "g", "a", Missing(values=["NA"]), Missing(values=["NA"]), denominator="answered")
    for r in s.groupBy("g").agg(F.sum("percentage").alias("t")).collect():
        assert r.t == pytest.approx(100.0)
    # 'all' denominators are never smaller, so shares never exceed 'answered' ones.
    alls = {(r.g, r.a): r.percentage for r in group_share(df, "g", "a", Missing(values=["NA"]), Missing(values=["NA"])).collect()}
    for r in s.collect():
        assert alls[(r.g, r.a)] <= r.percentage + 1e-9


@SETTINGS
@given(st.lists(st.integers(min_value=0, max_value=1000), min_size=0, max_size=30),
       st.floats(min_value=0, max_value=50))
def test_collapse_preserves_total(spark, counts, threshold):
    df = spark.createDataFrame([(f"l{i}", c) for i, c in enumerate(counts)], "label string, cnt long")
    out = collapse_small(df, "label", "cnt", threshold=threshold).collect()
    assert sum(r.cnt for r in out) == sum(counts)
    assert len({r.label for r in out}) == len(out)


bridge_rows = st.lists(st.tuples(st.integers(1, 6), st.integers(1, 4)), max_size=20)


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["x", "y", None]), st.floats(1, 100)), min_size=1, max_size=6),
       bridge_rows, bridge_rows)
def test_fanout_weighted_equals_brute_force(spark, ents, b1, b2):
    ent = spark.createDataFrame([(i + 1, a, s) for i, (a, s) in enumerate(ents)], "id long, attr string, s double")
    lu = spark.createDataFrame([(1, "p"), (2, "q"), (3, "r")], "id long, name string")  # id 4 dangles
    br1 = spark.createDataFrame(b1, "id long, item long")
    br2 = spark.createDataFrame(b2, "id long, item long")
    base = fanout_base(ent, "id", "s", "s", attrs=["attr"], bridges=[
        Bridge("one", br1, "id", "item", lu, "id", "name"), Bridge("two", br2, "id", "item", lu, "id", "name")])
    names = {1: "p", 2: "q", 3: "r"}
    rows = []
    for i, (a, s) in enumerate(ents, start=1):
        l1 = [names.get(t) for e, t in b1 if e == i] or [None]
        l2 = [names.get(t) for e, t in b2 if e == i] or [None]
        rows += [(a, s, x, y) for x in l1 for y in l2]
    for dim, idx in (("attr", 0), ("one", 2), ("two", 3)):
        acc = defaultdict(list)
        for r in rows:
            acc[r[idx]].append(r[1])
        want = {k: sum(v) / len(v) for k, v in acc.items()}
        got = {r[dim]: r.average for r in grouped_avg(base, dim).collect()}
        assert got == pytest.approx(want)
    h = histogram(base.entities, "s", 0, 100, 10, weight="weight").collect()
    assert sum(r.cnt for r in h) == len(rows)


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("uvw")), min_size=2, max_size=40))
def test_cramers_v_symmetric_in_unit_interval(spark, rows):
    df = spark.createDataFrame(rows, "x string, y string")
    a, b = cramers_v(df, "x", "y").first(), cramers_v(df, "y", "x").first()
    if a.v is None:
        assert b.v is None
    else:
        assert 0.0 <= a.v <= 1.0 + 1e-12
        assert a.v == pytest.approx(b.v)


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("xyz"), st.sampled_from("pq")), min_size=1,
                max_size=30))
def test_flow_conservation(spark, rows):
    df = spark.createDataFrame(rows, "a string, b string, c string")
    per_hop = defaultdict(int)
    for r in pair_flows(df, [("a", "b"), ("b", "c")]).collect():
        per_hop[r.hop] += r["count"]
    assert per_hop == {0: len(rows), 1: len(rows)}


@SETTINGS
@given(st.lists(st.tuples(st.integers(1, 8), st.integers(1, 3)), min_size=1, max_size=30))
def test_distinct_counts_bounded_by_entities(spark, pairs):
    b = spark.createDataFrame(pairs, "e long, i long")
    for r in adoption_vs_demand(b, b, "e", "i").collect():
        ents = {e for e, i in pairs if i == r.id}
        assert r.cnt == r.want_cnt == len(ents)
