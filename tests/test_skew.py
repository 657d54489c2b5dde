"""One key holding a third of all rows: results stay exact (the plans
pre-aggregate per key before any join or window on it)."""

from collections import Counter, defaultdict

import pytest

from panelcast.operators import (
    Bridge,
    adoption_vs_demand,
    bridge_weights,
    fanout_base,
    group_share,
    grouped_avg,
    indicator_long,
    label_counts,
    pair_flows,
)


@pytest.fixture(scope="module")
def skewed(spark):
    # 300 entities; entity 1 owns a third of the 1,200 bridge rows, item 7 a third of the rest.
    bridge = [(1, i % 5) for i in range(400)] + [(e, 7 if e % 2 else e % 9) for e in range(2, 402) for _ in (0, 1)]
    ents = [(e, ["a", "b", "c"][e % 3], float(e)) for e in range(1, 301)]
    return bridge, ents


def test_distinct_counts_with_hot_item_and_entity(spark, skewed):
    bridge, _ = skewed
    b = spark.createDataFrame(bridge, "e long, i long")
    got = {r.id: r.cnt for r in adoption_vs_demand(b, b, "e", "i").collect()}
    want = defaultdict(set)
    for e, i in bridge:
        want[i].add(e)
    assert got == {i: len(es) for i, es in want.items()}


def test_fanout_with_hot_entity(spark, skewed):
    bridge, ents = skewed
    ent = spark.createDataFrame(ents, "id long, attr string, s double")
    b = spark.createDataFrame(bridge, "id long, item long")
    lu = spark.createDataFrame([(i, f"L{i}") for i in range(10)], "id long, name string")
    base = fanout_base(ent, "id", "s", "s", attrs=["attr"],
                       bridges=[Bridge("one", b, "id", "item", lu, "id", "name"), Bridge("two", b, "id", "item", lu, "id", "name")])
    n = Counter(e for e, _ in bridge)
    acc = defaultdict(lambda: [0.0, 0])
    for e, a, s in ents:
        w = max(1, n[e]) ** 2
        acc[a][0] += s * w
        acc[a][1] += w
    got = {r.attr: r.average for r in grouped_avg(base, "attr").collect()}
    assert got == pytest.approx({a: v[0] / v[1] for a, v in acc.items()})


def test_flows_with_hot_entity(spark, skewed):
    bridge, ents = skewed
    lab = spark.createDataFrame([(e, f"L{i}") for e, i in bridge], "id long, label string")
    ent = spark.createDataFrame(ents, "id long, attr string, s double")
    comb = bridge_weights(lab, "id", "label").join(ent, "id")
    got = {(r.source, r.target): r["count"] for r in pair_flows(comb, [("attr", "label")], weight="mult").collect()}
    attr = {e: a for e, a, _ in ents}
    want = Counter((attr[e], f"L{i}") for e, i in bridge if e in attr)
    assert got == dict(want)
    # The same from raw bridge rows; items above 2 have no label.
    raw = spark.createDataFrame(bridge, "id long, item long")
    lookup = spark.createDataFrame([(i, f"L{i}") for i in range(3)], "item long, label string")
    comb = label_counts(ent, "id", ["attr"], raw, "id", "item", lookup, "item", "label", "label")
    got = {(r.source, r.target): r["count"] for r in pair_flows(comb, [("attr", "label")], weight="mult").collect()}
    assert got == {k: n for k, n in want.items() if k[1] in ("L0", "L1", "L2")}


def test_share_and_indicators_with_hot_group(spark, skewed):
    _, ents = skewed
    rows = [("hot", "x")] * 200 + [(f"g{i % 7}", "xy"[i % 2]) for i in range(400)]
    s = group_share(spark.createDataFrame(rows, "g string, a string"), "g", "a")
    assert {r.a: r.percentage for r in s.filter("g = 'hot'").collect()} == {"x": 100.0}
    lab = spark.createDataFrame([(1, "L1")] * 500 + [(2, "L2")], "id long, label string")
    ent = spark.createDataFrame(ents, "id long, attr string, s double")
    long = indicator_long(ent, "id", ["attr"], lab, "learn", "label")
    assert sorted((r.id, r.feature, r.label) for r in long.collect()) == [
        (1, "attr", "b"), (1, "learn", "L1"), (2, "attr", "c"), (2, "learn", "L2")]
