from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelcast.functions import NULLS, Missing
from panelcast.operators import breakdown, collapse_small, distribution, equals, group_share, pivot_share

ROWS = [("g1", "Yes"), ("g1", "Yes"), ("g1", "No"), ("g1", None), ("g1", "NA"),
        ("g2", "Yes"), ("g2", None), ("NA", "Yes"), (None, "Yes")]


@pytest.fixture
def answers(spark):
    return spark.createDataFrame(ROWS, "g string, a string")


def _dict(df, k, v):
    return {tuple(r[c] for c in k): r[v] for r in df.collect()}


def test_group_share_all_denominator_counts_missing_answers(answers):
    s = group_share(answers, "g", "a", Missing(values=["NA"]), NULLS, denominator="all")
    got = _dict(s, ["g", "a"], "percentage")
    # g1 has 5 rows (one NULL answer); 'NA' answers stay (K1, K2).
    assert got == pytest.approx({("g1", "Yes"): 40.0, ("g1", "No"): 20.0, ("g1", "NA"): 20.0, ("g2", "Yes"): 50.0})


def test_group_share_answered_adds_to_100(answers):
    s = group_share(answers, "g", "a", Missing(values=["NA"]), Missing(values=["NA"]), denominator="answered")
    totals = s.groupBy("g").agg(F.sum("percentage").alias("t")).collect()
    assert all(abs(r.t - 100.0) < 1e-9 for r in totals)


def test_group_share_equals_self_join(spark, answers):
    answers.createOrReplaceTempView("answers")
    literal = spark.sql("""
        WITH t AS (SELECT g, COUNT(*) AS total FROM answers WHERE g IS NOT NULL AND g != 'NA' GROUP BY g)
        SELECT r.g, r.a, COUNT(*) * 100D / t.total AS percentage
        FROM answers r JOIN t ON r.g = t.g WHERE r.a IS NOT NULL GROUP BY r.g, r.a, t.total""")
    s = group_share(answers, "g", "a", Missing(values=["NA"]), NULLS)
    assert _dict(s, ["g", "a"], "percentage") == pytest.approx(_dict(literal, ["g", "a"], "percentage"))


def test_pivot_share_explicit_values_fill_zero(answers):
    s = group_share(answers, "g", "a", Missing(values=["NA"]), Missing(values=["NA"]))
    w = pivot_share(s, "g", "a", ["Yes", "No", "Never"], sort_by="Yes")
    rows = w.collect()
    assert w.columns == ["g", "Yes", "No", "Never"]
    assert [r.g for r in rows] == ["g2", "g1"]  # sorted by Yes descending
    assert all(r.Never == 0.0 for r in rows)


def test_pivot_share_dotted_value_names(spark):
    s = spark.createDataFrame([("g", "No, but I plan to soon", 10.0), ("g", "v.1", 5.0)], "g string, a string, percentage double")
    w = pivot_share(s, "g", "a", ["No, but I plan to soon", "v.1"])
    assert w.first()["v.1"] == 5.0


def test_distribution_order_and_extra_predicate(spark):
    df = spark.createDataFrame(
        [("Somewhat trust", 1), ("Highly trust", 1), ("Highly trust", None), ("odd", 1), ("NA", 1), (None, 1)],
        "a string, w int")
    d = distribution(df, "a", Missing(values=["NA"]), where=F.col("w").isNotNull(),
                     order=["Highly trust", "Somewhat trust"], default_ord=6)
    assert [(r.a, r.cnt, r.ord) for r in d.collect()] == [("Highly trust", 1, 1), ("Somewhat trust", 1, 2), ("odd", 1, 6)]


def test_collapse_preserves_total_and_threshold(spark):
    rows = [("a", 50), ("b", 45), ("c", 3), ("d", 1), ("e", 1), ("f", None)]
    df = spark.createDataFrame(rows, "label string, cnt long")
    out = dict(collapse_small(df, "label", "cnt", threshold=2).collect())
    assert out == {"a": 50, "b": 45, "c": 3, "Other": 2}
    assert sum(out.values()) == 100


def test_collapse_exact_threshold_kept(spark):
    df = spark.createDataFrame([("a", 99), ("b", 1)], "label string, cnt long")
    assert dict(collapse_small(df, "label", "cnt", threshold=1).collect()) == {"a": 99, "b": 1}


def test_collapse_existing_other(spark):
    df = spark.createDataFrame([("a", 90), ("Other", 9), ("x", 1)], "label string, cnt long")
    merged = Counter(dict(collapse_small(df, "label", "cnt", threshold=5).collect()))
    assert merged == Counter({"a": 90, "Other": 10})
    literal = sorted(collapse_small(df, "label", "cnt", threshold=5, merge_existing=False).collect())
    assert literal == [("Other", 1), ("Other", 9), ("a", 90)]


def test_collapse_empty_input_gives_empty_output(spark):
    df = spark.createDataFrame([], "label string, cnt long")
    assert collapse_small(df, "label", "cnt").count() == 0


def test_collapse_numeric_label_becomes_string(spark):
    df = spark.createDataFrame([(1, 98), (2, 1), (3, 1)], "size int, cnt long")
    out = collapse_small(df, "size", "cnt", threshold=2)
    assert dict(out.collect()) == {"1": 98, "Other": 2}
    assert dict(out.dtypes)["size"] == "string"


def test_breakdown_apostrophe_filter(spark):
    rows = [("I'm not sure", "Dev")] * 98 + [("I'm not sure", "Rare"), ("Yes", "Dev"), ("I'm not sure", "NA")]
    df = spark.createDataFrame(rows, "threat string, dev string")
    out = dict(breakdown(df, "dev", equals("threat", "I'm not sure"), Missing(values=["NA"]), 1.5).collect())
    assert out == {"Dev": 98, "Other": 1}


def test_pivot_share_numeric_answers(spark):
    df = spark.createDataFrame([("g", 1), ("g", 1), ("g", 2), ("h", 2)], "g string, a int")
    w = pivot_share(group_share(df, "g", "a"), "g", "a", [1, 2, 3], sort_by=1)
    assert w.columns == ["g", "1", "2", "3"]
    assert [tuple(r) for r in w.collect()] == [("g", pytest.approx(200 / 3), pytest.approx(100 / 3), 0.0),
                                               ("h", 0.0, 100.0, 0.0)]


def test_pivot_rest_keeps_unlisted_answers(spark):
    from panelcast.operators import group_share, pivot_share

    df = spark.createDataFrame([("g", a) for a in ("Yes", "No", "New", "New")], "g string, a string")
    r = pivot_share(group_share(df, "g", "a"), "g", "a", ["Yes", "No"], rest="rest").first()
    assert (r.Yes, r.No, r.rest) == (25.0, 25.0, 50.0)
