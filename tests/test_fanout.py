"""The weighted fan-out equals the literal left-join chain, computed here by
brute force in plain Python from the fixture rows."""

from collections import defaultdict

import pytest

from fixtures import LANGUAGES, LEARN_CODE, RESPONDENT_LANGUAGE, RESPONDENT_LEARN_CODE, RESPONDENTS
from panelcast.operators import Bridge, decode, fanout_base, grouped_avg, histogram, histogram_nice


def literal_fanout():
    lc, lang = dict(LEARN_CODE), dict(LANGUAGES)
    b1, b2 = defaultdict(list), defaultdict(list)
    for r, i in RESPONDENT_LEARN_CODE:
        b1[r].append(lc.get(i))
    for r, i in RESPONDENT_LANGUAGE:
        b2[r].append(lang.get(i))
    rows = []
    for rid, ind, dev, _a, _acc, _t, _w, sal, ed, years in RESPONDENTS:
        if sal is None or not (0 < sal < 1000000):
            continue
        for m in b1.get(rid) or [None]:
            for p in b2.get(rid) or [None]:
                rows.append(dict(ResponseId=rid, salary=sal, EdLevel=ed, YearsCodePro=years, DevType=dev,
                                 Industry=ind, learn_code_method=m, programming_language=p))
    return rows


def literal_avg(rows, dim, exclude=(), keep_null=False):
    acc = defaultdict(list)
    for r in rows:
        v = r[dim]
        if v is None and not keep_null:
            continue
        if v in exclude:
            continue
        acc[v].append(r["salary"])
    return {k: sum(v) / len(v) for k, v in acc.items()}


@pytest.fixture
def base(survey):
    t = survey
    return fanout_base(
        t["Respondent"], "ResponseId", "CompTotal(USD)", "salary",
        attrs=["EdLevel", "YearsCodePro", "DevType", "Industry"],
        bridges=[Bridge("learn_code_method", t["RespondentLearnCode"], "ResponseId", "id", t["LearnCode"], "id", "name"),
                 Bridge("programming_language", t["RespondentLanguage"], "ResponseId", "id",
                        t["ProgrammingLanguage"], "id", "name")],
        lo=0, hi=1000000,
    )


def _avg(df, dim):
    return {r[dim]: r["average"] for r in df.collect()}


@pytest.mark.parametrize("dim,exclude,keep_null", [
    ("EdLevel", ["Something else"], False),
    ("YearsCodePro", [], True),
    ("DevType", ["Other (please specify):", "NA"], False),
    ("Industry", ["Other:", "NA"], False),
    ("learn_code_method", ["Not Specified"], False),
    ("programming_language", [], True),
])
def test_weighted_equals_literal(base, dim, exclude, keep_null):
    got = _avg(grouped_avg(base, dim, exclude=exclude), dim)
    want = literal_avg(literal_fanout(), dim, exclude, keep_null)
    assert got == pytest.approx(want)


def test_weights_count_literal_rows(base):
    rows = literal_fanout()
    per = defaultdict(int)
    for r in rows:
        per[r["ResponseId"]] += 1
    got = {r.ResponseId: r.weight for r in base.entities.collect()}
    assert got == per


def test_entity_weighting_counts_each_once(base):
    got = _avg(grouped_avg(base, "EdLevel", weighting="entity"), "EdLevel")
    ent = defaultdict(list)
    for r in RESPONDENTS:
        sal, ed = r[7], r[8]
        if sal is not None and 0 < sal < 1000000 and ed is not None:
            ent[ed].append(sal)
    assert got == pytest.approx({k: sum(v) / len(v) for k, v in ent.items()})


def test_sort_orders(base):
    by_val = [r.average for r in grouped_avg(base, "EdLevel").collect()]
    assert by_val == sorted(by_val)
    keys = [r.YearsCodePro for r in grouped_avg(base, "YearsCodePro", sort="key").collect()]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])


def test_weighted_histogram_equals_literal(base):
    rows = literal_fanout()
    h = histogram(base.entities, "salary", 0, 1000000, 100, weight="weight")
    got = {r.bin: r.cnt for r in h.collect()}
    assert len(got) == 100
    want = defaultdict(int)
    for r in rows:
        want[min(int(r["salary"] // 10000), 99)] += 1
    assert {k: v for k, v in got.items() if v} == want
    assert sum(got.values()) == len(rows)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (None,), (11.0,), (-1.0,)], "x double")
    h = {r.bin: (r.bin_lo, r.bin_hi, r.cnt) for r in histogram(df, "x", 0, 10, 2).collect()}
    assert h == {0: (0.0, 5.0, 1), 1: (5.0, 10.0, 2)}
    assert histogram(df, "x", 0, 10, 2, fill_empty=False).count() == 2


def test_decode_inner_and_left(survey):
    t = survey
    inner = decode(t["RespondentLearnCode"], "ResponseId", "id", t["LearnCode"], "id", "name")
    left = decode(t["RespondentLearnCode"], "ResponseId", "id", t["LearnCode"], "id", "name", how="left")
    assert inner.count() == len(RESPONDENT_LEARN_CODE) - 1  # id 99 is dangling
    assert left.filter("name IS NULL").count() == 1


def test_histogram_data_range(spark):
    df = spark.createDataFrame([(2.0,), (4.0,), (6.0,), (10.0,), (None,)], "x double")
    h = {r.bin: (r.bin_lo, r.bin_hi, r.cnt) for r in histogram(df, "x", None, None, 4).collect()}
    assert h == {0: (2.0, 4.0, 1), 1: (4.0, 6.0, 1), 2: (6.0, 8.0, 1), 3: (8.0, 10.0, 1)}
    same = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [(r.bin, r.cnt) for r in histogram(same, "x", None, None, 2).orderBy("bin").collect()] == [(0, 2), (1, 0)]


def test_entity_weighting_on_bridge_dimension(base):
    lc = dict(LEARN_CODE)
    ents = {}
    for r in RESPONDENTS:
        sal = r[7]
        if sal is not None and 0 < sal < 1000000:
            ents[r[0]] = sal
    acc = defaultdict(list)
    for rid, sal in ents.items():
        labels = {lc.get(i) for e, i in RESPONDENT_LEARN_CODE if e == rid} or {None}
        for lab in labels:
            acc[lab].append(sal)
    want = {k: sum(v) / len(v) for k, v in acc.items() if k != "Not Specified"}
    got = {r.learn_code_method: r.average
           for r in grouped_avg(base, "learn_code_method", exclude=["Not Specified"], keep_null=True,
                                weighting="entity").collect()}
    assert got == pytest.approx(want)


def test_histogram_nan_and_outside(spark):
    from panelcast.operators import histogram

    df = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,), (9.0,), (-1.0,), (None,)], "v double")
    assert [r.cnt for r in histogram(df, "v", None, None, 2).orderBy("bin").collect()] == [3, 1]
    got = [(r.bin, r.bin_lo, r.bin_hi, r.cnt) for r in histogram(df, "v", 0, 4, 2, outside=True).orderBy("bin").collect()]
    assert got == [(-1, None, 0.0, 1), (0, 0.0, 2.0, 1), (1, 2.0, 4.0, 1), (2, 4.0, None, 1)]


@pytest.mark.parametrize("values,edges", [
    ([0.0, 100.0], (10.0, 0.0, 11)),                      # 100 is on an edge: a bin of its own
    ([-37.0, -1.0, 4.0, 18.5], (5.0, -40.0, 12)),
    ([0.00012, 0.00031, 0.00029], (0.00002, 0.00012, 10)),
    ([1e9, 1.7e9], (1e8, 1e9, 8)),
    ([7.3, 7.3, 7.3], (1.0, 7.0, 1)),
    ([-2.5], (1.0, -3.0, 1)),
])
def test_nice_edges(spark, values, edges):
    step, first, n = edges
    df = spark.createDataFrame([(v, 2) for v in values] + [(None, 1), (float("nan"), 1), (float("inf"), 1)], "v double, w int")
    rows = sorted(histogram_nice(df, "v", max_bins=12).collect())
    assert [r.bin for r in rows] == list(range(n))
    assert [(r.bin_lo, r.bin_hi) for r in rows] == [(pytest.approx(first + i * step, rel=1e-12, abs=1e-15), pytest.approx(first + (i + 1) * step, rel=1e-12, abs=1e-15)) for i in range(n)]
    for r in rows:
        assert r.cnt == sum(r.bin_lo <= v < r.bin_hi for v in values)
    assert [r.cnt for r in sorted(histogram_nice(df, "v", 12, weight="w").collect())] == [2 * r.cnt for r in rows]


def test_nice_edges_without_values(spark):
    assert histogram_nice(spark.createDataFrame([(None,)], "v double"), "v").collect() == []
    with pytest.raises(ValueError):
        histogram_nice(spark.createDataFrame([(1.0,)], "v double"), "v", max_bins=1)
