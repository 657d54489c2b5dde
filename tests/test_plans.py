"""Plan shape of every registered query (final AQE plans at sf0.001).

No cartesian or nested-loop joins, no Python UDFs, column pruning into the
parquet scans, and each input read once by the queries whose plans were
restructured for that.
"""

import re

import pytest

from paths import SF001
from panelcast.plans.testbed import QUERIES

ML = {"cluster_profiles", "project_2d", "silhouette_sweep", "cluster_embeddings", "cluster_centres", "cluster_proof", "components_proof"}
NAMES = sorted(set(QUERIES) - ML)
# flow_nodes and flow_links store parts of their plans: test_flows_read_each_table_once_over_all_jobs.
READ_ONCE = ["pair_flows", "association_grid", "association_grid_multi", "top_associations",
             "indicator_long", "indicator_wide", "group_share", "pivot_share", "collapse_small",
             "breakdown_collapsed", "cramers_v", "histogram", "distribution", "fanout_breakdowns"]


def final_plan(df) -> str:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    # The tree with its subqueries, without the initial plan that each adaptive node also shows.
    out, skip = [], None
    for line in plan.split("\n"):
        depth = len(line) - len(line.lstrip(" :+-*"))
        if skip is not None and depth >= skip:
            continue
        skip = None
        if "== Initial Plan ==" in line:
            skip = line.index("==")
            continue
        out.append(line)
    return "\n".join(out)


@pytest.fixture(scope="module")
def plans(spark):
    return {n: final_plan(QUERIES[n](spark, SF001)) for n in NAMES}


@pytest.mark.parametrize("name", NAMES)
def test_no_quadratic_joins_or_python(plans, name):
    p = plans[name]
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert "FileScan parquet" in p or "ReusedExchange" in p or (name == "flow_nodes" and "Scan ExistingRDD" in p)


@pytest.mark.parametrize("name", NAMES)
def test_scans_are_pruned(plans, name):
    for schema in re.findall(r"ReadSchema: (struct<[^>]*>)", plans[name]):
        assert "text:" not in schema and "html:" not in schema, schema


@pytest.mark.parametrize("name", READ_ONCE)
def test_each_table_read_once(plans, name):
    tables = re.findall(r"Location: InMemoryFileIndex\(1 paths\)\[file:[^\]]*/(\w+)\.parquet", plans[name])
    assert tables
    assert len(tables) == len(set(tables)), sorted(tables)


def test_filters_reach_the_scan(plans):
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,0.0), LessThan(o_totalprice,400000.0)" \
        in plans["avg_by_attribute_entity"]


def test_missing_answer_filters_reach_the_scan(plans):
    assert "PushedFilters: [IsNotNull(o_orderpriority), Not(EqualTo(o_orderpriority,5-LOW))]" in plans["group_share"]
    assert "IsNotNull(c_mktsegment)" in plans["distribution_ordered"]
    assert "Not(StringStartsWith(source,src1))" in plans["clean_entities"]


def test_no_single_task_windows(plans):
    # Grand totals are scalar subqueries; node ids come from dense_index.
    for name in ("association_grid", "top_associations", "collapse_small", "breakdown_collapsed", "cramers_v"):
        assert "Window [" not in plans[name], name
    for name in ("flow_nodes", "flow_links"):
        assert "dense_rank" not in plans[name], name


TABLE = r"Location: InMemoryFileIndex\(1 paths\)\[file:[^\]]*/(\w+)\.parquet"


@pytest.mark.parametrize("name", ["flow_nodes", "flow_links", "flow_links_null"])
def test_flows_read_each_table_once_over_all_jobs(spark, monkeypatch, name):
    from panelcast.functions import ranking
    from panelcast.operators import flow
    from panelcast.sources import sinks

    stored = []

    def noted(df, path=None):
        stored.append(df._jdf.queryExecution().executedPlan().toString())
        return sinks.materialize(df, path)

    monkeypatch.setattr(flow, "materialize", noted)
    monkeypatch.setattr(ranking, "materialize", noted)
    last = final_plan(QUERIES[name](spark, SF001))
    tables = [t for p in [*stored, last] for t in re.findall(TABLE, p)]
    assert sorted(tables) == ["customer", "lineitem", "orders", "part"]


def test_families_share_one_distinct_count(plans):
    # One exchange by (family, item, entity) for both sides of all families.
    assert len(re.findall(r"Exchange hashpartitioning\(_f#\d+, id#\d+, _e#\d+", plans["adoption_families"])) == 1
