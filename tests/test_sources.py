import os
import tempfile

import pytest

from paths import SF001
from panelcast.sources import jdbc_options, load_tables, materialize, table, write_result


def test_load_tables_lists_parquet(spark):
    t = load_tables(spark, SF001)
    assert {"orders", "lineitem", "part"} <= set(t)
    assert t["orders"].count() == 1500


def test_scan_prunes_columns_and_pushes_filters(spark):
    df = table(spark, SF001, "orders").filter("o_totalprice > 1000").select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_jdbc_options_partitioned_query():
    o = jdbc_options("jdbc:x", query="select * from t;", partition_column="id", lower_bound=1,
                     upper_bound=100, num_partitions=4, options={"user": "u"})
    assert o["dbtable"] == "(select * from t) q" and "query" not in o
    assert o["numPartitions"] == "4" and o["fetchsize"] == "1000" and o["user"] == "u"
    assert jdbc_options("jdbc:x", table="t")["dbtable"] == "t"
    assert jdbc_options("jdbc:x", query="select 1")["query"] == "select 1"
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", table="t", query="q")
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", table="t", partition_column="id")


def test_write_and_materialize(spark):
    out = tempfile.mkdtemp(prefix="panelcast-test-")
    df = table(spark, SF001, "part").groupBy("p_type").count()
    write_result(df, os.path.join(out, "r"))
    assert spark.read.parquet(os.path.join(out, "r")).count() == df.count()
    m = materialize(df, os.path.join(out, "m"))
    assert sorted(m.collect()) == sorted(df.collect())
    c = materialize(df)  # reliable checkpoint into spark.checkpoint.dir
    assert sorted(c.collect()) == sorted(df.collect())
