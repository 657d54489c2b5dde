from pyspark.sql import functions as F

from panelcast.functions import Missing, clean_label, drop_missing, excluding, in_open_range, ordinal, relabel


def _vals(df, col):
    return sorted((r[0] for r in df.select(col).collect()), key=lambda v: (v is None, v))


def test_missing_nulls_values_prefixes(spark):
    df = spark.createDataFrame([("a",), ("NA",), ("Other:",), ("Other: x",), (None,), ("b",)], "c string")
    assert _vals(drop_missing(df, {"c": Missing(values=["NA", "Other:"])}), "c") == ["Other: x", "a", "b"]
    assert _vals(drop_missing(df, {"c": Missing(values=["NA"], prefixes=["Other:"])}), "c") == ["a", "b"]
    kept = drop_missing(df, {"c": Missing(nulls=False, values=["NA"])})
    assert _vals(kept, "c") == ["Other:", "Other: x", "a", "b", None]


def test_answered_never_null(spark):
    df = spark.createDataFrame([(None,), ("x",)], "c string")
    out = df.select(Missing(values=["NA"]).answered("c").alias("ok")).collect()
    assert sorted(r.ok for r in out) == [False, True]


def test_open_range_drops_null_and_ends(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (0.0,), (0.01,), (999999.99,), (1000000.0,)], "x double")
    assert _vals(df.filter(in_open_range("x", 0, 1000000)), "x") == [0.01, 999999.99]


def test_excluding_null_handling(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    assert _vals(df.filter(excluding("c", ["a"])), "c") == ["b"]
    assert _vals(df.filter(excluding("c", ["a"], keep_null=True)), "c") == ["b", None]
    # Same as the reference's != filter, which drops NULL rows too.
    assert _vals(df.filter(F.col("c") != "a"), "c") == ["b"]


def test_ordinal_and_default(spark):
    df = spark.createDataFrame([("Highly trust",), ("Highly distrust",), ("odd",)], "c string")
    order = ["Highly trust", "Somewhat trust", "Neither trust nor distrust", "Somewhat distrust", "Highly distrust"]
    got = dict(df.select("c", ordinal("c", order).alias("o")).collect())
    assert got == {"Highly trust": 1, "Highly distrust": 5, "odd": 6}


def test_relabel_values_with_dots(spark):
    df = spark.createDataFrame([("School (i.e., University, College, etc)",), ("Colleague",), (None,)], "c string")
    m = {"School (i.e., University, College, etc)": "School (University or College)"}
    assert _vals(df.select(relabel("c", m).alias("c")), "c") == ["Colleague", "School (University or College)", None]


def test_clean_label_strips_tabs_and_newlines(spark):
    df = spark.createDataFrame([(" \ta\n ",), ("b",)], "c string")
    assert _vals(df.select(clean_label("c").alias("c")), "c") == ["a", "b"]
    # Spark's trim keeps the tab and newline.
    assert len(df.select(F.trim("c")).first()[0]) == 3


def test_dense_index_matches_dense_rank(spark):
    from pyspark.sql import Window

    from panelcast.functions import dense_index

    df = spark.range(0, 5000).select((F.col("id") % 97).alias("a"), (F.col("id") % 7).cast("string").alias("b"))
    got = {(r.a, r.b): r.id for r in dense_index(df, ["a", "b"], partitions=5).collect()}
    ranked = df.distinct().select("a", "b", (F.dense_rank().over(Window.orderBy("a", "b")) - 1).alias("id"))
    assert got == {(r.a, r.b): r.id for r in ranked.collect()}
    assert sorted(got.values()) == list(range(len(got)))


def test_dense_index_without_exchange_reuse(spark):
    from panelcast.functions import dense_index

    was = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.range(330_000).selectExpr("concat('k', xxhash64(id)) AS k")
        r = dense_index(df, ["k"]).selectExpr("count(*) n", "count(DISTINCT id) d", "min(id) lo", "max(id) hi").first()
        assert (r.n, r.d, r.lo, r.hi) == (330_000, 330_000, 0, 329_999)
    finally:
        spark.conf.set("spark.sql.exchange.reuse", was)
