"""The operators placed on the driver's test tables.

Each query takes ``(spark, sf_dir)`` and returns a lazy DataFrame that reads
whole tables.  Sentinel values are picked from real values of the tables so
that every missing-value path runs.  Doubles are rounded (shares to 6
places, means to 4) so the results compare exactly with the DuckDB oracle in
``plans.oracle``; counts are BIGINT.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from panelcast.functions.missing import NULLS, Missing, drop_missing, relabel
from panelcast.operators.adoption import (
    Family,
    adoption_families,
    adoption_vs_demand,
    distinct_entities,
    entity_sketches,
    merged_sketches,
    sketch_counts,
)
from panelcast.operators.association import association_grid, contingency, cramers_v, top_associations
from panelcast.operators.fanout import Bridge, decode, fanout_base, fanout_breakdowns, grouped_avg, histogram, histogram_nice
from panelcast.operators.flow import flow_links, flow_nodes, label_counts, pair_flows, pathway
from panelcast.operators.profile import (
    array_vectors,
    cluster_profiles,
    distinct_vectors,
    fit_clusters,
    indicator_long,
    indicator_vectors,
    indicator_wide,
    normalized,
    principal_components,
    project_2d,
    second_moments,
    silhouette,
    silhouette_sweep,
)
from panelcast.operators.share import breakdown, collapse_small, distribution, equals, group_share, pivot_share
from panelcast.sources.sinks import checkpoint_dir, materialize
from panelcast.sources.store import Results, bucket_count, write_bridge, write_bucketed
from panelcast.sources.tables import table

# Category values of the test tables used as parameters.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
SEGMENT_ORDER = ["MACHINERY", "HOUSEHOLD", "FURNITURE", "BUILDING"]
SEED = 42


def _r(c: str, places: int) -> F.Column:
    return F.round(F.col(c), places).alias(c)


# ---------------------------------------------------------------- shares

def _orders_share_input(spark, d):
    return table(spark, d, "orders").select(
        "o_orderpriority", F.expr("nullif(o_orderstatus, 'F')").alias("o_orderstatus")
    )


def _orders_shares(spark, d):
    return group_share(
        _orders_share_input(spark, d), "o_orderpriority", "o_orderstatus",
        group_missing=Missing(values=["5-LOW"]), answer_missing=NULLS, denominator="all",
    )


def q_group_share(spark: SparkSession, d: str) -> DataFrame:
    s = _orders_shares(spark, d)
    return s.select("o_orderpriority", "o_orderstatus", _r("percentage", 6))


def q_group_share_answered(spark, d):
    docs = table(spark, d, "documents")
    s = group_share(docs, "source", "lang", answer_missing=Missing(values=["es"]), denominator="answered")
    return s.select("source", "lang", _r("percentage", 6))


def q_pivot_share(spark, d):
    w = pivot_share(_orders_shares(spark, d), "o_orderpriority", "o_orderstatus", STATUSES, sort_by="O")
    return w.select("o_orderpriority", *[_r(v, 6) for v in STATUSES])


def q_pivot_share_rest(spark, d):
    """One status listed; the others add up in a column of their own."""
    w = pivot_share(_orders_shares(spark, d), "o_orderpriority", "o_orderstatus", ["O"], rest="rest")
    return w.select("o_orderpriority", *[_r(v, 6) for v in ("O", "rest")])


def q_distribution_ordered(spark, d):
    cust = table(spark, d, "customer")
    return distribution(
        cust, "c_mktsegment", missing=Missing(values=["NA"]), where=F.col("c_acctbal").isNotNull(),
        order=SEGMENT_ORDER, default_ord=6,
    )


def q_distribution(spark, d):
    return distribution(table(spark, d, "events"), "event_type", missing=Missing(values=["error"]))


def q_breakdown_collapsed(spark, d):
    part = table(spark, d, "part")
    return breakdown(part, "p_brand", where=equals("p_type", "MEDIUM"), missing=Missing(values=["NA"]), threshold=4)


def q_relabelled_distribution(spark, d):
    """Part types under other names, two of which become one."""
    new = {"ECONOMY": "Low price", "PROMO": "Low price", "STANDARD": "Ordinary"}
    part = table(spark, d, "part").select(relabel("p_type", new).alias("p_type"))
    return distribution(part, "p_type")


def q_stored_group_share(spark, d):
    """The shares as a stored result: the second call finds what the first wrote."""
    results = Results(spark, f"{checkpoint_dir(spark)}/results")
    call = "group_share", {"group": "o_orderpriority", "answer": "o_orderstatus"}, [f"{d}/orders.parquet"]
    results.get(*call, lambda: q_group_share(spark, d))
    return results.get(*call, lambda: q_group_share(spark, d))


def q_collapse_small(spark, d):
    counts = distribution(table(spark, d, "part"), "p_size")
    return collapse_small(counts, "p_size", "cnt", threshold=2)


# ---------------------------------------------------------------- fan-out

def _order_attrs():
    return {
        "o_orderpriority": F.col("o_orderpriority"),
        "o_orderstatus": F.col("o_orderstatus"),
        "o_year": F.year("o_orderdate"),
    }


def _order_bridges(spark, d):
    li = table(spark, d, "lineitem")
    return [
        Bridge("s_name", li, "l_orderkey", "l_suppkey", table(spark, d, "supplier"), "s_suppkey", "s_name"),
        Bridge("p_type", li, "l_orderkey", "l_partkey", table(spark, d, "part"), "p_partkey", "p_type"),
    ]


def _fanout(spark, d):
    return fanout_base(table(spark, d, "orders"), "o_orderkey", "o_totalprice", measure_name="salary", attrs=_order_attrs(),
                       bridges=_order_bridges(spark, d), lo=0, hi=400000)


def q_fanout_breakdowns(spark, d):
    """Every dimension of the fan-out and its histogram from one pass."""
    out = fanout_breakdowns(table(spark, d, "orders"), "o_orderkey", "o_totalprice", attrs=_order_attrs(), bridges=_order_bridges(spark, d),
                            lo=0, hi=400000, exclude={"o_orderpriority": ["4-NOT SPECIFIED"], "p_type": ["PROMO"]}, bins=(0, 400000, 40))
    return out.select("dim", "value", _r("average", 4), "cnt")


#: Buckets of small tables; larger ones have more.
BUCKETS = 8


def bucketed_inputs(spark, d, buckets=None):
    """(orders, bridges) as tables bucketed by the order, in the shared folder,
    in as many buckets as their rows ask for unless the number is given."""
    run = uuid.uuid4().hex
    root = f"{checkpoint_dir(spark)}/bucketed-{run}"
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    buckets = buckets or bucket_count(orders, lines, least=BUCKETS)
    o = write_bucketed(orders.select("o_orderkey", "o_totalprice", "o_orderpriority"),
                       f"orders_{run}", f"{root}/orders", ["o_orderkey"], buckets)
    li = write_bridge(lines, "l_orderkey", ["l_suppkey", "l_partkey"], f"lineitem_{run}", f"{root}/lineitem", buckets)
    return o, [
        Bridge("s_name", li, "l_orderkey", "l_suppkey", table(spark, d, "supplier"), "s_suppkey", "s_name", mult="mult"),
        Bridge("p_type", li, "l_orderkey", "l_partkey", table(spark, d, "part"), "p_partkey", "p_type", mult="mult"),
    ]


def q_bucketed_fanout_base(spark, d):
    """The fan-out base from bucketed tables: counted and joined without a shuffle."""
    o, bridges = bucketed_inputs(spark, d)
    fb = fanout_base(o, "o_orderkey", "o_totalprice", measure_name="salary", bridges=bridges, lo=0, hi=400000)
    return fb.entities.select("o_orderkey", "salary", "weight")


def q_bucketed_avg_by_item(spark, d):
    """Means by item from bucketed tables: only sums per item are shuffled."""
    o, bridges = bucketed_inputs(spark, d)
    fb = fanout_base(o, "o_orderkey", "o_totalprice", measure_name="salary", bridges=bridges, lo=0, hi=400000)
    return _avg(fb, "p_type", exclude=["PROMO"])


def q_bucketed_pair_flows(spark, d):
    """Priority to part type, each line counted, from bucketed tables."""
    o, (_, b) = bucketed_inputs(spark, d)
    rows = label_counts(o, "o_orderkey", ["o_orderpriority"], b.df, "l_orderkey", "l_partkey", b.lookup, "p_partkey", "p_type",
                        "p_type", mult="mult")
    return pair_flows(rows, [("o_orderpriority", "p_type")], weight="mult")


def q_fanout_base(spark, d):
    return _fanout(spark, d).entities.select("o_orderkey", "salary", "weight")


def _avg(fb, dim, **kw):
    return grouped_avg(fb, dim, avg_col="average_salary", **kw).select(dim, _r("average_salary", 4))


def q_avg_by_attribute(spark, d):
    return _avg(_fanout(spark, d), "o_orderpriority", exclude=["4-NOT SPECIFIED"])


def q_avg_by_status(spark, d):
    return _avg(_fanout(spark, d), "o_orderstatus")


def q_avg_by_item(spark, d):
    return _avg(_fanout(spark, d), "p_type", exclude=["PROMO"])


def q_avg_by_item_keep_null(spark, d):
    return _avg(_fanout(spark, d), "s_name")


def q_avg_by_key_sorted(spark, d):
    return _avg(_fanout(spark, d), "o_year", sort="key")


def q_avg_by_attribute_entity(spark, d):
    return _avg(_fanout(spark, d), "o_orderpriority", exclude=["4-NOT SPECIFIED"], weighting="entity")


def q_histogram(spark, d):
    return histogram(table(spark, d, "orders"), "o_totalprice", 0, 500000, 50, outside=True)


def q_histogram_auto(spark, d):
    h = histogram(table(spark, d, "orders"), "o_totalprice", None, None, 20)
    return h.select("bin", _r("bin_lo", 4), _r("bin_hi", 4), "cnt")


def q_histogram_nice(spark, d):
    h = histogram_nice(table(spark, d, "orders"), "o_totalprice", max_bins=60)
    return h.select("bin", _r("bin_lo", 6), _r("bin_hi", 6), "cnt")


def q_histogram_weighted(spark, d):
    fb = _fanout(spark, d)
    return histogram(fb.entities, "salary", 0, 400000, 40, weight="weight")


# ---------------------------------------------------------------- popularity vs demand

def _li_adoption(spark, d, item, lookup, lookup_id, lookup_label, how="inner"):
    li = table(spark, d, "lineitem")
    return adoption_vs_demand(
        li.filter(F.col("l_returnflag") == "A"), li.filter(F.col("l_returnflag") == "R"),
        "l_orderkey", item, table(spark, d, lookup), lookup_id, lookup_label, how=how,
    )


def q_adoption_vs_demand_part(spark, d):
    return _li_adoption(spark, d, "l_partkey", "part", "p_partkey", "p_name")


def q_adoption_vs_demand_supplier(spark, d):
    return _li_adoption(spark, d, "l_suppkey", "supplier", "s_suppkey", "s_name")


def q_adoption_vs_demand_full(spark, d):
    return _li_adoption(spark, d, "l_partkey", "part", "p_partkey", "p_name", how="full")


def q_entity_sketches(spark, d):
    """Suppliers' distinct orders from the sketches of two loads (lines of odd
    and even number), and how many estimates are off the exact count by more than
    4 standard errors: ``n_items, n_off``, of which the second is 0."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    loads = [li.filter(F.pmod("l_linenumber", F.lit(2)) == r) for r in (0, 1)]
    merged = merged_sketches([entity_sketches(x, "l_orderkey", "l_suppkey") for x in loads])
    exact = distinct_entities(li, "l_orderkey", "l_suppkey", "id", "exact")
    both = sketch_counts(merged).join(exact, "id")
    off = F.abs(F.col("cnt") - F.col("exact")) > F.greatest(F.lit(1.0), F.col("exact") * (4 * 1.04 / 64))
    return both.agg(F.count(F.lit(1)).alias("n_items"), F.count_if(off).alias("n_off"))


def q_adoption_families(spark, d):
    """Parts and suppliers as two families of one plan."""
    li = table(spark, d, "lineitem")
    sides = li.filter(F.col("l_returnflag") == "A"), li.filter(F.col("l_returnflag") == "R")
    return adoption_families([
        Family("part", *sides, "l_orderkey", "l_partkey", table(spark, d, "part"), "p_partkey", "p_name"),
        Family("supplier", *sides, "l_orderkey", "l_suppkey", table(spark, d, "supplier"), "s_suppkey", "s_name"),
    ])


def q_adoption_vs_demand_event(spark, d):
    ev = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").try_cast("long")
    return adoption_vs_demand(
        ev.filter(F.col("event_type") == "click"), ev.filter(F.col("event_type") == "purchase"), "user_id", k,
    )


# ---------------------------------------------------------------- entities, decode, flows

def q_clean_entities(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    joined = docs.join(table(spark, d, "labels"), "doc_id")
    clean = drop_missing(joined, {"source": Missing(prefixes=["src1"]), "lang": Missing(values=["NA"])})
    return clean.select("doc_id", "lang", "source", "quality", "toxic")


def _part_types(spark, d, how="inner"):
    return decode(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", table(spark, d, "part"), "p_partkey",
                  "p_type", how=how, key_name="o_orderkey", label_name="p_type")


def q_decode(spark, d):
    return decode(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", table(spark, d, "part"), "p_partkey",
                  "p_type", label_name="p_type")


def _combined(spark, d):
    ent = table(spark, d, "orders").join(
        table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey"
    ).select("o_orderkey", "c_mktsegment", "o_orderpriority", "o_orderstatus")
    return label_counts(ent, "o_orderkey", ["c_mktsegment", "o_orderpriority", "o_orderstatus"],
                        table(spark, d, "lineitem"), "l_orderkey", "l_partkey",
                        table(spark, d, "part"), "p_partkey", "p_type", "p_type")


PATHWAY = ["c_mktsegment", "p_type", "o_orderpriority"]


def q_pair_flows(spark, d):
    pairs = [("c_mktsegment", "p_type"), ("p_type", "o_orderpriority"), ("p_type", "o_orderstatus")]
    return pair_flows(_combined(spark, d), pairs, weight="mult")


def q_flow_nodes(spark, d):
    return flow_nodes(pathway(_combined(spark, d), PATHWAY, weight="mult"))


def q_flow_links_null(spark, d):
    """Links whose ends may be NULL (one segment and one part type made NULL)."""
    df = _combined(spark, d).withColumns({
        "c_mktsegment": F.expr("nullif(c_mktsegment, 'BUILDING')"), "p_type": F.expr("nullif(p_type, 'PROMO')")})
    f = pathway(df, PATHWAY, weight="mult")
    return flow_links(f)


def q_flow_links(spark, d):
    return flow_links(pathway(_combined(spark, d), PATHWAY, weight="mult"))


# ---------------------------------------------------------------- indicators

def _long(spark, d):
    return indicator_long(
        table(spark, d, "orders"), "o_orderkey", ["o_orderpriority", "o_orderstatus"],
        bridge_labels=_part_types(spark, d), bridge_feature="p_type", bridge_label="p_type",
    )


def q_indicator_long(spark, d):
    return _long(spark, d)


def q_indicator_wide(spark, d):
    return indicator_wide(_long(spark, d), "o_orderkey", PRIORITIES + STATUSES + PART_TYPES)


# ---------------------------------------------------------------- associations

def _order_segments(spark, d):
    cust = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(cust, "o_custkey")


def q_contingency(spark, d):
    return contingency(_order_segments(spark, d), "o_orderpriority", "c_mktsegment")


def _v(df):
    return df.select(_r("chi2", 4), "dof", "n", _r("v", 6))


def q_cramers_v(spark, d):
    return _v(cramers_v(_order_segments(spark, d), "o_orderpriority", "c_mktsegment"))


def _grid(spark, d):
    return association_grid(_order_segments(spark, d), "o_orderkey", "o_orderpriority", "c_mktsegment",
                            PRIORITIES, SEGMENTS)


def _grid_out(g):
    return g.select("feature", "target", "n11", "r", "k", "n", _r("v", 6))


def q_association_grid(spark, d):
    return _grid_out(_grid(spark, d))


def q_association_grid_multi(spark, d):
    """Orders as entities; flags and statuses of their lines, several each."""
    return _grid_out(association_grid(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", "l_linestatus",
                                      ["A", "N", "R", "X"], ["F", "O"], multi_valued=True))


def q_top_associations(spark, d):
    return _grid_out(top_associations(_grid(spark, d), 10))


def q_association_labels(spark, d):
    return _v(cramers_v(table(spark, d, "labels"), "quality", "toxic"))


# ---------------------------------------------------------------- clustering (M5-M9), rows-only checks

def _order_vectors(spark, d):
    long = indicator_long(
        table(spark, d, "orders"), "o_orderkey", ["o_orderpriority"],
        bridge_labels=_part_types(spark, d), bridge_feature="p_type", bridge_label="p_type",
    )
    return indicator_vectors(long, "o_orderkey", PART_TYPES + PRIORITIES)


def _components(vectors, col):
    return vectors.select("o_orderkey", F.posexplode(vector_to_array(F.col(col))).alias("idx", "value"))


def q_indicator_vectors(spark, d):
    return _components(_order_vectors(spark, d), "features")


def q_normalized_vectors(spark, d):
    return _components(normalized(_order_vectors(spark, d)), "normalized_features").withColumn("value", F.round("value", 6))


def q_cluster_profiles(spark, d):
    return cluster_profiles(_order_vectors(spark, d), "o_orderkey", k=3, seed=SEED).select("o_orderkey", "cluster")


def q_project_2d(spark, d):
    clustered = cluster_profiles(_order_vectors(spark, d), "o_orderkey", k=3, seed=SEED)
    return project_2d(clustered, "o_orderkey")


def q_silhouette_sweep(spark, d):
    return silhouette_sweep(_order_vectors(spark, d), seed=SEED)


def q_cluster_embeddings(spark, d):
    vec = array_vectors(table(spark, d, "embeddings"), "vec_id", "embedding")
    return cluster_profiles(vec, "vec_id", k=10, seed=SEED).select("vec_id", "cluster")


def q_distinct_vectors(spark, d):
    """How many orders share each vector."""
    v = distinct_vectors(_order_vectors(spark, d))
    return v.select(F.array_join(F.transform("features", lambda x: x.cast("int")), "").alias("vector"), "weight")


def q_silhouette_labels(spark, d):
    """Silhouette of the embeddings' own labels, taken as clusters."""
    s = silhouette(table(spark, d, "embeddings"), "embedding", "label")
    return s.select(_r("silhouette", 6))


def q_second_moments(spark, d):
    v = normalized(_order_vectors(spark, d))
    return second_moments(v, "normalized_features", dim=len(PART_TYPES + PRIORITIES)).select("i", "j", _r("value", 4))


def q_cluster_centres(spark, d):
    c = fit_clusters(_order_vectors(spark, d), "o_orderkey", k=3, seed=SEED).centres
    return c.select("cluster", "size", F.posexplode("centre").alias("idx", "value"))


def q_cluster_proof(spark, d):
    """What makes a fit one of KMeans, counted over its two result tables:
    rows that another centre is nearer to, and coordinates of centres that are not
    the mean of their rows.  Both counts are 0."""
    fit = fit_clusters(_order_vectors(spark, d), "o_orderkey", k=3, seed=SEED)
    rows = fit.assignments.select("o_orderkey", "cluster", vector_to_array("normalized_features").alias("x"))
    centres = fit.centres.agg(F.collect_list(F.struct("cluster", "centre"))).scalar()

    def square(c):
        return F.aggregate(F.zip_with("x", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)

    far = F.transform("centres", lambda c: F.struct(square(c["centre"]).alias("far"), c["cluster"].alias("cluster")))
    rows = rows.withColumn("centres", centres).withColumn("far", far)
    own = F.filter("far", lambda f: f["cluster"] == F.col("cluster"))[0]["far"]
    nearer = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(own > F.array_min("far")["far"] + 1e-9).alias("n_nearer"))
    means = rows.select("cluster", F.posexplode("x").alias("idx", "v")).groupBy("cluster", "idx").agg(F.avg("v").alias("mean"), F.count("v").alias("m"))
    cells = fit.centres.select("cluster", "size", F.posexplode("centre").alias("idx", "value"))
    off = (means.join(cells, ["cluster", "idx"], "full")
           .agg(F.count(F.lit(1)).alias("n_cells"),
                F.count_if(F.coalesce(F.abs(F.col("mean") - F.col("value")) > 1e-6, F.lit(True)) | (F.col("m") != F.col("size"))).alias("n_off")))
    one = nearer.withColumn("one", F.lit(1)).join(off.withColumn("one", F.lit(1)), "one")
    return one.select("n", "n_nearer", "n_cells", "n_off")


def q_components_proof(spark, d):
    """The principal components against the covariance worked out in SQL from
    the second moments: per component the trace and the entries of
    covariance * v - eigenvalue * v that are not 0.  The distinct vectors are
    stored, so the orders and their lines are read once for both."""
    v = materialize(distinct_vectors(normalized(_order_vectors(spark, d)), "normalized_features"))
    dim = len(PART_TYPES + PRIORITIES)
    comps = principal_components(v, 2, "features", "weight", dim).table(spark)
    m = materialize(second_moments(v, "features", "weight", dim))
    n = m.filter("i = 0 AND j = 0").select("value").scalar()
    left = m.filter("j = 0 AND i > 0").select("i", F.col("value").alias("left"))
    right = m.filter("i = 0 AND j > 0").select("j", F.col("value").alias("right"))
    cov = (m.filter("i > 0 AND j > 0").join(left, "i").join(right, "j")
           .select("i", "j", ((F.col("value") - F.col("left") * F.col("right") / n) / (n - 1)).alias("c")))
    trace = cov.filter("i = j").agg(F.sum("c")).scalar()
    pairs = cov.join(comps.select("component", (F.col("idx") + 1).alias("j"), F.col("loading").alias("vj")), "j")
    product = pairs.groupBy("component", "i").agg(F.sum(F.col("c") * F.col("vj")).alias("cv"))
    own = comps.select("component", (F.col("idx") + 1).alias("i"), F.col("loading").alias("vi"), "eigenvalue")
    out = product.join(own, ["component", "i"]).groupBy("component").agg(
        F.count(F.lit(1)).alias("dims"), F.count_if(F.abs(F.col("cv") - F.col("eigenvalue") * F.col("vi")) > 1e-9).alias("n_off"),
        F.round(F.sum(F.col("vi") * F.col("vi")), 6).alias("length"))
    return out.select("component", "dims", F.round(trace, 6).alias("trace"), "n_off", "length")


QUERIES = {
    "group_share": q_group_share,
    "group_share_answered": q_group_share_answered,
    "stored_group_share": q_stored_group_share,
    "relabelled_distribution": q_relabelled_distribution,
    "bucketed_fanout_base": q_bucketed_fanout_base,
    "bucketed_avg_by_item": q_bucketed_avg_by_item,
    "bucketed_pair_flows": q_bucketed_pair_flows,
    "pivot_share": q_pivot_share,
    "pivot_share_rest": q_pivot_share_rest,
    "distribution_ordered": q_distribution_ordered,
    "distribution": q_distribution,
    "breakdown_collapsed": q_breakdown_collapsed,
    "collapse_small": q_collapse_small,
    "fanout_base": q_fanout_base,
    "avg_by_attribute": q_avg_by_attribute,
    "avg_by_status": q_avg_by_status,
    "avg_by_item": q_avg_by_item,
    "avg_by_item_keep_null": q_avg_by_item_keep_null,
    "avg_by_key_sorted": q_avg_by_key_sorted,
    "avg_by_attribute_entity": q_avg_by_attribute_entity,
    "histogram": q_histogram,
    "histogram_auto": q_histogram_auto,
    "histogram_weighted": q_histogram_weighted,
    "histogram_nice": q_histogram_nice,
    "adoption_vs_demand_part": q_adoption_vs_demand_part,
    "adoption_vs_demand_supplier": q_adoption_vs_demand_supplier,
    "adoption_vs_demand_event": q_adoption_vs_demand_event,
    "adoption_vs_demand_full": q_adoption_vs_demand_full,
    "adoption_families": q_adoption_families,
    "entity_sketches": q_entity_sketches,
    "fanout_breakdowns": q_fanout_breakdowns,
    "clean_entities": q_clean_entities,
    "decode": q_decode,
    "pair_flows": q_pair_flows,
    "flow_nodes": q_flow_nodes,
    "flow_links": q_flow_links,
    "flow_links_null": q_flow_links_null,
    "indicator_long": q_indicator_long,
    "indicator_wide": q_indicator_wide,
    "contingency": q_contingency,
    "cramers_v": q_cramers_v,
    "association_grid": q_association_grid,
    "association_grid_multi": q_association_grid_multi,
    "top_associations": q_top_associations,
    "association_labels": q_association_labels,
    "indicator_vectors": q_indicator_vectors,
    "normalized_vectors": q_normalized_vectors,
    "cluster_profiles": q_cluster_profiles,
    "project_2d": q_project_2d,
    "silhouette_sweep": q_silhouette_sweep,
    "cluster_embeddings": q_cluster_embeddings,
    "distinct_vectors": q_distinct_vectors,
    "silhouette_labels": q_silhouette_labels,
    "second_moments": q_second_moments,
    "cluster_centres": q_cluster_centres,
    "cluster_proof": q_cluster_proof,
    "components_proof": q_components_proof,
}
