import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from panelcast.operators import (
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


@pytest.fixture(scope="module")
def people(spark):
    ent = spark.createDataFrame(
        [(i, ["hs", "bsc", "msc"][i % 3], ["dev", "ops"][i % 2]) for i in range(1, 61)] + [(99, "bsc", None)],
        "id long, ed string, role string")
    methods = ["books", "school", "job", "friend"]
    br = spark.createDataFrame(
        [(i, methods[i % 4]) for i in range(1, 61)] + [(i, methods[(i + 1) % 4]) for i in range(1, 61, 2)]
        + [(5, "books"), (5, "books"), (200, "school"), (99, "off-vocab")],
        "id long, name string")
    return ent, br


def test_indicator_long_semi_join_and_dedupe(people):
    ent, br = people
    long = indicator_long(ent, "id", ["ed", "role"], br, "learn", "name", rename={"hs": "High school"})
    ids = {r.id for r in long.select("id").distinct().collect()}
    assert 200 not in ids  # bridge label of an unknown entity
    rows = long.filter("id = 5 AND feature = 'learn'").collect()
    assert sorted(r.label for r in rows) == ["books", "job", "school"]  # duplicate pair counted once (T17)
    assert long.filter("label = 'hs'").count() == 0 and long.filter("label = 'High school'").count() == 20
    assert long.filter("id = 99 AND feature = 'role'").count() == 0  # NULL answer gives no row


def test_indicator_without_bridge_requirement(spark, people):
    ent, _ = people
    br = spark.createDataFrame([(1, "books")], "id long, name string")
    assert indicator_long(ent, "id", ["ed"], br, "learn", "name").select("id").distinct().count() == 1
    assert indicator_long(ent, "id", ["ed"], br, "learn", "name", require_bridge=False).select("id").distinct().count() == 61


def test_wide_and_vectors_agree(people):
    ent, br = people
    long = indicator_long(ent, "id", ["ed"], br, "learn", "name")
    vocab = ["books", "school", "job", "friend", "hs", "bsc", "msc", "never"]
    wide = {r.id: [r[v] for v in vocab] for r in indicator_wide(long, "id", vocab).collect()}
    vec = indicator_vectors(long, "id", vocab)
    arr = {r.id: [int(x) for x in r.a] for r in vec.select("id", vector_to_array("features").alias("a")).collect()}
    assert wide == arr
    assert all(v[-1] == 0 for v in wide.values())
    assert arr[99] == [0, 0, 0, 0, 0, 1, 0, 0]  # off-vocabulary label ignored


def test_normalizer_keeps_zero_rows(spark):
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame([(1, Vectors.dense([0.0, 0.0])), (2, Vectors.dense([3.0, 4.0]))], ["id", "features"])
    got = {r.id: r.normalized_features.toArray().tolist() for r in normalized(df).collect()}
    assert got == {1: [0.0, 0.0], 2: [0.6, 0.8]}


@pytest.fixture(scope="module")
def vectors(people):
    ent, br = people
    long = indicator_long(ent, "id", ["ed"], br, "learn", "name")
    return indicator_vectors(long, "id", ["books", "school", "job", "friend", "hs", "bsc", "msc"])


def test_kmeans_repeatable_and_sized(vectors):
    a = {r.id: r.cluster for r in cluster_profiles(vectors, "id", k=3, seed=42).collect()}
    b = {r.id: r.cluster for r in cluster_profiles(vectors, "id", k=3, seed=42).collect()}
    assert a == b
    assert len(a) == vectors.count() and set(a.values()) <= {0, 1, 2}


def test_pca_projection(vectors):
    clustered = cluster_profiles(vectors, "id", k=3, seed=42)
    proj = project_2d(clustered, "id")
    assert proj.columns == ["id", "cluster", "pca_x", "pca_y"]
    pts = np.array([[r.pca_x, r.pca_y] for r in proj.collect()])
    assert pts.shape == (vectors.count(), 2) and np.isfinite(pts).all()


def test_silhouette_in_range(vectors):
    s = silhouette_sweep(vectors, [2, 3], seed=42).collect()
    assert [r.k for r in s] == [2, 3]
    assert all(-1.0 <= r.silhouette <= 1.0 for r in s)


def test_indicators_relabel_before_dedupe_and_drop_null_keys(spark):
    ent = spark.createDataFrame([(1, "x"), (None, "x")], "id int, a string")
    br = spark.createDataFrame([(1, "p"), (1, "q"), (None, "p")], "id int, name string")
    long = indicator_long(ent, "id", ["a"], br, "b", "name", rename={"p": "r", "q": "r"})
    assert sorted(map(tuple, long.collect())) == [(1, "a", "x"), (1, "b", "r")]
    wide = indicator_wide(long, "id", ["x"], rest="rest").collect()
    assert [tuple(r) for r in wide] == [(1, 1, 1)]


# ------------------------------------------------------------------ weighted distinct vectors

def groups(spark, n=240, seed=1, parts=4):
    """Rows of three well-separated groups, most of them copies."""
    rng = np.random.default_rng(seed)
    base = [rng.dirichlet(np.ones(6) * 0.3) + np.eye(6)[2 * g] * 4 for g in range(3) for _ in range(8)]
    rows = [(i, [float(round(x, 3)) for x in base[int(rng.integers(24))]]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, features array<double>").repartition(parts)


def brute_silhouette(points, clusters, cosine=True):
    p, c = np.asarray(points, float), np.asarray(clusters)
    if cosine:
        length = np.linalg.norm(p, axis=1, keepdims=True)
        u = np.divide(p, length, out=np.zeros_like(p), where=length > 0)
        far = 1 - u @ u.T
    else:
        far = ((p[:, None] - p[None]) ** 2).sum(-1)
    np.fill_diagonal(far, 0)
    out = []
    for i in range(len(p)):
        own = c == c[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = far[i, own].sum() / (own.sum() - 1)
        b = min(far[i, c == o].mean() for o in set(c.tolist()) - {c[i]})
        out.append(1 - a / b if a < b else b / a - 1 if a > b else 0.0)
    return float(np.mean(out))


def test_distinct_vectors_sum_weights(spark):
    df = spark.createDataFrame([([1.0, 0.0], 2), ([1.0, 0.0], 3), ([0.0, -0.0], 1), ([0.0, 0.0], 1), (None, 9)], "v array<double>, w int")
    got = {tuple(r.features): r.weight for r in distinct_vectors(df, "v", "w").collect()}
    assert got == {(1.0, 0.0): 5, (0.0, 0.0): 2}
    assert {r.weight for r in distinct_vectors(df, "v").collect()} == {2}


def test_weighted_fit_equals_unweighted(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    df = groups(spark)
    fit = fit_clusters(df.select("id", array_to_vector("features").alias("features")), "id", k=3, seed=5)
    plain = KMeans(featuresCol="normalized_features", k=3, seed=5, maxIter=200, tol=1e-9).fit(
        normalized(df.select("id", array_to_vector("features").alias("features"))))
    ours = sorted(tuple(r.centre) for r in fit.centres.collect())
    assert np.allclose(ours, sorted(map(tuple, plain.clusterCenters())), atol=1e-9)
    assert sum(r["size"] for r in fit.centres.collect()) == 240


def test_fit_does_not_depend_on_partitioning(spark):
    from pyspark.ml.functions import array_to_vector

    def fitted(parts):
        df = groups(spark, parts=parts).select("id", array_to_vector("features").alias("features"))
        fit = fit_clusters(df, "id", k=5, seed=3)
        return ({r.id: r.cluster for r in fit.assignments.collect()},
                {r.cluster: (r["size"], [round(x, 9) for x in r.centre]) for r in fit.centres.collect()})

    assert fitted(1) == fitted(211)


def test_fits_read_distinct_rows(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector

    from panelcast.operators import profile

    seen = []
    for name in ("_kmeans", "kmeans_many"):
        monkeypatch.setattr(profile, name, lambda rows, *a, f=getattr(profile, name), **k: seen.append(
            (rows.count(), rows._jdf.queryExecution().toString())) or f(rows, *a, **k))
    df = groups(spark).select("id", array_to_vector("features").alias("features"))
    silhouette_sweep(df, [2, 3], seed=1)
    fit_clusters(df, "id", 2, seed=1)
    assert len(seen) == 2
    for n, plan in seen:
        assert n <= 24 and "Scan ExistingRDD" in plan  # 240 rows, 24 different vectors, stored


def test_sweep_does_not_depend_on_partitioning_and_finds_the_groups(spark):
    from pyspark.ml.functions import array_to_vector

    def swept(parts):
        df = groups(spark, parts=parts).select("id", array_to_vector("features").alias("features"))
        return {r.k: r.silhouette for r in silhouette_sweep(df, [2, 3, 4, 30], seed=3).collect()}

    one, many = swept(1), swept(97)
    assert one == pytest.approx(many, abs=1e-9)
    assert max(one, key=lambda k: one[k] if k < 30 else -1) == 3


def test_lockstep_models_are_kmeans_models(spark):
    from panelcast.operators.kmeans import assigned_many, kmeans_many

    rows = distinct_vectors(groups(spark, n=500)).cache()
    models = kmeans_many(rows, 6, [1, 3, 5, 40], seed=2, max_iter=100, tol=1e-12)
    assert [len(models[k]) for k in (1, 3, 5)] == [1, 3, 5] and len(models[40]) <= rows.count()
    out = assigned_many(rows, 6, models).toPandas()
    for k, part in out.groupby("k"):
        x, w, c = np.stack(part["features"]), part["weight"].to_numpy(), part["cluster"].to_numpy()
        far = np.square(x[:, None] - models[k][None]).sum(-1)
        assert (far[np.arange(len(x)), c] <= far.min(1) + 1e-12).all()
        for j in set(c.tolist()):
            assert np.allclose(models[k][j], np.average(x[c == j], axis=0, weights=w[c == j]), atol=1e-9)
    assert kmeans_many(rows, 6, [], seed=1) == {}
    assert kmeans_many(rows.limit(0), 6, [2], seed=1)[2].shape == (0, 6)


@pytest.mark.parametrize("distance", ["cosine", "squaredEuclidean"])
def test_silhouette_equals_all_pairs_and_evaluator(spark, distance):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    df = groups(spark).selectExpr("id", "features", "CASE WHEN id = 7 THEN 9 ELSE id % 4 END AS cluster")
    rows = df.collect()
    want = brute_silhouette([r.features for r in rows], [r.cluster for r in rows], distance == "cosine")
    got = silhouette(df, distance=distance).first().silhouette
    assert got == pytest.approx(want, abs=1e-9)
    ev = ClusteringEvaluator(featuresCol="v", predictionCol="cluster", distanceMeasure=distance)
    assert got == pytest.approx(ev.evaluate(df.withColumn("v", array_to_vector("features")).selectExpr("v", "CAST(cluster AS DOUBLE) cluster")), abs=1e-6)
    weighted = df.groupBy("cluster", "features").count()
    assert silhouette(weighted, weight_col="count", distance=distance).first().silhouette == pytest.approx(want, abs=1e-9)


def test_silhouette_of_odd_input(spark):
    schema = "features array<double>, cluster int"
    one = silhouette(spark.createDataFrame([([1.0, 0.0], 1), ([0.0, 1.0], 1)], schema)).collect()
    none = silhouette(spark.createDataFrame([], schema)).collect()
    assert [r.silhouette for r in one] == [None] and [r.silhouette for r in none] == [None]
    rows = [([1.0, 0.0], 1), ([0.0, 0.0], 1), ([0.0, 1.0], 2), ([1.0, 0.0], 2), (None, 1), ([1.0, 1.0], None)]
    got = silhouette(spark.createDataFrame(rows, schema)).first().silhouette
    assert got == pytest.approx(brute_silhouette([r[0] for r in rows[:4]], [r[1] for r in rows[:4]]), abs=1e-12)


def test_second_moments_and_components(spark):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    df = groups(spark)
    x = np.array([r.features for r in df.collect()])
    one = np.hstack((np.ones((len(x), 1)), x))
    got = {(r.i, r.j): r.value for r in second_moments(df).collect()}
    assert len(got) == 49 and all(v == pytest.approx((one[:, i] * one[:, j]).sum()) for (i, j), v in got.items())
    c = principal_components(df, 2)
    assert np.allclose(c.covariance, np.cov(x.T))
    assert np.abs(c.covariance @ c.loadings - c.loadings * c.eigenvalues).max() < 1e-12
    model = PCA(k=2, inputCol="v", outputCol="p").fit(df.select(array_to_vector("features").alias("v")))
    assert np.allclose(np.abs(c.loadings), np.abs(model.pc.toArray()), atol=1e-9)
    assert np.allclose(c.explained, model.explainedVariance.toArray())
    theirs = {r.id: r.p.toArray() for r in model.transform(df.select("id", array_to_vector("features").alias("v"))).collect()}
    for r in project_2d(df, "id", "features").collect():
        assert np.allclose(np.abs([r.pca_x, r.pca_y]), np.abs(theirs[r.id]), atol=1e-9)
    assert second_moments(df.limit(0)).collect() == []


def test_second_moments_work_out_their_input_once(spark):
    sc = spark.sparkContext
    worked = sc.accumulator(0)

    def noted(r):
        worked.add(1)
        return r

    rows = sc.parallelize([([float(i % 3), float(i % 2)],) for i in range(60)], 4).map(noted)
    df = spark.createDataFrame(rows, "features array<double>")
    got = {(r.i, r.j): r.value for r in second_moments(df).collect()}
    assert worked.value == 60
    assert got[0, 0] == 60 and got[1, 2] == sum((i % 3) * (i % 2) for i in range(60)) == got[2, 1]


def test_components_proof_reads_each_table_once(spark, tmp_path, monkeypatch):
    from panelcast.operators import profile
    from panelcast.plans import testbed
    from panelcast.sources import sinks

    kinds, priorities = testbed.PART_TYPES, testbed.PRIORITIES
    for what, rows, schema in (
            ("orders", [(o, priorities[o % 5]) for o in range(80)], "o_orderkey long, o_orderpriority string"),
            ("lineitem", [(o, p) for o in range(80) for p in {o % 6, o // 7 % 6}], "l_orderkey long, l_partkey long"),
            ("part", list(enumerate(kinds)), "p_partkey long, p_type string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{what}.parquet")
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df

    # What is stored, what the driver gets, and the result.
    for module in (profile, testbed):
        monkeypatch.setattr(module, "materialize", lambda df, path=None: sinks.materialize(seen(df), path))
        monkeypatch.setattr(module, "second_moments", lambda *a, f=module.second_moments, **k: seen(f(*a, **k)))
    rows = seen(testbed.q_components_proof(spark, str(tmp_path))).collect()
    assert len(plans) == 5 and [p.count("parquet") for p in plans] == [3, 0, 0, 0, 0], plans
    x = np.zeros((80, 11))
    for o in range(80):
        for p in {o % 6, o // 7 % 6}:
            x[o, p] = 1
        x[o, 6 + o % 5] = 1
    trace = np.trace(np.cov((x / np.sqrt((x * x).sum(1))[:, None]).T))
    assert [(r.component, r.dims, r.n_off) for r in sorted(rows)] == [(1, 11, 0), (2, 11, 0)]
    assert all(r.trace == pytest.approx(trace, abs=1e-6) and r.length == 1 for r in rows)
