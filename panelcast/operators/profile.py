"""Indicator matrices, clustering and a 2-D projection.

Indicators stay long: ``(entity, feature, label)`` rows, one per label an
entity has.  A wide 0/1 table is produced only for an explicit value list,
and ML vectors are built from label sets with a fixed vocabulary, so no data
value ever becomes a column name.

Entities that give the same answers have the same vector, so everything that
is fitted is fitted on :func:`distinct_vectors`: one row per different vector
with the number of entities as its weight.  Fifteen indicators make at most
2^15 rows, whatever the number of respondents; the iterations of KMeans, the
second moments of the projection and the sums of the silhouette read that
table.  It is written once as a reliable checkpoint in the shared
``spark.checkpoint.dir``, laid out by content, so that seeded fits don't
depend on how the input is partitioned.

``fit_clusters``, ``cluster_profiles``, ``principal_components``,
``project_2d`` and ``silhouette_sweep`` run jobs when called, and so does
``second_moments`` without ``dim``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.missing import qcol, relabel
from panelcast.operators.kmeans import assigned_many, kmeans_many
from panelcast.sources.sinks import materialize

#: Different vectors in a partition of the table that fits read.
ROWS_PER_PARTITION = 100_000


def indicator_long(
    entities: DataFrame,
    key: str,
    attrs: Sequence[str],
    bridge_labels: DataFrame | None = None,
    bridge_feature: str = "bridge",
    bridge_label: str = "name",
    require_bridge: bool = True,
    rename: dict | None = None,
) -> DataFrame:
    """Long indicator rows ``key, feature, label``.

    Single-choice ``attrs`` of the entity table give one row per non-NULL
    answer; ``bridge_labels`` (``key, bridge_label``) give one row per distinct
    label of an entity.  Only entities of the entity table count, and with
    ``require_bridge`` only those with at least one bridge label (the
    reference's inner join of pivots).  Rows with a NULL key are left out, as
    a join on the key does.  ``rename`` relabels values; labels that become
    equal count once.

    Plan: entity rows (plus one marker row per entity) and bridge rows are
    stacked and gathered into one set per entity with ``collect_set``, which
    merges map-side, so a hot entity's repeated labels collapse before the
    single shuffle by key.  A set holds an entity's distinct answers -- at
    most its attributes plus the distinct labels of the bridge vocabulary.
    Entities are kept by testing the set (entity side present, bridge side
    present) and the set is exploded back to rows.  Each input is read once.
    """
    rename = rename or {}

    def item(feature, label, src):
        # Relabelled before the sets are built, so labels mapped to one are one row.
        return F.struct(feature.alias("feature"), relabel(label, rename).alias("label"), F.lit(src).alias("src"))

    marker = item(F.lit(None).cast("string"), F.lit(None).cast("string"), 0)
    pairs = F.array(marker, *[item(F.lit(a), qcol(a).cast("string"), 0) for a in attrs])
    rows = entities.filter(qcol(key).isNotNull()).select(qcol(key), F.explode(pairs).alias("_p"))
    if bridge_labels is not None:
        b = bridge_labels.filter(qcol(bridge_label).isNotNull() & qcol(key).isNotNull()).select(
            qcol(key), item(F.lit(bridge_feature), qcol(bridge_label).cast("string"), 1).alias("_p")
        )
        rows = rows.unionByName(b)
    sets = rows.groupBy(qcol(key)).agg(F.collect_set("_p").alias("_ps"))
    keep = F.exists("_ps", lambda x: x["src"] == 0)
    if bridge_labels is not None and require_bridge:
        keep = keep & F.exists("_ps", lambda x: x["src"] == 1)
    out = sets.filter(keep).select(qcol(key), F.explode("_ps").alias("_p")).filter(F.col("_p.label").isNotNull())
    return out.select(qcol(key), F.col("_p.feature").alias("feature"), F.col("_p.label").alias("label"))


def indicator_wide(long: DataFrame, key: str, values: Sequence[str], rest: str | None = None) -> DataFrame:
    """One row per entity, one 0/1 column per listed label.

    A listed label nobody has is all 0.  ``rest`` names a further column that
    is 1 for entities with a label off the list; without it such labels have
    no column.
    Written as one conditional aggregate per label -- what a pivot with an
    explicit value list does -- in a single hash aggregation by entity.
    """
    lab = F.col("label")
    more = [] if rest is None else [F.coalesce(F.max((~lab.isin(list(values))).cast("int")), F.lit(0)).alias(rest)]
    return long.groupBy(qcol(key)).agg(*[
        F.max((lab == F.lit(v)).cast("int")).alias(str(v)) for v in values
    ], *more)


def indicator_vectors(long: DataFrame, key: str, vocab: Sequence[str], out_col: str = "features") -> DataFrame:
    """``key, features``: a sparse 0/1 vector over ``vocab`` per entity (M5).

    Same vector as assembling the 0/1 columns, without a pivot: the per
    entity label set goes through ``CountVectorizerModel`` with a fixed
    vocabulary; labels off the vocabulary are ignored (T12: no NULLs, no NaN).
    """
    sets = long.groupBy(qcol(key)).agg(F.collect_set(F.when(F.col("label").isin(list(vocab)), F.col("label"))).alias("_labels"))
    cv = CountVectorizerModel.from_vocabulary(list(vocab), inputCol="_labels", outputCol=out_col, binary=True)
    return cv.transform(sets).select(qcol(key), out_col)


def array_vectors(df: DataFrame, key: str, array_col: str, out_col: str = "features") -> DataFrame:
    """``key, features`` from a numeric array column (e.g. stored embeddings)."""
    return df.select(qcol(key), array_to_vector(qcol(array_col)).alias(out_col))


def normalized(vectors: DataFrame, in_col: str = "features", out_col: str = "normalized_features") -> DataFrame:
    """L2 row normalisation; a zero vector stays zero (M6)."""
    return Normalizer(inputCol=in_col, outputCol=out_col, p=2.0).transform(vectors)


def _array(df: DataFrame, col: str) -> Column:
    """A vector or array column as array<double>."""
    kind = df.schema[col].dataType.typeName()
    return qcol(col).cast("array<double>") if kind == "array" else vector_to_array(qcol(col))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def distinct_vectors(vectors: DataFrame, features_col: str = "features", weight_col: str | None = None) -> DataFrame:
    """``features (array<double>), weight (long or double)``: each different
    vector once, with its number of rows or the sum of their weights.

    Equal rows are merged before the shuffle, so a vector that a third of all
    entities share costs one row per task.  NULL vectors are left out.
    """
    w = F.lit(1) if weight_col is None else qcol(weight_col)
    rows = vectors.select(_array(vectors, features_col).alias("features"), w.alias("_w")).filter(F.col("features").isNotNull())
    return rows.groupBy("features").agg(F.sum("_w").alias("weight"))


def _canonical(vectors: DataFrame, features_col: str) -> DataFrame:
    """The stored distinct vectors in an order that their content alone fixes:
    partitions by hash, sorted, as many as the number of rows asks for.  A
    seeded fit draws by partition and place, so it gives the same result
    however the input was partitioned."""
    rows = materialize(distinct_vectors(vectors, features_col))
    n = rows.count()
    laid = rows.repartition(max(1, -(-n // ROWS_PER_PARTITION)), "features").sortWithinPartitions("features")
    return materialize(laid.select(array_to_vector("features").alias("features"), F.col("weight").cast("double").alias("weight")))


def _kmeans(rows: DataFrame, k: int, seed: int, max_iter: int, tol: float):
    return KMeans(featuresCol="features", weightCol="weight", predictionCol="cluster", k=int(k), seed=seed, maxIter=max_iter, tol=tol).fit(rows)


@dataclass
class Clusters:
    """``assignments``: key, cluster, normalized_features; ``centres``:
    cluster, size, centre (array<double>)."""

    assignments: DataFrame
    centres: DataFrame


def fit_clusters(
    vectors: DataFrame,
    key: str,
    k: int = 3,
    *,
    seed: int,
    features_col: str = "features",
    max_iter: int = 200,
    tol: float = 1e-9,
) -> Clusters:
    """KMeans on L2-normalised vectors (M5-M7), with the centres as a result.

    ``seed`` is required: an unseeded KMeans changes between processes (T13).
    The fit reads the weighted distinct vectors and runs until no centre moves by more than
    ``tol`` (``max_iter`` at most), so that each centre is the mean of
    its rows and each row is with its nearest centre.  ``size`` counts the
    rows of a cluster; a cluster that lost all rows has size 0.
    """
    norm = materialize(normalized(vectors, features_col).select(qcol(key), "normalized_features"))
    rows = _canonical(norm, "normalized_features")
    model = _kmeans(rows, k, seed, max_iter, tol)
    spark = vectors.sparkSession
    sizes = model.transform(rows).groupBy("cluster").agg(F.sum("weight").cast("long").alias("_size"))
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centre array<double>")
    centres = centres.join(sizes, "cluster", "left").select("cluster", F.coalesce("_size", F.lit(0)).alias("size"), "centre")
    model.setFeaturesCol("normalized_features")
    return Clusters(model.transform(norm).select(qcol(key), "cluster", "normalized_features"), centres)


def cluster_profiles(
    vectors: DataFrame,
    key: str,
    k: int = 3,
    *,
    seed: int,
    features_col: str = "features",
    max_iter: int = 200,
) -> DataFrame:
    """The assignments of :func:`fit_clusters`: ``key, cluster, normalized_features``."""
    return fit_clusters(vectors, key, k, seed=seed, features_col=features_col, max_iter=max_iter).assignments


def second_moments(vectors: DataFrame, features_col: str = "features", weight_col: str | None = None, dim: int | None = None) -> DataFrame:
    """``i, j, value``: weighted sums of x_i * x_j, with x_0 = 1 (M8).

    So (0, 0) is the number of rows, (0, j) the sum of dimension j (from 1),
    and the rest the Gram matrix: one pass over the distinct vectors, one row
    per dimension and task in the shuffle.  ``dim`` is the vectors' length;
    vectors of another length are left out.  If it isn't given, the distinct
    vectors are stored and it is read off one of them, so that ``vectors`` are
    worked out once.  No rows for an empty input.
    """
    rows = distinct_vectors(vectors, features_col, weight_col)
    if dim is None:
        rows = materialize(rows)
        one = rows.select(F.size("features").alias("n")).head()
        dim = one["n"] if one else 0
    x = F.concat(F.array(F.lit(1.0)), F.col("features"))
    rows = rows.filter(F.size("features") == dim).select(F.col("weight").cast("double").alias("_w"), x.alias("_x"))
    left = rows.select("_x", F.posexplode("_x").alias("i", "_xi"), "_w")
    sums = left.groupBy("i").agg(*[F.sum(F.col("_w") * F.col("_xi") * F.col("_x")[j]).alias(f"_{j}") for j in range(dim + 1)])
    return sums.select("i", F.posexplode(F.array(*[f"_{j}" for j in range(dim + 1)])).alias("j", "value"))


@dataclass
class Components:
    """Principal components: ``loadings`` (dim x k, a unit vector per column),
    ``eigenvalues`` of the covariance (divisor n - 1) and ``explained`` shares of its trace."""

    loadings: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    covariance: np.ndarray

    def table(self, spark) -> DataFrame:
        """``component, eigenvalue, explained, idx, loading``, components and dimensions from 1 and 0."""
        rows = [(j + 1, float(self.eigenvalues[j]), float(self.explained[j]), i, float(v))
                for j in range(self.loadings.shape[1]) for i, v in enumerate(self.loadings[:, j])]
        return spark.createDataFrame(rows, "component int, eigenvalue double, explained double, idx int, loading double")


def principal_components(vectors: DataFrame, k: int = 2, features_col: str = "features", weight_col: str | None = None,
                         dim: int | None = None) -> Components:
    """The first ``k`` principal components from the second moments (M8): the
    driver gets (dim + 1)^2 sums, whatever the number of rows, and solves for
    the eigenvectors.  ``dim`` as in :func:`second_moments`.

    Component signs are arbitrary in any PCA; they are fixed so that each
    component's largest-magnitude loading is positive.
    """
    cells = second_moments(vectors, features_col, weight_col, dim).collect()
    if not cells:
        raise ValueError("no vectors")
    m = np.zeros((max(c["i"] for c in cells) + 1,) * 2)
    for c in cells:
        m[c["i"], c["j"]] = c["value"]
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    covariance = (m[1:, 1:] - n * np.outer(mean, mean)) / max(n - 1, 1)
    values, vectors_ = np.linalg.eigh(covariance)
    values, loadings = values[::-1][:k], vectors_[:, ::-1][:, :k]
    loadings = loadings * np.where(loadings[np.abs(loadings).argmax(0), np.arange(loadings.shape[1])] < 0, -1.0, 1.0)
    trace = float(np.trace(covariance))
    return Components(loadings, values, values / trace if trace > 0 else values * 0, covariance)


def project_2d(clustered: DataFrame, key: str, features_col: str = "normalized_features") -> DataFrame:
    """PCA to two components: ``key, cluster, pca_x, pca_y``.

    As Spark ML's PCA does, the data are not centred before projecting (T14: a
    zero vector maps to (0, 0)).  The loadings come from
    :func:`principal_components`, the projection is an expression per row.
    """
    loadings = principal_components(clustered, 2, features_col).loadings
    x = _array(clustered, features_col)
    keep = [qcol(key)] + ([F.col("cluster")] if "cluster" in clustered.columns else [])
    at = [_dot(x, F.array(*[F.lit(float(v)) for v in loadings[:, j]])) if j < loadings.shape[1] else F.lit(0.0) for j in range(2)]
    return clustered.select(*keep, at[0].alias("pca_x"), at[1].alias("pca_y"))


def silhouette(assigned: DataFrame, features_col: str = "features", cluster_col: str = "cluster", weight_col: str | None = None,
               distance: str = "cosine") -> DataFrame:
    """Mean silhouette of given assignments: one row ``silhouette`` (M9).

    The mean distance of a row to a cluster follows from the cluster's size and
    its summed (for ``cosine``: normalised) vectors, so no pairs are formed:
    one aggregate by cluster, then one expression per distinct row that reads
    the k sums as a scalar subquery.  ``distance`` is ``cosine`` (1 - cos; a zero
    vector is at distance 1 from all) or ``squaredEuclidean``.  A row counts ``weight_col`` times,
    as so many equal rows would.  A row alone in its cluster has 0.  NULL
    clusters and vectors are left out; NULL for fewer than two clusters.
    """
    if distance not in ("cosine", "squaredEuclidean"):
        raise ValueError("distance must be 'cosine' or 'squaredEuclidean'")
    w = F.lit(1.0) if weight_col is None else qcol(weight_col).cast("double")
    x = assigned.select(qcol(cluster_col).alias("c"), _array(assigned, features_col).alias("u"), w.alias("w")).filter("c IS NOT NULL AND u IS NOT NULL")
    return _silhouettes(x, [], distance == "cosine")


def _silhouettes(x: DataFrame, by: list[str], cosine: bool) -> DataFrame:
    """``by..., silhouette`` of rows (by..., c, u, w).  The sums of a clustering are as many as its clusters."""
    if cosine:
        length = F.sqrt(_dot(F.col("u"), F.col("u")))
        x = x.withColumn("l", length).withColumn("u", F.transform("u", lambda v: F.when(F.col("l") > 0, v / F.col("l")).otherwise(0.0)))
    points = x.groupBy(*by, "c", "u").agg(F.sum("w").alias("w"))
    square = F.lit(0.0) if cosine else _dot(F.col("u"), F.col("u"))
    sums = points.groupBy(*by, "c").agg(
        F.sum("w").alias("n"), F.sum(F.col("w") * square).alias("q"), Summarizer.mean(array_to_vector("u"), F.col("w")).alias("mean"))
    one = F.struct("c", "n", (F.col("q") / F.col("n")).alias("q"), vector_to_array("mean").alias("mean"))
    clusters = sums.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("k_"))
    p = points.join(clusters, by) if by else points.withColumn("k_", clusters.scalar())

    def far(s):  # mean distance to all rows of the cluster
        return 1 - _dot(F.col("u"), s["mean"]) if cosine else square + s["q"] - 2 * _dot(F.col("u"), s["mean"])

    p = p.withColumn("own", F.filter("k_", lambda s: s["c"] == F.col("c"))[0])
    p = p.withColumn("b", F.array_min(F.transform(F.filter("k_", lambda s: s["c"] != F.col("c")), far)))
    n = F.col("own")["n"]
    itself = 1 - _dot(F.col("u"), F.col("u")) if cosine else F.lit(0.0)  # is in the mean, and 1 for a zero vector
    p = p.withColumn("a", F.when(n > 1, F.greatest(far(F.col("own")) * n - itself, F.lit(0.0)) / (n - 1)))
    one = (F.when(n <= 1, 0.0).when(F.col("a") < F.col("b"), 1 - F.col("a") / F.col("b"))
           .when(F.col("a") > F.col("b"), F.col("b") / F.col("a") - 1).otherwise(0.0))
    total = F.sum(F.when(F.size("k_") > 1, one * F.col("w")))
    return p.groupBy(*by).agg(F.try_divide(total, F.sum("w")).alias("silhouette"))


def silhouette_sweep(
    vectors: DataFrame,
    ks: Sequence[int] = range(3, 51),
    *,
    seed: int,
    features_col: str = "features",
    distance: str = "cosine",
    max_iter: int = 20,
) -> DataFrame:
    """Silhouette of KMeans for each k (M9): ``k, silhouette``, sorted by k.

    The default ``ks`` is 3..50, the sweep the reference describes.  The
    entities' vectors are read once, for the weighted distinct vectors; all
    fits read that table in lockstep (:func:`kmeans_many`), and one more pass scores
    them all.  The result does not depend on how the input is partitioned.
    NULL where a model has fewer than two clusters.
    """
    if distance not in ("cosine", "squaredEuclidean"):
        raise ValueError("distance must be 'cosine' or 'squaredEuclidean'")
    rows = materialize(distinct_vectors(normalized(vectors, features_col), "normalized_features"))
    first = rows.select(F.size("features").alias("n")).head()
    if first is None:
        return vectors.sparkSession.createDataFrame([], "k int, silhouette double")
    models = kmeans_many(rows, first["n"], ks, seed=seed, max_iter=max_iter)
    x = assigned_many(rows, first["n"], models).select("k", F.col("cluster").alias("c"), F.col("features").alias("u"), F.col("weight").alias("w"))
    return _silhouettes(x, ["k"], distance == "cosine").orderBy("k")
