"""Contingency tables, Cramér's V and feature x target association grids
(A12, M1, M2, M3, O6).

Everything is computed from aggregated cells, never from a crosstab brought
to the driver:

* r x c table:  chi2 = n * (sum_ij n_ij^2 / (r_i * c_j) - 1) over non-empty
  cells (empty cells add nothing), V = sqrt(chi2 / n / min(r - 1, c - 1)).
* 2 x 2 indicator pair (feature label f, target label t) among n entities,
  with r entities having f, k having t and n11 having both:
  V = |n * n11 - r * k| / sqrt(r (n - r) k (n - k)).

Pearson chi2 without continuity correction, as in the reference.  V is NULL
where the reference gets NaN or an error: a constant column or a label that
never occurs (K12, T1, T2).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.missing import qcol


def contingency(df: DataFrame, x: str, y: str, count_col: str = "cnt") -> DataFrame:
    """Non-empty cells of the x-by-y table: ``x, y, cnt``.

    Rows with NULL in x or y are left out, as ``pd.crosstab`` does.  The long
    form has one row per non-empty cell; ``df.stat.crosstab`` gives the wide
    form when the label sets are short.
    """
    return (
        df.filter(qcol(x).isNotNull() & qcol(y).isNotNull())
        .groupBy(qcol(x), qcol(y))
        .agg(F.count(F.lit(1)).alias(count_col))
    )


def cramers_v(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: ``chi2, dof, n, v`` for columns x and y (M1).  Without rows in
    which both are known: 0, 0, 0 and NULL."""
    cells = contingency(df, x, y, "_n").select(qcol(x).alias("_x"), qcol(y).alias("_y"), F.col("_n").cast("double").alias("_n"))
    r = cells.groupBy("_x").agg(F.sum("_n").alias("_r"))
    c = cells.groupBy("_y").agg(F.sum("_n").alias("_c"))
    n = r.agg(F.coalesce(F.sum("_r"), F.lit(0.0))).scalar()
    # Null-safe: a plain key would add filters that set the branches' reads apart.
    r, c = r.withColumnRenamed("_x", "_rx"), c.withColumnRenamed("_y", "_cy")
    full = cells.join(r, F.col("_x").eqNullSafe(F.col("_rx"))).join(c, F.col("_y").eqNullSafe(F.col("_cy")))
    e = F.col("_r") * F.col("_c") / n
    s = full.agg(
        F.coalesce(F.sum(F.pow(F.col("_n") - e, 2.0) / e), F.lit(0.0)).alias("_s"),
        F.coalesce(F.sum(e), F.lit(0.0)).alias("_e"),
        F.count_distinct("_x").alias("_rows"),
        F.count_distinct("_y").alias("_cols"),
    ).withColumn("n", n)
    # An empty cell adds its expectation; all expectations add up to n.
    chi2 = F.greatest(F.col("_s") + F.col("n") - F.col("_e"), F.lit(0.0))
    m = F.least(F.col("_rows"), F.col("_cols")) - 1
    v = F.sqrt(F.try_divide(F.try_divide(chi2, F.col("n")), m.cast("double")))
    return s.select(
        chi2.alias("chi2"),
        (F.greatest(F.col("_rows") - 1, F.lit(0)) * F.greatest(F.col("_cols") - 1, F.lit(0))).cast("long").alias("dof"),
        F.col("n").cast("long").alias("n"),
        F.when(m > 0, v).alias("v"),
    )


def _labels(spark, name: str, values: Sequence) -> DataFrame:
    """One-column frame of the given labels (built from the argument list)."""
    arr = F.array(*[F.lit(v) for v in values])
    return spark.range(1).select(F.explode(arr).alias(name))


def association_grid(
    df: DataFrame,
    entity: str,
    x: str,
    y: str,
    features: Sequence,
    targets: Sequence,
    multi_valued: bool = False,
) -> DataFrame:
    """Cramér's V of every (feature label, target label) indicator pair (M2).

    ``df`` holds one row per entity with its x and y value (a single-choice
    answer each).  n counts every entity of ``df`` -- also those whose value is
    not in ``features`` or ``targets`` -- so it matches a 0/1 indicator matrix
    over the same rows.  Pairs that never co-occur get n11 = 0 and are kept:
    the grid is built from the two label lists, not from the data.

    ``multi_valued=True`` accepts several rows per entity (x or y from a
    bridge); all counts then become distinct-entity counts (a NULL entity is
    none).

    Result: ``feature, target, n11, r, k, n, v``; |features| x |targets| rows.
    """
    spark = df.sparkSession
    fl = _labels(spark, "feature", list(features))
    tl = _labels(spark, "target", list(targets))
    grid = fl.select("feature", F.explode(F.array(*[F.lit(t) for t in targets])).alias("target"))
    if multi_valued:
        # Distinct (entity, x, y), (entity, x), (entity, y) and (entity), told
        # apart by a tag, from one pass and one shuffle on all of the key.
        # The counts are conditional sums over the same cells, not filters,
        # so every branch below reuses one exchange and the data are read once.
        e, xc, yc = (F.col(c) for c in ("_e", "_x", "_y"))
        none_x, none_y = (F.lit(None).cast(df.select(qcol(c)).schema[0].dataType) for c in (x, y))
        parts = [F.struct(F.lit(t).alias("t"), u.alias("cf"), v.alias("ct"))
                 for t, (u, v) in enumerate(((xc, yc), (xc, none_y), (none_x, yc), (none_x, none_y)))]
        cells = (
            df.select(qcol(entity).alias("_e"), qcol(x).alias("_x"), qcol(y).alias("_y")).where(e.isNotNull())
            .select("_e", F.explode(F.array(*parts)).alias("_p")).select("_e", "_p.*").distinct()
            .groupBy("t", F.col("cf").alias("_cf"), F.col("ct").alias("_ct")).agg(F.count(F.lit(1)).alias("c"))
        )
        entities = [F.sum(F.when(F.col("t") == t, F.col("c"))) for t in range(4)]
        n11 = cells.groupBy("_cf", "_ct").agg(entities[0].alias("n11"))
        r = cells.groupBy(F.col("_cf").alias("_rf")).agg(entities[1].alias("r"))
        k = cells.groupBy(F.col("_ct").alias("_kt")).agg(entities[2].alias("k"))
        n_total = cells.agg(entities[3]).scalar()
    else:
        # One aggregate of the data; the marginals r, k and the universe size
        # n (which also counts NULL and unlisted values) are sums over its
        # cells.  The joins below use null-safe equality, so the optimizer
        # infers no NOT NULL filter to push under the aggregate: every branch
        # keeps the identical cells plan, its exchange is reused, and the
        # data are read once.  n is a scalar subquery (a global sum of
        # partial sums); no window gathers the cells into one task.
        n11 = df.groupBy(qcol(x).alias("_cf"), qcol(y).alias("_ct")).agg(F.count(F.lit(1)).alias("n11"))
        r = n11.groupBy(F.col("_cf").alias("_rf")).agg(F.sum("n11").alias("r"))
        k = n11.groupBy(F.col("_ct").alias("_kt")).agg(F.sum("n11").alias("k"))
        n_total = n11.agg(F.sum("n11")).scalar()
    g = (
        grid.join(n11, F.col("feature").eqNullSafe(F.col("_cf")) & F.col("target").eqNullSafe(F.col("_ct")), "left")
        .join(r, F.col("feature").eqNullSafe(F.col("_rf")), "left")
        .join(k, F.col("target").eqNullSafe(F.col("_kt")), "left")
        .withColumn("n", n_total)
    )
    g = g.select(
        "feature",
        "target",
        F.coalesce("n11", F.lit(0)).cast("long").alias("n11"),
        F.coalesce("r", F.lit(0)).cast("long").alias("r"),
        F.coalesce("k", F.lit(0)).cast("long").alias("k"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )
    n, a, rr, kk = (F.col(c).cast("double") for c in ("n", "n11", "r", "k"))
    den = F.sqrt(rr * (n - rr) * kk * (n - kk))
    v = F.try_divide(F.abs(n * a - rr * kk), den)
    return g.withColumn("v", F.when(den > 0, v))


def top_associations(grid: DataFrame, k: int = 10, score: str = "v") -> DataFrame:
    """The k strongest pairs: score descending, NULL last, ties by labels."""
    return grid.orderBy(F.col(score).desc_nulls_last(), "feature", "target").limit(k)
