"""Answer distributions, shares within groups and small-category collapse.

All operators are lazy: they return a DataFrame and run no job.

Scale notes
-----------
* Every count is a ``groupBy`` with map-side partial aggregation, so a hot
  answer or group (a third of all rows) is pre-aggregated per input split
  before the shuffle; the shuffle carries one row per (split, key).
* Group totals come from a window over the *aggregated* cells, partitioned by
  the group: one window partition holds at most one row per answer value.
* The grand total of ``collapse_small`` is a scalar subquery; Spark reuses the
  exchange of the aggregate it sums, so the input is scanned once and no
  category row is ever moved to a single partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.missing import NULLS, Missing, as_col, ordinal, qcol


def _pct(num: Column, den: Column) -> Column:
    """``100 * num / den`` as DOUBLE; NULL instead of an error for ``den = 0``."""
    return F.try_divide(F.lit(100.0) * num.cast("double"), den.cast("double"))


def distribution(
    df: DataFrame,
    col: str,
    missing: Missing = NULLS,
    where: Column | None = None,
    order: Sequence | None = None,
    default_ord: int | None = None,
    count_col: str = "cnt",
) -> DataFrame:
    """Count of each answer of ``col`` (A1), missing answers dropped.

    ``where`` adds predicates of the question (P7, K4).  With ``order`` the
    result gets an ``ord`` column (P10) and is sorted by it (O2); ties and
    unlisted values are sorted by the answer text (T15).
    """
    q = df if where is None else df.filter(where)
    q = q.filter(missing.answered(col))
    out = q.groupBy(qcol(col)).agg(F.count(F.lit(1)).alias(count_col))
    if order is not None:
        out = out.withColumn("ord", ordinal(col, order, default_ord)).orderBy("ord", qcol(col))
    return out


def group_share(
    df: DataFrame,
    group: str,
    answer: str,
    group_missing: Missing = NULLS,
    answer_missing: Missing = NULLS,
    denominator: str = "all",
    pct_col: str = "percentage",
) -> DataFrame:
    """Percentage of each answer within each group (A2).

    denominator='all'      -- the group total counts every row of the group,
                              also rows whose answer is missing (the reference
                              behaviour, K1), so shares need not add to 100.
    denominator='answered' -- only answered rows count; shares add to 100.

    Written as one aggregate plus a window over the aggregate instead of a
    self-join of the table with its group totals (J1): one scan, not two.
    """
    if denominator not in ("all", "answered"):
        raise ValueError("denominator must be 'all' or 'answered'")
    base = df.filter(group_missing.answered(group))
    if denominator == "answered":
        base = base.filter(answer_missing.answered(answer))
    cells = base.groupBy(qcol(group), qcol(answer)).agg(F.count(F.lit(1)).alias("_cnt"))
    cells = cells.withColumn("_total", F.sum("_cnt").over(Window.partitionBy(qcol(group))))
    if denominator == "all":
        # Filter after the totals so that the denominators keep missing answers.
        cells = cells.filter(answer_missing.answered(answer))
    return cells.select(qcol(group), qcol(answer), _pct(F.col("_cnt"), F.col("_total")).alias(pct_col))


def pivot_share(
    shares: DataFrame,
    group: str,
    answer: str,
    values: Sequence,
    pct_col: str = "percentage",
    sort_by=None,
    rest: str | None = None,
) -> DataFrame:
    """Long shares -> one row per group, one column per answer value.

    ``values`` is required: no job runs to discover them (P14, T8, T11), and a
    listed answer that never occurs still gets its column, filled with 0.
    ``rest`` names a further column with the summed share of all answers that
    are not listed; without it they have no column.
    ``sort_by`` names one of the values; rows are sorted by it, descending,
    then by the group (T15).
    """
    names = [str(v) for v in values]
    if rest is not None:
        if rest in names:
            raise ValueError("rest is one of the values")
        names.append(rest)
    # A listed answer has one cell per group; the others add up under rest.
    label = qcol(answer).cast("string")
    if rest is not None:
        label = F.when(label.isin(names[:-1]), label).otherwise(F.lit(rest))
    wide = (shares.select(qcol(group), label.alias("_answer"), qcol(pct_col).alias("_pct"))
            .groupBy(qcol(group)).pivot("_answer", names).agg(F.sum("_pct")))
    wide = wide.select(qcol(group), *[F.coalesce(qcol(n), F.lit(0.0)).alias(n) for n in names])
    if sort_by is not None:
        wide = wide.orderBy(qcol(str(sort_by)).desc(), qcol(group))
    return wide


def collapse_small(
    df: DataFrame,
    label: str,
    value: str,
    threshold: float = 1.0,
    other: str = "Other",
    merge_existing: bool = True,
) -> DataFrame:
    """Fold categories whose share of the total is below ``threshold`` % into one
    ``other`` row (A6, with A5, A9, A10, U1 folded in).

    Input: one row per category with a numeric ``value`` (usually a count).
    Output: ``label`` (as string, so that ``other`` fits) and ``value``.
    Rows with a NULL value are dropped (K8).  With ``merge_existing`` an
    existing ``other`` row is merged with the collapsed one; otherwise it stays
    a separate row as in the reference (K7).  Empty input gives empty output
    (T9).  Output rows are not sorted.
    """
    d = df.filter(qcol(value).isNotNull())
    total = d.agg(F.sum(qcol(value))).scalar()
    small = F.coalesce(_pct(qcol(value), total) < F.lit(float(threshold)), F.lit(False))
    lab = F.when(small, F.lit(other)).otherwise(qcol(label).cast("string"))
    d = d.select(lab.alias(label), qcol(value).alias(value), small.alias("_small"))
    keys = [qcol(label)] if merge_existing else [qcol(label), F.col("_small")]
    return d.groupBy(*keys).agg(F.sum(qcol(value)).alias(value)).select(qcol(label), qcol(value))


def breakdown(
    df: DataFrame,
    label: str,
    where: Column | None = None,
    missing: Missing = NULLS,
    threshold: float = 1.0,
    other: str = "Other",
    count_col: str = "cnt",
    merge_existing: bool = True,
) -> DataFrame:
    """Counts of ``label`` among rows matching ``where``, small ones collapsed
    (Q-AI5, Q-AI6: P7 + P2 + A1 + A6 in one plan, no driver round trip)."""
    counts = distribution(df, label, missing=missing, where=where, count_col=count_col)
    return collapse_small(counts, label, count_col, threshold=threshold, other=other, merge_existing=merge_existing)


def equals(col: str, value) -> Column:
    """Predicate ``col = value`` with the value bound as a literal.

    No quoting by hand: values with apostrophes (``I'm not sure``) are safe.
    """
    return as_col(col) == F.lit(value)

