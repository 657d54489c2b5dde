"""Popularity versus demand: distinct entities per item in two bridges."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.missing import as_col, qcol


def distinct_entities(bridge: DataFrame, entity: str | Column, item: str | Column, item_name: str, count_col: str,
                      approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """``COUNT(DISTINCT entity) GROUP BY item`` with NULL items left out.

    Spark plans the exact form as two aggregates: first on (item, entity),
    hash-partitioned on both, then on item.  A hot item is therefore spread
    over all shuffle partitions by its entities, not sent to one task.
    ``approx=True`` switches to HyperLogLog++ (one pass, bounded state).
    """
    it, en = as_col(item), as_col(entity)
    b = bridge.select(it.alias(item_name), en.alias("_entity")).filter(F.col(item_name).isNotNull())
    agg = F.approx_count_distinct("_entity", rsd) if approx else F.count_distinct("_entity")
    return b.groupBy(item_name).agg(agg.alias(count_col))


def adoption_vs_demand(
    worked: DataFrame,
    want: DataFrame,
    entity: str | Column,
    item: str | Column,
    lookup: DataFrame | None = None,
    lookup_id: str | None = None,
    lookup_label: str | None = None,
    how: str = "inner",
    item_name: str = "id",
    label_name: str = "name",
    approx: bool = False,
    sort: bool = True,
) -> DataFrame:
    """Distinct entities per item among those who worked with it (``cnt``) and
    those who want to (``want_cnt``), with the item's label.

    how='inner' -- only items present in both bridges, and in the lookup (K9).
    how='full'  -- every item of either bridge, missing counts as 0, label kept
                   NULL when the lookup lacks the item.

    Both sides are aggregated before they are joined, so the join sees one
    row per item.  The lookup join is left to AQE: a small lookup becomes a
    broadcast from its measured size, a large one stays a shuffle join.
    Sorted by ``cnt + want_cnt`` descending, then by item (O5, T15).
    """
    if how not in ("inner", "full"):
        raise ValueError("how must be 'inner' or 'full'")
    t = distinct_entities(worked, entity, item, item_name, "cnt", approx)
    w = distinct_entities(want, entity, item, item_name, "want_cnt", approx)
    if how == "inner":
        j = t.join(w, item_name, "inner")
    else:
        j = t.join(w, item_name, "full").select(
            item_name,
            F.coalesce("cnt", F.lit(0)).alias("cnt"),
            F.coalesce("want_cnt", F.lit(0)).alias("want_cnt"),
        )
    cols = [item_name, "cnt", "want_cnt"]
    if lookup is not None:
        lu = lookup.select(qcol(lookup_id).alias(item_name), qcol(lookup_label).alias(label_name))
        j = j.join(lu, item_name, "inner" if how == "inner" else "left")
        cols = [item_name, label_name, "cnt", "want_cnt"]
    j = j.select(*cols)
    if sort:
        j = j.orderBy((F.col("cnt") + F.col("want_cnt")).desc(), F.col(item_name))
    return j


@dataclass(frozen=True)
class Family:
    """One question of a series: who worked with, and who wants, each item."""

    name: str
    worked: DataFrame
    want: DataFrame
    entity: str | Column
    item: str | Column
    lookup: DataFrame
    lookup_id: str
    lookup_label: str


def adoption_families(families: Sequence[Family], sort: bool = True) -> DataFrame:
    """``family, id, name, cnt, want_cnt``: :func:`adoption_vs_demand` (inner
    form) for a series of questions in one plan (Q-TT1..9).

    The answers of all families and both sides are stacked with a tag.  One
    aggregate by (family, item, entity) notes which sides an entity is on, so a
    hot item or family spreads over all tasks by its entities; sums
    of those notes are the distinct counts of both sides.  The stacked lookups
    are joined once.  Item ids are compared as text across families, and come
    out as text.  Sorted by family as given, then as the single form.
    """
    if not families:
        raise ValueError("no families")

    def answers(i: int, f: Family, df: DataFrame, side: int) -> DataFrame:
        return df.select(F.lit(i).alias("_f"), as_col(f.item).cast("string").alias("id"), as_col(f.entity).cast("string").alias("_e"),
                         F.lit(side).alias("_s"))

    rows = reduce(DataFrame.unionAll, [answers(i, f, df, side) for i, f in enumerate(families) for side, df in ((1, f.worked), (2, f.want))])
    rows = rows.filter("id IS NOT NULL AND _e IS NOT NULL")
    seen = rows.groupBy("_f", "id", "_e").agg(F.bit_or("_s").alias("_s"))
    counts = seen.groupBy("_f", "id").agg(F.count_if(F.col("_s") != 2).alias("cnt"), F.count_if(F.col("_s") != 1).alias("want_cnt"))
    labels = reduce(DataFrame.unionAll, [
        f.lookup.select(F.lit(i).alias("_f"), F.lit(f.name).alias("family"), qcol(f.lookup_id).cast("string").alias("id"), qcol(f.lookup_label).alias("name"))
        for i, f in enumerate(families)])
    out = counts.filter("cnt > 0 AND want_cnt > 0").join(labels, ["_f", "id"])
    if sort:
        out = out.orderBy("_f", (F.col("cnt") + F.col("want_cnt")).desc(), F.length("id"), "id")
    return out.select("family", "id", "name", "cnt", "want_cnt")


def entity_sketches(bridge: DataFrame, entity: str | Column, item: str | Column, item_name: str = "id", lg_k: int = 12) -> DataFrame:
    """``item, sketch``: a HyperLogLog sketch of each item's distinct entities
    (A3), to be stored with a load and merged with those of other loads
    (:func:`merged_sketches`), so that old loads are not read again.

    A sketch takes 2^``lg_k`` buckets at most; the standard error of its
    estimate is about 1.04 / sqrt(2^lg_k) (1.6 % at 12), and small counts are nearly exact.
    NULL items and entities are left out.
    """
    b = bridge.select(as_col(item).alias(item_name), as_col(entity).alias("_entity")).filter(F.col(item_name).isNotNull())
    return b.groupBy(item_name).agg(F.hll_sketch_agg("_entity", lg_k).alias("sketch"))


def merged_sketches(loads: Sequence[DataFrame], item_name: str = "id") -> DataFrame:
    """``item, sketch`` of several loads' sketches: an entity in two loads counts once."""
    if not loads:
        raise ValueError("no sketches")
    rows = reduce(DataFrame.unionByName, loads)
    return rows.groupBy(item_name).agg(F.hll_union_agg("sketch").alias("sketch"))


def sketch_counts(sketches: DataFrame, item_name: str = "id", count_col: str = "cnt") -> DataFrame:
    """``item, cnt``: the estimated number of distinct entities."""
    return sketches.select(item_name, F.hll_sketch_estimate("sketch").alias(count_col))
