"""Hierarchical weighted hash tree: rows into shards, native expressions only."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parts of a shard that get their slot numbers independently.
SLOT_BITS = 12


class Shard(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def _draw(key: Column, node: str, weight: float) -> Column:
    """Exponential race: the node with the smallest draw wins with a chance in
    proportion to its weight, and a draw changes only with its own weight."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(node), key), 11) + 0.5) / float(1 << 53)
    return -F.log(u) / F.lit(float(weight))


def _descend(key: Column, tree: Sequence[Shard], depth: int = 0, path: str = "") -> Column:
    if depth == 3:
        return F.lit(tree[0].shard)
    nodes: dict[str, list[Shard]] = {}
    for s in tree:
        nodes.setdefault(f"{path}/{s[depth]}", []).append(s)
    below = {n: _descend(key, part, depth + 1, n) for n, part in nodes.items()}
    if len(nodes) == 1:
        return next(iter(below.values()))
    best = F.array_min(F.array(*[
        F.struct(_draw(key, n, sum(s.weight for s in part)).alias("draw"), F.lit(n).alias("node"))
        for n, part in nodes.items()]))["node"]
    out = F.lit(None)
    for n, c in below.items():
        out = F.when(best == n, c).otherwise(out)
    return out


def shard_of(key: Column, tree: Sequence[Shard]) -> Column:
    """The shard of ``key``: at the region, rack and shard level in turn the
    node with the smallest weighted hash draw.

    A node's weight is the sum of its live shards' weights.  When weights
    change, a key leaves a node only for a sibling whose weight rose, or from
    one whose weight fell; keys whose path has no changed weight stay.  Shards
    of weight 0 take nothing.  A null key is a key of its own."""
    live = [s for s in tree if s.weight > 0]
    if not live:
        raise ValueError("no shard has a positive weight")
    if len({s.shard for s in live}) != len(live):
        raise ValueError("a shard is listed twice")
    return _descend(F.coalesce(key.cast("string"), F.lit("\0null")), live)


def sharded(rows: DataFrame, key: str, tree: Sequence[Shard], *, grown: Sequence[Shard] | None = None,
            carry: Sequence[str] = ()) -> DataFrame:
    """(key, carry..., shard, slot, grown_shard) for every row.

    ``slot`` numbers a shard's rows from 0 without gaps.  It is the row's
    place within its hashed part of the shard plus the sizes of the parts
    before, so no task orders a whole shard, nor all rows of one key unless
    they are alike in the carried columns too.  ``grown_shard`` is the shard
    under the tree ``grown`` (null without one).  Ties in the slot order go by
    the carried columns; rows equal in all of them are interchangeable.
    """
    part = F.shiftrightunsigned(F.xxhash64(F.lit("slot"), F.col(key), *map(F.col, carry)), 64 - SLOT_BITS).cast("int")
    # A column of the input that is called like a result is dropped first.
    rows = rows.select(key, *carry)
    placed = rows.withColumns({
        "shard": shard_of(F.col(key), tree), "_part": part,
        "grown_shard": shard_of(F.col(key), grown) if grown else F.lit(None).cast("int")})
    before = W.partitionBy("shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (placed.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
               .select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    within = W.partitionBy("shard", "_part").orderBy(key, *carry)
    return (placed.join(offsets, ["shard", "_part"])
            .withColumn("slot", F.col("_before") + F.row_number().over(within).cast("long") - 1)
            .select(key, *carry, "shard", "slot", "grown_shard"))
