"""Multi-step pathway flows: pair counts, stacked links and node ids (G1-G4,
A11, U2-U4, P15).

A pathway is a list of columns ``[a, b, c, ...]``; hop i counts rows per
``(layer_i, layer_i+1)`` value pair.

Plan shape: every row is exploded into one small struct per hop and all hops
are counted by ONE ``groupBy(hop, source, target)``.  Partial aggregation
runs before the single shuffle, so the input (typically a large join) is
read once and a hot pair costs one row per task in the shuffle.  Node ids
come from a distributed dense index over the distinct link ends of the
aggregated flows.  Links need the flows twice, for the nodes and for
themselves, so the aggregated flows, a row per link, are stored first: in all
jobs together the input is read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.missing import clean_label, qcol
from panelcast.functions.ranking import dense_index
from panelcast.sources.sinks import materialize


def _lab(c: str | Column, strip: bool) -> Column:
    col = (qcol(c) if isinstance(c, str) else c).cast("string")
    return clean_label(col) if strip else col


def pair_flows(df: DataFrame, pairs: Sequence[tuple[str, str]], count_col: str = "count",
               strip: bool = False, weight: str | None = None) -> DataFrame:
    """Row counts per (source, target) value pair for each column pair.

    Result: ``hop`` (index into ``pairs``), ``source``, ``target``, ``count``;
    labels are cast to string so that hops of different types stack.  With
    ``strip`` labels lose surrounding whitespace before counting (P15).
    ``weight`` names a column of row multiplicities (see :func:`bridge_weights`);
    each row then counts that many times.
    """
    hops = F.array(*[
        F.struct(F.lit(i).alias("hop"), _lab(a, strip).alias("source"), _lab(b, strip).alias("target"))
        for i, (a, b) in enumerate(pairs)
    ])
    w = F.lit(1).alias("_w") if weight is None else qcol(weight).cast("long").alias("_w")
    return (
        df.select(F.explode(hops).alias("_h"), w)
        .groupBy(F.col("_h.hop").alias("hop"), F.col("_h.source").alias("source"), F.col("_h.target").alias("target"))
        .agg(F.sum("_w").alias(count_col))
    )


def bridge_weights(labels: DataFrame, key: str, label: str, weight: str = "mult") -> DataFrame:
    """``key, label, mult``: how often each entity names each label.

    Joining this (instead of raw bridge rows) to the entity table keeps the
    flow counts of the literal join while an entity with a huge number of
    bridge rows arrives at the join as one row per distinct label; the
    counting is pre-aggregated map-side.
    """
    return labels.groupBy(qcol(key), qcol(label)).agg(F.count(F.lit(1)).alias(weight))


def label_counts(entities: DataFrame, key: str, attrs: Sequence[str], bridge: DataFrame, bridge_key: str, item: str,
                 lookup: DataFrame, lookup_id: str, lookup_label: str, label: str, weight: str = "mult",
                 mult: str | None = None) -> DataFrame:
    """``attrs, label, mult``: rows of entities ⋈ bridge ⋈ lookup (J4), counted
    per combination of attributes and item id before the ids are decoded.

    The lookup meets one row per combination and item, whatever the size of
    the bridge; ids without a label drop out.  The bridge is joined once, on
    the entity key; an entity with a huge number of bridge rows is split by
    AQE, as the entity side has one row for it.  ``mult`` names a column of the
    bridge that says how often a row counts (``sources.write_bridge``).
    """
    ent = entities.select(qcol(key).alias("_key"), *[qcol(a) for a in attrs])
    rows = bridge.select(qcol(bridge_key).alias("_key"), qcol(item).alias("_item"),
                         (F.lit(1) if mult is None else qcol(mult)).cast("long").alias("_n"))
    counts = rows.join(ent, "_key").groupBy("_item", *[qcol(a) for a in attrs]).agg(F.sum("_n").alias(weight))
    labels = lookup.select(qcol(lookup_id).alias("_item"), qcol(lookup_label).alias(label))
    return counts.join(labels, "_item").select(*[qcol(a) for a in attrs], qcol(label), qcol(weight))


def pathway(df: DataFrame, layers: Sequence[str], count_col: str = "count", strip: bool = False,
            weight: str | None = None) -> DataFrame:
    """Flows along consecutive layers (G2): hop i goes from ``layers[i]`` to
    ``layers[i+1]``.  Two pathways sharing a first hop are two calls."""
    if len(layers) < 2:
        raise ValueError("a pathway needs at least two layers")
    return pair_flows(df, list(zip(layers[:-1], layers[1:])), count_col, strip, weight)


def _clean(flows: DataFrame, count_col: str, strip: bool) -> DataFrame:
    """Strip labels, then re-sum links that became equal."""
    if strip:
        flows = flows.groupBy("hop", clean_label("source").alias("source"), clean_label("target").alias("target")).agg(
            F.sum(count_col).alias(count_col)
        )
    return flows.select("hop", "source", "target", F.col(count_col))


def _nodes(f: DataFrame, merge_labels: bool) -> DataFrame:
    """Distinct nodes ``node_layer, label`` with a 0-based ``node_id`` in
    (layer, label) order.  The ids come from :func:`dense_index`, which never
    sends all nodes to one task."""
    ends = f.select(F.explode(F.array(
        F.struct(F.col("hop").alias("layer"), F.col("source").alias("label")),
        F.struct((F.col("hop") + 1).alias("layer"), F.col("target").alias("label")),
    )).alias("_e")).select("_e.layer", "_e.label")
    if merge_labels:
        nodes = ends.groupBy("label").agg(F.min("layer").alias("node_layer"))
    else:
        nodes = ends.select(F.col("layer").alias("node_layer"), "label")
    return dense_index(nodes, ["node_layer", "label"], "node_id")


def _null_safe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join in which NULL keys meet, with the left keys kept."""
    r = right.select(*[qcol(c).alias(f"_r_{c}") if c in on else qcol(c) for c in right.columns])
    match = [qcol(c).eqNullSafe(qcol(f"_r_{c}")) for c in on]
    return left.join(r, match).drop(*[f"_r_{c}" for c in on])


def _as_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select("node_id", F.col("node_layer").alias("layer"), "label")


def _as_links(f: DataFrame, nodes: DataFrame, count_col: str, merge_labels: bool) -> DataFrame:
    if merge_labels:
        src = nodes.select(F.col("label").alias("source"), F.col("node_id").alias("source_id"))
        tgt = nodes.select(F.col("label").alias("target"), F.col("node_id").alias("target_id"))
        keys = []
    else:
        src = nodes.select(F.col("node_layer").alias("hop"), F.col("label").alias("source"),
                           F.col("node_id").alias("source_id"))
        tgt = nodes.select((F.col("node_layer") - 1).alias("hop"), F.col("label").alias("target"),
                           F.col("node_id").alias("target_id"))
        keys = ["hop"]
    j = _null_safe(_null_safe(f, src, [*keys, "source"]), tgt, [*keys, "target"])
    return j.groupBy("source_id", "target_id").agg(F.sum(count_col).alias("value"))


def flow_nodes(flows: DataFrame, count_col: str = "count", strip: bool = True, merge_labels: bool = False) -> DataFrame:
    """Distinct nodes with integer ids from 0 (G4, U4): ``node_id, layer, label``.

    A node is ``(layer, label)``: the source of hop i sits in layer i, its
    target in layer i+1 (K11).  A NULL label is a node like any other.  ``merge_labels=True`` makes one node per label
    across layers, as the reference does; its ``layer`` is the first one.
    """
    return _as_nodes(_nodes(_clean(flows, count_col, strip), merge_labels))


def flow_links(flows: DataFrame, count_col: str = "count", strip: bool = True, merge_labels: bool = False) -> DataFrame:
    """Links rewritten to node ids: ``source_id, target_id, value``.

    Ids equal those of :func:`flow_nodes` on the same flows.  Labels are
    compared null-safe, so no flow is lost: the values add up to the flows.
    """
    return flow_graph(flows, count_col, strip, merge_labels)[1]


def flow_graph(flows: DataFrame, count_col: str = "count", strip: bool = True,
               merge_labels: bool = False) -> tuple[DataFrame, DataFrame]:
    """(:func:`flow_nodes`, :func:`flow_links`) of the same flows, which are
    aggregated and stored once for both."""
    f = materialize(_clean(flows, count_col, strip))
    nodes = _nodes(f, merge_labels)
    return _as_nodes(nodes), _as_links(f, nodes, count_col, merge_labels)


def forked_flows(flows: DataFrame, shared: int, ends: Sequence[int]) -> list[DataFrame]:
    """Pathways that share their first hops, out of one :func:`pair_flows`
    result: hops 0 to ``shared`` - 1, then one of the hops ``ends`` as the last.
    Pass stored flows; each pathway is a filter over them."""
    keep = F.col("hop") < shared
    return [flows.filter(keep | (F.col("hop") == e)).withColumn("hop", F.when(keep, F.col("hop")).otherwise(F.lit(shared)))
            for e in ends]
