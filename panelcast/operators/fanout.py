"""Entities with several multi-valued answers: decode, fan-out weights, grouped
means and histograms (J2, J3, A4, A13).

The literal form left-joins an entity table with two bridge tables, which
repeats every entity once per *pair* of its bridge rows.  Means and counts
over that product depend only on how many rows each entity contributes, so we
keep one row per entity with its bridge row counts ``n_b`` and weight

    w_b = greatest(1, n_b)          (an entity without rows still gives one row)
    weight = product of w_b         (rows of the entity in the literal product)

and never emit the pairs:

* mean by an entity attribute  = sum(m * weight) / sum(weight)
* mean by an item of bridge b  = sum(m * mult * w_other) / sum(mult * w_other)
  where ``mult`` is how often the entity names that item in b
* histogram count of a bin      = sum(weight)

Precondition, as in the literal join: lookup ids are unique.  A bridge id
missing from its lookup still counts as a row, with a NULL label.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.missing import as_col, excluding, in_open_range, qcol


def decode(
    bridge: DataFrame,
    key: str,
    item: str,
    lookup: DataFrame,
    lookup_id: str,
    lookup_label: str,
    how: str = "inner",
    key_name: str | None = None,
    label_name: str = "name",
) -> DataFrame:
    """Bridge rows ``(entity, item id)`` with the item's label.

    ``how='inner'`` drops ids missing from the lookup (the reference); ``'left'``
    keeps them with a NULL label.  No broadcast hint: AQE broadcasts the
    lookup when its measured size is small and keeps a shuffle join otherwise.
    """
    key_name = key_name or key
    b = bridge.select(qcol(key).alias(key_name), qcol(item).alias("_item"))
    lu = lookup.select(qcol(lookup_id).alias("_item"), qcol(lookup_label).alias(label_name))
    return b.join(lu, "_item", how).select(key_name, label_name)


@dataclass(frozen=True)
class Bridge:
    """A multi-valued answer: rows ``(entity key, item id)`` and a lookup that
    turns item ids into labels.  ``name`` is the label column in results.
    ``mult`` names a column that says how often a row counts (``sources.write_bridge``)."""

    name: str
    df: DataFrame
    key: str
    item: str
    lookup: DataFrame | None = None
    lookup_id: str | None = None
    lookup_label: str | None = None
    mult: str | None = None

    @property
    def rows(self) -> Column:
        """The rows of the literal bridge, as an aggregate."""
        return F.count(F.lit(1)) if self.mult is None else F.sum(qcol(self.mult).cast("long"))

    def labelled(self, key_name: str) -> DataFrame:
        """``(key_name, name)`` per bridge row; dangling ids keep a NULL label."""
        if self.lookup is None:
            return self.df.select(qcol(self.key).alias(key_name), qcol(self.item).alias(self.name))
        return decode(self.df, self.key, self.item, self.lookup, self.lookup_id, self.lookup_label,
                      how="left", key_name=key_name, label_name=self.name)


@dataclass
class FanoutBase:
    """One row per entity: key, measure, attributes, ``n_<b>`` and ``weight``."""

    entities: DataFrame
    key: str
    measure: str
    attrs: list[str]
    bridges: dict[str, Bridge] = field(default_factory=dict)


def _n(name: str) -> str:
    return f"n_{name}"


def fanout_base(
    entities: DataFrame,
    key: str,
    measure: str | Column,
    measure_name: str = "measure",
    attrs: Mapping[str, str | Column] | Sequence[str] = (),
    bridges: Sequence[Bridge] = (),
    lo: float | None = None,
    hi: float | None = None,
) -> FanoutBase:
    """The fan-out base (S2, J2, P1, P4) in compact weighted form.

    Entities outside ``lo < measure < hi`` (or with a NULL measure) are
    dropped first, as in the reference's WHERE clause.  Each bridge is
    reduced to one count per entity before it meets the entity table, so the
    joins are one-to-one on the key; all of them share the key's hash
    partitioning, so the entity side is shuffled once.
    """
    if isinstance(attrs, Mapping):
        attr_cols = {k: as_col(v) for k, v in attrs.items()}
    else:
        attr_cols = {a: qcol(a) for a in attrs}
    ent = entities.select(
        qcol(key).alias(key),
        as_col(measure).alias(measure_name),
        *[c.alias(n) for n, c in attr_cols.items()],
    ).filter(in_open_range(measure_name, lo, hi))
    weight = F.lit(1)
    for b in bridges:
        counts = b.df.groupBy(qcol(b.key).alias(key)).agg(b.rows.alias(_n(b.name)))
        ent = ent.join(counts, key, "left").withColumn(_n(b.name), F.coalesce(qcol(_n(b.name)), F.lit(0)))
        weight = weight * F.greatest(F.lit(1), qcol(_n(b.name)))
    ent = ent.withColumn("weight", weight.cast("long"))
    return FanoutBase(ent, key, measure_name, list(attr_cols), {b.name: b for b in bridges})


def _other_weight(base: FanoutBase, skip: str) -> Column:
    ws = [F.greatest(F.lit(1), qcol(_n(n))) for n in base.bridges if n != skip]
    return reduce(lambda a, b: a * b, ws, F.lit(1)).cast("long")


def grouped_avg(
    base: FanoutBase,
    dim: str,
    exclude: Sequence = (),
    keep_null: bool | None = None,
    weighting: str = "fanout",
    sort: str | None = "value",
    avg_col: str = "average",
    numeric_key: bool = False,
) -> DataFrame:
    """Mean of the measure per value of ``dim``.

    ``dim`` is an entity attribute or the name of a bridge.
    exclude    -- values left out.  ``keep_null`` defaults to True without
                  exclusions and False with them, matching ``col != v`` and
                  ``~col.isin(...)``, which drop NULL groups too (K6).
    weighting  -- 'fanout': every row of the literal fan-out join counts, so an
                  entity weighs (product of its bridge row counts) (K5);
                  'entity': every entity counts once per group.
    sort       -- 'value' (mean ascending, then key), 'key' (key ascending,
                  NULL first) or None.
    numeric_key -- sort='key' compares textual keys as numbers; keys that are
                  none come after the numbers.
    """
    if weighting not in ("fanout", "entity"):
        raise ValueError("weighting must be 'fanout' or 'entity'")
    if keep_null is None:
        keep_null = not exclude
    m = qcol(base.measure)
    if dim in base.bridges:
        b = base.bridges[dim]
        ent = base.entities.select(base.key, m, _other_weight(base, dim).alias("_w"))
        if weighting == "fanout":
            # Sums per item id first: the lookup meets one row per item.
            items = (b.df.groupBy(qcol(b.key).alias(base.key), qcol(b.item).alias("_item"))
                     .agg(b.rows.alias("_mult")))
            # Entities without bridge rows keep one row with a NULL item (left join).
            w = (F.coalesce(F.col("_mult"), F.lit(1)) * F.col("_w")).cast("double")
            rows = ent.join(items, base.key, "left").groupBy("_item").agg(F.sum(m * w).alias("_sum"), F.sum(w).alias("_weight"))
            if b.lookup is None:
                rows = rows.withColumnRenamed("_item", dim)
            else:
                labels = b.lookup.select(qcol(b.lookup_id).alias("_item"), qcol(b.lookup_label).alias(dim))
                rows = rows.join(labels, "_item", "left")
            total, weight = F.col("_sum"), F.col("_weight")
        else:
            items = b.labelled(base.key).select(base.key, qcol(dim)).distinct()
            rows, total, weight = ent.join(items, base.key, "left"), m.cast("double"), F.lit(1.0)
    else:
        rows = base.entities
        weight = (F.col("weight") if weighting == "fanout" else F.lit(1)).cast("double")
        total = m * weight
    if exclude or not keep_null:
        rows = rows.filter(excluding(dim, exclude, keep_null=keep_null))
    out = rows.groupBy(qcol(dim)).agg(F.try_divide(F.sum(total), F.sum(weight)).alias(avg_col))
    if sort == "value":
        out = out.orderBy(F.col(avg_col).asc(), qcol(dim).asc_nulls_first())
    elif sort == "key":
        key = qcol(dim)
        first = [key.isNotNull(), key.try_cast("double").asc_nulls_last()] if numeric_key else []
        out = out.orderBy(*first, key.asc_nulls_first())
    elif sort is not None:
        raise ValueError("sort must be 'value', 'key' or None")
    return out


def fanout_breakdowns(
    entities: DataFrame,
    key: str,
    measure: str | Column,
    attrs: Mapping[str, str | Column] | Sequence[str] = (),
    bridges: Sequence[Bridge] = (),
    lo: float | None = None,
    hi: float | None = None,
    exclude: Mapping[str, Sequence] | None = None,
    bins: tuple[float, float, int] | None = None,
    avg_col: str = "average",
    count_col: str = "cnt",
) -> DataFrame:
    """``dim, value, average, cnt``: the fan-out mean and row count per value
    of every attribute and bridge, and the measure's histogram, in one plan.

    The result holds what :func:`grouped_avg` gives per dimension (values as
    text, ``cnt`` the rows of the literal join) and, with ``bins`` = (lo, hi,
    number), rows of the dimension ``bin`` as :func:`histogram` counts them.
    ``exclude`` leaves values out per dimension, and NULL with them (K6).

    Each input is read once.  Bridge answers are stacked, counted per (entity,
    bridge, item) and gathered per entity: an entity with a huge number of rows
    arrives as its distinct items.  Every entity is then one row that
    gives a weighted value for each dimension (grouping sets whose weights
    differ), summed by one aggregate.  Item ids are decoded last, by one join
    with the stacked lookups.  Bridges over the same DataFrame share its scan.
    """
    exclude = dict(exclude or {})
    cols = {k: as_col(v) for k, v in attrs.items()} if isinstance(attrs, Mapping) else {a: qcol(a) for a in attrs}
    names = [*cols, *(b.name for b in bridges)]
    if len(set(names) | {"bin"}) != len(names) + 1 or set(exclude) - set(names):
        raise ValueError("dimensions must differ, and none be called bin; exclude names dimensions")
    ent = entities.select(qcol(key).alias("_k"), as_col(measure).alias("_m"), *[c.alias(f"_a{i}") for i, c in enumerate(cols.values())])
    ent = ent.filter(in_open_range("_m", lo, hi))
    if bridges:
        shared: dict[tuple[int, str, str | None], list[int]] = {}
        for i, b in enumerate(bridges):
            shared.setdefault((id(b.df), b.key, b.mult), []).append(i)
        rows = [bridges[of[0]].df.select(qcol(k).alias("_k"), F.explode(F.array(*[
            F.struct(F.lit(i).alias("b"), qcol(bridges[i].item).cast("string").alias("item")) for i in of])).alias("_i"),
            (F.lit(1) if m is None else qcol(m)).cast("long").alias("_n"))
            for (_, k, m), of in shared.items()]
        counts = reduce(DataFrame.unionAll, rows).groupBy("_k", "_i").agg(F.sum("_n").alias("mult"))
        items = counts.groupBy("_k").agg(F.collect_list(F.struct("_i.b", "_i.item", "mult")).alias("_items"))
        ent = ent.join(items, "_k", "left")
    none = F.array().cast("array<struct<b:int,item:string,mult:bigint>>")
    ent = ent.withColumn("_items", F.coalesce("_items", none) if bridges else none)

    def of_bridge(i):
        return F.filter("_items", lambda x: x["b"] == i)

    of = [of_bridge(i) for i in range(len(bridges))]
    w = [F.greatest(F.lit(1), F.aggregate(o, F.lit(0).cast("long"), lambda s, x: s + x["mult"])).cast("double") for o in of]
    ent = ent.select("_m", *[f"_a{i}" for i in range(len(cols))], *[o.alias(f"_o{i}") for i, o in enumerate(of)], *[x.alias(f"_w{i}") for i, x in enumerate(w)])
    every = reduce(lambda a, b: a * b, [F.col(f"_w{i}") for i in range(len(bridges))], F.lit(1.0))

    def cell(dim, value, weight):
        return F.struct(F.lit(dim).alias("dim"), value.cast("string").alias("value"), weight.cast("double").alias("w"))

    cells = [F.array(*[cell(n, F.col(f"_a{i}"), every) for i, n in enumerate(cols)])] if cols else []

    def bridge_cells(i, name):
        # An entity without rows keeps one with a NULL item (left join).
        other = reduce(lambda a, b: a * b, [F.col(f"_w{j}") for j in range(len(bridges)) if j != i], F.lit(1.0))
        some = F.transform(f"_o{i}", lambda x: cell(name, x["item"], x["mult"] * other))
        return F.when(F.size(f"_o{i}") > 0, some).otherwise(F.array(cell(name, F.lit(None), other)))

    cells += [bridge_cells(i, b.name) for i, b in enumerate(bridges)]
    if bins is not None:
        low, high, number = bins
        x = F.col("_m").cast("double")
        place = F.least(F.floor((x - low) / ((high - low) / number)), F.lit(number - 1))
        inside = (x >= low) & (x <= high)
        cells.append(F.filter(F.array(cell("bin", F.when(inside, place), every)), lambda c: c["value"].isNotNull()))
    if not cells:
        raise ValueError("no dimensions")
    flat = ent.select("_m", F.explode(F.concat(*cells)).alias("_c"))
    sums = flat.groupBy(F.col("_c.dim").alias("dim"), F.col("_c.value").alias("value")).agg(
        F.sum(F.col("_m") * F.col("_c.w")).alias("_s"), F.sum("_c.w").alias("_w"))
    decoded = [b for b in bridges if b.lookup is not None]
    if decoded:
        labels = reduce(DataFrame.unionAll, [
            b.lookup.select(F.lit(b.name).alias("dim"), qcol(b.lookup_id).cast("string").alias("value"), qcol(b.lookup_label).cast("string").alias("_label"))
            for b in decoded])
        sums = sums.join(labels, ["dim", "value"], "left").withColumn(
            "value", F.when(F.col("dim").isin([b.name for b in decoded]), F.col("_label")).otherwise(F.col("value")))
    for dim, values in exclude.items():
        if values:
            sums = sums.filter((F.col("dim") != dim) | excluding("value", [str(v) for v in values], keep_null=False))
    return sums.groupBy("dim", "value").agg(
        F.try_divide(F.sum("_s"), F.sum("_w")).alias(avg_col), F.sum("_w").cast("long").alias(count_col))


def histogram(
    df: DataFrame,
    col: str | Column,
    lo: float | None,
    hi: float | None,
    bins: int,
    weight: str | Column | None = None,
    fill_empty: bool = True,
    count_col: str = "cnt",
    outside: bool = False,
) -> DataFrame:
    """Equal-width histogram of ``col`` over ``[lo, hi]``.

    Bin i covers ``[lo + i*w, lo + (i+1)*w)`` with ``w = (hi - lo) / bins``; the
    last bin also holds ``hi``.  NULL and NaN are left out; values outside the
    range too, unless ``outside`` adds a bin -1 for those below ``lo`` and a
    bin ``bins`` for those above ``hi``.
    ``lo``/``hi`` = None take the data's minimum/maximum (as a chart library
    does), computed as scalar subqueries of one min/max aggregate.
    ``weight`` sums a weight column instead of counting rows (fan-out base).
    ``fill_empty`` adds empty bins with count 0.  The counts have at most
    ``bins`` rows, so the fill join is small whatever the input size.
    """
    if bins <= 0:
        raise ValueError("need bins > 0")
    x = as_col(col).cast("double")
    df = df.filter(x.isNotNull() & ~F.isnan(x))
    if lo is None or hi is None:
        rng = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
        lo_c = F.lit(float(lo)) if lo is not None else rng.select("lo").scalar()
        hi_c = F.lit(float(hi)) if hi is not None else rng.select("hi").scalar()
    else:
        if not hi > lo:
            raise ValueError("need hi > lo")
        lo_c, hi_c = F.lit(float(lo)), F.lit(float(hi))
    width = (hi_c - lo_c) / F.lit(float(bins))
    # A degenerate range (all values equal) puts everything in bin 0.
    raw = F.when(width > 0, F.floor((x - lo_c) / width)).otherwise(F.lit(0))
    b = F.least(raw, F.lit(bins - 1)).cast("long")
    if outside:
        b = F.when(x < lo_c, F.lit(-1)).when(x > hi_c, F.lit(bins)).otherwise(b).cast("long")
        rows = df
    else:
        rows = df.filter((x >= lo_c) & (x <= hi_c))
    val = F.count(F.lit(1)) if weight is None else F.sum(as_col(weight).cast("long"))
    counts = rows.groupBy(b.alias("bin")).agg(val.alias(count_col))
    if fill_empty:
        all_bins = df.sparkSession.range(-int(outside), bins + int(outside)).withColumnRenamed("id", "bin")
        counts = all_bins.join(counts, "bin", "left").select("bin", F.coalesce(count_col, F.lit(0)).alias(count_col))
    return counts.select(
        "bin",
        F.when(F.col("bin") >= 0, lo_c + F.col("bin") * width).alias("bin_lo"),
        F.when(F.col("bin") < bins, lo_c + (F.col("bin") + 1) * width).alias("bin_hi"),
        count_col,
    )


def histogram_nice(df: DataFrame, col: str | Column, max_bins: int = 100, weight: str | Column | None = None,
                   count_col: str = "cnt") -> DataFrame:
    """Histogram with round edges (A13): ``bin, bin_lo, bin_hi, cnt``.

    Edges are multiples of a step of 1, 2 or 5 times a power of ten: the
    smallest step with which at most ``max_bins`` bins hold all values.  Bin 0
    holds the minimum, the last bin the maximum; a value on an edge is in the
    bin above, empty bins have count 0.  Equal values fill one bin of step 1.
    NULL and non-finite values are left out; without any value there are no rows.
    The range is one min/max aggregate, the edges are expressions over it, and the counts have
    at most ``max_bins`` rows.
    """
    if max_bins < 2:
        raise ValueError("need max_bins > 1")
    x = as_col(col).cast("double")
    df = df.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def place(v, m, e):  # which multiple of m * 10^e is at or below v; powers below 1 are divided by, as they aren't exact
        return F.floor(F.when(e < 0, v * F.pow(F.lit(10.0), -e) / m).otherwise(v / (m * F.pow(F.lit(10.0), e)))).cast("long")

    def edge(i, m, e):
        return F.when(e < 0, i * m / F.pow(F.lit(10.0), -e)).otherwise(i * m * F.pow(F.lit(10.0), e))

    rng = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).filter("lo IS NOT NULL")
    e0 = F.floor(F.log10((F.col("hi") - F.col("lo")) / max_bins)).cast("int")
    steps = [F.struct(e.alias("e"), F.lit(m).alias("m"), place(F.col("lo"), F.lit(m), e).alias("first"), place(F.col("hi"), F.lit(m), e).alias("last"))
             for e in (e0 - 1, e0, e0 + 1) for m in (1.0, 2.0, 5.0)]
    one = F.struct(F.lit(0).alias("e"), F.lit(1.0).alias("m"), F.floor("lo").cast("long").alias("first"), F.floor("lo").cast("long").alias("last"))
    fits = F.filter(F.array(*steps), lambda s: s["last"] - s["first"] < max_bins)
    # Steps stand from the smallest to the largest.
    chosen = rng.select(F.when(F.col("hi") > F.col("lo"), fits[0]).otherwise(one).alias("s"))
    s = chosen.scalar()
    val = F.count(F.lit(1)) if weight is None else F.sum(as_col(weight).cast("long"))
    counts = (df.withColumn("_s", s).groupBy((place(x, F.col("_s.m"), F.col("_s.e")) - F.col("_s.first")).alias("bin"))
              .agg(val.alias(count_col)))
    bins = chosen.select("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s.last") - F.col("s.first"))).alias("bin"))
    at = F.col("s.first") + F.col("bin")
    return bins.join(counts, "bin", "left").select(
        "bin", edge(at, F.col("s.m"), F.col("s.e")).alias("bin_lo"), edge(at + 1, F.col("s.m"), F.col("s.e")).alias("bin_hi"),
        F.coalesce(count_col, F.lit(0)).alias(count_col))
