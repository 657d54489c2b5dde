"""Missing answers, sentinels, ranges and label clean-up as Column expressions.

Survey data marks "no answer" in three ways: SQL NULL, a sentinel text such
as ``'NA'``, and "Other" texts matched by equality or by prefix.  ``Missing``
describes which of these a column uses; every operator takes one so that no
sentinel text is hard-coded in the library.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def qcol(name: str) -> Column:
    """Column by exact name, safe for names with dots, spaces or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_col(c: str | Column) -> Column:
    return qcol(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class Missing:
    """What counts as "no answer" in a column.

    nulls     -- SQL NULL is missing (the usual case).
    values    -- exact sentinel texts, e.g. ``("NA", "Other:")``.
    prefixes  -- sentinel prefixes, e.g. ``("Other:",)`` for ``NOT LIKE 'Other:%'``.
    """

    nulls: bool = True
    values: tuple = ()
    prefixes: tuple = ()

    def __post_init__(self):
        object.__setattr__(self, "values", tuple(self.values))
        object.__setattr__(self, "prefixes", tuple(self.prefixes))

    def answered(self, c: str | Column) -> Column:
        """Predicate that is true exactly for answered (non-missing) values.

        Never evaluates to NULL, so it can be negated safely, and it is built
        from ``IS [NOT] NULL``, ``NOT IN`` and ``NOT STARTSWITH`` so that the
        parquet reader receives it as pushed filters.
        """
        col = as_col(c)
        checks = []
        if self.values:
            checks.append(~col.isin(*self.values))
        checks.extend(~col.startswith(p) for p in self.prefixes)
        if self.nulls:
            # FALSE AND NULL is FALSE: a NULL value never leaks through.
            return reduce(lambda a, b: a & b, checks, col.isNotNull())
        if not checks:
            return F.lit(True)
        # TRUE OR NULL is TRUE: a NULL value always counts as answered.
        return col.isNull() | reduce(lambda a, b: a & b, checks)


NONE = Missing(nulls=False)
NULLS = Missing()


def drop_missing(df: DataFrame, spec: Mapping[str, Missing]) -> DataFrame:
    """Keep rows answered in every listed column."""
    if not spec:
        return df
    cond = reduce(lambda a, b: a & b, (m.answered(c) for c, m in spec.items()))
    return df.filter(cond)


def in_open_range(c: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    """``lo < c < hi``; NULL never passes."""
    col = as_col(c)
    cond = col.isNotNull()
    if lo is not None:
        cond = cond & (col > F.lit(lo))
    if hi is not None:
        cond = cond & (col < F.lit(hi))
    return cond


def excluding(c: str | Column, values: Iterable, keep_null: bool = False) -> Column:
    """``c NOT IN values``.

    ``keep_null=False`` matches ``col != v`` / ``~col.isin([...])`` in a filter,
    which silently drops NULL rows (P5, P6); ``keep_null=True`` keeps them.
    """
    col = as_col(c)
    values = list(values)
    if not values:
        return F.lit(True) if keep_null else col.isNotNull()
    cond = col.isNotNull() & ~col.isin(*values)
    return (col.isNull() | cond) if keep_null else cond


def ordinal(c: str | Column, order: Iterable, default: int | None = None) -> Column:
    """Position of the value in ``order`` (1-based); others get ``default`` (P10).

    ``default`` is ``len(order) + 1`` unless given.
    """
    col = as_col(c)
    order = list(order)
    if default is None:
        default = len(order) + 1
    expr = None
    for i, v in enumerate(order, start=1):
        expr = F.when(col == F.lit(v), F.lit(i)) if expr is None else expr.when(col == F.lit(v), F.lit(i))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default))


def relabel(c: str | Column, mapping: Mapping[str, str]) -> Column:
    """Replace values found in ``mapping``; other values pass unchanged.

    Relabelling values (not column names) keeps dotted or very long labels
    usable everywhere.
    """
    col = as_col(c)
    if not mapping:
        return col
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    return F.coalesce(F.try_element_at(m, col), col)


# Every character ``str.strip()`` removes (all lie below U+3001), by rule.
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def clean_label(c: str | Column) -> Column:
    """Strip leading and trailing whitespace of any kind, as ``str.strip()``
    does (P15).

    ``F.trim`` removes spaces only; ``btrim`` with the whitespace set also
    removes tabs, newlines and Unicode spaces, without a regex.
    """
    return F.btrim(as_col(c), F.lit(WHITESPACE))
