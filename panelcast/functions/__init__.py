"""Column-level helpers: missing answers, ranges, ordinals, relabelling."""

from panelcast.functions.missing import (
    NONE,
    NULLS,
    Missing,
    as_col,
    clean_label,
    drop_missing,
    excluding,
    in_open_range,
    ordinal,
    qcol,
    relabel,
)
from panelcast.functions.ranking import dense_index

__all__ = [
    "NONE",
    "NULLS",
    "Missing",
    "as_col",
    "clean_label",
    "dense_index",
    "drop_missing",
    "excluding",
    "in_open_range",
    "ordinal",
    "qcol",
    "relabel",
]
