"""Conditional and banding expressions with SQL NULL semantics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def if_else(cond: Column, yes, no) -> Column:
    """Two-arm if: NULL condition gives NULL (not the ``no`` arm).

    ``when(c, a).otherwise(b)`` would send NULL to ``b``; the warehouse
    rendering is ``CASE WHEN c THEN a WHEN NOT c THEN b END``.
    """
    yes = yes if isinstance(yes, Column) else F.lit(yes)
    no = no if isinstance(no, Column) else F.lit(no)
    return F.when(cond, yes).when(~cond, no)


def flag_unless_equal(c, value) -> Column:
    """0 when ``c == value``, 1 otherwise, NULL stays NULL (sex coding)."""
    return if_else(_col(c) == F.lit(value), 0, 1)


def age_band(c, breaks: Sequence[int]) -> Column:
    """Half-open bands ``[lo,hi)``, the last one closed ``[lo,hi]``; outside -> NULL."""
    c = _col(c)
    expr = None
    pairs = list(zip(breaks[:-1], breaks[1:]))
    for i, (lo, hi) in enumerate(pairs):
        last = i == len(pairs) - 1
        cond = (c >= lo) & ((c <= hi) if last else (c < hi))
        label = f"[{lo},{hi}]" if last else f"[{lo},{hi})"
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def age_band_lower(c, breaks: Sequence[int]) -> Column:
    """Lower bound of the band of ``c`` (for ordering bands numerically)."""
    c = _col(c)
    expr = None
    pairs = list(zip(breaks[:-1], breaks[1:]))
    for i, (lo, hi) in enumerate(pairs):
        last = i == len(pairs) - 1
        cond = (c >= lo) & ((c <= hi) if last else (c < hi))
        expr = F.when(cond, F.lit(lo)) if expr is None else expr.when(cond, F.lit(lo))
    return expr


def band_flags(fi, lb: float, ub: float, boundary: str = "right_closed") -> dict[str, Column]:
    """Robust / prefrail / frail indicator columns for a score ``fi``.

    ``right_closed`` (current rule): robust fi <= lb, prefrail lb < fi <= ub,
    frail fi > ub. ``left_closed`` (older rule): robust fi < lb, prefrail
    lb <= fi < ub, frail fi >= ub.
    """
    fi = _col(fi)
    if boundary == "right_closed":
        return {"prefrail": if_else((fi > lb) & (fi <= ub), 1, 0),
                "frail": if_else(fi > ub, 1, 0),
                "robust": if_else(fi <= lb, 1, 0)}
    if boundary == "left_closed":
        return {"prefrail": if_else((fi >= lb) & (fi < ub), 1, 0),
                "frail": if_else(fi >= ub, 1, 0),
                "robust": if_else(fi < lb, 1, 0)}
    raise ValueError(f"boundary must be right_closed or left_closed, not {boundary!r}")


def percent_label(c, digits: int = 0) -> Column:
    """Display label ``12%`` for a fraction (report text only)."""
    return F.concat(F.format_number(_col(c) * 100, digits), F.lit("%"))


def thousands_label(c) -> Column:
    """Display label ``34,808,145`` for a count (report text only)."""
    return F.format_number(_col(c).cast("double"), 0)
