"""Ratios and money columns with one fixed set of semantics.

x / 0 is NULL (never an error, never infinity). Every ratio is taken in
double precision and rounded to 6 decimals, and money sums are returned
as doubles rounded to cents, so results compare exactly across engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RATIO_DIGITS = 6


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str, scale: float | None = None) -> Column:
    """``num / den`` as a rounded double; NULL when ``den`` is 0 or NULL."""
    q = F.try_divide(_col(num).cast("double"), _col(den).cast("double"))
    if scale is not None:
        q = q * F.lit(float(scale))
    return F.round(q, RATIO_DIGITS)


def money(c: Column | str) -> Column:
    """A decimal amount (usually a sum) as a double rounded to cents."""
    return F.round(_col(c).cast("double"), 2)


def rounded(c: Column | str) -> Column:
    """An average or other double rounded like a ratio."""
    return F.round(_col(c).cast("double"), RATIO_DIGITS)


def count_when(cond: Column) -> Column:
    """Rows where ``cond`` holds (NULL counts as false)."""
    return F.count_if(F.coalesce(cond, F.lit(False)))
