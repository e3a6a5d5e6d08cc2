"""Date and period helpers, all native Column expressions.

Spark has ISO weeks (``weekofyear``) only. The reports count weeks the
old way instead: weeks start on Sunday and run 0..53, week 1 being the
first week that holds a Sunday of the year. ``year_week`` gives each
Sunday-week one label, so the days of a new year before its first Sunday
belong to the last week of the old year.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def ts(text: str) -> Column:
    """A TIMESTAMP_NTZ literal from date text such as ``'2012-8-22'``.

    Date-only text means midnight, so ``between(ts(a), ts(b))`` ends at
    00:00:00 of day ``b``. Catalyst folds the cast, and the bound reaches
    the parquet scan as a pushed filter.
    """
    m = re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})(?:[ T](\d{1,2}):(\d{2}):(\d{2}))?", text.strip())
    if not m:
        raise ValueError(f"not a date or datetime: {text!r}")
    y, mo, d, hh, mm, ss = m.groups()
    norm = f"{int(y):04d}-{int(mo):02d}-{int(d):02d} {int(hh or 0):02d}:{int(mm or 0):02d}:{int(ss or 0):02d}"
    return F.lit(norm).cast("timestamp_ntz")


def sunday_week(c: Column | str) -> Column:
    """Week of the year, weeks starting on Sunday, 0..53."""
    d = F.to_date(c)
    return F.floor((F.dayofyear(d) + 6 - (F.dayofweek(d) - 1)) / 7).cast("int")


def week_start(c: Column | str) -> Column:
    """The Sunday on or before the day of ``c``."""
    d = F.to_date(c)
    return F.date_sub(d, F.dayofweek(d) - 1)


def year_week(c: Column | str) -> Column:
    """``year * 100 + week`` of the Sunday-week holding ``c``."""
    ws = week_start(c)
    return (F.year(ws) * 100 + sunday_week(ws)).cast("int")


def monday_weekday(c: Column | str) -> Column:
    """Day of week with Monday = 0 .. Sunday = 6."""
    return F.weekday(F.to_date(c))


def split_label(c: Column, split: str, before: str, after: str, other: str) -> Column:
    """Two-way period label on a datetime, as a searched case.

    The last branch is unreachable for non-null input; it is kept so a
    NULL datetime shows up under ``other`` rather than vanishing.
    """
    return F.when(c < ts(split), F.lit(before)).when(c >= ts(split), F.lit(after)).otherwise(F.lit(other))
