"""The values that become columns of a pivot, found in the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: columns groups that a pivot may get at most.
WIDEST = 100


class TooWide(ValueError):
    """More different values than a pivot may have columns for."""


def values_of(df: DataFrame, column: str, widest: int = WIDEST) -> list:
    """The different values of ``column`` in order, nulls left out; ``TooWide`` beyond ``widest``.

    One aggregate; at most ``widest`` + 1 values reach the driver.
    """
    found = df.select(F.col(column).alias("v")).filter("v is not null").distinct().limit(widest + 1).collect()
    if len(found) > widest:
        raise TooWide(f"{column} has more than {widest} values; name those that are wanted")
    return sorted(r.v for r in found)
