"""What follows every row of its group, however many rows one group has.

A window over a session would sort the whole session in one task. Here a
group is cut into ranges of ``range_ids`` ids; ids are unique, so a range
holds no more rows than that. Inside a range a window does the work; what
lies behind a range is a row per range (its first row, or its minimum),
and a second window over those rows, one per range of the group, carries
it back to the range before. The rows are shuffled once, by group and range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: ids per range: the most rows of a group that one task sorts together.
RANGE_IDS = 1 << 20


def _ranged(rows: DataFrame, order: str, range_ids: int) -> DataFrame:
    return rows.withColumn("__range", F.floor(F.col(order) / F.lit(range_ids)).cast("bigint"))


def next_events(
    rows: DataFrame, group: str, order: str, carry: Sequence[str] = (), range_ids: int = RANGE_IDS, prefix: str = "next_"
) -> DataFrame:
    """``rows`` with ``order`` and ``carry`` of the next row of their ``group``, null for its last row.

    ``order`` is a unique integer id. Rows whose group or id is null have
    no next row.
    """
    names = [order, *carry]
    ranged = _ranged(rows, order, range_ids)
    inside = Window.partitionBy(group, "__range").orderBy(order)
    held = ranged.withColumn("__next", F.lead(F.struct(*names)).over(inside))
    # the first row behind a range, for the last row inside it
    heads = ranged.groupBy(F.col(group).alias("__g"), F.col("__range").alias("__r")).agg(F.min(F.struct(*names)).alias("__head"))
    along = Window.partitionBy("__g").orderBy("__r")
    behind = heads.withColumn("__behind", F.lead("__head").over(along)).filter("__behind is not null").drop("__head")
    last = held.filter("__next is null").join(behind, (F.col(group) == F.col("__g")) & (F.col("__range") == F.col("__r")), "left")
    last = last.withColumn("__next", F.col("__behind")).select(*held.columns)
    out = held.filter("__next is not null").unionByName(last)
    some = F.col(group).isNotNull() & F.col(order).isNotNull()
    return out.select(*rows.columns, *[F.when(some, F.col(f"__next.{n}")).alias(prefix + n) for n in names])


def least_behind(rows: DataFrame, group: str, order: str, value: str, name: str, range_ids: int = RANGE_IDS) -> DataFrame:
    """``rows`` with the least ``value`` among the rows behind each in its ``group``, null where there is none."""
    ranged = _ranged(rows, order, range_ids)
    inside = Window.partitionBy(group, "__range").orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    held = ranged.withColumn("__near", F.min(value).over(inside))
    lows = ranged.groupBy(F.col(group).alias("__g"), F.col("__range").alias("__r")).agg(F.min(value).alias("__low"))
    along = Window.partitionBy("__g").orderBy("__r").rowsBetween(1, Window.unboundedFollowing)
    behind = lows.withColumn("__far", F.min("__low").over(along)).filter("__far is not null").drop("__low")
    out = held.join(behind, (F.col(group) == F.col("__g")) & (F.col("__range") == F.col("__r")), "left")
    return out.select(*rows.columns, F.least("__near", "__far").alias(name))
