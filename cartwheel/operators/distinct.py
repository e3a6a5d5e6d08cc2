"""Distinct counts under many conditions, in one shuffle, over tables whose ids repeat.

``count(distinct when(p, id))`` for several ``p`` makes Spark copy every row
once per condition (``Expand``). Here an id is a bit: ids are dealt to
buckets of 32,768 neighbours, and each condition has one bitmap per group
and bucket, merged on the map side before the shuffle. A row that was
loaded twice sets its bits twice. Ids are integers; a null id is no id, as
for ``count(distinct)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_counts(
    df: DataFrame, id_col: str, conditions: dict[str, Column], keys: dict[str, Column] | None = None, least: dict[str, Column] | None = None,
) -> DataFrame:
    """Per ``keys`` (none: one row) and condition, the number of different ids among its rows.

    ``least`` adds minima of other columns. Groups without rows do not occur.
    """
    keys, least = keys or {}, least or {}
    number = F.col(id_col).cast("bigint")
    bits = {n: F.bitmap_construct_agg(F.when(cond, F.bitmap_bit_position(number))).alias(n) for n, cond in conditions.items()}
    per_bucket = df.groupBy(*[c.alias(n) for n, c in keys.items()], F.bitmap_bucket_number(number).alias("__bucket")).agg(
        *bits.values(), *[F.min(c).alias(n) for n, c in least.items()]
    )
    # a bucket's bitmap belongs to that bucket alone, so the counts of buckets add up
    return per_bucket.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.bitmap_count(n)), F.lit(0)).cast("bigint").alias(n) for n in conditions], *[F.min(n).alias(n) for n in least]
    )
