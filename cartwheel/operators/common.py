"""Building blocks shared by the report families.

Grain rules the reports rely on: ``website_session_id`` is the key of
sessions, ``website_pageview_id`` of page views, ``order_id`` of orders,
``order_item_id`` of order items (``sources`` refuses tables where it is
not); every view and order belongs to one session. Under those keys a
distinct count of ids is a plain count at the right grain, which is how
the reports below avoid Spark's ``Expand`` for multiple distinct
aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwheel.functions import ts

SESSION = "website_session_id"
VIEW = "website_pageview_id"
CREATED = "created_at"


def created_before(until: str, col: str = CREATED) -> Column:
    return F.col(col) < ts(until)


def created_between(start: str, end: str, col: str = CREATED) -> Column:
    """Both ends included; date-only text ends at midnight of ``end``."""
    return F.col(col).between(ts(start), ts(end))


def created_after(after: str, col: str = CREATED) -> Column:
    return F.col(col) > ts(after)


def paid_search(source: str | Sequence[str] | None = None, campaign: str | None = None) -> Column:
    """Filter on ``utm_source`` (one value or a list) and ``utm_campaign``."""
    cond = F.lit(True)
    if source is not None:
        if isinstance(source, str):
            cond = cond & (F.col("utm_source") == source)
        else:
            cond = cond & F.col("utm_source").isin(list(source))
    if campaign is not None:
        cond = cond & (F.col("utm_campaign") == campaign)
    return cond


def sessions_with_orders(keyed: DataFrame, orders: DataFrame, **per_session: Column) -> DataFrame:
    """``keyed`` with its sessions' orders folded into columns.

    ``keyed`` holds ``website_session_id`` and the columns a report groups or
    filters on; each of its rows stays one row. The orders are summed per
    session first (partial + final aggregate), so the left join has at most
    one row per session on its right side, nothing fans out, and either
    side may be split or broadcast. ``_orders`` (0 without orders) and
    ``_revenue`` are always there, ``per_session`` adds aggregates over the
    order rows.
    """
    folded = orders.groupBy(F.col(SESSION).alias("_of")).agg(
        F.count("order_id").alias("_n"), F.sum("price_usd").alias("_revenue"), *[c.alias(n) for n, c in per_session.items()]
    )
    joined = keyed.join(folded, F.col(SESSION) == F.col("_of"), "left")
    return joined.withColumn("_orders", F.coalesce("_n", F.lit(0))).drop("_of", "_n")


def n_sessions() -> Column:
    return F.count(F.lit(1))


def n_orders() -> Column:
    return F.sum("_orders")


def revenue() -> Column:
    return F.sum("_revenue")


def per_distinct_order(order_values: Column) -> Column:
    """A sum over folded order values, 0 where no session has an order."""
    return F.coalesce(F.sum(order_values), F.lit(0))


def first_view(*extra: str) -> Column:
    """Aggregate: the struct (id, extra...) of the least view id.

    ``min`` over a struct compares its fields in order, so this is the
    first view of the group together with its URL (or time); it runs as a
    partial + final aggregate, never a join back on the view id.
    """
    return F.min(F.struct(VIEW, *extra))


def first_view_where(cond: Column, *extra: str) -> Column:
    """As ``first_view``, over the rows where ``cond`` holds only."""
    return F.min(F.when(cond, F.struct(VIEW, *extra)))


def next_view(
    anchors: DataFrame, pageviews: DataFrame, keys: Sequence[str], anchor: str = "anchor", with_url: bool = True
) -> DataFrame:
    """``keys`` of every anchor row with the session's least view id above it.

    ``anchors`` has ``keys`` (which include the session id) and the view id
    ``anchor`` of one of the session's views. Returns ``keys`` + ``next_id``
    (+ ``next_url``), NULL where no view follows.

    The range condition rides on an equi-join on the session id and includes
    the anchor itself, so the inner join loses no anchor and no join back is
    needed. Each view meets at most as many anchors as its session has (two
    periods at most), so the join stays linear; a skewed session is split by
    AQE because the join is inner. The minimum is a partial + final
    aggregate -- a hash aggregate when only the id is wanted.
    """
    views = pageviews.select(F.col(SESSION).alias("_vs"), F.col(VIEW).alias("_vid"), F.col("pageview_url").alias("_vurl"))
    joined = anchors.join(views, (F.col(SESSION) == F.col("_vs")) & (F.col("_vid") >= F.col(anchor)), "inner")
    later = F.col("_vid") > F.col(anchor)
    if not with_url:
        return joined.groupBy(*keys).agg(F.min(F.when(later, F.col("_vid"))).alias("next_id"))
    nxt = F.min(F.when(later, F.struct(F.col("_vid").alias("id"), F.col("_vurl").alias("url")))).alias("_n")
    return joined.groupBy(*keys).agg(nxt).select(*keys, F.col("_n.id").alias("next_id"), F.col("_n.url").alias("next_url"))


def each_order(rows: DataFrame, orders: DataFrame, *order_cols: str) -> DataFrame:
    """Left join of ``rows`` with their session's orders, safe for a session with very many.

    A left outer join cannot split its right side, so the matches are an
    inner join and the rows without an order are added by an anti join.
    """
    matched = orders_of(rows, orders, *order_cols)
    kinds = {f.name: f.dataType for f in orders.schema}
    without = rows.join(orders.select(SESSION).distinct(), SESSION, "left_anti")
    return matched.unionByName(without.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in order_cols]))


def orders_of(rows: DataFrame, orders: DataFrame, *order_cols: str) -> DataFrame:
    """Inner join of ``rows`` with their session's orders.

    The key is the id as text: ``rows`` that were grouped by the session id
    are then shuffled anew instead of joined where the grouping left them,
    and only a join of two plain shuffles lets AQE split a session with
    very many orders.
    """
    mine = rows.withColumn("_key", F.col(SESSION).cast("string"))
    theirs = orders.select(F.col(SESSION).cast("string").alias("_key"), *order_cols)
    return mine.join(theirs, "_key").drop("_key")


def of_sessions(pageviews: DataFrame, ids: DataFrame) -> DataFrame:
    """The views of the sessions ``ids``.

    The least and greatest id, two scalar subqueries, are a filter that
    reaches the scan: staged views are sorted by session, so files and row
    groups outside are skipped. The semi-join decides exactly.
    """
    least = ids.agg(F.min(SESSION)).scalar()
    greatest = ids.agg(F.max(SESSION)).scalar()
    return pageviews.filter((F.col(SESSION) >= least) & (F.col(SESSION) <= greatest)).join(ids, SESSION, "left_semi")


def sorted_small(df: DataFrame, *cols) -> DataFrame:
    """Order a report whose size is bounded by calendar or segment keys
    (months, weeks, hours, products, segments).

    Such a result fits one task, so it is moved to one partition and
    sorted there: no range-partitioning sample job. Row-level outputs,
    whose size grows with the data, keep ``orderBy``.
    """
    return df.repartition(1).sortWithinPartitions(*cols)
