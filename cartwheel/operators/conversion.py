"""Session-to-order conversion by segment and period.

All reports here are one shape: filter sessions, give each a segment
key, match its orders, and aggregate sessions, orders and revenue per
key (see ``common.sessions_with_orders``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwheel.functions import count_when, money, ratio, split_label, sunday_week, ts
from cartwheel.functions import vocab as V
from cartwheel.operators.common import (
    CREATED,
    SESSION,
    created_after,
    created_before,
    created_between,
    n_orders,
    n_sessions,
    paid_search,
    per_distinct_order,
    revenue,
    sessions_with_orders,
    sorted_small,
)
from cartwheel.operators.distinct import distinct_counts


def _keyed(sessions: DataFrame, where: Column, **keys: Column) -> DataFrame:
    return sessions.filter(where).select(SESSION, *[c.alias(n) for n, c in keys.items()])


def _counts(
    keyed: DataFrame, orders: DataFrame, by: Sequence[str], *extra: Column, per_session: dict[str, Column] | None = None
) -> DataFrame:
    rows = sessions_with_orders(keyed, orders, **(per_session or {}))
    aggs = [n_sessions().alias("sessions"), n_orders().alias("orders"), *extra]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def conversion_by(
    sessions: DataFrame,
    orders: DataFrame,
    where: Column | None = None,
    keys: dict[str, Column] | Sequence[str] = (),
    percent: bool = False,
    with_revenue: bool = False,
    repeated_ids: bool = False,
) -> DataFrame:
    """Sessions, orders and conversion per segment -- the general form of
    the conversion reports below.

    ``keys`` are session columns, or ``name -> Column`` (e.g.
    ``{"yr": F.year("created_at")}``); ``where`` filters the sessions.
    ``with_revenue`` adds revenue and revenue per session. ``repeated_ids``:
    rows of either table may repeat an id, so count different sessions and
    orders; sums of money need unique orders.
    """
    if not isinstance(keys, dict):
        keys = {c: F.col(c) for c in keys}
    keyed = _keyed(sessions, where if where is not None else F.lit(True), **keys)
    if repeated_ids:
        if with_revenue:
            raise ValueError("revenue needs tables without repeated orders; open_shop merges them")
        return _distinct_conversion(keyed, orders, list(keys), percent)
    extra = [revenue().alias("_rev")] if with_revenue else []
    out = _counts(keyed, orders, list(keys), *extra)
    cols = [*keys, "sessions", "orders", ratio("orders", "sessions", 100 if percent else None).alias("conv")]
    if with_revenue:
        cols += [money("_rev").alias("revenue"), ratio("_rev", "sessions").alias("rev_per_session")]
    return out.select(*cols)


def _distinct_conversion(keyed: DataFrame, orders: DataFrame, by: list[str], percent: bool) -> DataFrame:
    cells = {k: F.col(k) for k in by}
    seen = distinct_counts(keyed, SESSION, {"sessions": F.lit(True)}, cells)
    # an inner join, so that a session with very many orders can be split
    bought = keyed.join(orders.select(F.col(SESSION).alias("_of"), "order_id"), F.col(SESSION) == F.col("_of"))
    bought = distinct_counts(bought, "order_id", {"orders": F.lit(True)}, cells).select(*[F.col(k).alias(f"_k_{k}") for k in by], "orders")
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = seen.join(bought, same, "left").withColumn("orders", F.coalesce("orders", F.lit(0)).cast("bigint"))
    return out.select(*by, "sessions", "orders", ratio("orders", "sessions", 100 if percent else None).alias("conv"))


def search_conversion(
    sessions: DataFrame,
    orders: DataFrame,
    until: str = V.TRAFFIC_UNTIL,
    source: str = V.GSEARCH,
    campaign: str = V.NONBRAND,
    by: Sequence[str] = (),
) -> DataFrame:
    """Sessions, orders and conversion (percent) of a paid channel.

    With ``by`` (e.g. ``["device_type"]``) one row per segment.
    """
    keyed = _keyed(sessions, created_before(until) & paid_search(source, campaign), **{c: F.col(c) for c in by})
    out = _counts(keyed, orders, list(by))
    return out.select(*by, "sessions", "orders", ratio("orders", "sessions", 100).alias("cvr"))


def monthly_conversion(
    sessions: DataFrame,
    orders: DataFrame,
    where: Column,
    by: Sequence[str] = (),
    with_year: bool = False,
    month_name: str = "months",
    with_conv: bool = True,
) -> DataFrame:
    """Sessions and orders per month (and optionally year) and segment."""
    keys: dict[str, Column] = {}
    if with_year:
        keys["yr"] = F.year(CREATED)
    keys[month_name] = F.month(CREATED)
    keys.update({c: F.col(c) for c in by})
    out = _counts(_keyed(sessions, where, **keys), orders, list(keys))
    cols = [*keys, "sessions", "orders"]
    if with_conv:
        out = out.withColumn("conv", ratio("orders", "sessions"))
        cols.append("conv")
    # free segment columns (campaigns) are not bounded like calendar keys
    return out.select(*cols).orderBy(*keys) if by else sorted_small(out.select(*cols), *keys)


def gsearch_monthly(sessions: DataFrame, orders: DataFrame, until: str = V.MID_PROJECT_UNTIL) -> DataFrame:
    return monthly_conversion(
        sessions, orders, created_before(until) & paid_search(V.GSEARCH), with_year=True, with_conv=False
    )


def gsearch_monthly_by_campaign(sessions: DataFrame, orders: DataFrame, until: str = V.MID_PROJECT_UNTIL) -> DataFrame:
    return monthly_conversion(sessions, orders, created_before(until) & paid_search(V.GSEARCH), by=["utm_campaign"])


def nonbrand_monthly_by_device(sessions: DataFrame, orders: DataFrame, until: str = V.MID_PROJECT_UNTIL) -> DataFrame:
    return monthly_conversion(
        sessions, orders, created_before(until) & paid_search(V.GSEARCH, V.NONBRAND), by=["device_type"]
    )


def site_monthly(sessions: DataFrame, orders: DataFrame, until: str = V.MID_PROJECT_UNTIL) -> DataFrame:
    return monthly_conversion(sessions, orders, created_before(until))


def device_source_conversion(
    sessions: DataFrame,
    orders: DataFrame,
    start: str = V.DEVICE_SOURCE_FROM,
    end: str = V.DEVICE_SOURCE_TO,
    sources: Sequence[str] = (V.GSEARCH, V.BSEARCH),
    campaign: str = V.NONBRAND,
) -> DataFrame:
    keyed = _keyed(
        sessions,
        created_between(start, end) & paid_search(sources, campaign),
        device_type=F.col("device_type"),
        utm_source=F.col("utm_source"),
    )
    out = _counts(keyed, orders, ["device_type", "utm_source"])
    return out.withColumn("conv", ratio("orders", "sessions"))


def seasonality_monthly(sessions: DataFrame, orders: DataFrame, through: str = V.SEASONALITY_THROUGH) -> DataFrame:
    """Sessions and orders per year and month up to midnight of ``through``."""
    keyed = _keyed(sessions, F.col(CREATED) <= ts(through), yr=F.year(CREATED), mon=F.month(CREATED))
    return sorted_small(_counts(keyed, orders, ["yr", "mon"]), "mon", "yr")


def seasonality_weekly(sessions: DataFrame, orders: DataFrame, through: str = V.SEASONALITY_THROUGH) -> DataFrame:
    """Sessions and orders per Sunday-week number (years merged)."""
    keyed = _keyed(
        sessions,
        F.col(CREATED) <= ts(through),
        wk=sunday_week(CREATED),
        _day=F.to_date(CREATED),
    )
    rows = sessions_with_orders(keyed, orders)
    out = rows.groupBy("wk").agg(
        F.min("_day").alias("week_start"), n_sessions().alias("sessions"), n_orders().alias("orders")
    )
    return sorted_small(out, "wk")


def launch_impact(
    sessions: DataFrame, orders: DataFrame, after: str = V.LAUNCH_AFTER, before: str = V.LAUNCH_BEFORE
) -> DataFrame:
    """Monthly conversion, revenue per session and orders per primary product."""
    keyed = _keyed(
        sessions, created_before(before) & created_after(after), yr=F.year(CREATED), mon=F.month(CREATED)
    )
    prod = F.col("primary_product_id")
    out = _counts(
        keyed,
        orders,
        ["yr", "mon"],
        revenue().alias("_rev"),
        per_distinct_order(F.col("_p1")).alias("product_one_order"),
        per_distinct_order(F.col("_p2")).alias("product_two_order"),
        per_session={"_p1": count_when(prod == 1), "_p2": count_when(prod == 2)},
    )
    return out.select(
        "yr",
        "mon",
        "sessions",
        "orders",
        ratio("orders", "sessions").alias("conv"),
        ratio("_rev", "sessions").alias("rev_per_session"),
        "product_one_order",
        "product_two_order",
    )


def period_scorecard(
    sessions: DataFrame,
    orders: DataFrame,
    start: str = V.SCORECARD_FROM,
    end: str = V.SCORECARD_TO,
    split: str = V.SCORECARD_SPLIT,
) -> DataFrame:
    """Before/after scorecard: conversion, revenue, products per order."""
    label = split_label(F.col(CREATED), split, V.PRE_CROSS_SALES_2, V.POST_CROSS_SALES_2, V.PERIOD_FALLBACK)
    keyed = _keyed(sessions, created_between(start, end), time_period=label)
    out = _counts(
        keyed, orders, ["time_period"], revenue().alias("_rev"), F.sum("_bought").alias("_items"),
        per_session={"_bought": F.sum("items_purchased")},
    )
    return out.select(
        "time_period",
        "sessions",
        "orders",
        ratio("orders", "sessions").alias("conv"),
        money("_rev").alias("total_rev"),
        F.col("_items").cast("bigint").alias("total_products_sold"),
        ratio("_rev", "orders").alias("av_order_value"),
        ratio("_items", "orders").alias("product_per_order"),
        ratio("_rev", "sessions").alias("revenue_per_session"),
    )


def new_vs_repeat(
    sessions: DataFrame, orders: DataFrame, start: str = V.NEW_VS_REPEAT_FROM, end: str = V.NEW_VS_REPEAT_TO
) -> DataFrame:
    keyed = _keyed(sessions, created_between(start, end), is_repeat_session=F.col("is_repeat_session"))
    out = _counts(keyed, orders, ["is_repeat_session"], revenue().alias("_rev"))
    return out.select(
        "is_repeat_session",
        "sessions",
        "orders",
        ratio("orders", "sessions").alias("conv"),
        ratio("_rev", "sessions").alias("rev_per_sesion"),
    )


def quarterly(sessions: DataFrame, orders: DataFrame, efficiency: bool = False) -> DataFrame:
    """Sessions and orders per year and quarter over all data.

    With ``efficiency``: conversion and revenue ratios. The two revenue
    columns keep the names of the original question, which are swapped:
    ``rev_per_session`` is revenue per order and ``rev_per_order`` is
    revenue per session.
    """
    keyed = _keyed(sessions, F.lit(True), yr=F.year(CREATED), quat=F.quarter(CREATED))
    if not efficiency:
        return sorted_small(_counts(keyed, orders, ["yr", "quat"]), "yr", "quat")
    out = _counts(keyed, orders, ["yr", "quat"], revenue().alias("_rev"))
    return out.select(
        "yr",
        "quat",
        "sessions",
        "orders",
        ratio("orders", "sessions").alias("conv"),
        ratio("_rev", "orders").alias("rev_per_session"),
        ratio("_rev", "sessions").alias("rev_per_order"),
    ).transform(lambda df: sorted_small(df, "yr", "quat"))


def quarterly_channel_conversion(sessions: DataFrame, orders: DataFrame) -> DataFrame:
    """Per year and quarter, orders / sessions of five channels."""
    src, camp, ref = F.col("utm_source"), F.col("utm_campaign"), F.col("http_referer")
    channels = {
        "gsearch_nonbrand_orders": (src == V.GSEARCH) & (camp == V.NONBRAND),
        "bsearch_nonbrand_orders": (src == V.BSEARCH) & (camp == V.NONBRAND),
        "brand_searc_orders": camp == V.BRAND,
        "or_searc_orders": src.isNull() & ref.isNotNull(),
        "direct_type_in": src.isNull() & ref.isNull(),
    }
    flags = {f"_c{i}": F.coalesce(cond, F.lit(False)) for i, cond in enumerate(channels.values())}
    keyed = _keyed(sessions, F.lit(True), yr=F.year(CREATED), quat=F.quarter(CREATED), **flags)
    rows = sessions_with_orders(keyed, orders)
    aggs = []
    for i in range(len(channels)):
        aggs.append(F.count_if(F.col(f"_c{i}")).alias(f"_s{i}"))
        aggs.append(per_distinct_order(F.when(F.col(f"_c{i}"), F.col("_orders"))).alias(f"_o{i}"))
    out = rows.groupBy("yr", "quat").agg(*aggs)
    return out.select(
        "yr", "quat", *[ratio(f"_o{i}", f"_s{i}").alias(name) for i, name in enumerate(channels)]
    ).transform(lambda df: sorted_small(df, "yr", "quat"))
