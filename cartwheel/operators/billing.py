"""Billing-page test: conversion and revenue of ``/billing`` vs ``/billing-2``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.functions import ratio
from cartwheel.functions import vocab as V
from cartwheel.operators.common import (
    SESSION,
    VIEW,
    created_after,
    created_before,
    each_order,
    n_orders,
    n_sessions,
    sessions_with_orders,
)
from cartwheel.operators.landing import _first_id_of


def _test_views(pageviews: DataFrame, until: str, pages: Sequence[str], test_page: str) -> DataFrame:
    start_id = _first_id_of(pageviews, test_page)
    return pageviews.filter(
        (F.col(VIEW) >= start_id) & created_before(until) & F.col("pageview_url").isin(list(pages))
    )


def billing_test_views(
    pageviews: DataFrame,
    orders: DataFrame,
    until: str = V.BILLING_TEST_UNTIL,
    pages: Sequence[str] = (V.BILLING, V.BILLING_2),
    test_page: str = V.BILLING_2,
) -> DataFrame:
    """Billing pages seen since the test began with their session's orders; ``n_rows`` is the number of views.

    The original lists every view with every order; equal rows are returned once with their number.
    """
    views = _test_views(pageviews, until, pages, test_page).groupBy(SESSION, "pageview_url").agg(F.count(F.lit(1)).alias("n_rows"))
    return each_order(views, orders, "order_id")


def billing_conversion(
    pageviews: DataFrame,
    orders: DataFrame,
    until: str = V.BILLING_TEST_UNTIL,
    pages: Sequence[str] = (V.BILLING, V.BILLING_2),
    test_page: str = V.BILLING_2,
) -> DataFrame:
    """Sessions, orders and conversion per billing page."""
    keyed = _test_views(pageviews, until, pages, test_page).select("pageview_url", SESSION).distinct()
    rows = sessions_with_orders(keyed, orders)
    return (
        rows.groupBy("pageview_url")
        .agg(n_sessions().alias("sessions"), n_orders().alias("orders"))
        .withColumn("conversion", ratio("orders", "sessions"))
    )


def billing_revenue(
    pageviews: DataFrame,
    orders: DataFrame,
    after: str = V.BILLING_REVENUE_AFTER,
    before: str = V.BILLING_REVENUE_BEFORE,
    pages: Sequence[str] = (V.BILLING, V.BILLING_2),
) -> DataFrame:
    """Sessions and revenue per session per billing page.

    As in the original question the revenue of a session counts once per
    billing view of that page (a session that saw ``/billing`` twice
    counts its order twice). That sum is ``views x session revenue`` per
    (page, session), so the fan-out is never materialised.
    """
    keyed = (
        pageviews.filter(created_after(after) & created_before(before) & F.col("pageview_url").isin(list(pages)))
        .groupBy(F.col("pageview_url").alias("billing_version_seen"), SESSION)
        .agg(F.count(F.lit(1)).alias("n_views"))
    )
    rows = sessions_with_orders(keyed, orders)
    return rows.groupBy("billing_version_seen").agg(
        n_sessions().alias("sessions"),
        F.sum(F.col("n_views") * F.col("_revenue")).alias("_rev"),
    ).select("billing_version_seen", "sessions", ratio("_rev", "sessions").alias("revenue_per_click"))
