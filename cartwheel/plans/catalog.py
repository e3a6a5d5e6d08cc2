"""Every report of the original analysis under one key.

Each entry takes ``(spark, path)``, opens the shop tables of ``path``
(``sources.open_shop``) and returns the report DataFrame with the
original question's dates and pages. Keys are ``s<statement number>_``
plus a short name; staged intermediate tables the analysis printed have
keys too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cartwheel.functions import vocab as V
from cartwheel.operators import billing, conversion, funnel, landing, paths, products, repeat, traffic
from cartwheel.sources import ShopTables, open_shop

Report = Callable[[ShopTables], DataFrame]

# landing-page test windows of the original analysis
_LANDER_TEST = dict(until=V.LANDER_TEST_UNTIL, test_page=V.LANDER_1)
_LANDER_TEST_INCL = dict(until=V.LANDER_TEST_UNTIL, test_page=V.LANDER_1, inclusive=True)

REPORTS: dict[str, Report] = {
    "s02_traffic_sources": lambda t: traffic.traffic_sources(t.sessions),
    "s03_gsearch_cvr": lambda t: conversion.search_conversion(t.sessions, t.orders),
    "s04_weekly_volume": lambda t: traffic.weekly_volume(t.sessions),
    "s05_device_cvr": lambda t: conversion.search_conversion(
        t.sessions, t.orders, until=V.DEVICE_CVR_UNTIL, by=["device_type"]
    ),
    "s06_weekly_device": lambda t: traffic.weekly_device(t.sessions),
    "s07_top_pages": lambda t: landing.top_pages(t.pageviews),
    "s08_entry_pages": lambda t: landing.entry_pages(t.pageviews, t.session_facts),
    "s09_first_pageview": lambda t: landing.first_pageview(t.pageviews),
    "s11_landing_page": lambda t: landing.landing_pages(t.pageviews),
    "s13_bounced_sessions": lambda t: landing.bounced_sessions(t.pageviews, facts=t.session_facts),
    "s15_bounce_rate": lambda t: landing.bounce_rate(t.pageviews, facts=t.session_facts),
    "s16_first_lander": lambda t: landing.first_page_seen(t.pageviews, V.LANDER_1),
    "s17_test_first_pv": lambda t: landing.test_first_views(t.pageviews, t.sessions, **_LANDER_TEST),
    "s19_test_landing": lambda t: landing.test_landing(t.pageviews, t.sessions, **_LANDER_TEST).drop("n_views"),
    "s20_test_bounce": lambda t: landing.test_landing(t.pageviews, t.sessions, with_bounce=True, **_LANDER_TEST),
    "s22_ab_bounce": lambda t: landing.ab_bounce(t.pageviews, t.sessions, **_LANDER_TEST),
    "s23_session_first_count": lambda t: landing.session_first_and_count(t.pageviews, t.sessions, facts=t.session_facts),
    "s25_session_landing": lambda t: landing.session_first_and_count(
        t.pageviews, t.sessions, with_landing=True, facts=t.session_facts
    ),
    "s27_weekly_landing": lambda t: landing.weekly_landing_mix(t.pageviews, t.sessions, facts=t.session_facts),
    "s28_pageview_flags": lambda t: funnel.pageview_flags(t.sessions, t.pageviews),
    "s29_session_flags": lambda t: funnel.click_funnel_flags(t.sessions, t.pageviews, facts=t.session_facts),
    "s30_funnel_counts": lambda t: funnel.funnel_counts(funnel.click_funnel_flags(t.sessions, t.pageviews, facts=t.session_facts)),
    "s31_funnel_rates": lambda t: funnel.funnel_rates(funnel.click_funnel_flags(t.sessions, t.pageviews, facts=t.session_facts)),
    "s37_first_billing2": lambda t: landing.first_page_seen(t.pageviews, V.BILLING_2),
    "s38_billing_test": lambda t: billing.billing_test_views(t.pageviews, t.orders),
    "s40_billing_cvr": lambda t: billing.billing_conversion(t.pageviews, t.orders),
    "s41_monthly_gsearch": lambda t: conversion.gsearch_monthly(t.sessions, t.orders),
    "s42_monthly_campaign": lambda t: conversion.gsearch_monthly_by_campaign(t.sessions, t.orders),
    "s43_monthly_device": lambda t: conversion.nonbrand_monthly_by_device(t.sessions, t.orders),
    "s44_monthly_channel": lambda t: traffic.monthly_channels(t.sessions),
    "s45_monthly_cvr": lambda t: conversion.site_monthly(t.sessions, t.orders),
    "s46_test_first_pv": lambda t: landing.test_first_views(t.pageviews, t.sessions, **_LANDER_TEST_INCL),
    "s47_test_landing": lambda t: landing.test_landing(t.pageviews, t.sessions, **_LANDER_TEST_INCL).drop("n_views"),
    "s48_test_orders": lambda t: landing.test_orders(t.pageviews, t.sessions, t.orders, **_LANDER_TEST_INCL),
    "s50_ab_cvr": lambda t: landing.ab_conversion(t.pageviews, t.sessions, t.orders, **_LANDER_TEST_INCL),
    "s51_last_home_session": lambda t: landing.last_session_seeing(t.sessions, t.pageviews, facts=t.session_facts),
    "s52_sessions_since": lambda t: landing.sessions_since_last(t.sessions, t.pageviews, facts=t.session_facts),
    "s53_session_flags8": lambda t: funnel.lander_funnel_flags(t.sessions, t.pageviews, facts=t.session_facts),
    "s54_segment_funnel": lambda t: funnel.segment_funnel(funnel.lander_funnel_flags(t.sessions, t.pageviews, facts=t.session_facts)),
    "s55_segment_rates": lambda t: funnel.segment_rates(funnel.lander_funnel_flags(t.sessions, t.pageviews, facts=t.session_facts)),
    "s56_billing_revenue": lambda t: billing.billing_revenue(t.pageviews, t.orders),
    "s57_weekly_sources": lambda t: traffic.weekly_sources(t.sessions),
    "s58_source_mobile": lambda t: traffic.source_mobile_share(t.sessions),
    "s59_device_source_cvr": lambda t: conversion.device_source_conversion(t.sessions, t.orders),
    "s60_bid_change": lambda t: traffic.bid_change_weekly(t.sessions),
    "s61_season_month": lambda t: conversion.seasonality_monthly(t.sessions, t.orders),
    "s62_season_week": lambda t: conversion.seasonality_weekly(t.sessions, t.orders),
    "s63_hour_weekday": lambda t: traffic.hour_weekday_grid(t.sessions),
    "s64_sales_trend": lambda t: products.sales_trend(t.orders),
    "s65_launch_impact": lambda t: conversion.launch_impact(t.sessions, t.orders),
    "s66_products_views": lambda t: paths.product_page_views(t.pageviews),
    "s68_next_pageview": lambda t: paths.next_pageview(t.pageviews),
    "s69_next_url": lambda t: paths.next_page_url(t.pageviews),
    "s70_next_page_mix": lambda t: paths.next_page_mix(t.pageviews),
    "s71_cart_views": lambda t: paths.cart_views(t.pageviews),
    "s72_cart_next": lambda t: paths.cart_next(t.pageviews),
    "s74_cart_orders": lambda t: paths.cart_orders(t.pageviews, t.orders),
    "s75_cart_flags": lambda t: paths.cart_flags(t.pageviews, t.orders),
    "s76_cart_metrics": lambda t: paths.cart_metrics(t.pageviews, t.orders),
    "s77_period_scorecard": lambda t: conversion.period_scorecard(t.sessions, t.orders),
    "s78_refund_rates": lambda t: products.refund_rates(t.order_items, t.refunds),
    "s79_repeat_pairs": lambda t: repeat.repeat_pairs(t.sessions),
    "s81_repeat_histogram": lambda t: repeat.repeat_histogram(t.sessions),
    "s82_repeat_dates": lambda t: repeat.repeat_pairs(t.sessions, with_dates=True),
    "s83_repeat_lag": lambda t: repeat.repeat_lag(t.sessions),
    "s84_repeat_lag_stats": lambda t: repeat.repeat_lag_stats(t.sessions),
    "s85_channel_group": lambda t: traffic.channel_groups(t.sessions),
    "s85_channel_group_fixed": lambda t: traffic.channel_groups(t.sessions, organic_referers=V.ORGANIC_REFERERS),
    "s86_new_vs_repeat": lambda t: conversion.new_vs_repeat(t.sessions, t.orders),
    "s87_quarter_volume": lambda t: conversion.quarterly(t.sessions, t.orders),
    "s88_quarter_efficiency": lambda t: conversion.quarterly(t.sessions, t.orders, efficiency=True),
    "s89_quarter_channel_cvr": lambda t: conversion.quarterly_channel_conversion(t.sessions, t.orders),
    "s90_product_margin": lambda t: products.product_margins(t.order_items),
    "s91_products_views": lambda t: paths.product_views(t.pageviews),
    "s92_products_ctr": lambda t: paths.product_click_through(t.pageviews, t.orders, facts=t.session_facts),
    "s93_recent_orders": lambda t: products.recent_orders(t.orders),
    "s94_cross_sell_matrix": lambda t: products.cross_sell_matrix(t.orders, t.order_items),
}

# reports that read no other table: nothing else is derived for them
SESSIONS_ONLY = frozenset({
    "s02_traffic_sources", "s04_weekly_volume", "s06_weekly_device", "s44_monthly_channel", "s57_weekly_sources", "s58_source_mobile",
    "s60_bid_change", "s63_hour_weekday", "s79_repeat_pairs", "s81_repeat_histogram", "s82_repeat_dates", "s83_repeat_lag",
    "s84_repeat_lag_stats", "s85_channel_group", "s85_channel_group_fixed",
})


def run(key: str, spark: SparkSession, path: str) -> DataFrame:
    """The report ``key`` over the shop tables of ``path``."""
    return REPORTS[key](open_shop(spark, path, sessions_only=key in SESSIONS_ONLY))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """``key -> (spark, path) -> DataFrame`` for every report."""
    return {key: (lambda spark, path, _k=key: run(_k, spark, path)) for key in REPORTS}
