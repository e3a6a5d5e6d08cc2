"""Hand-made cases for the traps of the original analysis."""

import datetime as dt
from decimal import Decimal

import pytest

from cartwheel.functions import vocab as V
from cartwheel.operators import billing, conversion, paths, repeat, traffic

SES = "website_session_id bigint, created_at timestamp_ntz, user_id bigint, is_repeat_session int, utm_source string, utm_campaign string, device_type string, http_referer string"
PV = "website_pageview_id bigint, created_at timestamp_ntz, website_session_id bigint, pageview_url string"
ORD = "order_id bigint, created_at timestamp_ntz, website_session_id bigint, primary_product_id int, items_purchased int, price_usd decimal(6,2), cogs_usd decimal(6,2)"


def T(s):
    return dt.datetime.fromisoformat(s)


def test_revenue_counts_once_per_billing_view(spark):
    # row 11: a session that saw /billing twice counts its order twice
    pv = spark.createDataFrame(
        [(1, T("2012-10-01 10:00:00"), 1, V.BILLING), (2, T("2012-10-01 10:01:00"), 1, V.BILLING), (3, T("2012-10-02 10:00:00"), 2, V.BILLING)],
        PV,
    )
    orders = spark.createDataFrame([(9, T("2012-10-01 10:02:00"), 1, 1, 1, Decimal("50.00"), Decimal("20.00"))], ORD)
    row = billing.billing_revenue(pv, orders).first()
    assert row.sessions == 2 and row.revenue_per_click == 50.0  # (2 x 50) / 2 sessions


def test_cart_fanout_is_kept_in_the_sums(spark):
    # row 12: session 1 has three cart views (each followed by a view) and one order:
    # each cart view meets each of the 3 cart-view x order rows -> 9 rows
    pv = spark.createDataFrame(
        [
            (1, T("2013-09-10 10:00:00"), 1, V.CART),
            (2, T("2013-09-10 10:01:00"), 1, V.CART),
            (3, T("2013-09-10 10:02:00"), 1, V.CART),
            (4, T("2013-09-10 10:03:00"), 1, V.SHIPPING),
        ],
        PV,
    )
    orders = spark.createDataFrame([(9, T("2013-09-10 10:04:00"), 1, 1, 1, Decimal("50.00"), Decimal("20.00"))], ORD)
    flags = paths.cart_flags(pv, orders).collect()
    assert [(r.click_to_anoter_page, r.placed_order, r.n_rows) for r in flags] == [(1, 1, 9)]
    m = paths.cart_metrics(pv, orders).first()
    assert (m.cart_sessions, m.ctr, m.cart_ctr, m.aov, m.rev_per_cart_session) == (1, 9, 9, 50.0, 450.0)


def test_overlapping_period_labels_first_match_wins(spark):
    # row 6: '< 2013-09-05' is tested before '>= 2013-01-06'
    pv = spark.createDataFrame(
        [(1, T("2013-09-01 00:00:00"), 1, V.CART), (2, T("2013-09-06 00:00:00"), 2, V.CART)], PV
    )
    labels = {r.website_session_id: r.time_period for r in paths.cart_views(pv).collect()}
    assert labels == {1: V.PRE_CROSS_SALES_2, 2: V.POST_CROSS_SALES_2}


def _sessions(spark, rows):
    return spark.createDataFrame(rows, SES)


def test_comma_referers_never_match(spark):
    # row 8: as written, no session is organic; with real URLs one is
    s = _sessions(spark, [(1, T("2014-02-01 00:00:00"), 1, 0, None, None, "desktop", "https://www.gsearch.com")])
    as_written = {r.channel_group for r in traffic.channel_groups(s).collect()}
    fixed = {r.channel_group for r in traffic.channel_groups(s, organic_referers=V.ORGANIC_REFERERS).collect()}
    assert as_written == {None} and fixed == {V.CHANNEL_ORGANIC}


def test_months_of_different_years_share_a_row(spark):
    # row 15
    s = _sessions(
        spark,
        [
            (1, T("2012-04-02 00:00:00"), 1, 0, "gsearch", "nonbrand", "desktop", None),
            (2, T("2013-04-02 00:00:00"), 2, 0, "gsearch", "nonbrand", "desktop", None),
        ],
    )
    orders = spark.createDataFrame([], ORD)
    rows = conversion.gsearch_monthly_by_campaign(s, orders, until="2014-01-01").collect()
    assert [(r.months, r.sessions) for r in rows] == [(4, 2)]


@pytest.mark.parametrize("gap_days, expected", [(3, 3), (0, 0)])
def test_repeat_lag_counts_calendar_days(spark, gap_days, expected):
    # row 5: least day count per user
    first = T("2014-03-01 23:00:00")
    s = _sessions(
        spark,
        [
            (1, first, 5, 0, None, None, "desktop", None),
            (2, first + dt.timedelta(days=gap_days, minutes=30), 5, 1, None, None, "desktop", None),
        ],
    )
    row = repeat.repeat_lag(s).first()
    assert row.user_id == 5 and row.diff == (expected if gap_days else 0)
