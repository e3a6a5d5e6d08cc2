"""Randomised checks of the next-view join and the compact cart drill-down.

Random small sessions (several cart / product views each, sometimes in
both periods, some with orders) are run through the Spark operators and
through a direct Python transcription of the questions as written: every
anchor view against every later view of its session, and the literal
cart-view x cart-view x order fan-out.
"""

import datetime as dt
from collections import Counter
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cartwheel.functions import vocab as V
from cartwheel.operators import paths

PV = "website_pageview_id bigint, created_at timestamp_ntz, website_session_id bigint, pageview_url string"
ORD = "order_id bigint, created_at timestamp_ntz, website_session_id bigint, primary_product_id int, items_purchased int, price_usd decimal(6,2), cogs_usd decimal(6,2)"
PAGES = [V.CART, V.PRODUCTS, V.HOME, V.SHIPPING, V.LOVE_BEAR, V.MR_FUZZY]
# around the cart split (2013-09-05) and inside the cart window
DAYS = [dt.datetime(2013, 8, 30), dt.datetime(2013, 9, 4, 23), dt.datetime(2013, 9, 10), dt.datetime(2013, 10, 1)]

session_st = st.lists(
    st.tuples(
        st.lists(st.tuples(st.sampled_from(PAGES), st.sampled_from(range(len(DAYS)))), min_size=1, max_size=7),
        st.lists(st.tuples(st.integers(1, 2), st.sampled_from(["49.99", "59.99", "109.98"])), max_size=2),
    ),
    min_size=1,
    max_size=6,
)


def _tables(spark, sessions):
    views, orders = [], []
    vid, oid = 1, 1
    for sid, (path, ords) in enumerate(sessions, start=1):
        # view times never go back inside a session
        times = sorted(DAYS[d] for _, d in path)
        for (url, _), t in zip(path, times):
            views.append((vid, t + dt.timedelta(seconds=vid), sid, url))
            vid += 1
        for items, price in ords:
            orders.append((oid, DAYS[-1], sid, 1, items, Decimal(price), Decimal("10.00")))
            oid += 1
    return views, orders, spark.createDataFrame(views, PV), spark.createDataFrame(orders, ORD)


def _label(t):
    return V.PRE_CROSS_SALES_2 if t < dt.datetime(2013, 9, 5) else V.POST_CROSS_SALES_2


def _brute_cart_rows(views, orders):
    cart = [(_label(t), s, v) for v, t, s, u in views if u == V.CART and dt.datetime(2013, 8, 25) <= t <= dt.datetime(2013, 10, 25)]
    nt = {}
    for p, s, v in cart:
        later = [w for w, _, s2, _ in views if s2 == s and w > v]
        if later:
            nt[(p, s)] = min(later) if (p, s) not in nt else min(nt[(p, s)], min(later))
    ses = [(p, s, o) for p, s, _ in cart for o in orders if o[2] == s]
    rows = Counter()
    for p, s, _ in cart:
        se_rows = [k for k in nt if k[1] == s]
        if not se_rows:
            rows[(p, s, 0, 0, None, None)] += 1
            continue
        for _ in se_rows:
            pre = [o for (_, s2, o) in ses if s2 == s]
            if not pre:
                rows[(p, s, 1, 0, None, None)] += 1
            for o in pre:
                rows[(p, s, 1, 1, o[4], float(o[5]))] += 1
    return rows


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(session_st)
def test_cart_drill_down_equals_literal_fanout(spark, sessions):
    views, orders, pv, od = _tables(spark, sessions)
    got = Counter()
    for r in paths.cart_flags(pv, od).collect():
        got[(r.time_period, r.website_session_id, r.click_to_anoter_page, r.placed_order, r.items_purchased, r.price_usd)] += r.n_rows
    assert got == _brute_cart_rows(views, orders)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(session_st)
def test_next_view_equals_all_pairs_minimum(spark, sessions):
    views, _, pv, _ = _tables(spark, sessions)
    window = dict(after="2013-8-1", before="2013-12-1", split="2013-09-05")
    got = {(r.time_period, r.website_session_id): r.min_p_id for r in paths.next_pageview(pv, **window).collect()}
    want = {}
    for v, t, s, u in views:
        if u != V.PRODUCTS or not (dt.datetime(2013, 8, 1) < t < dt.datetime(2013, 12, 1)):
            continue
        key = (V.PRE_PRODUCT_2 if t < dt.datetime(2013, 9, 5) else V.POST_PRODUCT_2, s)
        later = [w for w, _, s2, _ in views if s2 == s and w > v]
        best = min(later) if later else None
        if key not in want:
            want[key] = best
        elif best is not None:
            want[key] = best if want[key] is None else min(want[key], best)
    assert got == want
