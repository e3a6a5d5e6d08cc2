"""Brute-force check of every report on a hand-made shop with hot keys.

One user holds about a third of all sessions, four sessions hold most of
the page views (long paths through products, cart and billing), one
session has several orders, some orders have 40 items and some items
several refunds. The SQL side runs the long forms (range self-joins,
fan-out joins, distinct counts) directly on these tables.
"""

import pytest

from cartwheel.plans.catalog import REPORTS
from cartwheel.plans.oracle import REPORT_SQL, over_given_tables
from compare import compare
from fixture_shop import build_pair

# (seed, sessions, share of sessions held by one user)
SHOPS = [(7, 600, 0.33), (11, 250, 0.6)]


@pytest.fixture(scope="module", params=SHOPS, ids=lambda p: f"seed{p[0]}")
def fixture_pair(spark, request):
    return build_pair(spark, *request.param)


def test_fixture_is_skewed(fixture_pair):
    _, _, t = fixture_pair
    s, v = t["website_sessions"], t["website_pageviews"]
    assert (s.user_id == 7).mean() > 0.25
    assert v.groupby("website_session_id").size().max() > 0.1 * len(v)
    assert v.groupby("website_session_id").size().max() > 500


@pytest.mark.parametrize("key", list(REPORTS))
def test_report_on_skewed_fixture(fixture_pair, key):
    shop, con, _ = fixture_pair
    diff = compare(REPORTS[key](shop), con, over_given_tables(REPORT_SQL[key]))
    assert diff is None, diff
