"""Reports read from staged session facts equal the same reports computed
from the page views."""

import pytest

from cartwheel.plans.catalog import REPORTS
from cartwheel.sources import ShopTables

FACT_REPORTS = [
    "s08_entry_pages",
    "s13_bounced_sessions",
    "s15_bounce_rate",
    "s23_session_first_count",
    "s25_session_landing",
    "s27_weekly_landing",
    "s29_session_flags",
    "s30_funnel_counts",
    "s31_funnel_rates",
    "s51_last_home_session",
    "s52_sessions_since",
    "s53_session_flags8",
    "s54_segment_funnel",
    "s55_segment_rates",
    "s92_products_ctr",
]


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_staged_shop_has_facts(staged_check):
    assert staged_check.session_facts is not None
    assert staged_check.session_facts.count() == staged_check.pageviews.select("website_session_id").distinct().count()


@pytest.mark.parametrize("key", FACT_REPORTS)
def test_facts_and_views_agree(staged_check, key):
    t = staged_check
    without = ShopTables(t.sessions, t.pageviews, t.orders, t.order_items, t.refunds)
    with_facts = REPORTS[key](t)
    plan = with_facts._jdf.queryExecution().executedPlan().toString()
    assert any(c in plan for c in ("first_url", "n_views", "last_view_id", "seen_")), "reads the facts"
    assert _rows(with_facts) == _rows(REPORTS[key](without))


def test_stored_tables_get_staged_facts(spark, staged_check, tmp_path):
    """Tables stored by the user (no events) get session facts too."""
    from cartwheel.sources import open_shop
    from cartwheel.sources.tables import TABLE_FILES

    root = str(tmp_path / "shop")
    for name, field in TABLE_FILES.items():
        getattr(staged_check, field).write.parquet(f"{root}/{name}.parquet")
    shop = open_shop(spark, root)
    for key in ("s29_session_flags", "s92_products_ctr"):
        assert _rows(REPORTS[key](shop)) == _rows(REPORTS[key](staged_check))
