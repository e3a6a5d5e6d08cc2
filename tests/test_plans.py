"""Physical-plan guards: the shapes the scale design relies on."""

import re

import pytest

from cartwheel.plans.catalog import REPORTS

# reports whose plan may hold a window, and why it is bounded
BOUNDED_WINDOWS = {
    # one row per (period, session): at most two rows per session
    "s75_cart_flags",
    "s76_cart_metrics",
    # at most RANGE_IDS rows of one user, and a row per range of a user
    "s83_repeat_lag",
    "s84_repeat_lag_stats",
}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", list(REPORTS))
def test_no_pairs_no_expand(staged_check, key):
    plan = _plan(REPORTS[key](staged_check))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "Expand" not in plan, "distinct counts should be grain counts"
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, "no Python UDFs"
    if key not in BOUNDED_WINDOWS:
        assert not re.search(r"\bWindow\b", plan)


@pytest.mark.parametrize(
    "key, column",
    [
        ("s03_gsearch_cvr", "created_at"),
        ("s07_top_pages", "created_at"),
        ("s63_hour_weekday", "created_at"),
        ("s71_cart_views", "pageview_url"),
        ("s78_refund_rates", "created_at"),
    ],
)
def test_filters_reach_the_scan(staged_check, key, column):
    df = REPORTS[key](staged_check)
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = re.findall(r"PushedFilters: \[([^\]]*)", plan)
    assert any(column in p for p in pushed), pushed


def test_scan_prunes_columns(staged_check):
    plan = _plan(REPORTS["s02_traffic_sources"](staged_check))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all("user_id" not in s and "device_type" not in s for s in schemas), schemas


def test_derivation_limits_ranks_before_the_shuffle(spark):
    from cartwheel.sources import derive_shop

    from compare import SF_CHECK

    plan = _plan(derive_shop(spark.read.parquet(f"{SF_CHECK}/events.parquet")).pageviews)
    # Spark plans row_number() <= 10 with a partial limit below the exchange
    assert re.search(r"Exchange hashpartitioning\(user_id#\d+L?, blk#\d+L?.*\n.*WindowGroupLimit", plan) or (
        plan.count("WindowGroupLimit") >= 2
    ), plan
