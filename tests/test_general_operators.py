"""The general operators reproduce the fixed reports they generalise."""

from pyspark.sql import functions as F

from cartwheel.functions import vocab as V
from cartwheel.operators import conversion, traffic
from cartwheel.operators.common import created_before, created_between, paid_search


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_conversion_by_matches_device_report(staged_check):
    t = staged_check
    general = conversion.conversion_by(
        t.sessions, t.orders, created_before("2012-05-11") & paid_search(V.GSEARCH, V.NONBRAND), ["device_type"], percent=True
    )
    fixed = conversion.search_conversion(t.sessions, t.orders, until="2012-05-11", by=["device_type"])
    assert _rows(general) == _rows(fixed)


def test_conversion_by_revenue_matches_new_vs_repeat(staged_check):
    t = staged_check
    general = conversion.conversion_by(
        t.sessions, t.orders, created_between("2014-01-01", "2014-11-08"), ["is_repeat_session"], with_revenue=True
    ).select("is_repeat_session", "sessions", "orders", "conv", "rev_per_session")
    fixed = conversion.new_vs_repeat(t.sessions, t.orders)
    assert _rows(general) == _rows(fixed)


def test_volume_matches_weekly_device_report(staged_check):
    s = staged_check.sessions
    general = traffic.volume(
        s,
        created_between("2012-04-15", "2012-06-09") & paid_search(V.GSEARCH, V.NONBRAND),
        "week",
        {"dtop_sessions": F.col("device_type") == V.DESKTOP, "mob_sessions": F.col("device_type") == V.MOBILE},
    )
    assert _rows(general) == _rows(traffic.weekly_device(s))


def test_volume_by_quarter_counts_all_sessions(staged_check):
    s = staged_check.sessions
    total = sum(r.sessions for r in traffic.volume(s, period="quarter").collect())
    assert total == s.count()
