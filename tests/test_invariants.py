"""Invariants of the reports at sf 0.01."""

from pyspark.sql import functions as F

from cartwheel.operators import conversion, funnel, landing, products, traffic
from cartwheel.operators.common import created_before


def test_funnel_steps_never_exceed_sessions(staged_check):
    t = staged_check
    row = funnel.funnel_counts(funnel.click_funnel_flags(t.sessions, t.pageviews)).first().asDict()
    assert all(row[k] <= row["sessions"] for k in row if k.startswith("to_"))
    for r in funnel.segment_funnel(funnel.lander_funnel_flags(t.sessions, t.pageviews)).collect():
        assert all(r[k] <= r["sessions"] for k in r.asDict() if k.startswith("to_"))


def test_bounces_never_exceed_sessions(staged_check):
    row = landing.bounce_rate(staged_check.pageviews).first()
    assert 0 <= row.bounces <= row.total_visits


def test_channels_plus_social_cover_all_sessions(staged_check):
    s = staged_check.sessions
    channels = traffic.monthly_channels(s).agg(*[F.sum(c).alias(c) for c in ("sear", "bsear", "oranic", "direct")]).first()
    early = s.filter(created_before("2012-11-27"))
    social = early.filter(F.col("utm_source") == "socialbook").count()
    assert sum(channels) + social == early.count()


def test_hour_grid_has_at_most_24_rows(staged_check):
    hours = [r.hr for r in traffic.hour_weekday_grid(staged_check.sessions).collect()]
    assert len(hours) <= 24 and hours == sorted(hours)


def test_orders_never_exceed_sessions(staged_check):
    for r in conversion.quarterly(staged_check.sessions, staged_check.orders).collect():
        assert r.orders <= r.sessions


def test_margin_is_revenue_minus_cost(staged_check):
    o = staged_check.orders.filter(created_before("2013-01-04"))
    cost = o.agg(F.sum("cogs_usd")).first()[0]
    tot = products.sales_trend(staged_check.orders).agg(F.sum("revenue"), F.sum("mar")).first()
    assert abs(float(tot[0]) - float(tot[1]) - float(cost)) < 0.01
