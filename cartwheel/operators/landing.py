"""Landing pages, bounce rates and landing-page tests.

The original analysis finds a session's first view with ``min(view id)``
and joins back on the id to get its URL, then joins all views again to
count them. Here one aggregate per session does all of it:
``min(struct(view_id, url))`` is the first view with its URL and
``count(*)`` the number of views -- one partial + final aggregate over
the views, whatever the size of a session.

Thresholds the analysis typed in by hand after looking at an earlier
result (the first id of a test page) are scalar subqueries here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.functions import count_when, ratio, year_week
from cartwheel.functions import vocab as V
from cartwheel.sources.facts import FACT_PAGES, seen_column
from cartwheel.operators.common import (
    CREATED,
    SESSION,
    VIEW,
    created_after,
    created_before,
    each_order,
    first_view,
    first_view_where,
    n_orders,
    n_sessions,
    of_sessions,
    paid_search,
    sessions_with_orders,
    sorted_small,
)


def top_pages(pageviews: DataFrame, until: str = V.TOP_PAGES_UNTIL) -> DataFrame:
    """Views per URL, largest first."""
    return (
        pageviews.filter(created_before(until))
        .groupBy("pageview_url")
        .agg(F.count(F.lit(1)).alias("pvs"))
        .orderBy(F.desc("pvs"))
    )


def entry_pages(pageviews: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Sessions per entry (first) page (from ``facts`` when staged)."""
    if facts is not None:
        return facts.groupBy(F.col("first_url").alias("pageview_url")).agg(F.count(F.lit(1)).alias("entries"))
    firsts = pageviews.groupBy(SESSION).agg(first_view("pageview_url").alias("f"))
    return firsts.groupBy(F.col("f.pageview_url").alias("pageview_url")).agg(F.count(F.lit(1)).alias("entries"))


def _landing_and_size(pageviews: DataFrame, until: str, facts: DataFrame | None = None) -> DataFrame:
    """Per session with a view before ``until``: that first view and the
    session's all-time view count.

    The first view (a sort-based aggregate, the struct holds a string)
    runs on the date-filtered views only; the count of all views is a hash
    aggregate over the views of those sessions alone (a semi-join, which
    broadcasts the session set when AQE measures it small) -- or read from
    the staged session facts.
    """
    landing = pageviews.filter(created_before(until)).groupBy(SESSION).agg(first_view("pageview_url").alias("f"))
    if facts is not None:
        return landing.join(facts.select(SESSION, "n_views"), SESSION)
    sizes = (
        pageviews.join(landing.select(SESSION), SESSION, "left_semi")
        .groupBy(SESSION)
        .agg(F.count(F.lit(1)).alias("n_views"))
    )
    return landing.join(sizes, SESSION)


def first_pageview(pageviews: DataFrame, until: str = V.LANDING_UNTIL) -> DataFrame:
    """First view id of each session, among views before ``until``."""
    return pageviews.filter(created_before(until)).groupBy(SESSION).agg(F.min(VIEW).alias("first_page"))


def landing_pages(pageviews: DataFrame, until: str = V.LANDING_UNTIL) -> DataFrame:
    """Landing URL of each session, among views before ``until``."""
    return (
        pageviews.filter(created_before(until))
        .groupBy(SESSION)
        .agg(first_view("pageview_url").alias("f"))
        .select(SESSION, F.col("f.pageview_url").alias("landing_page_session"))
    )


def bounced_sessions(pageviews: DataFrame, until: str = V.LANDING_UNTIL, facts: DataFrame | None = None) -> DataFrame:
    """Sessions landing before ``until`` with exactly one view in total.

    The landing set is cut off at ``until``, the view count is not.
    """
    return (
        _landing_and_size(pageviews, until, facts)
        .filter(F.col("f").isNotNull() & (F.col("n_views") == 1))
        .select(SESSION, F.col("f.pageview_url").alias("landing_page_session"), F.col("n_views").alias("bounces"))
    )


def bounce_rate(pageviews: DataFrame, until: str = V.LANDING_UNTIL, facts: DataFrame | None = None) -> DataFrame:
    """Sessions, bounced sessions and bounce rate (percent)."""
    per = _landing_and_size(pageviews, until, facts).filter(F.col("f").isNotNull())
    return per.agg(
        F.count(F.lit(1)).alias("total_visits"), count_when(F.col("n_views") == 1).alias("bounces")
    ).withColumn("bounce_rate", ratio("bounces", "total_visits", 100))


def first_page_seen(pageviews: DataFrame, page: str = V.LANDER_1) -> DataFrame:
    """Least view id and least time of a page (two independent minima)."""
    return pageviews.filter((F.col("pageview_url") == page) & F.col(CREATED).isNotNull()).agg(
        F.min(VIEW).alias("firstpageview_id"), F.min(CREATED).alias("firstdate")
    )


def _first_id_of(pageviews: DataFrame, page: str):
    """Scalar subquery: the least view id of ``page``."""
    return pageviews.filter((F.col("pageview_url") == page) & F.col(CREATED).isNotNull()).agg(F.min(VIEW)).scalar()


def _test_sessions(
    pageviews: DataFrame,
    sessions: DataFrame,
    until: str,
    source: str,
    campaign: str,
    test_page: str,
    inclusive: bool,
    with_url: bool = True,
) -> DataFrame:
    """Per test session: first view from the test's first id on, and view count.

    Sessions are filtered first and semi-joined to the views of their id
    range, so a narrow test window reads and shuffles only its own views
    (the session set is broadcast when AQE measures it small). Without ``with_url`` the first
    view is a plain ``min`` (hash aggregate) in ``f.website_pageview_id``.
    """
    start_id = _first_id_of(pageviews, test_page)
    in_test = (F.col(VIEW) >= start_id) if inclusive else (F.col(VIEW) > start_id)
    ids = sessions.filter(created_before(until) & paid_search(source, campaign)).select(SESSION)
    first = first_view_where(in_test, "pageview_url") if with_url else F.min(F.when(in_test, F.col(VIEW)))
    per = of_sessions(pageviews, ids).groupBy(SESSION).agg(first.alias("f"), F.count(F.lit(1)).alias("n_views"))
    if not with_url:
        per = per.withColumn("f", F.when(F.col("f").isNotNull(), F.struct(F.col("f").alias(VIEW))))
    return per.filter(F.col("f").isNotNull())


def test_first_views(
    pageviews: DataFrame,
    sessions: DataFrame,
    until: str = V.LANDER_TEST_UNTIL,
    source: str = V.GSEARCH,
    campaign: str = V.NONBRAND,
    test_page: str = V.LANDER_1,
    inclusive: bool = False,
) -> DataFrame:
    """First view id of each test session from the test's start on."""
    per = _test_sessions(pageviews, sessions, until, source, campaign, test_page, inclusive, with_url=False)
    return per.select(SESSION, F.col(f"f.{VIEW}").alias("min_pageview_id"))


def test_landing(
    pageviews: DataFrame,
    sessions: DataFrame,
    until: str = V.LANDER_TEST_UNTIL,
    source: str = V.GSEARCH,
    campaign: str = V.NONBRAND,
    test_page: str = V.LANDER_1,
    inclusive: bool = False,
    pages: Sequence[str] = (V.HOME, V.LANDER_1),
    with_bounce: bool = False,
) -> DataFrame:
    """Landing page of each test session, kept if it is one of ``pages``.

    With ``with_bounce`` only sessions with one view in total remain, with
    their view count as ``bounces``.
    """
    per = _test_sessions(pageviews, sessions, until, source, campaign, test_page, inclusive).filter(
        F.col("f.pageview_url").isin(list(pages))
    )
    cols = [SESSION, F.col("f.pageview_url").alias("landing_page")]
    if with_bounce:
        return per.filter(F.col("n_views") == 1).select(*cols, F.col("n_views").alias("bounces"))
    return per.select(*cols, "n_views")


def ab_bounce(pageviews: DataFrame, sessions: DataFrame, **test) -> DataFrame:
    """Sessions, bounced sessions and bounce rate per tested landing page."""
    land = test_landing(pageviews, sessions, **test)
    return land.groupBy("landing_page").agg(
        F.count(F.lit(1)).alias("sessions"), count_when(F.col("n_views") == 1).alias("bounce_sessions")
    ).withColumn("bounce_rate", ratio("bounce_sessions", "sessions"))


def test_orders(pageviews: DataFrame, sessions: DataFrame, orders: DataFrame, **test) -> DataFrame:
    """Test sessions with their landing page and orders (one row per order)."""
    land = test_landing(pageviews, sessions, **test).select(SESSION, "landing_page")
    return each_order(land, orders, "order_id")


def ab_conversion(pageviews: DataFrame, sessions: DataFrame, orders: DataFrame, **test) -> DataFrame:
    """Sessions, orders and conversion per tested landing page."""
    land = test_landing(pageviews, sessions, **test).select(SESSION, "landing_page")
    rows = sessions_with_orders(land, orders)
    return (
        rows.groupBy("landing_page")
        .agg(n_sessions().alias("sessions"), n_orders().alias("orders"))
        .withColumn("conv", ratio("orders", "sessions"))
    )


def session_first_and_count(
    pageviews: DataFrame,
    sessions: DataFrame,
    after: str = V.LANDING_TREND_AFTER,
    before: str = V.LANDING_TREND_BEFORE,
    source: str = V.GSEARCH,
    campaign: str = V.NONBRAND,
    with_landing: bool = False,
    facts: DataFrame | None = None,
) -> DataFrame:
    """First view id and view count per session of a channel and window.

    With ``with_landing`` also the first view's URL and time. All of it is
    a whole-session fact, read from ``facts`` when staged.
    """
    ids = sessions.filter(created_after(after) & created_before(before) & paid_search(source, campaign)).select(SESSION)
    if facts is not None:
        cols = [SESSION, F.col("first_view_id").alias("first_page"), F.col("n_views").alias("count_pv")]
        if with_landing:
            cols += [F.col("first_url").alias("pageview_url"), F.col("first_at").alias(CREATED)]
        return facts.join(ids, SESSION, "left_semi").select(*cols)
    views = of_sessions(pageviews, ids).groupBy(SESSION)
    if not with_landing:
        # the first id alone is a hash aggregate; the URL needs the sort-based struct minimum
        return views.agg(F.min(VIEW).alias("first_page"), F.count(VIEW).alias("count_pv"))
    per = views.agg(first_view("pageview_url", CREATED).alias("f"), F.count(VIEW).alias("count_pv"))
    return per.select(
        SESSION,
        F.col(f"f.{VIEW}").alias("first_page"),
        "count_pv",
        F.col("f.pageview_url").alias("pageview_url"),
        F.col(f"f.{CREATED}").alias(CREATED),
    )


def weekly_landing_mix(pageviews: DataFrame, sessions: DataFrame, facts: DataFrame | None = None, **window) -> DataFrame:
    """Per Sunday-week of the landing view: sessions, bounces, home vs lander."""
    per = session_first_and_count(pageviews, sessions, with_landing=True, facts=facts, **window)
    url = F.col("pageview_url")
    return (
        per.groupBy(year_week(CREATED).alias("year_week"))
        .agg(
            F.min(F.to_date(CREATED)).alias("start_of_week"),
            F.count(F.lit(1)).alias("total_sessions"),
            count_when(F.col("count_pv") == 1).alias("bounce"),
            count_when(url == V.HOME).alias("home_sessions"),
            count_when(url == V.LANDER_1).alias("lander_session"),
        )
        .select(
            "year_week",
            "start_of_week",
            "total_sessions",
            "bounce",
            ratio("bounce", "total_sessions").alias("bounce_rate"),
            "home_sessions",
            "lander_session",
        )
        .transform(lambda df: sorted_small(df, "year_week"))
    )


def last_session_seeing(
    sessions: DataFrame,
    pageviews: DataFrame,
    until: str = V.MID_PROJECT_UNTIL,
    page: str = V.HOME,
    source: str = V.GSEARCH,
    campaign: str = V.NONBRAND,
    facts: DataFrame | None = None,
) -> DataFrame:
    """Largest id of a channel's sessions that viewed ``page``."""
    if facts is not None and page in FACT_PAGES:
        seen = facts.filter(F.col(seen_column(page)) == 1).select(SESSION)
    else:
        # one row per session, so that a session with very many views is no hot key of the join
        seen = pageviews.filter(F.col("pageview_url") == page).select(SESSION).distinct()
    return (
        sessions.filter(created_before(until) & paid_search(source, campaign))
        .join(seen, SESSION, "left_semi")
        .agg(F.max(SESSION).alias("max_id"))
    )


def sessions_since_last(
    sessions: DataFrame,
    pageviews: DataFrame,
    until: str = V.MID_PROJECT_UNTIL,
    page: str = V.HOME,
    source: str = V.GSEARCH,
    campaign: str = V.NONBRAND,
    facts: DataFrame | None = None,
) -> DataFrame:
    """Sessions of the channel after the last one that viewed ``page``."""
    last = last_session_seeing(sessions, pageviews, until, page, source, campaign, facts).scalar()
    return (
        sessions.filter(created_before(until) & (F.col(SESSION) > last) & paid_search(source, campaign))
        .agg(F.count(SESSION).alias("session"))
    )
