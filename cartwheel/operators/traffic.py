"""Traffic reports on the session table alone.

Sessions are unique per row, so every "distinct sessions where ..." is a
conditional count; each report is one scan with pushed-down date bounds
and one partial + final aggregate on a handful of keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwheel.functions import count_when, monday_weekday, ratio, rounded, sunday_week, year_week
from cartwheel.functions import vocab as V
from cartwheel.operators.common import CREATED, SESSION, created_before, created_between, paid_search, sorted_small
from cartwheel.operators.distinct import distinct_counts


def traffic_sources(sessions: DataFrame, until: str = V.TRAFFIC_UNTIL) -> DataFrame:
    """Sessions per source, campaign and referer (NULL is a group), largest first."""
    return (
        sessions.filter(created_before(until))
        .groupBy("utm_source", "utm_campaign", "http_referer")
        .agg(F.count(F.lit(1)).alias("sessions"))
        .orderBy(F.desc("sessions"))
    )


def _weekly(df: DataFrame, *aggs, by_year_week: bool = False) -> DataFrame:
    """Group by Sunday-week: ``year + week`` keys, or one ``year_week`` key.

    The week keys are not output; ``week_start`` is the first day seen.
    """
    if by_year_week:
        names, keys = ["_yw"], [year_week(CREATED)]
    else:
        names, keys = ["_y", "_w"], [F.year(CREATED), sunday_week(CREATED)]
    keys = [k.alias(n) for k, n in zip(keys, names)]
    out = df.groupBy(*keys).agg(F.min(F.to_date(CREATED)).alias("week_start"), *aggs)
    return sorted_small(out.drop(*names), "week_start")


PERIODS = ("week", "year_week", "month", "quarter")


def volume(
    sessions: DataFrame,
    where: Column | None = None,
    period: str = "week",
    segments: dict[str, Column] | None = None,
    repeated_ids: bool = False,
) -> DataFrame:
    """Sessions per period and segment -- the general form of the volume
    reports below. ``repeated_ids``: rows may repeat a session id, so count
    different ids.

    ``period``: ``week`` (year + Sunday-week, output ``week_start``),
    ``year_week`` (one label per Sunday-week, output ``week_start``),
    ``month`` (``yr``, ``mon``) or ``quarter`` (``yr``, ``quat``).
    ``segments``: output column -> session condition, each counted;
    default one ``sessions`` column.
    """
    df = sessions.filter(where) if where is not None else sessions
    segments = segments or {"sessions": F.lit(True)}
    if repeated_ids:
        return _distinct_volume(df, period, segments)
    aggs = [count_when(cond).alias(name) for name, cond in segments.items()]
    if period in ("week", "year_week"):
        return _weekly(df, *aggs, by_year_week=period == "year_week")
    if period == "month":
        part, part_fn = "mon", F.month
    elif period == "quarter":
        part, part_fn = "quat", F.quarter
    else:
        raise ValueError(f"period must be one of {PERIODS}")
    out = df.groupBy(F.year(CREATED).alias("yr"), part_fn(CREATED).alias(part)).agg(*aggs)
    return sorted_small(out, "yr", part)


def _distinct_volume(sessions: DataFrame, period: str, segments: dict[str, Column]) -> DataFrame:
    if period not in PERIODS:
        raise ValueError(f"period must be one of {PERIODS}")
    keys = {
        "week": {"_y": F.year(CREATED), "_w": sunday_week(CREATED)}, "year_week": {"_yw": year_week(CREATED)},
        "month": {"yr": F.year(CREATED), "mon": F.month(CREATED)}, "quarter": {"yr": F.year(CREATED), "quat": F.quarter(CREATED)},
    }[period]
    if period in ("week", "year_week"):
        out = distinct_counts(sessions, SESSION, segments, keys, least={"week_start": F.to_date(CREATED)})
        return sorted_small(out.select("week_start", *segments), "week_start")
    return sorted_small(distinct_counts(sessions, SESSION, segments, keys), *keys)


def weekly_volume(
    sessions: DataFrame, until: str = V.WEEKLY_VOLUME_UNTIL, source: str = V.GSEARCH, campaign: str = V.NONBRAND
) -> DataFrame:
    """Weekly session volume of one paid channel."""
    df = sessions.filter(created_before(until) & paid_search(source, campaign))
    return _weekly(df, F.count(F.lit(1)).alias("sessions"))


def weekly_device(
    sessions: DataFrame,
    start: str = V.WEEKLY_DEVICE_FROM,
    end: str = V.WEEKLY_DEVICE_TO,
    source: str = V.GSEARCH,
    campaign: str = V.NONBRAND,
) -> DataFrame:
    """Weekly desktop and mobile sessions of one paid channel."""
    df = sessions.filter(created_between(start, end) & paid_search(source, campaign))
    return _weekly(
        df,
        count_when(F.col("device_type") == V.DESKTOP).alias("dtop_sessions"),
        count_when(F.col("device_type") == V.MOBILE).alias("mob_sessions"),
    )


def monthly_channels(sessions: DataFrame, until: str = V.MID_PROJECT_UNTIL) -> DataFrame:
    """Monthly sessions per channel: paid g/b search, organic, direct.

    Months of different years share a row, as in the original question.
    """
    src, ref = F.col("utm_source"), F.col("http_referer")
    return (
        sessions.filter(created_before(until))
        .groupBy(F.month(CREATED).alias("months"))
        .agg(
            count_when(src == V.GSEARCH).alias("sear"),
            count_when(src == V.BSEARCH).alias("bsear"),
            count_when(src.isNull() & ref.isNotNull()).alias("oranic"),
            count_when(src.isNull() & ref.isNull()).alias("direct"),
        )
    ).transform(lambda df: sorted_small(df, "months"))


def weekly_sources(
    sessions: DataFrame, start: str = V.WEEKLY_SOURCES_FROM, end: str = V.WEEKLY_SOURCES_TO, campaign: str = V.NONBRAND
) -> DataFrame:
    """Weekly gsearch and bsearch sessions of one campaign."""
    df = sessions.filter(created_between(start, end) & paid_search(None, campaign))
    return _weekly(
        df,
        count_when(F.col("utm_source") == V.GSEARCH).alias("gsearch_sessions"),
        count_when(F.col("utm_source") == V.BSEARCH).alias("bsearch_sessions"),
    )


def source_mobile_share(
    sessions: DataFrame,
    start: str = V.SOURCE_MOBILE_FROM,
    end: str = V.SOURCE_MOBILE_TO,
    sources: Sequence[str] = (V.GSEARCH, V.BSEARCH),
    campaign: str = V.NONBRAND,
) -> DataFrame:
    """Sessions, mobile sessions and mobile share per source."""
    return (
        sessions.filter(created_between(start, end) & paid_search(sources, campaign))
        .groupBy("utm_source")
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            count_when(F.col("device_type") == V.MOBILE).alias("mobile_sessions"),
        )
        .withColumn("conv", ratio("mobile_sessions", "sessions"))
    )


def bid_change_weekly(
    sessions: DataFrame,
    start: str = V.BID_CHANGE_FROM,
    end: str = V.BID_CHANGE_TO,
    sources: Sequence[str] = (V.GSEARCH, V.BSEARCH),
    campaign: str = V.NONBRAND,
) -> DataFrame:
    """Weekly gsearch/bsearch sessions per device and the bsearch/gsearch ratio."""
    src, dev = F.col("utm_source"), F.col("device_type")
    df = sessions.filter(created_between(start, end) & paid_search(sources, campaign))
    out = _weekly(
        df,
        count_when((src == V.GSEARCH) & (dev == V.DESKTOP)).alias("d_gsearch_sessions"),
        count_when((src == V.BSEARCH) & (dev == V.DESKTOP)).alias("d_bsearch_sessions"),
        count_when((src == V.GSEARCH) & (dev == V.MOBILE)).alias("m_gsearch_sessions"),
        count_when((src == V.BSEARCH) & (dev == V.MOBILE)).alias("m_bsearch_sessions"),
        by_year_week=True,
    )
    return out.select(
        "week_start",
        "d_gsearch_sessions",
        "d_bsearch_sessions",
        ratio("d_bsearch_sessions", "d_gsearch_sessions").alias("d_conv"),
        "m_gsearch_sessions",
        "m_bsearch_sessions",
        ratio("m_bsearch_sessions", "m_gsearch_sessions").alias("m_conv"),
    )


def hour_weekday_grid(sessions: DataFrame, start: str = V.STAFFING_FROM, end: str = V.STAFFING_TO) -> DataFrame:
    """Average sessions per hour of day, overall and per weekday (Mon..Sun).

    Days without a session in an hour have no row, so they do not pull
    the average down -- as in the original question. Two aggregates; the
    second runs on at most days x 24 rows.
    """
    daily = (
        sessions.filter(created_between(start, end))
        .groupBy(F.to_date(CREATED).alias("day"), monday_weekday(CREATED).alias("wk"), F.hour(CREATED).alias("hr"))
        .agg(F.count(F.lit(1)).alias("website_session"))
    )
    per_day = [rounded(F.avg(F.when(F.col("wk") == i, F.col("website_session")))).alias(name) for i, name in enumerate(V.WEEKDAY_NAMES)]
    return sorted_small(daily.groupBy("hr").agg(rounded(F.avg("website_session")).alias("sessions"), *per_day), "hr")


def channel_groups(
    sessions: DataFrame,
    start: str = V.CHANNEL_GROUP_FROM,
    end: str = V.CHANNEL_GROUP_TO,
    organic_referers: Sequence[str] = V.ORGANIC_REFERERS_AS_WRITTEN,
) -> DataFrame:
    """New and repeat sessions per channel group.

    The branches are tried in order; a session matching none has a NULL
    group. With the referers as originally typed (a comma for the dot) no
    session is organic; pass ``vocab.ORGANIC_REFERERS`` for real URLs.
    """
    src, camp, ref = F.col("utm_source"), F.col("utm_campaign"), F.col("http_referer")
    group = (
        F.when(src.isNull() & ref.isin(list(organic_referers)), F.lit(V.CHANNEL_ORGANIC))
        .when(camp == V.NONBRAND, F.lit(V.CHANNEL_PAID_NONBRAND))
        .when(camp == V.BRAND, F.lit(V.CHANNEL_PAID_BRAND))
        .when(src.isNull() & ref.isNull(), F.lit(V.CHANNEL_DIRECT))
        .when(src == V.SOCIALBOOK, F.lit(V.CHANNEL_SOCIAL))
    )
    return (
        sessions.filter(created_between(start, end))
        .groupBy(group.alias("channel_group"))
        .agg(
            count_when(F.col("is_repeat_session") == 0).alias("new_sessions"),
            count_when(F.col("is_repeat_session") == 1).alias("repeat_session"),
        )
    )
