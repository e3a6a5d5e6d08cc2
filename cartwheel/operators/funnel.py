"""Conversion funnels: which steps each session reached, counts and click rates.

Sessions of the window are filtered first and semi-joined to the views;
one aggregate per session turns the views into 0/1 "made it" flags
(``max`` of a page flag), and one more aggregate counts them. Sessions
without any view keep all-zero flags, as with the original left join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwheel.functions import count_when, ratio
from cartwheel.functions import vocab as V
from cartwheel.sources.facts import FACT_PAGES, seen_column
from cartwheel.operators.common import SESSION, created_after, created_before, created_between, of_sessions, paid_search


def _page_flag(page: str) -> Column:
    return F.when(F.col("pageview_url") == page, 1).otherwise(0)


def _window_sessions(sessions: DataFrame, where: Column, source: str, campaign: str) -> DataFrame:
    return sessions.filter(where & paid_search(source, campaign))


def pageview_flags(
    sessions: DataFrame,
    pageviews: DataFrame,
    start: str = V.FUNNEL_FROM,
    end: str = V.FUNNEL_TO,
    source: str = V.GSEARCH,
    campaign: str = V.NONBRAND,
    steps: Sequence[tuple[str, str]] = V.PAGE_FLAGS_6,
) -> DataFrame:
    """Every view of the window's sessions with one 0/1 column per step."""
    ses = _window_sessions(sessions, created_between(start, end), source, campaign).select(
        SESSION, F.col("created_at").alias("_session_start")
    )
    views = of_sessions(pageviews, ses.select(SESSION)).select(SESSION, "pageview_url", "website_pageview_id")
    # a left outer join could not split the views of a very long session: matches, then sessions without a view
    silent = ses.join(views.select(SESSION).distinct(), SESSION, "left_anti")
    nothing = [F.lit(None).cast(views.schema[c].dataType).alias(c) for c in ("pageview_url", "website_pageview_id")]
    return (
        ses.join(views, SESSION)
        .unionByName(silent.select(SESSION, "_session_start", *nothing))
        .select(SESSION, "pageview_url", *[_page_flag(p).alias(name) for p, name in steps], "_session_start", "website_pageview_id")
        .orderBy(SESSION, "_session_start", "website_pageview_id")
        .drop("_session_start", "website_pageview_id")
    )


def session_flags(
    sessions: DataFrame,
    pageviews: DataFrame,
    where: Column,
    source: str = V.GSEARCH,
    campaign: str = V.NONBRAND,
    steps: Sequence[tuple[str, str]] = V.FUNNEL_6,
    facts: DataFrame | None = None,
) -> DataFrame:
    """One row per session of the window: 1 where a step's page was seen.

    "Seen in the session" is a whole-session fact: read from ``facts`` when
    staged and every step page is kept there.
    """
    ids = _window_sessions(sessions, where, source, campaign).select(SESSION)
    if facts is not None and all(p in FACT_PAGES for p, _ in steps):
        seen = facts.join(ids, SESSION, "left_semi").select(
            SESSION, *[F.col(seen_column(p)).alias(name) for p, name in steps]
        )
    else:
        seen = (
            of_sessions(pageviews, ids)
            .groupBy(SESSION)
            .agg(*[F.max(_page_flag(p)).alias(name) for p, name in steps])
        )
    names = [name for _, name in steps]
    return ids.join(seen, SESSION, "left").fillna(0, subset=names).select(SESSION, *[F.col(n).cast("int") for n in names])


def click_funnel_flags(
    sessions: DataFrame,
    pageviews: DataFrame,
    start: str = V.FUNNEL_FROM,
    end: str = V.FUNNEL_TO,
    facts: DataFrame | None = None,
) -> DataFrame:
    return session_flags(sessions, pageviews, created_between(start, end), facts=facts)


def lander_funnel_flags(
    sessions: DataFrame,
    pageviews: DataFrame,
    after: str = V.LANDER_FUNNEL_AFTER,
    before: str = V.LANDER_FUNNEL_BEFORE,
    facts: DataFrame | None = None,
) -> DataFrame:
    return session_flags(
        sessions, pageviews, created_before(before) & created_after(after), steps=V.FUNNEL_8, facts=facts
    )


def _step_counts(flags: DataFrame, step_cols: Sequence[str]) -> list[Column]:
    return [count_when(F.col(c) == 1).alias(name) for c, name in zip(step_cols, V.FUNNEL_COUNT_NAMES)]


def funnel_counts(flags: DataFrame, step_cols: Sequence[str] = tuple(n for _, n in V.FUNNEL_6)) -> DataFrame:
    """Sessions and sessions reaching each step."""
    return flags.agg(F.count(F.lit(1)).alias("sessions"), *_step_counts(flags, step_cols))


def _neighbour_rates(counts: list[str], names: Sequence[str]) -> list[Column]:
    prev = ["sessions", *counts[:-1]]
    return [ratio(c, p).alias(n) for c, p, n in zip(counts, prev, names)]


def funnel_rates(flags: DataFrame, step_cols: Sequence[str] = tuple(n for _, n in V.FUNNEL_6)) -> DataFrame:
    """Click rate of each step over the previous one (the first over sessions)."""
    counts = funnel_counts(flags, step_cols)
    names = list(V.FUNNEL_COUNT_NAMES)
    return counts.select("sessions", *_neighbour_rates(names, names))


def _segment(flags: DataFrame) -> Column:
    return (
        F.when(F.col("saw_homepage") == 1, F.lit(V.SEGMENT_HOME))
        .when(F.col("saw_custom_lander") == 1, F.lit(V.SEGMENT_LANDER))
        .otherwise(F.lit(V.SEGMENT_FALLBACK))
    )


_STEPS_8 = tuple(n for _, n in V.FUNNEL_8[2:])


def segment_funnel(flags8: DataFrame) -> DataFrame:
    """Funnel step counts per landing segment (home vs custom lander)."""
    return flags8.groupBy(_segment(flags8).alias("segments")).agg(
        F.count(F.lit(1)).alias("sessions"), *_step_counts(flags8, _STEPS_8)
    )


def segment_rates(flags8: DataFrame) -> DataFrame:
    """Funnel click rates per landing segment."""
    counts = segment_funnel(flags8)
    return counts.select("segments", "sessions", *_neighbour_rates(list(V.FUNNEL_COUNT_NAMES), V.SEGMENT_RATE_NAMES))
