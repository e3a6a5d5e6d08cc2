"""Per-session facts: one row per session, derived once from the page views.

Many reports ask whole-session questions -- how many views, which page
came first, which pages were seen at all, what was the last view. When
the shop tables are staged, these answers are written once as
``session_facts`` and those reports scan a session-sized table instead
of aggregating every page view again. Reports over tables that were not
staged compute the same answers from the page views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.functions import vocab as V

SESSION = "website_session_id"
VIEW = "website_pageview_id"

# pages whose "seen in the session" flag is kept
FACT_PAGES = (
    V.HOME,
    V.LANDER_1,
    V.PRODUCTS,
    V.MR_FUZZY,
    V.LOVE_BEAR,
    V.CART,
    V.SHIPPING,
    V.BILLING,
    V.BILLING_2,
    V.THANK_YOU,
)


def seen_column(page: str) -> str:
    """Name of the 0/1 column telling whether ``page`` was seen."""
    return "seen_" + re.sub(r"[^0-9a-z]+", "_", page.lower()).strip("_")


def session_facts(pageviews: DataFrame) -> DataFrame:
    """One row per session with at least one view.

    ``n_views``, ``first_view_id`` / ``first_url`` / ``first_at`` (the
    least view id), ``last_view_id`` and one ``seen_<page>`` 0/1 column per
    page of ``FACT_PAGES``. A single partial + final aggregate.
    """
    first = F.min(F.struct(VIEW, "pageview_url", "created_at")).alias("_f")
    seen = [F.max(F.when(F.col("pageview_url") == p, 1).otherwise(0)).alias(seen_column(p)) for p in FACT_PAGES]
    return (
        pageviews.groupBy(SESSION)
        .agg(F.count(F.lit(1)).alias("n_views"), first, F.max(VIEW).alias("last_view_id"), *seen)
        .select(
            SESSION,
            "n_views",
            F.col(f"_f.{VIEW}").alias("first_view_id"),
            F.col("_f.pageview_url").alias("first_url"),
            F.col("_f.created_at").alias("first_at"),
            "last_view_id",
            *[seen_column(p) for p in FACT_PAGES],
        )
    )
