"""The staged tables of the analysis as temporary views, for SQL users.

``register(spark, shop)`` makes the five tables and every stage known under
its own name. A view is a plan over the shop's tables: it is computed when
it is read, and not before. The two stages that were both called ``ses``
are told apart: ``ses`` holds the orders of cart sessions, ``repeat_ses`` the
dates of repeat sessions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from cartwheel.plans.catalog import REPORTS
from cartwheel.sources import ShopTables
from cartwheel.sources.tables import TABLE_FILES

# fixed values: the stages' names and the reports that build them
STAGES = {
    "first_pageview": "s09_first_pageview",
    "l_p": "s11_landing_page",
    "boun": "s13_bounced_sessions",
    "first_test_pageviews": "s17_test_first_pv",
    "landing_page_table": "s19_test_landing",
    "bounce": "s20_test_bounce",
    "first_pv": "s23_session_first_count",
    "pv2": "s25_session_landing",
    "pv": "s29_session_flags",
    "cf": "s38_billing_test",
    "first_test_pageview": "s46_test_first_pv",
    "test_session_land": "s47_test_landing",
    "order_include": "s48_test_orders",
    "session_level": "s53_session_flags8",
    "pp": "s66_products_views",
    "session_next": "s68_next_pageview",
    "session_url": "s69_next_url",
    "session_cart": "s71_cart_views",
    "session_nt": "s72_cart_next",
    "ses": "s74_cart_orders",
    "sessions": "s79_repeat_pairs",
    "repeat_ses": "s82_repeat_dates",
    "diff": "s83_repeat_lag",
    "sess_prod": "s91_products_views",
    "ord": "s93_recent_orders",
}


def register(spark: SparkSession, shop: ShopTables, prefix: str = "") -> list[str]:
    """Registers the tables and stages as temporary views; returns their names."""
    frames = {name: getattr(shop, field) for name, field in TABLE_FILES.items()}
    frames |= {name: REPORTS[key](shop) for name, key in STAGES.items()}
    for name, df in frames.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in frames]
