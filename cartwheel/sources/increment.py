"""What new event files change of the derived tables.

A session is a block of one user's events, so new events change the page
views, orders, items and refunds of the blocks that they fall into, and
no others. Whether a session is a visitor's first depends on all blocks of
the visitor (three in a row), so the session rows of touched visitors
change. The derivation is run on those blocks alone: the old events are
scanned once more, but only rows of touched blocks are shuffled and
written. What the base copy holds of touched blocks is listed as gone;
readers leave it out by an anti join on those ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.sources import events as E

# what is gone -> its column; sessions go with their visitor, views and orders with their block
GONE = {"sessions": "website_session_id", "views": "website_session_id", "orders": "order_id", "items": "order_item_id"}
BLOCK = ["user_id", "blk"]


def increment(
    old: DataFrame, new: DataFrame, base: dict[str, DataFrame], written: Callable[[str, DataFrame], DataFrame]
) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(rows to add per table file, ids of ``base`` that are gone per entry of ``GONE``).

    ``old`` and ``new`` are events, ``base`` the tables derived from
    ``old``; ``written`` stores an intermediate table and gives it back.
    """
    touched = written("_touched", E.with_blocks(new).select(*BLOCK, E.visitor().alias("visitor")).filter("visitor is not null").distinct())
    events = E.with_blocks(old).withColumn("old", F.lit(True))
    events = events.unionByName(E.with_blocks(new).withColumn("old", F.lit(False)))

    # sessions: every block of the touched visitors, one row each
    visitors = touched.select("visitor").distinct()
    blocks = (
        events.withColumn("visitor", E.visitor())
        .join(visitors, "visitor", "left_semi")
        .groupBy(*BLOCK)
        .agg(F.min("event_id").alias("sid"), F.min("secs").alias("secs0"), F.min(F.when(F.col("old"), F.col("event_id"))).alias("old_sid"))
    )
    blocks = written("_blocks", blocks.withColumn("st", E.session_starts(F.col("secs0"))))
    sessions = E.derive_sessions(blocks.select(*BLOCK, "sid", "st"))

    # the rest: the touched blocks only
    mine = touched.select(*BLOCK)
    views, _ = E.tag_blocks(events.drop("old").join(mine, BLOCK, "left_semi"))
    views = written("_tagged", views)
    items = E.derive_order_items(views)
    delta = {
        "website_sessions": sessions.coalesce(8).sortWithinPartitions("website_session_id"),
        "website_pageviews": E.derive_pageviews(views).repartitionByRange(F.col("website_session_id")).sortWithinPartitions("website_session_id", "website_pageview_id"),
        "orders": E.derive_orders(views),
        "order_items": items,
        "order_item_refunds": E.derive_refunds(items),
    }
    # what the base has of them; sessions that the base does not know cannot be gone from it
    gone_sessions = blocks.select(F.col("old_sid").alias("website_session_id")).filter("website_session_id is not null")
    gone_views = blocks.join(mine, BLOCK, "left_semi").select(F.col("old_sid").alias("website_session_id")).filter("website_session_id is not null")
    gone_orders = base["orders"].join(gone_views, "website_session_id", "left_semi").select("order_id")
    gone_items = base["order_items"].join(gone_orders, "order_id", "left_semi").select("order_item_id")
    return delta, {"sessions": gone_sessions, "views": gone_views, "orders": gone_orders, "items": gone_items}


def combined(base: dict[str, DataFrame], own: dict[str, DataFrame], gone: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``base`` without what is gone, and ``own``."""
    left_out = {
        "sessions": ("sessions", "website_session_id"), "pageviews": ("views", "website_session_id"), "orders": ("views", "website_session_id"),
        "order_items": ("orders", "order_id"), "refunds": ("items", "order_item_id"),
    }
    return {
        field: base[field].join(gone[which], key, "left_anti").select(*own[field].columns).unionByName(own[field]) for field, (which, key) in left_out.items()
    }
