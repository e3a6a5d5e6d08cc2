"""Derive the five shop tables from a raw click stream.

The input is an ``events`` table (``event_id``, ``ts``, ``user_id``,
``props``; ids rise with time). Events of one user fall into staggered
two-day blocks; a block is one website session, its events are the page
views, the 7th view of a session is an order. Thirty days of events are
stretched over three years so that dated reports select rows. The rules
are the ones documented in FIXTURES.md.

Scale notes. A block is grouped by ``(user_id, blk)``; a single heavy user
or bot may hold a large share of all events, so no step sends a whole
block to one task:

* the block's first id and first second are partial+final aggregates;
* only the first ten views of a block are ranked (views after the 10th
  all get the same page). ``row_number() <= 10`` is planned with a
  partial window-group limit *before* the shuffle, so at most ten rows per
  block and map task are shuffled;
* the ten ids travel as a bounded array on the one-row-per-block table,
  which is joined back to the events (a skewed join partition is split by
  AQE, the block side is one row per key).

The full events cross an exchange for the ranks (cut to ten rows per block
and map task) and, where the blocks are too many to broadcast, one for the
join with them; the raw events are scanned once for the ids, once for the
ranks and once for that join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwheel.functions import vocab as V

# --- fixed values of the derivation (see FIXTURES.md) --------------------
EVENT_EPOCH = "2024-01-01 00:00:00"  # seconds are counted from here
SHOP_EPOCH = "2012-03-19 00:00:00"  # a block starting at EVENT_EPOCH starts here
STRETCH = 36  # one event second = 36 shop seconds
BLOCK_SECONDS = 172800  # two days
STAGGER_SECONDS = 3600  # blocks of user u are shifted by 3600 * ((7u) % 48)
HEAD_VIEWS = 10  # views 1..10 of a session have their own page, later views go home
LANDER_FROM = "2012-06-19 00:00:00"
LOVE_BEAR_FROM = "2013-01-06 00:00:00"
BILLING_2_FROM = "2012-09-10 00:00:00"
# products on offer: 1 before 2013-01-06, 2 before 2013-12-12, 3 before
# 2014-06-01, then 4
PRODUCT_LAUNCHES = ("2013-01-06 00:00:00", "2013-12-12 00:00:00", "2014-06-01 00:00:00")
TWO_ITEMS_FROM = "2013-01-06 00:00:00"
REFUND_EVERY = 13  # items whose id is a multiple of 13 are refunded
# page of view n (1-based) for n = 2..10 when no date rule applies
HEAD_PAGES = {
    2: V.PRODUCTS,
    4: V.CART,
    5: V.SHIPPING,
    7: V.THANK_YOU,
    8: V.CART,
    9: V.PRODUCTS,
    10: V.BILLING,
}
ORDER_VIEW = 7


def _ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _seconds_since(epoch: str, c: Column) -> Column:
    """Whole seconds from ``epoch`` to ``c``, floored (exact integer math)."""
    micros = F.timestamp_diff("MICROSECOND", _ntz(epoch), c)
    return (micros - F.pmod(micros, F.lit(1_000_000))).cast("long") / F.lit(1_000_000)


def _whole_div(a: Column, b: int) -> Column:
    """Floor division of integers."""
    return F.floor(a / F.lit(b)).cast("long")


def _price(product: Column) -> Column:
    return (product * 10 + F.lit(39.99).cast("decimal(4,2)")).cast("decimal(6,2)")


def _cogs(product: Column) -> Column:
    return (product * 4 + F.lit(15.49).cast("decimal(4,2)")).cast("decimal(6,2)")


def with_blocks(events: DataFrame) -> DataFrame:
    """The events with what the derivation reads of them and the block ``blk`` of their user."""
    secs = _seconds_since(EVENT_EPOCH, F.col("ts")).cast("long")
    ev = events.select(
        "event_id",
        "user_id",
        secs.alias("secs"),
        F.regexp_extract("props", "[0-9]+", 0).try_cast("int").alias("k"),
    )
    return ev.withColumn(
        "blk",
        _whole_div(F.col("secs") + F.lit(STAGGER_SECONDS) * ((F.col("user_id") * 7) % 48), BLOCK_SECONDS),
    )


def visitor() -> Column:
    """The shop's user of a block: three blocks in a row of one user."""
    return F.col("user_id") * 100 + _whole_div(F.col("blk") + F.col("user_id") % 3, 3)


def session_starts(secs0: Column) -> Column:
    return F.timestamp_add("SECOND", secs0 * STRETCH, _ntz(SHOP_EPOCH))


def tag_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Return ``(views, blocks)``.

    ``views``: one row per event with its session id ``sid``, rank ``n``
    (0 when beyond the 10th), ``k``, shop time ``at`` and session start ``st``.
    ``blocks``: one row per session (``user_id``, ``blk``, ``sid``, ``st``).
    """
    return tag_blocks(with_blocks(events))


def tag_blocks(ev: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``tag_events`` of events that have their blocks."""
    keys = ["user_id", "blk"]

    # one row per block: first id, first second (partial + final aggregate)
    firsts = ev.groupBy(*keys).agg(F.min("event_id").alias("sid"), F.min("secs").alias("secs0"))
    # first ten ids per block; the filter on row_number lets Spark limit
    # each block to ten rows on the map side, before the shuffle
    rank_w = Window.partitionBy(*keys).orderBy("event_id")
    heads = (
        ev.select(*keys, "event_id")
        .withColumn("rn", F.row_number().over(rank_w))
        .filter(F.col("rn") <= HEAD_VIEWS)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("event_id")).alias("head_ids"))
    )
    blocks = firsts.join(heads, keys).withColumn("st", session_starts(F.col("secs0")))
    views = (
        ev.join(blocks, keys)
        .withColumn("n", F.array_position("head_ids", F.col("event_id")).cast("int"))
        .withColumn("at", F.timestamp_add("SECOND", F.col("secs") - F.col("secs0"), F.col("st")))
        .drop("head_ids")
    )
    return views, blocks.drop("head_ids")


def session_rows(events: DataFrame) -> DataFrame:
    """The rows of ``views`` with ``n`` = 1, as ``blocks`` have them, without the other views.

    ``rank() <= 1`` is limited to a block's least id before the shuffle; an
    id that is there twice gives two rows, as it does in ``views``.
    """
    keys = ["user_id", "blk"]
    ev = with_blocks(events).filter("user_id is not null and blk is not null")
    rank_w = Window.partitionBy(*keys).orderBy("event_id")
    least = ev.filter("event_id is not null").select(*keys, F.col("event_id").alias("sid"), F.rank().over(rank_w).alias("r"))
    seconds = ev.groupBy(*keys).agg(F.min("secs").alias("secs0"))
    return least.filter("r <= 1").drop("r").join(seconds, keys).withColumn("st", session_starts(F.col("secs0")))


def _page(n: Column, st: Column, sid: Column, k: Column) -> Column:
    page = F.when(
        n == 1,
        F.when((st >= _ntz(LANDER_FROM)) & (sid % 2 == 1), F.lit(V.LANDER_1)).otherwise(F.lit(V.HOME)),
    ).when(
        n == 3,
        F.when((st >= _ntz(LOVE_BEAR_FROM)) & (k % 3 == 0), F.lit(V.LOVE_BEAR)).otherwise(F.lit(V.MR_FUZZY)),
    ).when(
        n == 6,
        F.when((st >= _ntz(BILLING_2_FROM)) & (_whole_div(sid, 2) % 2 == 1), F.lit(V.BILLING_2)).otherwise(
            F.lit(V.BILLING)
        ),
    )
    for pos, url in HEAD_PAGES.items():
        page = page.when(n == pos, F.lit(url))
    return page.otherwise(F.lit(V.HOME))


def derive_pageviews(views: DataFrame) -> DataFrame:
    return views.select(
        F.col("event_id").alias("website_pageview_id"),
        F.col("at").alias("created_at"),
        F.col("sid").alias("website_session_id"),
        _page(F.col("n"), F.col("st"), F.col("sid"), F.col("k")).alias("pageview_url"),
    )


def derive_sessions(blocks: DataFrame) -> DataFrame:
    sid = F.col("sid")
    src_digit = sid % 10
    base = blocks.select(sid, F.col("st"), visitor().alias("visitor"))
    # a visitor's least session is the new one; every later one is a repeat
    first_visit = base.groupBy("visitor").agg(F.min("sid").alias("first_sid"))
    source = (
        F.when(src_digit <= 4, F.lit(V.GSEARCH))
        .when(src_digit <= 6, F.lit(V.BSEARCH))
        .when(src_digit == 7, F.lit(V.SOCIALBOOK))
    )
    campaign = F.when(
        src_digit <= 6, F.when(_whole_div(sid, 10) % 4 == 0, F.lit(V.BRAND)).otherwise(F.lit(V.NONBRAND))
    ).when(src_digit == 7, F.lit("pilot"))
    referer = (
        F.when((src_digit <= 4) | (src_digit == 8), F.lit("https://www.gsearch.com"))
        .when(src_digit <= 6, F.lit("https://www.bsearch.com"))
        .when(src_digit == 7, F.lit("https://www.socialbook.com"))
    )
    device = F.when(_whole_div(sid, 3) % 3 == 0, F.lit(V.MOBILE)).otherwise(F.lit(V.DESKTOP))
    return base.join(first_visit, "visitor").select(
        sid.alias("website_session_id"),
        F.col("st").alias("created_at"),
        F.col("visitor").alias("user_id"),
        F.when(sid == F.col("first_sid"), 0).otherwise(1).alias("is_repeat_session"),
        source.alias("utm_source"),
        campaign.alias("utm_campaign"),
        device.alias("device_type"),
        referer.alias("http_referer"),
    )


def _order_base(views: DataFrame) -> DataFrame:
    st = F.col("st")
    av = (
        F.when(st < _ntz(PRODUCT_LAUNCHES[0]), 1)
        .when(st < _ntz(PRODUCT_LAUNCHES[1]), 2)
        .when(st < _ntz(PRODUCT_LAUNCHES[2]), 3)
        .otherwise(4)
    )
    k = F.col("k")
    km = k % F.col("av")
    return (
        views.filter(F.col("n") == ORDER_VIEW)
        .withColumn("av", av)
        .select(
            F.col("event_id").alias("order_id"),
            F.col("at").alias("created_at"),
            F.col("sid").alias("website_session_id"),
            (km + 1).cast("int").alias("p1"),
            ((km + 1 + _whole_div(k, 10) % 2) % F.col("av") + 1).cast("int").alias("p2"),
            F.when(st >= _ntz(TWO_ITEMS_FROM), k % 2 + 1).otherwise(1).cast("int").alias("items"),
        )
    )


def derive_orders(views: DataFrame) -> DataFrame:
    base = _order_base(views)
    two = F.col("items") == 2
    zero = F.lit(0).cast("decimal(6,2)")
    return base.select(
        "order_id",
        "created_at",
        "website_session_id",
        F.col("p1").alias("primary_product_id"),
        F.col("items").alias("items_purchased"),
        (_price(F.col("p1")) + F.when(two, _price(F.col("p2"))).otherwise(zero)).cast("decimal(6,2)").alias("price_usd"),
        (_cogs(F.col("p1")) + F.when(two, _cogs(F.col("p2"))).otherwise(zero)).cast("decimal(6,2)").alias("cogs_usd"),
    )


def derive_order_items(views: DataFrame) -> DataFrame:
    base = _order_base(views)
    primary = F.struct(
        (F.col("order_id") * 2).alias("order_item_id"), F.col("p1").alias("product_id"), F.lit(1).alias("is_primary_item")
    )
    second = F.struct(
        (F.col("order_id") * 2 + 1).alias("order_item_id"),
        F.col("p2").alias("product_id"),
        F.lit(0).alias("is_primary_item"),
    )
    lines = F.when(F.col("items") == 2, F.array(primary, second)).otherwise(F.array(primary))
    return base.select("order_id", "created_at", F.inline(lines)).select(
        F.col("order_item_id").cast("long"),
        "created_at",
        "order_id",
        F.col("product_id").cast("int"),
        F.col("is_primary_item").cast("int"),
        _price(F.col("product_id")).alias("price_usd"),
        _cogs(F.col("product_id")).alias("cogs_usd"),
    )


def derive_refunds(order_items: DataFrame) -> DataFrame:
    """The refund table of the fixture: by its rule (FIXTURES.md) the items
    whose id is a multiple of 13 are the refunded ones. This defines the
    table's content; no report samples or filters its input this way."""
    return order_items.filter(F.col("order_item_id") % REFUND_EVERY == 0).select("order_item_id")
