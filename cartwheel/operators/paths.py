"""User paths: the page after a page, cart follow-through, product click-through.

"The next view" is the least view id above an anchor view in the same
session. The original analysis joins every anchor view with every later
view of its session (quadratic in the session's length) and takes the
minimum. Here the anchor of a (period, session) is its *first* anchor
view -- the least id above any of the anchors is the least id above the
first one -- so each view meets at most one anchor per period and the
join stays linear (``common.next_view``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwheel.functions import count_when, ratio, ts
from cartwheel.functions import vocab as V
from cartwheel.operators.common import (
    CREATED,
    SESSION,
    VIEW,
    created_after,
    created_before,
    created_between,
    n_orders,
    n_sessions,
    next_view,
    orders_of,
    sessions_with_orders,
    sorted_small,
)
from cartwheel.operators.next_event import RANGE_IDS, next_events


def _label(before_until: str, before: str, after_from: str, after: str, other: str = V.PERIOD_FALLBACK) -> Column:
    """Searched case: ``< before_until`` -> before, ``>= after_from`` -> after."""
    c = F.col(CREATED)
    return F.when(c < ts(before_until), F.lit(before)).when(c >= ts(after_from), F.lit(after)).otherwise(F.lit(other))


def product_page_views(
    pageviews: DataFrame,
    after: str = V.PATH_AFTER,
    before: str = V.PATH_BEFORE,
    split: str = V.PRODUCT_2_SPLIT,
    page: str = V.PRODUCTS,
) -> DataFrame:
    """Views of ``page`` in the window, labelled before/after ``split``."""
    return pageviews.filter(created_before(before) & created_after(after) & (F.col("pageview_url") == page)).select(
        SESSION, VIEW, CREATED, _label(split, V.PRE_PRODUCT_2, split, V.POST_PRODUCT_2).alias("time_period")
    )


def _next_after_first(
    anchor_views: DataFrame, pageviews: DataFrame, keep_without_next: bool, with_url: bool = True
) -> DataFrame:
    keys = ["time_period", SESSION]
    anchors = anchor_views.groupBy(*keys).agg(F.min(VIEW).alias("anchor"))
    nxt = next_view(anchors, pageviews, keys, with_url=with_url)
    return nxt if keep_without_next else nxt.filter(F.col("next_id").isNotNull())


def next_pageview(pageviews: DataFrame, **window) -> DataFrame:
    """Per period and session of a product view: the id of the next view (or NULL)."""
    nxt = _next_after_first(product_page_views(pageviews, **window), pageviews, keep_without_next=True, with_url=False)
    return nxt.select("time_period", SESSION, F.col("next_id").alias("min_p_id"))


def next_page_url(pageviews: DataFrame, **window) -> DataFrame:
    """Per period and session of a product view: the URL of the next view."""
    nxt = _next_after_first(product_page_views(pageviews, **window), pageviews, keep_without_next=True)
    return nxt.select("time_period", SESSION, F.col("next_url").alias("next_pageview_url"))


def next_page_mix(pageviews: DataFrame, **window) -> DataFrame:
    """Per period: product-page sessions, how many went on, and where."""
    nxt = next_page_url(pageviews, **window)
    url = F.col("next_pageview_url")
    return (
        nxt.groupBy("time_period")
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            count_when(url.isNotNull()).alias("w_next_p"),
            count_when(url == V.MR_FUZZY).alias("to_mrfuzzy"),
            count_when(url == V.LOVE_BEAR).alias("bear_love"),
        )
        .select(
            "time_period",
            "sessions",
            "w_next_p",
            ratio("w_next_p", "sessions").alias("pct_w_next"),
            "to_mrfuzzy",
            ratio("to_mrfuzzy", "sessions").alias("pct_to_mrfuzzy"),
            "bear_love",
            ratio("bear_love", "sessions").alias("pct_bear_love"),
        )
    )


def next_after_each(pageviews: DataFrame, page: str | None = None, range_ids: int = RANGE_IDS) -> DataFrame:
    """Every view (of ``page``) with the view that follows it in its session: ``next_id``, ``next_url``.

    Unlike ``next_pageview``, which answers for a session's first view of
    the page, each view has its own next one. Null where none follows.
    """
    rows = pageviews.select(SESSION, VIEW, CREATED, "pageview_url")
    out = next_events(rows, SESSION, VIEW, ["pageview_url"], range_ids).withColumnsRenamed({f"next_{VIEW}": "next_id", "next_pageview_url": "next_url"})
    return out if page is None else out.filter(F.col("pageview_url") == page)


# --- cross-sell test around the cart page ---------------------------------


def cart_views(
    pageviews: DataFrame,
    start: str = V.CART_FROM,
    end: str = V.CART_TO,
    split: str = V.CART_SPLIT,
    after_from: str = V.CART_AFTER_FROM,
    page: str = V.CART,
) -> DataFrame:
    """Cart views of the window with a period label.

    The label is a searched case whose second test, as originally
    written, is ``>= after_from`` (earlier than ``split``); the first
    test wins, so in effect views from ``split`` on are "after".
    """
    return pageviews.filter(created_between(start, end) & (F.col("pageview_url") == page)).select(
        _label(split, V.PRE_CROSS_SALES_2, after_from, V.POST_CROSS_SALES_2).alias("time_period"), SESSION, VIEW
    )


def cart_next(pageviews: DataFrame, **window) -> DataFrame:
    """Per period and session: the next view after the cart, where there is one."""
    nxt = _next_after_first(cart_views(pageviews, **window), pageviews, keep_without_next=False, with_url=False)
    return nxt.select("time_period", SESSION, F.col("next_id").alias("min_p_id"))


def cart_orders(pageviews: DataFrame, orders: DataFrame, **window) -> DataFrame:
    """Per period, the orders of sessions that saw the cart; ``n_rows`` is the session's cart views.

    The original lists an order once per cart view; equal rows are returned once with their number.
    """
    views = cart_views(pageviews, **window).groupBy("time_period", SESSION).agg(F.count(F.lit(1)).alias("n_rows"))
    return views.join(orders.select(SESSION, "order_id", "items_purchased", "price_usd"), SESSION, "inner").select(
        "time_period", SESSION, "order_id", "items_purchased", F.col("price_usd").cast("double").alias("price_usd"), "n_rows"
    )


def _cart_cells(pageviews: DataFrame, **window) -> DataFrame:
    """Per period and session: what multiplies the rows of the cross-sell drill-down.

    The drill-down joins each cart view ``s`` with the session's rows of
    "went past the cart" (one per period, ``m`` of them) and each of those
    with the session's cart-view x order rows (``c`` cart views times the
    orders). All joins are on the session only, so a session with ``c``
    cart views gives ``c_p * m * c`` copies of each order row: quadratic in
    ``c``. Instead of emitting the copies, each distinct row is returned
    once with its number of copies:

    * no later view (``m = 0``): ``c_p`` rows, nothing clicked;
    * later view, no order: ``c_p * m`` rows, clicked;
    * later view and orders: ``c_p * m * c`` rows per order.

    ``c`` and ``m`` are sums over the session's (period, session) rows --
    at most one per period, so the window on the session id holds at most
    two rows whatever the size of the session.
    """
    keys = ["time_period", SESSION]
    per_period = (
        cart_views(pageviews, **window)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("c_p"), F.min(VIEW).alias("anchor"))
    )
    went = next_view(per_period, pageviews, [*keys, "c_p"], with_url=False)
    by_session = Window.partitionBy(SESSION)
    return went.select(
        *keys, "c_p", F.sum("c_p").over(by_session).alias("c"), F.count("next_id").over(by_session).alias("m")
    )


def cart_flags(pageviews: DataFrame, orders: DataFrame, **window) -> DataFrame:
    """Distinct cart drill-down rows with their number of copies ``n_rows``.

    A session's orders matter only when it went past the cart. The order
    rows come from an inner join, which Spark can split at a session with
    very many orders; the other rows keep one row per period and session.
    """
    cells = _cart_cells(pageviews, **window)
    has_order = orders.select(F.col(SESSION).alias("_os")).distinct()
    marked = cells.join(has_order, F.col(SESSION) == F.col("_os"), "left").withColumn(
        "ordered", F.col("_os").isNotNull() & (F.col("m") > 0)
    )
    keys = ["time_period", SESSION, "click_to_anoter_page", "placed_order", "items_purchased", "price_usd"]
    kinds = {f.name: f.dataType for f in orders.schema}
    plain = marked.filter(~F.col("ordered")).select(
        "time_period", SESSION, (F.col("m") > 0).cast("int").alias("click_to_anoter_page"), F.lit(0).alias("placed_order"),
        *[F.lit(None).cast(kinds[c]).alias(c) for c in keys[4:]],
        (F.col("c_p") * F.greatest(F.col("m"), F.lit(1))).alias("n_rows"),
    )
    bought = orders_of(cells.filter("m > 0"), orders, "items_purchased", "price_usd").select(
        "time_period", SESSION, F.lit(1).alias("click_to_anoter_page"), F.lit(1).alias("placed_order"),
        "items_purchased", "price_usd", (F.col("c_p") * F.col("m") * F.col("c")).alias("n_rows"),
    )
    return (
        plain.unionByName(bought)
        .groupBy(*keys)
        .agg(F.sum("n_rows").cast("bigint").alias("n_rows"))
        .select(*keys[:5], F.col("price_usd").cast("double").alias("price_usd"), "n_rows")
        .orderBy(SESSION, "time_period")
    )


def cart_metrics(pageviews: DataFrame, orders: DataFrame, **window) -> DataFrame:
    """Per period: cart sessions, click-through, orders, products and revenue.

    Sums run over the drill-down rows including their copies, exactly as
    the original sums over the fanned-out join. The orders are folded per
    session first, so each (period, session) meets one row.
    """
    cells = _cart_cells(pageviews, **window)
    rows = sessions_with_orders(cells, orders, _items=F.sum("items_purchased"))
    m, n = F.col("m"), F.col("_orders")
    copies = F.col("c_p") * m * F.when(n > 0, F.col("c")).otherwise(1)
    ordered = (m > 0) & (n > 0)
    agg = rows.groupBy("time_period").agg(
        F.count(F.lit(1)).alias("cart_sessions"),
        F.sum(copies * F.greatest(n, F.lit(1))).alias("ctr"),
        F.coalesce(F.sum(F.when(ordered, copies * n)), F.lit(0)).alias("cart_ctr"),
        F.sum(F.when(ordered, copies * F.col("_items"))).alias("_items"),
        F.sum(F.when(ordered, copies * F.col("_revenue"))).alias("_rev"),
    )
    return agg.select(
        "time_period",
        "cart_sessions",
        F.col("ctr").cast("bigint").alias("ctr"),
        F.col("cart_ctr").cast("bigint").alias("cart_ctr"),
        ratio("_items", "cart_ctr").alias("ppo"),
        ratio("_rev", "cart_ctr").alias("aov"),
        ratio("_rev", "cart_sessions").alias("rev_per_cart_session"),
    )


# --- product page click-through per month ----------------------------------


def product_views(pageviews: DataFrame, page: str = V.PRODUCTS) -> DataFrame:
    """All views of ``page``: session, view id and when it was seen."""
    return pageviews.filter(F.col("pageview_url") == page).select(SESSION, VIEW, F.col(CREATED).alias("saw_product"))


def product_click_through(
    pageviews: DataFrame, orders: DataFrame, page: str = V.PRODUCTS, facts: DataFrame | None = None
) -> DataFrame:
    """Per month: sessions seeing ``page``, how many clicked on, how many ordered.

    A session "clicked on" in a month when it has any view after its
    first ``page`` view of that month, i.e. when its last view id is
    greater. The last id per session is one partial + final aggregate
    over all views; no range join.
    """
    seen = product_views(pageviews, page)
    per_month = seen.groupBy(
        F.year("saw_product").alias("yr"), F.month("saw_product").alias("mont"), SESSION
    ).agg(F.min(VIEW).alias("anchor"))
    if facts is not None:
        last = facts.select(SESSION, F.col("last_view_id").alias("last_id"))
    else:
        last = pageviews.groupBy(SESSION).agg(F.max(VIEW).alias("last_id"))
    keyed = per_month.join(last, SESSION, "inner").select(
        "yr", "mont", SESSION, (F.col("last_id") > F.col("anchor")).alias("clicked")
    )
    rows = sessions_with_orders(keyed, orders)
    agg = rows.groupBy("yr", "mont").agg(
        n_sessions().alias("session_to_product"),
        F.count_if("clicked").alias("clicked_to_next_p"),
        n_orders().alias("orders"),
    )
    return agg.select(
        "yr",
        "mont",
        "session_to_product",
        "clicked_to_next_p",
        ratio("clicked_to_next_p", "session_to_product").alias("ctr"),
        "orders",
        ratio("orders", "session_to_product").alias("order_to_product"),
    ).transform(lambda df: sorted_small(df, "yr", "mont"))
