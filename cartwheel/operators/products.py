"""Sales, margins, refunds and cross-sell per product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.functions import count_when, money, ratio
from cartwheel.functions import vocab as V
from cartwheel.functions.pivot import values_of
from cartwheel.operators.common import CREATED, created_after, created_before, sorted_small


def sales_trend(orders: DataFrame, until: str = V.SALES_UNTIL) -> DataFrame:
    """Monthly orders, revenue and margin."""
    return (
        orders.filter(created_before(until))
        .groupBy(F.year(CREATED).alias("yr"), F.month(CREATED).alias("mon"))
        .agg(
            F.count("order_id").alias("orders"),
            F.sum("price_usd").alias("_rev"),
            F.sum(F.col("price_usd") - F.col("cogs_usd")).alias("_mar"),
        )
        .select("yr", "mon", "orders", money("_rev").alias("revenue"), money("_mar").alias("mar"))
        .transform(lambda df: sorted_small(df, "yr", "mon"))
    )


def refund_rates(
    order_items: DataFrame, refunds: DataFrame, until: str = V.REFUND_UNTIL, products: Sequence[int] | None = (1, 2, 3)
) -> DataFrame:
    """Monthly items sold and share refunded, per product (None: every product among the items).

    An item counts as refunded once however many refund rows it has; the
    refund ids are de-duplicated (partial aggregate) before the join.
    """
    refunded = refunds.select("order_item_id").distinct().withColumn("_refunded", F.lit(True))
    items = order_items.filter(created_before(until)).select("order_item_id", CREATED, "product_id")
    products = values_of(items, "product_id") if products is None else products
    joined = items.join(refunded, "order_item_id", "left")
    prod, ref = F.col("product_id"), F.coalesce(F.col("_refunded"), F.lit(False))
    aggs = []
    for p in products:
        aggs.append(count_when(prod == p).alias(f"_n{p}"))
        aggs.append(count_when((prod == p) & ref).alias(f"_r{p}"))
    out = joined.groupBy(F.year(CREATED).alias("yr"), F.month(CREATED).alias("mon")).agg(*aggs)
    cols = ["yr", "mon"]
    for p in products:
        cols += [F.col(f"_n{p}").alias(f"P{p}_orders"), ratio(f"_r{p}", f"_n{p}").alias(f"P{p}_rt")]
    return sorted_small(out.select(*cols), "yr", "mon")


def product_margins(order_items: DataFrame, products: Sequence[int] | None = (1, 2, 3, 4)) -> DataFrame:
    """Monthly revenue and margin per product (None: every product among the items).

    The first four products' columns have names of their own, others are ``p<id>_rev`` and ``p<id>_mr``.
    """
    prod = F.col("product_id")
    products = values_of(order_items, "product_id") if products is None else products
    named = dict(enumerate(V.PRODUCT_MARGIN_NAMES, start=1))
    aggs = []
    for p in products:
        rev_name, mar_name = named.get(p, (f"p{p}_rev", f"p{p}_mr"))
        aggs.append(money(F.sum(F.when(prod == p, F.col("price_usd")))).alias(rev_name))
        aggs.append(money(F.sum(F.when(prod == p, F.col("price_usd") - F.col("cogs_usd")))).alias(mar_name))
    return (
        order_items.groupBy(F.year(CREATED).alias("yr"), F.month(CREATED).alias("mont"))
        .agg(*aggs)
        .transform(lambda df: sorted_small(df, "yr", "mont"))
    )


def recent_orders(orders: DataFrame, after: str = V.RECENT_ORDERS_AFTER) -> DataFrame:
    """Orders after a date: id, primary product and time."""
    return orders.filter(created_after(after)).select(
        "order_id", "primary_product_id", F.col(CREATED).alias("order_at")
    )


def cross_sell_matrix(
    orders: DataFrame, order_items: DataFrame, after: str = V.RECENT_ORDERS_AFTER, products: Sequence[int] | None = (1, 2, 3, 4)
) -> DataFrame:
    """Per primary product: orders, and orders that also bought product i (None: every product among the items).

    The non-primary items are matched to the recent orders with an inner
    join (the recent orders are broadcast when AQE measures them small)
    and folded to one flag row per order -- partial + final aggregate on
    the order id -- before one more aggregate per primary product.
    """
    ords = recent_orders(orders, after).select("order_id", "primary_product_id")
    extra = order_items.filter(F.col("is_primary_item") == 0).select("order_id", F.col("product_id").alias("cross_sell"))
    products = values_of(order_items, "product_id") if products is None else products
    flags = (
        ords.join(extra, "order_id", "inner")
        .groupBy("order_id")
        .agg(*[F.max(F.col("cross_sell") == p).alias(f"_x{p}") for p in products])
    )
    per_order = ords.join(flags, "order_id", "left")
    aggs = [F.count(F.lit(1)).alias("orders")]
    aggs += [count_when(F.col(f"_x{p}")).alias(f"sold_p{p}x") for p in products]
    out = per_order.groupBy("primary_product_id").agg(*aggs)
    return out.select(
        "primary_product_id",
        "orders",
        *[f"sold_p{p}x" for p in products],
        *[ratio(f"sold_p{p}x", "orders").alias(f"sold_p{p}x_rt") for p in products],
    ).transform(lambda df: sorted_small(df, "primary_product_id"))
