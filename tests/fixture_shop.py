"""A small hand-made shop with hot keys, for brute-force checks.

About a third of all sessions belong to one user, a few sessions hold
most of the page views (long bot-like paths through products and cart),
one session has several orders and one order has many items. Dates span
the windows of the original analysis.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

HOT_USER = 7
FUNNEL = ["/products", None, "/cart", "/shipping", None, "/thank-you-for-your-order"]
PRICE = {1: 49.99, 2: 59.99, 3: 69.99, 4: 79.99}
COGS = {1: 19.49, 2: 23.49, 3: 27.49, 4: 31.49}


def make_tables(seed: int = 7, n_sessions: int = 600, hot_share: float = 0.33) -> dict[str, pd.DataFrame]:
    rng = np.random.default_rng(seed)
    start, end = pd.Timestamp("2012-03-19").value // 10**9, pd.Timestamp("2015-03-01").value // 10**9
    secs = np.sort(rng.integers(start, end, n_sessions))
    times = pd.to_datetime(secs, unit="s")
    sids = np.arange(1, n_sessions + 1)
    users = np.where(rng.random(n_sessions) < hot_share, HOT_USER, rng.integers(100, 300, n_sessions))
    seen: set[int] = set()
    repeat = []
    for u in users:
        repeat.append(1 if u in seen else 0)
        seen.add(int(u))
    src = rng.choice(["gsearch", "gsearch", "gsearch", "bsearch", "socialbook", "none"], n_sessions)
    sessions = pd.DataFrame(
        {
            "website_session_id": sids,
            "created_at": times,
            "user_id": users.astype("int64"),
            "is_repeat_session": np.array(repeat, dtype="int32"),
            "utm_source": [None if s == "none" else s for s in src],
            "utm_campaign": [
                ("brand" if rng.random() < 0.25 else "nonbrand") if s in ("gsearch", "bsearch") else ("pilot" if s == "socialbook" else None)
                for s in src
            ],
            "device_type": rng.choice(["desktop", "mobile"], n_sessions),
            "http_referer": [
                {"gsearch": "https://www.gsearch.com", "bsearch": "https://www.bsearch.com", "socialbook": "https://www.socialbook.com"}.get(
                    s, rng.choice(["https://www.gsearch.com", None])
                )
                for s in src
            ],
        }
    )
    # hot sessions: the first session in the billing, product-path and cart windows
    hot = {int(sessions.loc[sessions.created_at >= t, "website_session_id"].iloc[0]) for t in ("2012-09-20", "2012-12-01", "2013-09-01", "2012-08-10")}

    views, orders, items = [], [], []
    vid, oid = 1, 1
    for sid, t in zip(sids, times):
        sid = int(sid)
        landing = "/lander-1" if (t >= pd.Timestamp("2012-06-19") and rng.random() < 0.5) else "/home"
        if sid in hot:
            path = [landing] + ["/products", "/the-original-mr-fuzzy", "/cart", "/products", "/cart", "/home"] * 150
            path += ["/shipping", "/billing-2", "/thank-you-for-your-order", "/cart", "/billing", "/thank-you-for-your-order"]
        else:
            depth = int(rng.integers(0, 8))
            path = [landing]
            for step in FUNNEL[:depth]:
                if step is None:
                    step = "/the-forever-love-bear" if (t >= pd.Timestamp("2013-01-06") and rng.random() < 0.3) else "/the-original-mr-fuzzy"
                    if len(path) == 5:
                        step = "/billing-2" if (t >= pd.Timestamp("2012-09-10") and rng.random() < 0.5) else "/billing"
                path.append(step)
            if rng.random() < 0.2:
                path += ["/cart", "/products", "/home"][: int(rng.integers(1, 4))]
        for j, url in enumerate(path):
            at = t + pd.Timedelta(seconds=45 * j)
            views.append((vid, at, sid, url))
            vid += 1
            if url == "/thank-you-for-your-order":
                n_av = 1 if at < pd.Timestamp("2013-01-06") else (2 if at < pd.Timestamp("2013-12-12") else (3 if at < pd.Timestamp("2014-06-01") else 4))
                p1 = int(rng.integers(1, n_av + 1))
                n_items = 1 if n_av == 1 else int(rng.integers(1, 3))
                if sid in hot and oid % 2 == 0:
                    n_items = 40
                lines = [(p1, 1)] + [(int(rng.integers(1, n_av + 1)), 0) for _ in range(n_items - 1)]
                base = oid * 100
                for i, (p, prim) in enumerate(lines):
                    items.append((base + i, at, oid, p, prim, PRICE[p], COGS[p]))
                orders.append((oid, at, sid, p1, len(lines), round(sum(PRICE[p] for p, _ in lines), 2), round(sum(COGS[p] for p, _ in lines), 2)))
                oid += 1
    pageviews = pd.DataFrame(views, columns=["website_pageview_id", "created_at", "website_session_id", "pageview_url"])
    orders_df = pd.DataFrame(
        orders, columns=["order_id", "created_at", "website_session_id", "primary_product_id", "items_purchased", "price_usd", "cogs_usd"]
    )
    items_df = pd.DataFrame(items, columns=["order_item_id", "created_at", "order_id", "product_id", "is_primary_item", "price_usd", "cogs_usd"])
    refund_ids = items_df.order_item_id[rng.random(len(items_df)) < 0.1]
    refunds = pd.DataFrame({"order_item_id": pd.concat([refund_ids, refund_ids.head(3)]).astype("int64")})
    return {
        "website_sessions": sessions,
        "website_pageviews": pageviews,
        "shop_orders": orders_df,
        "order_items": items_df,
        "order_item_refunds": refunds,
    }


SPARK_SCHEMAS = {
    "website_sessions": "website_session_id bigint, created_at timestamp_ntz, user_id bigint, is_repeat_session int, "
    "utm_source string, utm_campaign string, device_type string, http_referer string",
    "website_pageviews": "website_pageview_id bigint, created_at timestamp_ntz, website_session_id bigint, pageview_url string",
    "shop_orders": "order_id bigint, created_at timestamp_ntz, website_session_id bigint, primary_product_id int, "
    "items_purchased int, price_usd double, cogs_usd double",
    "order_items": "order_item_id bigint, created_at timestamp_ntz, order_id bigint, product_id int, is_primary_item int, "
    "price_usd double, cogs_usd double",
    "order_item_refunds": "order_item_id bigint",
}
MONEY = ("price_usd", "cogs_usd")


FIELD = {
    "website_sessions": "sessions",
    "website_pageviews": "pageviews",
    "shop_orders": "orders",
    "order_items": "order_items",
    "order_item_refunds": "refunds",
}


def build_pair(spark, seed: int = 7, n_sessions: int = 600, hot_share: float = 0.33):
    """The hand-made shop as Spark tables and as DuckDB tables."""
    import duckdb

    from cartwheel.sources import ShopTables

    tables = make_tables(seed, n_sessions, hot_share)
    con = duckdb.connect()
    dfs = {}
    for name, pdf in tables.items():
        con.register(f"raw_{name}", pdf)
        cols = ", ".join(
            f"CAST({c} AS DECIMAL(6,2)) AS {c}" if c in MONEY else (f"CAST({c} AS TIMESTAMP) AS {c}" if c == "created_at" else c)
            for c in pdf.columns
        )
        con.execute(f"CREATE TABLE {name} AS SELECT {cols} FROM raw_{name}")
        dfs[FIELD[name]] = spark.createDataFrame(pdf, schema=SPARK_SCHEMAS[name])
    return ShopTables(**dfs).conform(), con, tables
