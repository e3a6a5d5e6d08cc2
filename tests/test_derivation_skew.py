"""The click-stream derivation under a hot block and under at-scale plans.

A hand-made ``events`` table where one user fires a third of all events
inside one two-day block (one session with thousands of views), derived
by Spark and by the SQL prefix of the oracle, with broadcasts off and
every shuffle partition treated as skewed.
"""

import duckdb
import numpy as np
import pandas as pd
import pytest

from cartwheel.plans.oracle import with_tables
from cartwheel.sources import derive_shop
from compare import rows_of
from test_scale_paths import SPLIT_EVERYTHING

TABLES = {
    "sessions": "website_sessions",
    "pageviews": "website_pageviews",
    "orders": "shop_orders",
    "order_items": "order_items",
    "refunds": "order_item_refunds",
}


def _events(seed=3, n=6000):
    rng = np.random.default_rng(seed)
    start = pd.Timestamp("2024-01-01").value // 1000
    span = 30 * 86400 * 10**6
    ts = np.sort(rng.integers(start, start + span, n))
    users = rng.integers(1, 120, n)
    # a third of all events: user 5 inside one two-day block (day 10)
    hot = rng.random(n) < 0.33
    hot_ts = np.sort(rng.integers(start + 10 * 86400 * 10**6, start + 10 * 86400 * 10**6 + 3600 * 10**6, hot.sum()))
    ts = ts.copy()
    ts[hot] = hot_ts
    users[hot] = 5
    order = np.argsort(ts, kind="stable")
    df = pd.DataFrame(
        {
            "event_id": np.arange(n, dtype="int64"),
            "ts": pd.to_datetime(ts[order], unit="us"),
            "user_id": users[order].astype("int64"),
            "event_type": "view",
            "value": 1.0,
            "props": [f'{{"k": {k}}}' for k in rng.integers(0, 100, n)],
        }
    )
    return df


@pytest.fixture(scope="module")
def hot_events(spark):
    pdf = _events()
    con = duckdb.connect()
    con.register("events", pdf)
    sdf = spark.createDataFrame(pdf, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    return sdf, con, pdf


def test_one_session_holds_a_third(hot_events, spark):
    sdf, _, _ = hot_events
    pv = derive_shop(sdf).pageviews
    biggest = pv.groupBy("website_session_id").count().agg({"count": "max"}).first()[0]
    assert biggest > 0.3 * pv.count()


@pytest.mark.parametrize("conf", [{}, SPLIT_EVERYTHING], ids=["default", "skew_splits"])
@pytest.mark.parametrize("name", list(TABLES))
def test_derivation_with_hot_block(hot_events, spark, conf, name):
    sdf, con, _ = hot_events
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = getattr(derive_shop(sdf), name)
        got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    res = con.execute(with_tables(f"SELECT {', '.join(df.columns)} FROM {TABLES[name]}"))
    want = rows_of([c[0] for c in res.description], res.fetchall())
    assert got == want
