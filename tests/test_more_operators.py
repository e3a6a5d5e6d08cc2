"""Next event of every row, repeat lag without pairs, pivots by the data's values, stages as views."""

import datetime as dt

import pytest
from compare import compare
from pyspark.sql import Window
from pyspark.sql import functions as F

from cartwheel.functions.pivot import TooWide, values_of
from cartwheel.operators import paths, products, repeat
from cartwheel.operators.next_event import least_behind, next_events
from cartwheel.plans import views
from cartwheel.plans.catalog import REPORTS
from cartwheel.plans.oracle import oracle_sql

SESSION, VIEW = "website_session_id", "website_pageview_id"


def _rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def hot(spark):
    """Rows of a few groups, one with most of them, and rows without group or id."""
    df = spark.range(0, 3000, 1, 5).select(
        (F.col("id") * 3 - 700).alias("n"), F.when(F.rand(3) < 0.7, 1).otherwise((F.rand(4) * 40).cast("int")).alias("g"), (F.rand(5) * 90).cast("int").alias("v")
    )
    none = spark.createDataFrame([(None, 1, 3), (90_001, None, 4), (90_002, None, 5)], "n long, g int, v int")
    df = df.unionByName(none).withColumn("s", F.concat(F.lit("x"), "v"))
    return spark.createDataFrame(df.collect(), "n long, g int, v int, s string")  # the same rows at every use


@pytest.mark.parametrize("range_ids", [1, 7, 500, 1 << 20])
def test_next_event_equals_lead(hot, range_ids):
    w = Window.partitionBy("g").orderBy("n")
    some = F.col("g").isNotNull() & F.col("n").isNotNull()
    ids = hot.filter("n is not null")
    want = ids.select("*", F.when(some, F.lead("n").over(w)).alias("next_n"), F.when(some, F.lead("s").over(w)).alias("next_s"))
    want = want.unionByName(hot.filter("n is null").select("*", F.lit(None).cast("long").alias("next_n"), F.lit(None).cast("string").alias("next_s")))
    assert _rows(next_events(hot, "g", "n", ["s"], range_ids)) == _rows(want)


@pytest.mark.parametrize("range_ids", [1, 7, 500, 1 << 20])
def test_least_behind_equals_a_window_over_the_group(hot, range_ids):
    rows = hot.filter("n is not null and g is not null")
    w = Window.partitionBy("g").orderBy("n").rowsBetween(1, Window.unboundedFollowing)
    assert _rows(least_behind(rows, "g", "n", "v", "low", range_ids)) == _rows(rows.withColumn("low", F.min("v").over(w)))


def test_a_hot_group_is_spread_over_tasks(spark, hot):
    """With small ranges the group that holds most rows is sorted in many tasks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is tiny
    hottest = next_events(hot.filter("g = 1"), "g", "n", ["s"], range_ids=300).withColumn("task", F.spark_partition_id())
    sizes = [r["count"] for r in hottest.groupBy("task").count().collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) > 4 and max(sizes) < 0.5 * sum(sizes)


def test_next_view_of_every_view(staged_check):
    pv = staged_check.pageviews
    w = Window.partitionBy(SESSION).orderBy(VIEW)
    want = pv.select(SESSION, VIEW, "created_at", "pageview_url", F.lead(VIEW).over(w).alias("next_id"), F.lead("pageview_url").over(w).alias("next_url"))
    for page in (None, "/products"):
        chosen = want if page is None else want.filter(F.col("pageview_url") == page)
        assert _rows(paths.next_after_each(pv, page, range_ids=1000)) == _rows(chosen)


def test_repeat_lag_of_users_with_many_new_sessions(spark):
    day = lambda n: dt.datetime(2014, 1, 2) + dt.timedelta(days=n)
    rows = [(i, day(i * 7 % 200), i % 3 if i % 4 else 0, int(i % 5 in (2, 4))) for i in range(400)]
    sessions = spark.createDataFrame(rows, "website_session_id long, created_at timestamp_ntz, user_id long, is_repeat_session int")
    lag = {}
    for a in rows:
        for b in rows:
            if a[3] == 0 and b[3] == 1 and a[2] == b[2] and b[0] > a[0] and all(dt.datetime(2014, 1, 1) <= x[1] < dt.datetime(2014, 11, 3) for x in (a, b)):
                lag.setdefault((a[2], a[0], a[1]), []).append(b[1])
    want = {}
    for (user, _, start), ends in lag.items():
        want[user] = min(want.get(user, 10**6), (min(ends).date() - start.date()).days)
    for range_ids in (3, 1 << 20):
        assert {r.user_id: r["diff"] for r in repeat.repeat_lag(sessions, range_ids=range_ids).collect()} == want
    plan = repeat.repeat_lag(sessions, range_ids=50)._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001
    assert "Join Inner" not in plan, "no pairs of sessions"


def test_a_fifth_product_appears_as_columns(spark, staged_check):
    items, orders = staged_check.order_items, staged_check.orders
    fifth = items.limit(3).withColumn("product_id", F.lit(5)).withColumn("order_item_id", F.col("order_item_id") + 10**9).withColumn("is_primary_item", F.lit(0))
    more = spark.createDataFrame(items.unionByName(fifth).collect(), items.schema)
    assert "P5_orders" in products.refund_rates(more, staged_check.refunds, until="2100-01-01", products=None).columns
    assert {"p5_rev", "p5_mr", "minbear_rev"} <= set(products.product_margins(more, products=None).columns)
    matrix = products.cross_sell_matrix(orders, more, after="2000-01-01", products=None)
    assert sum(r.sold_p5x for r in matrix.collect()) == fifth.select("order_id").distinct().count()
    for p in (None, (1, 2, 3, 4)):  # the reports' own values are those of the data
        assert _rows(products.product_margins(items, products=p)) == _rows(products.product_margins(items))
    with pytest.raises(TooWide):
        values_of(items, "order_item_id", widest=20)


def test_stages_as_views_equal_their_reports(spark, staged_check, duck_check):
    names = views.register(spark, staged_check)
    try:
        assert len(views.STAGES) == 25 and set(views.STAGES) < set(names)
        oracle = oracle_sql()
        for name, key in views.STAGES.items():
            assert compare(spark.sql(f"SELECT * FROM {name}"), duck_check, oracle[key]) is None, name
        joined = spark.sql("SELECT count(*) n FROM boun b JOIN l_p l ON b.website_session_id = l.website_session_id JOIN website_sessions w ON w.website_session_id = b.website_session_id")
        assert joined.first().n == REPORTS["s13_bounced_sessions"](staged_check).count()
    finally:
        for name in names:
            spark.catalog.dropTempView(name)
