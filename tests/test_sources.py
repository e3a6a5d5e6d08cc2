"""The derived shop tables equal the independent SQL derivation."""

import pytest
from pyspark.sql import functions as F

from cartwheel.plans.oracle import with_tables
from cartwheel.sources import SCHEMAS, derive_shop, open_shop
from compare import rows_of

from compare import SF_CHECK

ORACLE_NAMES = {
    "sessions": "website_sessions",
    "pageviews": "website_pageviews",
    "orders": "shop_orders",
    "order_items": "order_items",
    "refunds": "order_item_refunds",
}
# FIXTURES.md section 3, sf 0.01
EXPECTED_ROWS = {"sessions": 2316, "pageviews": 10000, "orders": 355, "order_items": 483, "refunds": 36}


def _check(shop, name, duck_check):
    df = getattr(shop, name)
    assert [f.name for f in df.schema.fields] == list(SCHEMAS[name])
    assert [f.dataType.simpleString() for f in df.schema.fields] == list(SCHEMAS[name].values())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = duck_check.execute(with_tables(f"SELECT {', '.join(df.columns)} FROM {ORACLE_NAMES[name]}"))
    want = rows_of([c[0] for c in res.description], res.fetchall())
    assert len(got) == EXPECTED_ROWS[name]
    assert got == want


@pytest.mark.parametrize("name", list(ORACLE_NAMES))
def test_derived_tables_match_sql(spark, duck_check, name):
    _check(derive_shop(spark.read.parquet(f"{SF_CHECK}/events.parquet")), name, duck_check)


@pytest.mark.parametrize("name", list(ORACLE_NAMES))
def test_staged_tables_match_sql(staged_check, duck_check, name):
    _check(staged_check, name, duck_check)


def test_one_view_sessions(spark):
    pv = open_shop(spark, SF_CHECK).pageviews
    assert pv.groupBy("website_session_id").count().filter("count = 1").count() == 176


def test_catalog_tables_give_the_same_reports(spark, staged_check):
    """Tables registered in the catalog (temp views here) read like files."""
    from cartwheel.operators import conversion
    from cartwheel.sources import catalog_shop
    from cartwheel.sources.tables import TABLE_FILES

    for name, field in TABLE_FILES.items():
        getattr(staged_check, field).createOrReplaceTempView(name)
    shop = catalog_shop(spark)
    a = conversion.quarterly(shop.sessions, shop.orders, efficiency=True).collect()
    b = conversion.quarterly(staged_check.sessions, staged_check.orders, efficiency=True).collect()
    assert a == b
    for name in TABLE_FILES:
        spark.catalog.dropTempView(name)


def test_errors_in_staging_are_raised(spark, monkeypatch, tmp_path):
    import os

    import cartwheel.sources.tables as T
    from cartwheel.session import checkpoint_dir

    def broken(*_a, **_k):
        raise OSError("bad row")

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(500)
    events.write.parquet(str(tmp_path / "events.parquet"))
    before = set(os.listdir(checkpoint_dir(spark)))
    monkeypatch.setattr(T, "_from_tagged", broken)
    with pytest.raises(OSError, match="bad row"):
        T.open_shop(spark, str(tmp_path))
    assert not [n for n in set(os.listdir(checkpoint_dir(spark))) - before if n.startswith("shop-")], "the folder is removed"


def test_no_shared_folder_keeps_the_lazy_plan(spark, monkeypatch):
    import cartwheel.sources.tables as T
    from cartwheel.session import NoSharedFolder

    def none(_spark):
        raise NoSharedFolder("set spark.checkpoint.dir")

    monkeypatch.setattr(T, "checkpoint_dir", none)
    with pytest.warns(UserWarning, match="nothing is staged"):
        shop = T.open_shop(spark, "/root/testdata/sf0.001")
    assert shop.sessions.count() == 230  # FIXTURES.md section 3, sf 0.001


def _write_events(spark, path, rows, mode="overwrite"):
    spark.read.parquet(f"{SF_CHECK}/events.parquet").orderBy("event_id").limit(rows).coalesce(1).write.mode(mode).parquet(f"{path}/events.parquet")


def test_replaced_rewritten_and_added_files_are_seen(spark, tmp_path):
    import glob
    import os
    import shutil

    path = str(tmp_path)
    _write_events(spark, path, 1000)
    assert open_shop(spark, path).pageviews.count() == 1000
    assert open_shop(spark, path).pageviews.count() == 1000
    _write_events(spark, path, 3000)
    assert open_shop(spark, path).pageviews.count() == 3000
    # another file of the same name and length in place of the old one
    part = glob.glob(f"{path}/events.parquet/part-*.parquet")[0]
    first = open_shop(spark, path)
    os.utime(part, (1_000_000_000, 1_000_000_000))
    second = open_shop(spark, path)
    assert first.pageviews.inputFiles() != second.pageviews.inputFiles()
    more = str(tmp_path / "more")
    spark.read.parquet(f"{SF_CHECK}/events.parquet").orderBy(F.desc("event_id")).limit(10).coalesce(1).write.parquet(more)
    shutil.copy(glob.glob(f"{more}/part-*.parquet")[0], f"{path}/events.parquet/part-99999-more.parquet")
    assert open_shop(spark, path).pageviews.count() == 3010


def _store(shop, root, **instead):
    from cartwheel.sources.tables import TABLE_FILES

    for name, field in TABLE_FILES.items():
        instead.get(field, getattr(shop, field)).write.parquet(f"{root}/{name}.parquet")


def test_different_rows_with_one_id_are_refused_by_the_reports_that_use_them(spark, staged_check, tmp_path):
    from cartwheel.plans.catalog import REPORTS
    from cartwheel.sources.tables import KEYS, RepeatedIds

    uses = {"sessions": "s02_traffic_sources", "pageviews": "s07_top_pages", "orders": "s64_sales_trend", "order_items": "s90_product_margin"}
    for field in KEYS:
        table = getattr(staged_check, field)
        root = str(tmp_path / field)
        other_time = table.limit(1).withColumn("created_at", F.expr("created_at + interval 1 second"))
        _store(staged_check, root, **{field: table.unionByName(other_time)})
        shop = open_shop(spark, root)
        with pytest.raises(RepeatedIds, match=KEYS[field]):
            REPORTS[uses[field]](shop)
        other = uses["order_items" if field != "order_items" else "sessions"]
        assert sorted(map(repr, REPORTS[other](shop).collect())) == sorted(map(repr, REPORTS[other](staged_check).collect()))


def test_opening_stored_tables_starts_no_job(spark, staged_check, tmp_path):
    root = str(tmp_path / "shop")
    _store(staged_check, root)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("opening", "")
    try:
        open_shop(spark, root)
        assert not [j for j in tracker.getJobIdsForGroup("opening")
                    if any(tracker.getStageInfo(s).numTasks > 1 for s in tracker.getJobInfo(j).stageIds)]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_large_prices_keep_their_value(spark, staged_check, tmp_path, ansi):
    from decimal import Decimal

    from cartwheel.plans.catalog import REPORTS

    root = str(tmp_path / "shop")
    orders = staged_check.orders.withColumn("price_usd", F.lit(Decimal("12345.67")).cast("decimal(12,2)"))
    _store(staged_check, root, orders=orders)
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        trend = REPORTS["s64_sales_trend"](open_shop(spark, root)).collect()
        assert trend and all(abs(r.revenue - r.orders * 12345.67) < 0.01 for r in trend)
        assert all(r.rev_per_session > 10000 for r in REPORTS["s88_quarter_efficiency"](open_shop(spark, root)).collect() if r.orders)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)


def test_catalog_tables_over_files_get_facts(spark, staged_check, tmp_path):
    from cartwheel.plans.catalog import REPORTS
    from cartwheel.sources import catalog_shop
    from cartwheel.sources.tables import TABLE_FILES

    root = str(tmp_path / "shop")
    _store(staged_check, root)
    for name in TABLE_FILES:
        spark.read.parquet(f"{root}/{name}.parquet").createOrReplaceTempView(name)
    try:
        shop = catalog_shop(spark)
        plan = REPORTS["s29_session_flags"](shop)._jdf.queryExecution().executedPlan().toString()
        assert "seen_" in plan
        for key in ("s29_session_flags", "s92_products_ctr", "s51_last_home_session"):
            assert sorted(map(repr, REPORTS[key](shop).collect())) == sorted(map(repr, REPORTS[key](staged_check).collect()))
    finally:
        for name in TABLE_FILES:
            spark.catalog.dropTempView(name)


def test_staged_copy_is_marked_and_reused(spark):
    import os

    from cartwheel.sources import stage_shop

    first = stage_shop(spark, "/root/testdata/sf0.001")
    assert os.path.exists(os.path.join(first, "_COMPLETE"))
    assert stage_shop(spark, "/root/testdata/sf0.001") == first
