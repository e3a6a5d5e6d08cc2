"""Tables loaded more than once: repeated rows count once, found by what is known of their files."""

import glob
import os
import shutil

import pytest
from compare import SF_CHECK, compare
from pyspark.sql import functions as F

from cartwheel.operators import conversion, traffic
from cartwheel.operators.distinct import distinct_counts
from cartwheel.plans.catalog import REPORTS
from cartwheel.plans.oracle import oracle_sql
from cartwheel.sources import open_shop
from cartwheel.sources.files import FileTable, listing, plain
from cartwheel.sources.tables import KEYS, TABLE_FILES

ORACLE = oracle_sql()


def _part(df, digit):
    """A tenth of a table's rows, by its first column."""
    return df.filter(F.pmod(F.xxhash64(F.col(df.columns[0])), F.lit(10)) == digit)


@pytest.fixture(scope="module")
def loaded_twice(spark, staged_check, tmp_path_factory):
    """Stored tables where rows repeat inside a file and in a later file, one of them three times."""
    root = str(tmp_path_factory.mktemp("twice"))
    for name, field in TABLE_FILES.items():
        df = getattr(staged_check, field)
        df.unionByName(_part(df, 1)).repartitionByRange(4, df.columns[0]).write.parquet(f"{root}/{name}.parquet")
        _part(df, 2).unionByName(_part(df, 1)).coalesce(1).write.mode("append").parquet(f"{root}/{name}.parquet")
    return open_shop(spark, root)


@pytest.mark.parametrize("key", list(REPORTS))
def test_reports_over_repeated_rows_equal_the_oracle(loaded_twice, duck_check, key):
    diff = compare(REPORTS[key](loaded_twice), duck_check, ORACLE[key])
    assert diff is None, diff


def test_views_without_files_are_merged_in_the_plan(spark, staged_check, duck_check):
    from cartwheel.sources import catalog_shop

    for name, field in TABLE_FILES.items():
        df = getattr(staged_check, field)
        df.unionByName(_part(df, 3)).createOrReplaceTempView(name)
    try:
        for key in ("s03_gsearch_cvr", "s76_cart_metrics", "s90_product_margin"):
            assert compare(REPORTS[key](catalog_shop(spark)), duck_check, ORACLE[key]) is None
    finally:
        for name in TABLE_FILES:
            spark.catalog.dropTempView(name)


# -- the file table ------------------------------------------------------------


def _ids(spark, path, ranges):
    for low, high in ranges:
        spark.range(low, high, 1, 1).select(F.col("id"), (F.col("id") * 2).alias("x")).write.mode("append").parquet(path)


class Reader:
    def __init__(self, spark):
        self.spark, self.asked = spark, []

    def __call__(self, files):
        self.asked.append(sorted(map(plain, files)))
        return self.spark.read.parquet(*files)


def test_only_new_files_and_those_they_overlap_are_read(spark, tmp_path):
    path, facts = str(tmp_path / "t"), str(tmp_path / "facts")
    _ids(spark, path, [(0, 100), (100, 200), (200, 300)])
    first = Reader(spark)
    assert FileTable(spark, "id", facts).update(listing(spark, path), first) == []
    old = {plain(f) for f in listing(spark, path)}
    # the same state again: nothing is read
    again = Reader(spark)
    assert FileTable(spark, "id", facts).update(listing(spark, path), again) == [] and not again.asked
    # one more file beyond the others: only it is read
    _ids(spark, path, [(300, 400)])
    more = Reader(spark)
    assert FileTable(spark, "id", facts).update(listing(spark, path), more) == []
    assert {f for asked in more.asked for f in asked} == {plain(f) for f in listing(spark, path)} - old
    # one that overlaps the second file: both are read, both are told
    _ids(spark, path, [(150, 160)])
    overlap, table = Reader(spark), FileTable(spark, "id", facts)
    dirty = table.update(listing(spark, path), overlap)
    assert len(dirty) == 2 and sorted((table.facts[plain(f)].least, table.facts[plain(f)].greatest) for f in dirty) == [(100, 199), (150, 159)]
    assert len({f for asked in overlap.asked for f in asked}) == 2
    # what was told is kept, and goes with the file
    assert sorted(FileTable(spark, "id", facts).update(listing(spark, path), Reader(spark))) == sorted(dirty)
    late = [f for f in dirty if table.facts[plain(f)].least == 150][0]
    os.remove(plain(late))
    assert plain(late) not in {plain(f) for f in FileTable(spark, "id", facts).update(listing(spark, path), Reader(spark))}


def test_listing_sees_folders_and_leaves_out_hidden_names(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(40).select("id", (F.col("id") % 3).alias("k")).write.partitionBy("k").parquet(path)
    os.makedirs(f"{path}/_temporary")
    shutil.copy(glob.glob(f"{path}/k=0/*.parquet")[0], f"{path}/_temporary/x.parquet")
    assert {plain(f) for f in listing(spark, path)} == set(glob.glob(f"{path}/k=*/*.parquet"))
    assert all(size == os.path.getsize(plain(f)) for f, (size, _) in listing(spark, path).items())


def test_a_batch_of_reports_lists_each_table_once(spark, staged_check, tmp_path, monkeypatch):
    import cartwheel.sources.tables as T

    root, calls = str(tmp_path / "shop"), []
    for name, field in TABLE_FILES.items():
        getattr(staged_check, field).write.parquet(f"{root}/{name}.parquet")
    monkeypatch.setattr(T, "listing", lambda s, p: calls.append(p) or listing(s, p))
    shop = open_shop(spark, root)
    for key in ("s02_traffic_sources", "s03_gsearch_cvr", "s08_entry_pages", "s88_quarter_efficiency"):
        REPORTS[key](shop).collect()
    assert sorted(calls) == sorted(f"{root}/{n}.parquet" for n, f in TABLE_FILES.items() if f in ("sessions", "pageviews", "orders"))


# -- distinct counts -------------------------------------------------------------


def test_distinct_counts_equal_count_distinct(spark):
    rows = [(i * 7919 % 200_003 - 50_000 if i % 11 else None, i % 5 if i % 13 else None, i % 3) for i in range(6000)] * 2
    df = spark.createDataFrame(rows, "id long, g int, c int").repartition(6)
    conditions = {"all_": F.lit(True), "c0": F.col("c") == 0, "never": F.lit(False), "c12": F.col("c") > 0}
    got = distinct_counts(df, "id", conditions, {"g": F.col("g")}, least={"low": F.col("c")})
    want = df.groupBy("g").agg(*[F.count_distinct(F.when(c, F.col("id"))).alias(n) for n, c in conditions.items()], F.min("c").alias("low"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    assert "Expand" not in plan and plan.count("partial_bitmap_construct_agg") >= 1


def test_volume_and_conversion_over_repeated_ids(staged_check):
    sessions, orders = staged_check.sessions, staged_check.orders
    many, sold = sessions.unionByName(_part(sessions, 1)).unionByName(_part(sessions, 1)), orders.unionByName(orders)
    segments = {"mobile": F.col("device_type") == "mobile", "paid": F.col("utm_source").isNotNull()}
    for period in traffic.PERIODS:
        want, got = traffic.volume(sessions, period=period, segments=segments), traffic.volume(many, period=period, segments=segments, repeated_ids=True)
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    for keys in ([], ["utm_source", "device_type"]):
        want, got = conversion.conversion_by(sessions, orders, keys=keys), conversion.conversion_by(many, sold, keys=keys, repeated_ids=True)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_keys_have_a_table():
    assert set(KEYS) < set(TABLE_FILES.values()) and SF_CHECK
