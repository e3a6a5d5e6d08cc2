"""Staging after new event files equals staging everything, and writes what they touch."""

import glob
import os
import shutil

import pytest
from compare import SF_CHECK
from pyspark.sql import functions as F

from cartwheel.plans.catalog import REPORTS
from cartwheel.sources import derive_shop, open_shop, stage_shop
from cartwheel.sources import tables as T


def _add(spark, df, path, name, tmp):
    df.coalesce(1).write.parquet(str(tmp / name))
    os.makedirs(f"{path}/events.parquet", exist_ok=True)
    shutil.copy(glob.glob(f"{tmp}/{name}/part-*.parquet")[0], f"{path}/events.parquet/{name}.parquet")


def _rows(df):
    return sorted(map(repr, df.collect()))


def _size(root):
    return sum(os.path.getsize(f) for f in glob.glob(f"{root}/**/*.parquet", recursive=True))


PARTS = {
    "latest": "event_id > 9900",
    "scattered": "pmod(xxhash64(event_id), 100) = 3",
    "one_user": "user_id = 17",
}


@pytest.mark.parametrize("kind", PARTS)
def test_an_added_file_equals_a_full_restage(spark, tmp_path, kind):
    events = spark.read.parquet(f"{SF_CHECK}/events.parquet")
    path = str(tmp_path / "in")
    late = F.expr(PARTS[kind])
    _add(spark, events.filter(~late), path, "a", tmp_path)
    first = stage_shop(spark, path)
    assert T._base_of(spark, first) is None
    _add(spark, events.filter(late), path, "b", tmp_path)
    second = stage_shop(spark, path)
    assert T._base_of(spark, second) == first
    shop, whole = open_shop(spark, path), derive_shop(spark.read.parquet(f"{path}/events.parquet"))
    for name in T.SCHEMAS:
        got, want = getattr(shop, name), getattr(whole, name)
        assert got.columns == want.columns and _rows(got) == _rows(want), name
    assert _rows(shop.session_facts) == _rows(T.session_facts(whole.pageviews))
    for key in ("s08_entry_pages", "s28_pageview_flags", "s76_cart_metrics", "s81_repeat_histogram", "s94_cross_sell_matrix"):
        assert _rows(REPORTS[key](shop)) == _rows(REPORTS[key](whole)), key
    # the page views written are those of touched sessions
    n = spark.read.parquet(f"{second}/website_pageviews.parquet").count()
    new = spark.read.parquet(f"{path}/events.parquet/b.parquet").count()
    assert new <= n <= (12 if kind == "scattered" else 2.5) * new
    assert not glob.glob(f"{second}/_t*.parquet") and not glob.glob(f"{second}/_blocks*")


def test_increments_follow_one_another_until_too_many(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "MOST_INCREMENTS", 2)
    events = spark.read.parquet(f"{SF_CHECK}/events.parquet")
    path, at, bases = str(tmp_path / "in"), 0, []
    for k, upto in enumerate((9000, 9300, 9600, 10_000)):
        _add(spark, events.filter((F.col("event_id") >= at) & (F.col("event_id") < upto)), path, f"p{k}", tmp_path)
        at = upto
        bases.append(T._base_of(spark, stage_shop(spark, path)))
    assert [b is None for b in bases] == [True, False, False, True]
    third = open_shop(spark, path)
    whole = derive_shop(spark.read.parquet(f"{path}/events.parquet"))
    assert all(_rows(getattr(third, n)) == _rows(getattr(whole, n)) for n in T.SCHEMAS)


def test_a_rewritten_file_or_many_new_bytes_stage_everything(spark, tmp_path):
    events = spark.read.parquet(f"{SF_CHECK}/events.parquet").filter("event_id < 3000")
    path = str(tmp_path / "in")
    _add(spark, events.filter("event_id < 1000"), path, "a", tmp_path)
    stage_shop(spark, path)
    _add(spark, events.filter("event_id >= 1000"), path, "b", tmp_path)
    assert T._base_of(spark, stage_shop(spark, path)) is None
    os.utime(f"{path}/events.parquet/a.parquet", (1_000_000_000, 1_000_000_000))
    assert T._base_of(spark, stage_shop(spark, path)) is None
    assert open_shop(spark, path).pageviews.count() == 3000


def test_an_increment_is_small(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet")
    path = str(tmp_path / "in")
    top = events.agg(F.max("event_id")).first()[0]
    _add(spark, events.filter(F.col("event_id") <= top * 0.99), path, "a", tmp_path)
    first = stage_shop(spark, path, files_per_table=2)
    _add(spark, events.filter(F.col("event_id") > top * 0.99), path, "b", tmp_path)
    second = stage_shop(spark, path)
    assert T._base_of(spark, second) == first
    assert spark.read.parquet(f"{second}/website_pageviews.parquet").count() < 0.03 * spark.read.parquet(f"{first}/website_pageviews.parquet").count()
    assert _size(second) < 0.25 * _size(first)
