"""Week helpers, date literals, ratio semantics."""

import datetime as dt

from pyspark.sql import functions as F

from cartwheel.functions import monday_weekday, ratio, sunday_week, ts, year_week


def _days(spark, start="2000-01-01", n=30 * 366):
    return spark.range(n).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("d"))


def test_sunday_week_and_year_week_over_thirty_years(spark):
    df = _days(spark).select(
        "d",
        sunday_week(F.col("d")).alias("w"),
        year_week(F.col("d")).alias("yw"),
        monday_weekday(F.col("d")).alias("wd"),
    )
    for d, w, yw, wd in df.collect():
        assert w == int(d.strftime("%U")), d
        sunday = d - dt.timedelta(days=(d.weekday() + 1) % 7)
        assert yw == int(sunday.strftime("%Y%U")), d
        assert wd == d.weekday(), d


def test_new_year_days_belong_to_old_year_week(spark):
    # 2012-01-01 is a Sunday (week 1); 2013-01-01 is a Tuesday (week 0 of 2013,
    # which is the Sunday-week 2012-12-30 .. 2013-01-05: week 53 of 2012,
    # a year that began on a Sunday)
    rows = dict(
        spark.createDataFrame([("2012-01-01",), ("2013-01-01",), ("2013-01-06",)], "d string")
        .select(F.col("d"), F.struct(sunday_week(F.col("d").cast("date")), year_week(F.col("d").cast("date"))).alias("v"))
        .collect()
    )
    assert tuple(rows["2012-01-01"]) == (1, 201201)
    assert tuple(rows["2013-01-01"]) == (0, 201253)
    assert tuple(rows["2013-01-06"]) == (1, 201301)


def test_unpadded_literal_and_midnight_between(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2012, 6, 9, 0, 0, 0),), (dt.datetime(2012, 6, 9, 0, 0, 1),), (dt.datetime(2012, 8, 22),)],
        "t timestamp_ntz",
    )
    assert df.select(ts("2012-8-22").alias("x")).first().x == dt.datetime(2012, 8, 22)
    kept = df.filter(F.col("t").between(ts("2012-04-15"), ts("2012-06-09"))).collect()
    assert [r.t for r in kept] == [dt.datetime(2012, 6, 9)]


def test_ratio_by_zero_is_null(spark):
    r = spark.range(1).select(
        ratio(F.lit(1), F.lit(0)).alias("a"),
        ratio(F.lit(1), F.lit(3)).alias("b"),
        ratio(F.lit(1), F.lit(8), 100).alias("c"),
        ratio(F.lit(None).cast("long"), F.lit(2)).alias("d"),
    ).first()
    assert r.a is None and r.b == 0.333333 and r.c == 12.5 and r.d is None
