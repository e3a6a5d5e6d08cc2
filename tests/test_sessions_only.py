"""Reports over sessions alone derive and stage no other table."""

import datetime as dt
import os
import random

import pytest

from cartwheel.plans.catalog import REPORTS, SESSIONS_ONLY, run
from cartwheel.session import checkpoint_dir
from cartwheel.sources import open_shop, stage_shop

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _write_events(spark, path, seed):
    """Events with repeated rows and ids, nulls in each column that is read, and times that fall against the ids."""
    rng = random.Random(seed)
    rows = []
    for i in range(1500):
        at = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randint(0, 30 * 86400))
        row = [i, at, rng.randint(1, 40), "view", 1.0, f'{{"k": {rng.randint(0, 99)}}}']
        if i % 17 == 0:
            row[rng.choice([0, 1, 2, 5])] = None
        rows += [tuple(row)] * (1 + (i % 5 == 0))
        if i % 50 == 0:  # an id of another time, often in the same block
            rows.append((i, at + dt.timedelta(seconds=-40), *row[2:]))
    rng.shuffle(rows)
    spark.createDataFrame(rows, EVENTS).repartition(3).write.parquet(f"{path}/events.parquet")
    return path


def _folders(spark):
    return set(os.listdir(checkpoint_dir(spark).removeprefix("file://")))


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_the_reports_that_read_sessions_alone(spark, staged_check):
    class Recorder:
        def __getattr__(self, name):
            read.add(name)
            return getattr(staged_check, name)

    found = set()
    for key, report in REPORTS.items():
        read = set()
        report(Recorder())
        if read == {"sessions"}:
            found.add(key)
    assert found == SESSIONS_ONLY


def test_only_sessions_are_staged_and_equal_those_of_all_tables(spark, tmp_path):
    path, before = _write_events(spark, str(tmp_path), 1), _folders(spark)
    got = {key: _rows(run(key, spark, path)) for key in ("s60_bid_change", "s02_traffic_sources", "s81_repeat_histogram")}
    new = _folders(spark) - before
    assert [n.split("-")[0] for n in new] == ["sessions"], "staged once, and nothing else"
    sessions = _rows(open_shop(spark, path, sessions_only=True).sessions)
    stage_shop(spark, path)
    whole = open_shop(spark, path)
    assert sessions == _rows(whole.sessions) and len(sessions) > len(set(sessions)) > 100
    assert got == {key: _rows(REPORTS[key](whole)) for key in got}


def test_another_table_is_staged_when_it_is_read(spark, tmp_path):
    path = _write_events(spark, str(tmp_path), 3)
    shop = open_shop(spark, path, sessions_only=True)
    for key in ("s60_bid_change", "s29_session_flags", "s78_refund_rates"):
        assert _rows(REPORTS[key](shop)) == _rows(REPORTS[key](open_shop(spark, path)))
    # from now on the copy of all tables is used
    assert open_shop(spark, path, sessions_only=True).sessions.inputFiles()[0].split("/website_")[0].endswith(stage_shop(spark, path))


def test_errors_leave_no_sessions_folder(spark, tmp_path, monkeypatch):
    import cartwheel.sources.tables as T

    def broken(*_a, **_k):
        raise OSError("bad row")

    path, before = _write_events(spark, str(tmp_path), 4), _folders(spark)
    monkeypatch.setattr(T, "_write_sessions", broken)
    with pytest.raises(OSError, match="bad row"):
        run("s60_bid_change", spark, path)
    assert not _folders(spark) - before
