"""Repeat visitors: new-to-repeat session pairs, repeat counts, days to return.

A visitor has one new session (``is_repeat_session = 0``) and any number
of repeat sessions. The pairs of a new session with the later repeat
sessions of the same user in the window are an inner equi-join on the
user plus a range condition -- AQE may split a heavy user's partition on
either side of an inner join -- and the new sessions without any later
repeat are added from a one-row-per-user aggregate, instead of an outer
join that would pin a heavy user to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.functions import rounded, ts
from cartwheel.functions import vocab as V
from cartwheel.operators.common import CREATED, SESSION, created_before, sorted_small
from cartwheel.operators.next_event import RANGE_IDS, least_behind


def _window(sessions: DataFrame, start: str, end: str) -> DataFrame:
    return sessions.filter(created_before(end) & (F.col(CREATED) >= ts(start)))


def _new_and_repeat(sessions: DataFrame, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    win = _window(sessions, start, end)
    new = win.filter(F.col("is_repeat_session") == 0).select(
        "user_id", F.col(SESSION).alias("new_session_id"), F.col(CREATED).alias("first_session")
    )
    rep = win.filter(F.col("is_repeat_session") == 1).select(
        F.col("user_id").alias("_ru"), F.col(SESSION).alias("repeat_session_id"), F.col(CREATED).alias("second_session")
    )
    return new, rep


def _matched(new: DataFrame, rep: DataFrame) -> DataFrame:
    cond = (F.col("user_id") == F.col("_ru")) & (F.col("repeat_session_id") > F.col("new_session_id"))
    return new.join(rep, cond, "inner").drop("_ru")


def repeat_pairs(
    sessions: DataFrame, start: str = V.REPEAT_FROM, end: str = V.REPEAT_BEFORE, with_dates: bool = False
) -> DataFrame:
    """Each new session of the window with each later repeat session of its user.

    New sessions without a later repeat appear once with NULL repeat.
    """
    new, rep = _new_and_repeat(sessions, start, end)
    matched = _matched(new, rep)
    last_rep = rep.groupBy(F.col("_ru").alias("user_id")).agg(F.max("repeat_session_id").alias("_last"))
    lonely = (
        new.join(last_rep, "user_id", "left")
        .filter(F.col("_last").isNull() | (F.col("_last") <= F.col("new_session_id")))
        .select(
            "user_id",
            "new_session_id",
            "first_session",
            F.lit(None).cast("bigint").alias("repeat_session_id"),
            F.lit(None).cast("timestamp_ntz").alias("second_session"),
        )
    )
    cols = ["user_id", "new_session_id", "first_session", "repeat_session_id", "second_session"]
    pairs = matched.select(*cols).unionByName(lonely.select(*cols))
    if with_dates:
        return pairs
    return pairs.select("user_id", "new_session_id", "repeat_session_id")


def repeat_histogram(sessions: DataFrame, start: str = V.REPEAT_FROM, end: str = V.REPEAT_BEFORE) -> DataFrame:
    """Users with a new session in the window, by number of later repeat sessions."""
    new, rep = _new_and_repeat(sessions, start, end)
    firsts = new.groupBy("user_id").agg(F.min("new_session_id").alias("new_session_id"))
    reps = _matched(firsts, rep).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rep"))
    per_user = firsts.join(reps, "user_id", "left").select(
        "user_id", F.coalesce(F.col("n_rep"), F.lit(0)).alias("repeat_session")
    )
    return sorted_small(per_user.groupBy("repeat_session").agg(F.count(F.lit(1)).alias("users")), "repeat_session")


def repeat_lag(
    sessions: DataFrame, start: str = V.REPEAT_FROM, end: str = V.REPEAT_BEFORE, range_ids: int = RANGE_IDS
) -> DataFrame:
    """Per user: days from the new session to the first later repeat session.

    The days are counted per new session and the least is kept per user
    (a user with one new session -- the normal case -- has just one). The
    first repeat behind each session is a running minimum, so no pairs of
    sessions are made, however many new sessions a user has.
    """
    win = _window(sessions, start, end).select(
        "user_id", SESSION, CREATED, "is_repeat_session", F.when(F.col("is_repeat_session") == 1, F.col(CREATED)).alias("_again")
    )
    back = least_behind(win, "user_id", SESSION, "_again", "repeat_session_date", range_ids)
    came_back = back.filter((F.col("is_repeat_session") == 0) & F.col("repeat_session_date").isNotNull())
    return came_back.groupBy("user_id").agg(F.min(F.datediff(F.col("repeat_session_date"), F.col(CREATED))).alias("diff"))


def repeat_lag_stats(sessions: DataFrame, **window) -> DataFrame:
    """Average, largest and smallest days to return."""
    lag = repeat_lag(sessions, **window)
    return lag.agg(
        rounded(F.avg("diff")).alias("avg_diff"), F.max("diff").alias("max_diff"), F.min("diff").alias("min_diff")
    )
