"""Spark session settings the reports are tuned for."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# SQL settings every cartwheel job wants, on a laptop or a cluster.
SQL_CONF = {
    # datetimes in the shop tables carry no zone (TIMESTAMP_NTZ); keep
    # date arithmetic deterministic anyway
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # runtime re-planning: coalesce small shuffles, split skewed join
    # partitions (a bot session or a heavy user may hold a large share of
    # all rows), turn a join side into a broadcast only once its real
    # size is known
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join even when an aggregate on the same key follows;
    # the aggregates after our joins are partial+final, so the extra
    # exchange only carries pre-aggregated rows
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # build the bloom filter of a selective session set and apply it to
    # the page-view scan before the shuffle
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def build_session(
    master: str | None = None,
    shuffle_partitions: int = 8,
    app_name: str = "cartwheel",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create a local session with the settings above, or return the
    active one untouched.

    ``master`` defaults to ``local[$BENCH_CPUS or 8]``. On a cluster the
    launcher's session is active already and keeps its own settings
    (shuffle partitions, checkpoint folder ...); only the checkpoint
    folder is filled in when it is unset.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        checkpoint_dir(active)
        return active
    if master is None:
        master = f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # the status store lives on even without the UI; a long-lived
        # driver running many reports should not keep every plan around
        .config("spark.ui.retainedJobs", "50")
        .config("spark.ui.retainedStages", "50")
        .config("spark.ui.retainedTasks", "1000")
        .config("spark.sql.ui.retainedExecutions", "20")
        .config("spark.driver.memory", os.environ.get("CARTWHEEL_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    env_conf = dict(kv.split("=", 1) for kv in os.environ.get("CARTWHEEL_SQL_CONF", "").split(",") if "=" in kv)
    for key, value in {**SQL_CONF, **(extra or {}), **env_conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


class NoSharedFolder(ValueError):
    """A cluster session that names no folder which all executors share."""


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    A cluster names it in ``spark.checkpoint.dir`` or has set it with
    ``setCheckpointDir``; either is used as it is. Only when there is
    neither on a local master (local runs and tests) a fresh scratch
    folder is taken; on a cluster that is an error, a machine-local folder
    would not be seen by the executors.
    """
    global _LOCAL_DIR
    sc = spark.sparkContext
    current = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder all executors share")
        if _LOCAL_DIR is None:
            _LOCAL_DIR = tempfile.mkdtemp(prefix="cartwheel-ckpt-")
        current = _LOCAL_DIR
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


_LOCAL_DIR: str | None = None


# runtime settings the report plans rely on; applied to a caller's session
# only where the caller has not set them
PREFERRED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def prefer_settings(spark: SparkSession) -> None:
    """Fill in ``PREFERRED`` where the session leaves them unset."""
    for key, value in PREFERRED.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
