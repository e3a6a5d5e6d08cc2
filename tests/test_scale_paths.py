"""The plans a large cluster would run give the same answers.

On small data AQE broadcasts most filtered sides. Here broadcasts are
switched off, so every join is a shuffled sort-merge join, and in the
second setting every shuffle partition counts as skewed, so AQE splits
the join partitions (``SortMergeJoin(skew=true)``) the way it splits a
hot session or user at scale. All reports run on the skewed hand-made
shop and are compared with the brute-force SQL.
"""

import pytest

from cartwheel.plans.catalog import REPORTS
from cartwheel.plans.oracle import REPORT_SQL, over_given_tables
from compare import compare
from fixture_shop import build_pair

NO_BROADCAST = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}
SPLIT_EVERYTHING = {
    **NO_BROADCAST,
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture(scope="module", params=[NO_BROADCAST, SPLIT_EVERYTHING], ids=["shuffled_joins", "skew_splits"])
def scale_shop(spark, request):
    shop, con, _ = build_pair(spark, 7, 600, 0.33)
    old = {k: spark.conf.get(k, None) for k in request.param}
    for k, v in request.param.items():
        spark.conf.set(k, v)
    yield shop, con
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.mark.parametrize("key", list(REPORTS))
def test_report_with_scale_plans(scale_shop, key):
    shop, con = scale_shop
    diff = compare(REPORTS[key](shop), con, over_given_tables(REPORT_SQL[key]))
    assert diff is None, diff
