import random

import pytest
from pyspark.sql import functions as F

from cartwheel.llm.common import staged
from cartwheel.llm.components import _large_star, _small_star, connected_components


def plain(links):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in parent}


def test_chain_star_and_random(spark):
    rnd = random.Random(2)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    loose = [(rnd.randrange(5000, 5400), rnd.randrange(5000, 5400)) for _ in range(250)]
    links = [x if rnd.random() < 0.5 else x[::-1] for x in chain + star + loose] + [(None, 3), (77777, 77777)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = plain([x for x in links if None not in x and x[0] != x[1]])
    assert got == expected


def test_none(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


SPLIT_LARGE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.mark.parametrize("hub, step", [(0, _large_star), (10**6, _small_star)])
def test_a_hub_is_split(spark, hub, step):
    old = {k: spark.conf.get(k, None) for k in SPLIT_LARGE}
    for k, v in SPLIT_LARGE.items():
        spark.conf.set(k, v)
    try:
        star = spark.range(1, 60_001).select(F.greatest("id", F.lit(hub)).alias("u"), F.least("id", F.lit(hub)).alias("v"))
        loose = spark.range(2 * 10**6, 2 * 10**6 + 3000, 2).select((F.col("id") + 1).alias("u"), F.col("id").alias("v"))
        df = step(staged(star.union(loose).repartition(8)))
        assert df.filter(f"v = {min(hub, 1)}").count() >= 59_999
        df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
