"""Connected components of a link table, by alternating large-star and small-star joins.

Every round is two grouped minima joined back to the links; nothing but
one row count and checksum per round reaches the driver. Vertices are
longs; a hub with very many links is only a skewed join key, never one
task's list. The minima are staged, so both sides of the joins come from
plain shuffles and Spark can split the hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.llm.common import staged


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) longs in any order -> (node, root): root is the least node reachable.

    Nodes without a link to another node do not occur. Null ends are ignored.
    """
    edges = staged(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state = now
        edges = staged(_small_star(staged(_large_star(edges))))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).union(edges.select("u", "v"))
    least = staged(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m")))
    return edges.join(least, edges["v"] == least["x"]).select("u", F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = staged(edges.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")))
    moved = edges.join(least, edges["u"] == least["x"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = least.select(F.col("x").alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").union(kept).distinct()
