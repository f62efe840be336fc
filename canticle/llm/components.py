"""Connected components of a link table by alternating star contraction.

Each round points larger nodes at the smallest neighbour (large star), then gathers smaller neighbours under the
smallest (small star). Rounds grow with the logarithm of a component's diameter. Each round's links are a
written table, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canticle.plans.cut import written


def stars(links: DataFrame) -> DataFrame:
    """(a, b) with b the smallest node of a's component, for every a of a link but the smallest."""
    edges = written(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not state[0] or state == before:
            return edges
        before = state
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        under = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(under, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.union(under.select("a", F.col("m").alias("b"))).distinct(), "links")


def smallest_reachable(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fp, component_id) for every row of ``nodes`` (fp, lo): the smallest ``lo`` of its component."""
    star = stars(links)
    members = star.select(F.col("a").alias("fp"), F.col("b").alias("root")).union(star.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct())
    lows = members.join(nodes, "fp").groupBy("root").agg(F.min("lo").alias("low"))
    joined = written(members.join(lows, "root").select("fp", "low"), "members")
    return written(nodes.join(joined, "fp", "left").select("fp", F.coalesce("low", "lo").alias("component_id")), "components")
