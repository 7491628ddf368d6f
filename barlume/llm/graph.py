"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlume.llm.common import Scratch


def connected_components(links: DataFrame, scratch: Scratch, name: str, most: int = 60) -> DataFrame:
    """(node, root) of every node with a link; root is the smallest node that it reaches.

    ``links`` has columns a and b. Each round ties the neighbours of a node to
    the smallest of them, first the larger ones, then the smaller ones; the
    number of rounds grows with the logarithm of a chain's length. The smallest
    neighbour comes from an aggregate that is combined before the shuffle, and is
    joined back, so the many links of a hub needn't stand in one task. Rounds are
    written to the shared folder, so a lost executor costs one round at most.

    Edge cases: repeated links, links of a node with itself and links in both
    directions count once or not at all; rows with a null in a or b tie nothing;
    without links the result is empty.
    """
    edges = scratch.put(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{name}0")
    before = None
    for k in range(1, most):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join has plain shuffles on both sides: those are what a hub's rows can be split over
        least = scratch.put(both.groupBy("u").agg(F.min("v").alias("m")), f"{name}least{k}")
        # each larger neighbour u of v goes to the smallest of v and its neighbours
        large = edges.join(least.select(F.col("u").alias("v"), "m"), "v").select("u", F.least("v", "m").alias("v"))
        large = large.distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = scratch.put(small.filter("u <> v").distinct(), f"{name}{k}")
        scratch.drop(f"{name}{k - 1}", f"{name}least{k}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {most} rounds")
