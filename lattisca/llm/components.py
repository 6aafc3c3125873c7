"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattisca.llm.common import spool


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges (u, v; bigint), root being the smallest node of its component.

    Alternates large-star and small-star steps until the edges stand still: each round is two aggregations and two joins,
    the number of edges never grows, and rounds grow with the logarithm of the nodes. Each round is written to the
    shared folder, so a lost executor costs one round at most; the driver sees a count and a checksum. Self-loops and
    repeated edges are harmless; an empty table gives an empty one; null ends are left out.
    """
    at = spool(edges.filter("u IS NOT NULL AND v IS NOT NULL AND u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    nodes = at.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    seen = None
    for _ in range(rounds):
        now = at.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen or not now[0]:
            break
        seen = tuple(now)
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        at = spool(small.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = at.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.join(roots, nodes.node == roots.u, "left").select("node", F.coalesce("root", "node").alias("root"))
