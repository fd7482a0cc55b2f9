"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm import common


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b of one ordered type. Returns node, root (the smallest node that it reaches) for every node of an edge.

    Large-star and small-star in turns: every round hangs nodes onto smaller neighbours and keeps connectivity, until all are stars.
    Rounds grow with the logarithm of the longest path. Each round is staged; nothing but two sums comes to the driver. A hub, such as the root of
    a giant component, owns many edges: what is known of it is broadcast to them (at most 1000 hubs) instead of bringing them together.
    Edges from a node to itself count for nothing; nulls and no edges at all give no rows.
    """
    now = common.stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, rows = None, 2 * now.count()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.stage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")))
        large = common.stage(common.attach(both, least, "u", "n", rows, staged=True).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = common.stage(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        hung = common.attach(large, small, "u", "n", rows, staged=True).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = common.stage(small.select("u", F.col("m").alias("v")).unionByName(hung).distinct())
        total = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for done in (least, large, small, now):
            common.release(done)
        now, rows = after, 2 * total[0]
        if tuple(total) == before or not total[0]:
            break
        before = tuple(total)
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
