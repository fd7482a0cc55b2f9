"""Strongly connected components of graphs that are too large for one task: which nodes are on cycles, and on the same ones.

1. What cannot be on a cycle goes: nodes without a way in or without a way out.
2. Chains of nodes with one way in and one way out become one edge each, by pointer jumping: what a node points to doubles its distance every round, so a chain of n nodes takes log2(n) rounds.
   What points round and round is a cycle of its own.
3. When neither finds more, the rest is coloured: every node takes the smallest node that reaches it, and of the nodes of one colour those are a component that reach the node of that name. Edges between colours
   go, and it begins again. This takes as many rounds as ways between the nodes that are left are long, which chains no longer lengthen.
4. The nodes of a chain belong to the component of its two ends, if that is the same one.

Every step is a join or an aggregation by node, written and read again; nothing but counts comes to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.staging import staged


def strong_components(edges: DataFrame) -> DataFrame:
    """edges: key, a, b. key, node and component (the smallest node of it) of every node on a cycle of its key's graph; a node that leads to itself is one.

    Defined results: edges with a null node lead nowhere, repeated ones count once, a null key is a key like any other. Nodes that only lead to a cycle or come from one are not on it.
    """
    end = lambda c: F.struct(F.col("key").alias("key"), F.col(c).alias("node"))
    given = staged(edges.where("a IS NOT NULL AND b IS NOT NULL").select(end("a").alias("p"), end("b").alias("q")).distinct())
    names = staged(given.select("p").unionByName(given.select(F.col("q").alias("p"))).distinct().withColumn("x", F.monotonically_increasing_id()))  # numbers join faster than names
    whole = staged(given.join(names, "p").join(names.toDF("q", "y"), "q").select("x", "y"))
    loops, found, chains = [whole.where("x = y").select("x")], [], []
    left = whole.where("x <> y")
    before = None
    while True:
        left = staged(_trimmed(left))
        if left.isEmpty():
            break
        left, looped, rings, chain = _contracted(left)
        loops.append(looped)
        found.append(rings)
        chains.append(chain)
        left = staged(left)
        now = left.count()
        if now == before:
            found.append(_coloured(left))
            break
        before = now
    none = whole.select("x", F.col("x").alias("c")).limit(0)
    grouped = staged(reduce(DataFrame.unionByName, found, none))
    for looped, chain in reversed(list(zip(loops[1:], chains, strict=True))):  # a node that leads to itself here may have been inside a chain later
        grouped = staged(grouped.unionByName(_alone(looped, grouped)))
        ends = chain.join(grouped.toDF("start", "c"), "start").join(grouped.toDF("stop", "d"), "stop").where("c = d")
        grouped = staged(grouped.unionByName(ends.select("x", "c")))
    grouped = grouped.unionByName(_alone(loops[0], grouped))
    named = grouped.join(names, "x").select("p", "c")
    least = named.groupBy("c").agg(F.min("p").alias("least"))
    return named.join(least, "c").select("p.key", "p.node", F.col("least.node").alias("component"))


def _alone(looped: DataFrame, grouped: DataFrame) -> DataFrame:
    """Nodes that lead to themselves and are in no component yet are one each."""
    return looped.distinct().join(grouped, "x", "left_anti").withColumn("c", F.col("x"))


def _trimmed(left: DataFrame) -> DataFrame:
    """Without the edges that come from a node without a way in, or lead to one without a way out."""
    return left.join(left.select(F.col("y").alias("x")).distinct(), "x", "left_semi").join(left.select(F.col("x").alias("y")).distinct(), "y", "left_semi").select("x", "y")


def _contracted(left: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """left, without loops. Edges with chains as one each; nodes x that lead to themselves now; components (x, c) that were rings of single ways; and the nodes of chains: x, start, stop."""
    ins, outs = (left.groupBy(F.col(side).alias("x")).agg(F.count("*").alias("n"), F.first(other).alias(name)).where("n = 1").drop("n") for side, other, name in (("y", "x", "back"), ("x", "y", "on")))
    single = staged(ins.join(outs, "x").withColumn("m", F.col("x")))
    waiting = None
    while True:
        ahead = single.select(F.col("x").alias("on"), F.col("on").alias("on2"), F.col("m").alias("m2"))
        behind = single.select(F.col("x").alias("back"), F.col("back").alias("back2"))
        both = single.join(ahead, "on", "left").join(behind, "back", "left")
        single = staged(both.select("x", F.coalesce("on2", "on").alias("on"), F.coalesce("back2", "back").alias("back"), F.least("m", "m2").alias("m"), F.col("on2").isNotNull().alias("goes_on")))
        state = single.where("goes_on").agg(F.count("*"), F.sum(F.xxhash64("x", "m").cast("decimal(38,0)"))).first()
        if tuple(state) == waiting or not state[0]:
            break
        waiting = tuple(state)
    rings = single.where("goes_on").select("x", F.col("m").alias("c"))  # still on the way: there is no end
    chain = single.where("NOT goes_on").select("x", F.col("back").alias("start"), F.col("on").alias("stop"))
    inner = single.select("x")
    rest = left.join(inner, "x", "left_anti").join(inner.toDF("y"), "y", "left_anti").select("x", "y")
    short = chain.select(F.col("start").alias("x"), F.col("stop").alias("y")).distinct()
    return rest.unionByName(short.where("x <> y")).distinct(), short.where("x = y").select("x"), rings, chain


def _coloured(left: DataFrame) -> DataFrame:
    """left, without loops, staged. Components (x, c) of two nodes or more."""
    found = []
    while not left.isEmpty():
        nodes = staged(left.select("x").unionByName(left.select(F.col("y").alias("x"))).distinct().withColumn("c", F.col("x")))
        changed = True
        while changed:
            reached = left.join(nodes, "x").groupBy(F.col("y").alias("x")).agg(F.min("c").alias("by"))
            next_ = staged(nodes.join(reached, "x", "left").select("x", F.least("c", "by").alias("c"), (F.col("by") < F.col("c")).alias("new")))
            changed = not next_.where("new").isEmpty()
            nodes = next_.drop("new")
        inside = staged(left.join(nodes, "x").join(nodes.toDF("y", "d"), "y").where("c = d").select("x", "y", "c"))
        home, size = staged(nodes.where("x = c")), 0
        while (now := home.count()) != size:
            size = now
            home = staged(home.unionByName(inside.join(home.select(F.col("x").alias("y")), "y", "left_semi").select("x", "c")).distinct())
        found.append(home.join(home.groupBy("c").count().where("count > 1"), "c", "left_semi").select("x", "c"))
        left = staged(_trimmed(inside.select("x", "y").join(home.select("x"), "x", "left_anti").join(home.select(F.col("x").alias("y")), "y", "left_anti")))
    return reduce(DataFrame.unionByName, found)
