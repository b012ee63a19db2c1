"""Connected components of links by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import discard, saved


def components(links: DataFrame) -> DataFrame:
    """node, component (its least reachable node) of every node in links (a, b).

    In each round a node goes into the first of itself and its neighbours, by
    degree and then by a hash that differs from round to round.  Links are then
    rewritten between what is left, and loops fall out.  A star ends in one round,
    and of a chain, in whatever order its nodes come, about half is left.  So rounds
    grow with the logarithm of a component's size, and there is no cap on them.  At
    the end the steps of the rounds are joined from the last to the first.

    A hub's links are summed up before they meet, and both sides of each join are
    plain exchanges, which Spark can split.  A node linked with itself alone is a
    component; links with a null are left out.
    """
    links = links.where("a is not null and b is not null").select("a", "b")
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    edges, steps = saved(links.unionByName(turned).where("a <> b").distinct(), "edges"), []
    while not edges.isEmpty():
        rank = lambda n, c, k=len(steps): F.struct((-n).alias("n"), F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("v"))
        degree = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        near = edges.join(degree.select(F.col("a").alias("b"), F.col("n").alias("m")), "b").groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min(rank(F.col("m"), "b")).alias("near"))
        step = saved(near.select(F.col("a").alias("node"), F.least(rank(F.col("n"), "a"), "near").getField("v").alias("into")), "steps")
        steps.append(step)
        left, right = (step.select(F.col("node").alias(c), F.col("into").alias(f"{c}_into")) for c in "ab")
        moved = edges.join(left, "a").join(right, "b").where("a_into <> b_into")
        rest = saved(moved.select(F.col("a_into").alias("a"), F.col("b_into").alias("b")).distinct(), "edges")
        discard(edges)
        edges = rest
    loops = links.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("into")).distinct()
    if not steps:
        return loops.select("node", F.col("into").alias("component"))
    found = steps[-1]
    for step in reversed(steps[:-1]):
        end = found.select(F.col("node").alias("into"), F.col("into").alias("end"))
        after = saved(step.join(end, "into", "left").select("node", F.coalesce("end", "into").alias("into")), "steps")
        discard(step, found)
        found = after
    least = found.groupBy("into").agg(F.min("node").alias("component"))
    return found.join(least, "into").select("node", "component").unionByName(loops.join(found, "node", "left_anti").withColumnRenamed("into", "component"))
