"""Walking the graph a bounded number of steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.shared import staged

MAX_DEPTH = 5


def k_hop(edges: DataFrame, starts: DataFrame, depth: int, reverse: bool = True, tasks: int | None = None) -> DataFrame:
    """(start, node, distance), distinct, for trails of 1 to ``depth`` edges that
    end (reverse) or begin (forward) at a start id.  No trail repeats an edge.

    First plain steps, one row a node and round, find the edges within reach;
    they are written, and all else runs over them.  An edge can only be repeated
    if it lies on a cycle, so not if nothing leads to it or on from it within
    reach; two rounds of peeling leave those that may, and only these are kept by a
    hash along a trail, so trails that differ in others are one row.  All edges are
    dealt by the end they are met at, to ``tasks`` parts if given.
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth is 1 to {MAX_DEPTH}")
    near, far = ("dst", "src") if reverse else ("src", "dst")
    every = edges.select(F.col(near).alias("node"), F.col(far).alias("next"))
    every = (every if tasks is None else every.repartition(tasks, "node")).distinct()
    if depth == 1:
        return starts.select(F.col("id").alias("start"), F.col("id").alias("node")).join(every, "node").select("start", F.col("next").alias("node"), F.lit(1).alias("distance")).distinct()
    front, seen = starts.select(F.col("id").alias("node")).distinct(), []
    for _ in range(depth - 1):
        seen.append(front)
        front = front.join(every, "node").select(F.col("next").alias("node")).distinct()
    met = reduce(DataFrame.unionByName, [*seen, front]).distinct()
    reach = staged(every.join(met, "node", "left_semi"), "reach")
    cyclic = reach
    for _ in range(2):
        cyclic = cyclic.join(cyclic.select(F.col("next").alias("node")).distinct(), "node", "left_semi").select("node", "next")
        cyclic = cyclic.join(cyclic.select(F.col("node").alias("next")).distinct(), "next", "left_semi").select("node", "next")
    steps = staged(reach.join(cyclic.withColumn("edge", F.xxhash64("node", "next")), ["node", "next"], "left"), "steps")
    trail = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array().cast("array<bigint>").alias("used")).distinct()
    out = []
    for distance in range(1, depth + 1):
        trail = trail.join(steps, "node").where(F.col("edge").isNull() | ~F.array_contains("used", F.col("edge")))
        used = F.when(F.col("edge").isNull(), F.col("used")).otherwise(F.array_sort(F.concat("used", F.array("edge"))))
        trail = trail.select("start", F.col("next").alias("node"), used.alias("used")).distinct()
        out.append(trail.select("start", "node", F.lit(distance).alias("distance")))
    return reduce(DataFrame.unionByName, out).distinct()


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node): everything reachable over one or more edges, to a fixpoint;
    each round is a written table."""
    steps = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    new = starts.select(F.col("id").alias("start"), F.col("id").alias("node")).distinct()
    seen = None
    while True:
        reached = new.join(steps, "node").select("start", F.col("next").alias("node")).distinct()
        new = staged(reached if seen is None else reached.join(seen, ["start", "node"], "left_anti"), "closure")
        if new.isEmpty():
            return seen if seen is not None else new
        seen = new if seen is None else seen.unionByName(new)


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge leads to."""
    return nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti")
