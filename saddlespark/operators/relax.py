"""Smallest sums and lowest barriers of a graph by bucketed relaxation.

The state has one row of fixed width per node that was reached: node, distance, hops,
fresh.  Fresh nodes have a distance they have not passed on yet.  A round takes the fresh
nodes within ``delta`` of the least fresh distance and passes their distances along their
edges; only these nodes are joined with the edges.  Offers to a node, and what it had, are
reduced by an aggregation, so a hub is never gathered.  A larger bucket means fewer rounds
and more distances that are improved twice; the result does not depend on it.

With ``parents`` the distances are settled together with the number of hops, and every node
gets a parent that explains both: parents form a tree even where edges weigh nothing.
``trace`` follows them to the start by pointer doubling, in as many joins as the length of
the path has bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .graph import MAX, SUM

BUCKETS = 4  # of a barrier search: buckets that the range of weights is cut into
EDGES_AHEAD = 16  # of a sum: edges of mean weight that a bucket spans


def _label(mode: str, distance: Column, weight: Column) -> Column:
    return distance + weight if mode == SUM else F.greatest(distance, weight)


def bucket_width(graph: DataFrame, mode: str) -> float:
    """A width from the weights of the graph."""
    low, high, mean = graph.agg(F.min("weight"), F.max("weight"), F.avg("weight")).first()
    if low is None:
        return math.inf
    if mode == SUM:
        if low < 0:
            raise ValueError("sums along edges of negative weight have no smallest value")
        return EDGES_AHEAD * mean or math.inf
    return (high - low) / BUCKETS or math.inf


def lowest_labels(graph: DataFrame, start: int, mode: str, parents: bool = False, delta: float | None = None) -> DataFrame:
    """node, distance and, if asked, hops and parent of every node in reach of ``start``.

    ``graph``: ``src, dst, weight``.  ``mode`` is the smallest sum or the lowest maximum of
    weights; the start has distance 0 or minus infinity.  In sum mode weights are not negative.
    """
    if mode not in (SUM, MAX):
        raise ValueError(f"unknown mode {mode!r}")
    spark = graph.sparkSession
    edges = materialize(graph.select("src", "dst", "weight"))
    width = bucket_width(edges, mode) if delta is None else delta
    zero = 0.0 if mode == SUM else float("-inf")
    state = spark.range(1).select(F.lit(start).cast("long").alias("node"), F.lit(zero).alias("distance"), F.lit(0).alias("hops"), F.lit(True).alias("fresh"))
    state = materialize(state)
    while True:
        least = state.filter("fresh").agg(F.min("distance")).first()[0]
        if least is None:
            break
        limit = F.lit(least + width if width < math.inf else math.inf)
        now = state.filter(F.col("fresh") & (F.col("distance") <= limit))
        found = state.withColumn("fresh", F.col("fresh") & (F.col("distance") > limit))
        sent = now.join(edges, F.col("node") == F.col("src"))
        hops = F.col("hops") + 1 if parents else F.lit(0)
        offer = F.struct(_label(mode, F.col("distance"), F.col("weight")).alias("distance"), hops.alias("hops"))
        best = sent.select(F.col("dst").alias("node"), offer.alias("o")).groupBy("node").agg(F.min("o").alias("o"))
        found = found.unionByName(best.select("node", "o.*", F.lit(True).alias("fresh")))
        # of equal rows the one that was passed on (not fresh) is the lesser, so nothing is passed on twice
        m = F.min(F.struct("distance", "hops", "fresh")).alias("m")
        state = materialize(found.groupBy("node").agg(m).select("node", "m.*"))
    if not parents:
        return state.select("node", "distance")
    near = state.select(F.col("node").alias("src"), F.col("distance").alias("d"), F.col("hops").alias("h")).join(edges, "src")
    near = near.join(state, F.col("dst") == F.col("node"))
    tight = near.filter((_label(mode, F.col("d"), F.col("weight")) == F.col("distance")) & (F.col("h") + 1 == F.col("hops")))
    parent = tight.groupBy("node").agg(F.min("src").alias("parent"))
    return state.select("node", "distance", "hops").join(parent, "node", "left")


def trace(nodes: DataFrame, end: int) -> DataFrame:
    """ord, node of the path to ``end`` along ``parent``; no rows if ``end`` was not reached."""
    nodes = materialize(nodes.select("node", "parent", "hops"))
    last = nodes.filter(F.col("node") == end).select("hops").first()
    if last is None:
        return nodes.filter("false").select(F.col("hops").cast("long").alias("ord"), "node")
    jumps = [nodes.filter("parent IS NOT NULL").select("node", F.col("parent").alias("to"))]
    while 1 << len(jumps) <= last.hops:
        one = jumps[-1]
        far = one.join(one.select(F.col("node").alias("to"), F.col("to").alias("far")), "to")
        jumps.append(materialize(far.select("node", F.col("far").alias("to"))))
    path = nodes.sparkSession.range(1).select(F.lit(end).cast("long").alias("node"))
    for jump in reversed(jumps):
        path = materialize(path.union(path.join(jump, "node").select("to")).distinct())
    return path.join(nodes, "node").select(F.col("hops").cast("long").alias("ord"), "node")
