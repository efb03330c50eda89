"""Connected components by alternating stars.

Every round moves edges towards the smallest node in reach: the large star links each node's
larger neighbours to its smallest one, the small star does the same below it.  Rounds grow
with the logarithm of the longest chain.  A hub's edges are joined with one row per node and
never gathered, so adaptive execution can split them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, stored


def _smallest(edges: DataFrame) -> DataFrame:
    """edges (u, v) with the smallest v of each u, or u itself, as m."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("m", "u").alias("m"))
    return edges.join(low, F.col("u") == F.col("_u")).drop("_u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _smallest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    found = _smallest(edges)
    near = found.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(found.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for every node with an edge but the roots.

    ``edges`` has two columns of whole numbers.
    """
    a, b = edges.columns
    down = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()

    def kept(df: DataFrame) -> tuple[DataFrame, dict]:
        # counted while it is written
        seen = Observation()
        return stored(df.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("mark"))), seen.get

    down, old = kept(down)
    while old["n"]:
        last = down
        down, new = kept(_small_star(_large_star(last)))
        discard(last)
        if new == old:
            break
        old = new
    return down.select(F.col("u").alias("node"), F.col("v").alias("root"))


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``roots`` (node, root) when ``links`` (a, b) connect some of them; stored."""
    for x in "ab":
        links = links.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"_{x}")), x, "left")
    over = components(links.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))
    top = over.select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = roots.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return stored(moved.union(over))
