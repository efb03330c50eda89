"""Label-setting path search over a graph that is cut into tiles.

The search serves nodes one by one, always the one with the smallest label, and fixes
its label for good.  In minimum-free-energy mode a longer path can have a smaller label,
so the *order* in which nodes are served decides the result and has to be reproduced.

What makes that possible in parallel: when node u is served before node v can be told
from their two paths alone.  Walk each path and note the labels met; dropping every
label that a later one exceeds leaves a falling list, and u is served first exactly if
its list is the lexicographically smaller one (``serve_key``).  So each tile can run the
search over its own nodes, taking the paths of the nodes around it as given, and tell
its neighbours about paths that changed.  Tiles repeat that while changes arrive.  By
induction on the serving order the paths settle, and when nothing changes they are the
ones the one-by-one search finds.

A tile holds a bounded number of nodes, whatever the size of the grid; a small grid is a
single tile and takes a single round.
"""

from __future__ import annotations

import heapq
from bisect import insort
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import GridSpec
from ..session import materialize
from .graph import MAX, MFEP, SUM, grid_edges, is_bipartite, spfa
from .histogram import Histogram
from .patches import Patch, apply_patches
from .relax import lowest_labels

# Nodes of one tile, that is, of one task's search.
TILE_NODES = 1 << 12

OUT_TYPE = "array<struct<dst:bigint,tile:bigint,weight:double>>"
STATE = f"tile long, node long, own boolean, out {OUT_TYPE}, path array<long>, weights array<double>, changed boolean"


@dataclass(frozen=True)
class SearchResult:
    """``path``: ord, node.  ``visited``: node.  ``nodes``: node, distance, path."""

    path: DataFrame
    visited: DataFrame
    nodes: DataFrame


# ---- labels -------------------------------------------------------------------------
class _Label:
    """How a label grows along an edge, and a plain value that sorts like it."""

    def __init__(self, mode: str):
        self.mode = mode
        self.zero = {SUM: 0.0, MAX: float("-inf"), MFEP: ()}[mode]

    def extend(self, label, weight: float):
        if self.mode == SUM:
            return label + weight
        if self.mode == MAX:
            return max(label, weight)
        grown = list(label)  # negated weights, ascending: the heaviest comes first
        insort(grown, -weight)
        return tuple(grown)

    def key(self, label):
        """In minimum-free-energy mode: runs (weight, how often), the last run endless."""
        if self.mode != MFEP:
            return label
        runs: list = []
        for w, same in groupby(label):
            runs += [-w, len(list(same))]
        if runs:
            runs[-1] = float("inf")
        return tuple(runs), len(label)


def _push(serve_key: tuple, entry: tuple) -> tuple:
    """Serve key of a path one node longer: drop what the new label exceeds."""
    n = len(serve_key)
    while n and serve_key[n - 1] < entry:
        n -= 1
    return serve_key[:n] + (entry,)


def _trace(rule: _Label, path, weights) -> tuple:
    """Label and serve key at the end of a path."""
    label, key = rule.zero, ()
    for node, w in zip(path[1:], weights):
        label = rule.extend(label, w)
        key = _push(key, (rule.key(label), node))
    return label, key


# ---- one tile -------------------------------------------------------------------------
def _serve(
    rule: _Label, own: dict, around: dict, start: int, limit: tuple | None = None, end: int | None = None
) -> dict:
    """Serve the nodes of one tile: node -> (path, weights).

    ``own``: node -> outgoing edges.  ``around``: node outside -> (path, weights, edges into
    the tile).  With ``limit`` only nodes served before that key are returned.  If ``end`` is
    given and no edge leaves the tile, nodes behind ``end`` are not served.
    """
    if end is not None and (start not in own or any(v not in own for out in own.values() for v, _ in out)):
        end = None
    heap, best, done = [], {}, {}
    for node, (path, weights, _) in around.items():
        label, key = _trace(rule, path, weights)
        best[node] = (label, rule.key(label), key, None, None, frozenset(path))
        heap.append((key, node))
    if start in own:
        best[start] = (rule.zero, rule.key(rule.zero), (), None, None, frozenset())
        heap.append(((), start))
    heapq.heapify(heap)
    while heap:
        key, u = heapq.heappop(heap)
        if u in done or best[u][2] != key:
            continue
        if limit is not None and key >= limit:
            break
        label, _, _, parent, last_weight, entered_by = best[u]
        done[u] = (parent, last_weight)
        if u == end:
            break
        for v, w in own[u] if u in own else around[u][2]:
            # nodes of the path by which the search came into the tile are behind us
            if v not in own or v in done or v in entered_by:
                continue
            new = rule.extend(label, w)
            new_key = rule.key(new)
            if v not in best or new_key < best[v][1]:
                best[v] = (new, new_key, _push(key, (new_key, v)), u, w, entered_by)
                heapq.heappush(heap, (best[v][2], v))
    out: dict = {}
    for v, (parent, w) in done.items():  # parents come before their children
        if v in around:
            out[v] = around[v][0], around[v][1]
        elif parent is None:
            out[v] = ([v], [])
        else:
            path, weights = out[parent]
            out[v] = ([*path, v], [*weights, w])
    return {v: p for v, p in out.items() if v in own}


def _split(pdf: pd.DataFrame):
    def edges(out):
        return [(e["dst"], e["weight"]) for e in out]

    own = pdf[pdf.own]
    halo = pdf[~pdf.own]
    inside = {n: edges(o) for n, o in zip(own.node, own.out)}
    around = {
        n: (list(p), list(w), edges(o))
        for n, p, w, o in zip(halo.node, halo.path, halo.weights, halo.out)
        if p is not None
    }
    return own, inside, around


def _tile_round(mode: str, start: int, end: int | None):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # of a node outside the tile the message just received replaces the older one
        halo = pdf[~pdf.own].sort_values("changed").drop_duplicates("node", keep="last")
        pdf = pd.concat([pdf[pdf.own], halo])
        own, inside, around = _split(pdf)
        found = _serve(_Label(mode), inside, around, start, end=end)
        old = {n: None if p is None else (list(p), list(w)) for n, p, w in zip(own.node, own.path, own.weights)}
        rows = pdf.copy()
        rows["changed"] = False
        paths, weights, changed = [], [], []
        for node, is_own, p, w in zip(rows.node, rows.own, rows.path, rows.weights):
            if is_own:
                changed.append(found.get(node) != old[node])
                p, w = found.get(node, (None, None))
            else:
                changed.append(False)
            paths.append(p)
            weights.append(w)
        rows["path"], rows["weights"], rows["changed"] = paths, weights, changed
        return rows

    return run


def _tile_visited(mode: str, start: int, end_path: list, end_weights: list):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rule = _Label(mode)
        _, inside, around = _split(pdf)
        limit = _trace(rule, end_path, end_weights)[1]
        return pd.DataFrame({"node": list(_serve(rule, inside, around, start, limit))}, dtype="int64")

    return run


# ---- rounds -----------------------------------------------------------------------------
def label_setting(
    graph: DataFrame,
    start: int,
    end: int,
    mode: str = MFEP,
    tile: int | None = None,
    tile_of: Column | None = None,
    to_end: bool = False,
) -> SearchResult:
    """Search from ``start``; paths to every reachable node, and the one to ``end``.

    ``graph``: ``src, dst, weight``.  Nodes are cut into tiles of ``tile`` consecutive
    numbers, or by ``tile_of``, an expression over the column ``node``.  With ``to_end`` the
    nodes that would be served after ``end`` may be missing.
    """
    node = F.col("node")
    tile_of = F.floor(node / F.lit(tile or TILE_NODES)).cast("long") if tile_of is None else tile_of
    spark = graph.sparkSession
    ends = graph.select("src", F.col("dst").alias("node"), "weight").withColumn("tile", tile_of)
    outs = ends.groupBy("src").agg(F.collect_list(F.struct(node.alias("dst"), "tile", "weight")).cast(OUT_TYPE).alias("out"))
    every = graph.select(F.col("dst").alias("node")).union(spark.range(1).select(F.lit(start).cast("long"))).distinct()
    nodes = outs.withColumnRenamed("src", "node").join(every, "node", "full_outer")
    state = materialize(
        nodes.select(
            tile_of.alias("tile"), "node", F.lit(True).alias("own"), F.coalesce("out", F.array().cast(OUT_TYPE)).alias("out"),
            F.lit(None).cast("array<long>").alias("path"), F.lit(None).cast("array<double>").alias("weights"),
            F.lit(False).alias("changed"),
        )
    )
    first = state.filter(node == F.lit(start)).select("tile").first()[0]
    messages = None
    while True:
        if messages is None:
            busy = state.filter(F.col("tile") == F.lit(first))
            idle = state.filter(F.col("tile") != F.lit(first))
        else:
            active = messages.select("tile").distinct()
            busy = state.join(active, "tile", "left_semi").unionByName(messages)
            idle = state.join(active, "tile", "left_anti")
        served = busy.groupBy("tile").applyInPandas(_tile_round(mode, start, end if to_end else None), STATE)
        state = materialize(idle.withColumn("changed", F.lit(False)).unionByName(served))
        moved = state.filter("own AND changed").withColumnRenamed("tile", "home")
        targets = F.array_distinct(F.transform("out", lambda e: e["tile"]))
        moved = moved.withColumn("tile", F.explode(targets)).filter(F.col("tile") != F.col("home"))
        messages = moved.withColumns({"own": F.lit(False), "out": F.expr("filter(out, e -> e.tile = tile)")}).drop("home")
        if messages.isEmpty():
            break

    own = state.filter("own AND path IS NOT NULL")
    if mode == SUM:
        distance = F.aggregate("weights", F.lit(0.0), lambda a, w: a + w)
    else:
        empty = F.lit(0.0 if mode == MFEP else float("-inf"))
        distance = F.coalesce(F.array_max("weights"), empty)
    result = own.select("node", distance.alias("distance"), "path")
    last = own.filter(node == F.lit(end)).select("path", "weights").first()
    path = result.filter(node == F.lit(end)).select(F.posexplode("path").alias("ord", "node"))
    if last is None:
        visited = result.select("node")
    else:
        near = _tile_visited(mode, start, list(last.path), list(last.weights))
        visited = state.groupBy("tile").applyInPandas(near, "node long")
    return SearchResult(path, visited, result)


# ---- on grids -----------------------------------------------------------------------------
def _grid_tile(spec: GridSpec, node: Column, tile_nodes: int) -> Column:
    """Number of the box of bins a bin belongs to; a box has at most ``tile_nodes`` bins."""
    side = max(1, int(round(tile_nodes ** (1.0 / spec.ndim), 6)))
    tile, scale = F.lit(0).cast("long"), 1
    for axis, i in zip(spec.axes, spec.index_of_address(node)):
        tile = tile + F.floor(i / F.lit(side)).cast("long") * F.lit(scale)
        scale *= -(-axis.bins // side)
    return tile


@dataclass(frozen=True)
class PathResult:
    """``path``: ord, addr, s, x0.., value.  ``visited``: addr, x0.."""

    grid: Histogram
    path: DataFrame
    visited: DataFrame
    distances: DataFrame


def find_distances(pmf: Histogram, start: list[float], mode: str, patches: list[Patch] = (), delta: float | None = None) -> DataFrame:
    """addr, distance of every bin from a position: smallest sums (``sum``) or lowest barriers (``max``)."""
    a = pmf.spec.address_value(list(start)) if len(start) == pmf.spec.ndim else None
    if a is None:
        raise ValueError("the start must lie on the grid")
    edges = grid_edges(apply_patches(pmf, list(patches)))
    return lowest_labels(edges, a, mode, delta=delta).withColumnRenamed("node", "addr")


def find_path(
    pmf: Histogram,
    start: list[float],
    end: list[float],
    patches: list[Patch] = (),
    algorithm: str = "dijkstra",
    mode: str = MFEP,
    tile_nodes: int = TILE_NODES,
) -> PathResult:
    """Path between two positions of a (patched) grid.

    In minimum-free-energy mode ``distances`` has the bins served before the end, and the end.

    ``algorithm`` is ``"dijkstra"`` (label setting) or ``"spfa"`` (queue based); in
    minimum-free-energy mode the two can find different paths.
    """
    spec = pmf.spec
    if len(start) != spec.ndim or len(end) != spec.ndim:
        raise ValueError(f"start and end need {spec.ndim} coordinates")
    a, b = spec.address_value(list(start)), spec.address_value(list(end))
    if a is None or b is None:
        raise ValueError("start and end must lie on the grid")
    patched = apply_patches(pmf, list(patches))
    grid = Histogram(spec, materialize(patched.df), patched.values)
    edges = grid_edges(grid)
    if algorithm == "dijkstra":
        tiles = _grid_tile(spec, F.col("node"), tile_nodes)
        if mode == MFEP:
            # No bin beyond the barrier between the two ends is served before the search
            # arrives.  Finding the barrier first is the cheaper search of the two.
            cheap = lowest_labels(edges, a, MAX)
            barrier = cheap.filter(F.col("node") == F.lit(b)).select("distance").first()
            edges = edges.filter(F.col("weight") <= F.lit(barrier[0])) if barrier else edges
        r = label_setting(edges, a, b, mode, tile_of=tiles, to_end=mode == MFEP)
        nodes, visited, distances = r.path, r.visited, r.nodes.select("node", "distance")
        if mode == MFEP:
            served = visited.union(distances.filter(F.col("node") == F.lit(b)).select("node")).distinct()
            distances = distances.join(served, "node", "left_semi")
    elif algorithm == "spfa":
        found = spfa(edges, a, mode, bipartite=is_bipartite(spec))
        nodes = found.filter(F.col("node") == F.lit(b)).select(F.posexplode("path").alias("ord", "node"))
        visited, distances = found.select("node"), found.select("node", "distance")
    else:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    steps = nodes.withColumnRenamed("node", "addr").join(grid.df, "addr", "left")
    length = nodes.agg(F.max("ord")).scalar()
    steps = steps.withColumn("s", F.when(length > 0, F.col("ord") / length).otherwise(F.lit(0.0)))
    path = spec.with_coords(steps).select("ord", "addr", "s", *spec.coord_names, "value")
    seen = spec.with_coords(visited.withColumnRenamed("node", "addr")).select("addr", *spec.coord_names)
    return PathResult(grid, path, seen, distances.withColumnRenamed("node", "addr"))
