"""Bucketed relaxation against serving nodes one by one."""

import math
import random

import pytest
from pyspark.sql import functions as F

from brute import dijkstra
from saddlespark.operators.relax import lowest_labels, trace


def some_graph(seed):
    rnd = random.Random(seed)
    n = 25
    edges = {(rnd.randrange(n), rnd.randrange(n)): float(rnd.choice([0, 0, 1, 2, 5, 9])) for _ in range(60)}
    edges |= {(7, k): 3.0 for k in range(n)}  # a hub
    return [(s, d, w) for (s, d), w in edges.items() if s != d], n


@pytest.mark.parametrize("mode, delta", [("sum", 4.0), ("max", None)])
def test_distances_and_trees(spark, mode, delta):
    edges, n = some_graph(len(mode))
    adj = {k: [(d, w) for s, d, w in edges if s == k] for k in range(n)}
    want = dijkstra(adj, 0, mode)
    weight = {(s, d): w for s, d, w in edges}
    join = (lambda ws: sum(ws)) if mode == "sum" else (lambda ws: max(ws, default=-math.inf))
    lengths = {k: join([weight[e] for e in zip(v[0], v[0][1:])]) for k, v in want.items()}
    graph = spark.createDataFrame(edges, "src long, dst long, weight double")
    nodes = lowest_labels(graph, 0, mode, parents=True, delta=delta)
    got = {r.node: r for r in nodes.collect()}
    assert {k: r.distance for k, r in got.items()} == lengths
    assert {r.node: r.distance for r in lowest_labels(graph, 0, mode, delta=delta).collect()} == lengths
    for end in (max(got, key=lambda k: got[k].hops), 0):
        path = [r.node for r in trace(nodes, end).orderBy("ord").collect()]
        assert path[0] == 0 and path[-1] == end and len(path) == got[end].hops + 1 == len(set(path))
        assert join([weight[e] for e in zip(path, path[1:])]) == lengths[end]
    assert trace(nodes, 999).count() == 0


def test_lone_start_and_negative_sums(spark):
    graph = spark.createDataFrame([(1, 2, -1.0)], "src long, dst long, weight double")
    assert [tuple(r) for r in lowest_labels(graph, 2, "max").collect()] == [(2, -math.inf)]
    assert [tuple(r) for r in lowest_labels(graph.filter("src > 5"), 3, "sum").collect()] == [(3, 0.0)]
    with pytest.raises(ValueError, match="negative"):
        lowest_labels(graph, 1, "sum")


def test_chain_longer_than_many_buckets(spark):
    graph = spark.range(30).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(2.0).alias("weight"))
    got = lowest_labels(graph, 0, "sum", delta=10.0).orderBy("node").collect()
    assert [r.distance for r in got] == [2.0 * k for k in range(31)]
