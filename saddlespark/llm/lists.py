"""Pairs of members that share a list and lie in different components, without forming all pairs.

Lists whose members are all connected already are left out.  The members of the others are
ordered by component and cut into blocks; every two blocks of a list meet in one place, unless
both lie in the same component.  So a long list, and a group of copies in it, is spread over
many places, and none holds more than two blocks.

Where a second, dear test is given it settles the pairs on the spot.  Members that links found
by the same task connect are not held against each other any more, also not in further lists, so
what is handed on is at most a link for each member and task, however many pairs there are.

Lists ordered by size form only pairs of like sizes; pairs that the cheap tests leave wait over
many lists until they are worth settling together.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

BLOCK = 512
PAIRS_HELD = 1 << 18  # that a task hands on at once
LINKS_HELD = 1 << 18  # that a task remembers
LOOK_AGAIN = 16  # steps after which members that links have connected meanwhile are left out
SIZED = 2  # as long are blocks that are ordered by size
SLACK = 1e-6  # of sizes, for rounding
PENDING = 1 << 12  # pairs that are settled at once
TEXT_HELD = 1 << 23  # characters of pairs that wait

Test = Callable[[np.ndarray, np.ndarray], np.ndarray]
Settle = Callable[[int, int], bool]


def pairs_across(
    lists: DataFrame,
    roots: DataFrame,
    about: Callable[[DataFrame], DataFrame],
    test: Callable[[pd.DataFrame], Test],
    settle: Callable[[pd.DataFrame], Settle] | None = None,
    held: int | None = None,
) -> DataFrame:
    """(a, b) with a < b for members (key, sid) of ``lists`` that pass the test.

    ``roots`` (node, root) has the components; members without a row are alone.  ``about`` gives
    further columns for a table of sids, and ``test`` makes from rows with these a function of
    two arrays of row numbers.  ``settle`` makes one of two row numbers; with it the result is
    not all pairs, but enough of those that pass both to connect what they connect.  With
    ``held``, members have a ``size``, and the sizes of a block add up to so much, or to less than
    that before its last member; else a block has ``BLOCK`` members.
    """
    root = roots.select(F.col("node").alias("sid"), "root")
    rows = lists.select("key", "sid", *["size"] * (held is not None)).join(root, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    mixed = rows.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a <> _b").select("key")
    rows = rows.join(mixed, "key")
    order = W.partitionBy("key").orderBy("root", "sid")
    if held is None:
        block = F.floor((F.row_number().over(order) - 1) / F.lit(BLOCK))
    else:
        block = F.floor((F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")) / F.lit(held))
    rows = stored(rows.withColumn("block", block.cast("int")).select("key", "sid", "root", "block"))
    blocks = rows.groupBy("key", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    other = blocks.select("key", F.col("block").alias("block2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    meet = blocks.join(other, "key").filter("block <= block2 AND NOT (lo = hi AND lo2 = hi2 AND lo = lo2)")
    meet = meet.select("key", F.col("block").alias("i"), F.col("block2").alias("j"))
    sides = meet.select("key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    full = rows.join(sides, ["key", "block"]).join(about(rows.select("sid").distinct()), "sid")
    full = full.repartition(F.col("key"), F.col("i"), F.col("j")).sortWithinPartitions("key", "i", "j", "block", "root", "sid")
    return _grouped(full, lambda part, starts, links: _inside(part, starts, test, settle, links), _Links if settle else None)


def alike_across(
    lists: DataFrame,
    roots: DataFrame,
    about: Callable[[DataFrame], DataFrame],
    ratio: float,
    test: Callable[[pd.DataFrame], Test],
    near: Callable[[pd.DataFrame], Test],
    settle: Callable[[list[str], list[str]], np.ndarray],
) -> DataFrame:
    """Enough of the pairs (a, b), a < b, to connect what all pairs connect that are in different components and pass the tests.

    Members (key, sid, size) are ordered by size, and only pairs whose smaller size is at least ``ratio`` of the
    larger are formed: blocks whose sizes rule that out do not meet.  The first test gets row numbers as arrays
    or slices, the second arrays; ``settle`` gets the texts (``told``) of many pairs at once.
    """
    root = roots.select(F.col("node").alias("sid"), "root")
    rows = lists.join(root, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    mixed = rows.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a <> _b").select("key")
    order = W.partitionBy("key").orderBy("size", "sid")
    block = F.floor((F.row_number().over(order) - 1) / F.lit(SIZED * BLOCK)).cast("int")
    rows = stored(rows.join(mixed, "key").withColumn("block", block).select("key", "sid", "root", "size", "block"))
    blocks = rows.groupBy("key", "block").agg(*[f("root").alias(x) for f, x in ((F.min, "lo"), (F.max, "hi"))], F.min("size").alias("least"), F.max("size").alias("most"))
    other = blocks.select("key", F.col("block").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("least").alias("next"))
    meet = blocks.withColumnRenamed("block", "i").join(other, "key").filter("i <= j AND NOT (lo = hi AND lo2 = hi2 AND lo = lo2)")
    meet = meet.filter((F.col("i") == F.col("j")) | (F.col("next") * F.lit(ratio) <= F.col("most") + F.lit(SLACK))).select("key", "i", "j")
    sides = meet.select("key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    full = rows.join(sides, ["key", "block"]).join(about(rows.select("sid").distinct()), "sid")
    full = full.repartition(F.col("key"), F.col("i"), F.col("j")).sortWithinPartitions("key", "i", "j", "size", "sid")
    return _grouped(full, lambda part, starts, links: _by_size(part, starts, ratio, test, near, links), lambda: _Waiting(settle))


def _grouped(full: DataFrame, inside: Callable, memory: Callable | None) -> DataFrame:
    """What ``inside`` hands on of whole groups (key, i, j), which stand together in ``full``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        links = memory() if memory else None
        left = None  # the last group of a batch may go on in the next
        for b in itertools.chain(batches, [None]):
            rest = left if b is None else b if left is None else pd.concat([left, b], ignore_index=True)
            if rest is None or not len(rest):
                continue
            group = rest[["key", "i", "j"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1)])
            done = len(rest) if b is None else starts[-1]
            left = None if b is None else rest.iloc[done:].reset_index(drop=True)
            if done:
                yield from inside(rest.iloc[:done], starts[starts < done], links)
        if isinstance(links, _Waiting):
            yield links.settled()

    return full.mapInPandas(run, "a long, b long").distinct()


def _by_size(
    rows: pd.DataFrame, starts: np.ndarray, ratio: float, test: Callable[[pd.DataFrame], Test], near: Callable[[pd.DataFrame], Test], links: _Waiting
) -> Iterator[pd.DataFrame]:
    """Links inside groups of rows that are ordered by size; if a group has two blocks, between both."""
    own, sid, block, size = (rows[c].to_numpy() for c in ("root", "sid", "block", "size"))
    across, passes, likely, told = (rows["i"] != rows["j"]).to_numpy(), test(rows), near(rows), rows["told"].array
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(rows)]))
    # how many rows further sizes are still near enough
    most = np.floor((size + SLACK) / ratio).astype(np.int64)
    reach = np.searchsorted(group * (most.max() + 1) + size, group * (most.max() + 1) + most, side="right") - 1 - np.arange(len(rows))
    root, known, pending, count, step = links.tops(own), links.joined, [], 0, 1
    at = np.flatnonzero(reach >= step)
    while len(at):
        lo, hi = at[0], at[-1] + 1
        # where most rows have a partner, slices are cheaper than places
        dense = 2 * len(at) >= hi - lo
        x = slice(lo, hi) if dense else at
        fits = passes(x, slice(lo + step, hi + step) if dense else at + step)
        x = np.flatnonzero(fits & (reach[x] >= step)) + lo if dense else at[fits]
        x = x[(root[x] != root[x + step]) & (~across[x] | (block[x] != block[x + step]))]
        pending.append((x, x + step))
        count += len(x)
        step += 1
        at = at[reach[at] >= step]
        if count >= PENDING or not len(at):
            x, y = (np.concatenate(z) for z in zip(*pending, strict=True))
            x, y = links.new(x, y, sid)
            some = likely(x, y)
            x, y, pending, count = x[some], y[some], [], 0
            # texts are copied before their batch goes
            for k in range(0, len(x), PENDING):
                i, j = x[k : k + PENDING], y[k : k + PENDING]
                if links.wait(own[i], own[j], sid[i], sid[j], told[i], told[j]):
                    yield links.settled()
            if known != links.joined:
                root, known = links.tops(own), links.joined


def _inside(
    rows: pd.DataFrame,
    starts: np.ndarray,
    test: Callable[[pd.DataFrame], Test],
    settle: Callable[[pd.DataFrame], Settle] | None,
    links: _Links | None,
) -> Iterator[pd.DataFrame]:
    """Pairs inside groups of rows that lie in different components and, if a group has two blocks, in both."""
    ends = np.r_[starts[1:], len(rows)]
    last = np.repeat(ends, ends - starts)
    own, sid, block = (rows[c].to_numpy() for c in ("root", "sid", "block"))
    across, passes, at = (rows["i"] != rows["j"]).to_numpy(), test(rows), np.arange(len(rows))
    holds, root, known = settle(rows) if settle else None, own, None
    found, held, step = [], 0, 1
    while True:
        at = at[at + step < last[at]]
        if not len(at):
            break
        if links and step % LOOK_AGAIN == 1 and known != links.joined:
            root, known = links.tops(own), links.joined
        x = at[(root[at] != root[at + step]) & (~across[at] | (block[at] != block[at + step]))]
        x = x[passes(x, x + step)]
        if links:
            x = links.new(x, x + step, root, sid, holds)
        found.append(np.stack([sid[x], sid[x + step]], axis=1))
        held += len(x)
        if held >= PAIRS_HELD:
            yield _sorted(found)
            found, held = [], 0
        step += 1
    if held:
        yield _sorted(found)
    if links:
        links.shrink()


def _sorted(found: list[np.ndarray]) -> pd.DataFrame:
    pairs = np.sort(np.concatenate(found), axis=1)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]}).drop_duplicates()


class _Links:
    """Components as far as a task has met their links."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.joined = 0  # how often two became one, or all was forgotten
        self.not_linked: set[tuple[int, int]] = set()  # pairs come again in further lists

    def top(self, node: int) -> int:
        up = self.up
        while (over := up.get(node, node)) != node:
            up[node] = node = up.get(over, over)
        return node

    def tops(self, nodes: np.ndarray) -> np.ndarray:
        some, at = np.unique(nodes, return_inverse=True)
        return np.array([self.top(k) for k in some.tolist()], dtype=np.int64)[at]

    def new(self, x: np.ndarray, y: np.ndarray, root: np.ndarray, sid: np.ndarray, holds: Settle) -> np.ndarray:
        """Those of x that link with their y and lie in another component."""
        kept = []
        for k, i, j in zip(range(len(x)), x.tolist(), y.tolist(), strict=True):
            a, b = self.top(int(root[i])), self.top(int(root[j]))
            if a == b:
                continue
            pair = (int(sid[i]), int(sid[j]))
            if pair in self.not_linked:
                continue
            if holds(i, j):
                self.up[max(a, b)] = min(a, b)
                self.joined += 1
                kept.append(k)
            elif len(self.not_linked) < PAIRS_HELD:
                self.not_linked.add(pair)
        return x[kept]

    def shrink(self) -> None:
        if len(self.up) >= LINKS_HELD:
            self.up.clear()
            self.joined += 1


class _Waiting(_Links):
    """The same, with pairs that wait until they are many enough to be settled at once."""

    def __init__(self, settle: Callable[[list[str], list[str]], np.ndarray]):
        super().__init__()
        self.settle = settle
        self.rows: list[tuple[int, int, int, int, str, str]] = []
        self.held = 0

    def new(self, x: np.ndarray, y: np.ndarray, sid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of rows that were not met before, as far as remembered."""
        kept, known = [], self.not_linked
        for k, pair in enumerate(zip(np.minimum(sid[x], sid[y]).tolist(), np.maximum(sid[x], sid[y]).tolist(), strict=True)):
            if pair not in known:
                kept.append(k)
                if len(known) >= PAIRS_HELD:
                    known.clear()
                known.add(pair)
        return x[kept], y[kept]

    def wait(self, *columns) -> bool:
        """Add pairs (roots, sids and texts); whether they are enough."""
        rows = [*zip(*(c.tolist() for c in columns), strict=True)]
        self.rows += rows
        self.held += sum(len(r[4]) + len(r[5]) for r in rows)
        return len(self.rows) >= PENDING or self.held >= TEXT_HELD

    def settled(self) -> pd.DataFrame:
        """Links among the pairs that wait, one for each two components that become one."""
        rows = [r for r in self.rows if self.top(r[0]) != self.top(r[1])]
        self.rows, self.held, found = [], 0, []
        if rows:
            one, two = ([*x] for x in [*zip(*rows, strict=True)][4:])
            for (i, j, a, b, *_), linked in zip(rows, self.settle(one, two).tolist(), strict=True):
                i, j = self.top(i), self.top(j)
                if linked and i != j:
                    self.up[max(i, j)] = min(i, j)
                    self.joined += 1
                    found.append((min(a, b), max(a, b)))
            self.shrink()
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")
