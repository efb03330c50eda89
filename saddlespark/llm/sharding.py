"""Shards of near-equal size by histogram sort.

Rows get a 64-bit key: the upper bits hash the text, the lower ones the document and its place
in the input, so equal texts are neighbours and yet a hot text can be cut, also one whose rows
all have the same doc_id or none.  Splitters between shards are found by
rounds: every round asks, for a few candidate boundaries in each splitter's bracket, how many
bytes lie below (partial sums per task, one row per boundary), and narrows the brackets until
every splitter is within tolerance.  Candidates stay on the borders between texts as long as
such a border is precise enough.  Then the rows are exchanged once, by ranges of keys, and
numbered by their place in the sorted ranges and one small row per range.

Only small rows (id, size, checksum, key) take part; they are written once to the shared
folder, so that the rounds do not read the texts again and a lost executor costs a re-read.

Cases: a null text counts as empty; null doc_ids and repeated rows are rows like others and may
go to different shards.  A document is never cut, so a text longer than
the tolerance may make shards differ by its size.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

LOW_BITS = 24  # of the key, for the document
TOLERANCE = 0.005  # of a shard's bytes
PROBES = 32  # candidate boundaries in each bracket and round
PART_ROWS = 100_000  # rows that one task sorts
FIRST, LAST = -(1 << 63), (1 << 63) - 1


def keyed(docs: DataFrame) -> DataFrame:
    """Light rows: doc_id, size, text_crc32 and the sort key."""
    text = F.coalesce("text", F.lit(""))
    low = F.lit((1 << LOW_BITS) - 1)
    own = F.xxhash64(F.lit(1), "doc_id", F.monotonically_increasing_id())
    return docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).bitwiseAND(F.bitwise_not(low)).bitwiseOR(own.bitwiseAND(low)).alias("key"),
    )


def bytes_below(rows: DataFrame, bounds: list[int]) -> list[int]:
    """Exact sizes of the rows whose key is below each bound; bounds are sorted."""
    edges = np.array(bounds, dtype="int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(edges) + 1, dtype="int64")
        for b in batches:
            np.add.at(total, np.searchsorted(edges, b["key"].to_numpy(), side="right"), b["size"].to_numpy())
        at = np.flatnonzero(total)
        yield pd.DataFrame({"slot": at, "bytes": total[at]})

    found = rows.select("key", "size").mapInPandas(run, "slot long, bytes long").groupBy("slot").agg(F.sum("bytes").alias("bytes"))
    sums = np.zeros(len(edges) + 1, dtype="int64")
    for r in found.collect():  # at most one row per candidate boundary
        sums[r["slot"]] = r["bytes"]
    return np.cumsum(sums)[:-1].tolist()


def candidates(lo: int, hi: int) -> list[int]:
    """Boundaries strictly inside a bracket, evenly spaced, on borders between texts where there are any."""
    step = 1 << LOW_BITS if hi - lo > 1 << LOW_BITS else 1
    a, b = lo // step + 1, -(-hi // step)
    n = b - a
    if n <= 0:
        return []
    take = min(n, PROBES)
    return sorted({(a + n * (2 * k + 1) // (2 * take)) * step for k in range(take)})


def splitters(rows: DataFrame, total: int, parts: int, tolerance: float) -> list[int]:
    """``parts`` - 1 keys such that the bytes below the k-th are near k / parts of all."""
    goal = [total * k / parts for k in range(1, parts)]
    brackets = [((FIRST, 0), (LAST, total)) for _ in goal]
    slack = tolerance * total / parts
    best: list[int | None] = [None] * len(goal)
    while any(b is None for b in best):
        asked = {i: candidates(lo[0], hi[0]) for i, (lo, hi) in enumerate(brackets) if best[i] is None}
        bounds = sorted({c for cs in asked.values() for c in cs})
        below = dict(zip(bounds, bytes_below(rows, bounds), strict=True)) if bounds else {}
        for i, cs in asked.items():
            lo, hi = brackets[i]
            points = [lo, *[(c, below[c]) for c in cs], hi]
            near = min(points, key=lambda p: abs(p[1] - goal[i]))
            if abs(near[1] - goal[i]) <= slack or not cs:
                best[i] = near[0]
                continue
            lo = max((p for p in points if p[1] <= goal[i]), default=lo)
            hi = min((p for p in points if p[1] > goal[i]), default=hi)
            brackets[i] = (lo, hi)
    return best


def shard(docs: DataFrame, shards: int = 16, tolerance: float = TOLERANCE) -> DataFrame:
    """Light rows with ``shard`` and ``slot``, sorted by key inside each shard."""
    rows = materialize(keyed(docs))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    cuts = splitters(rows, total, shards, tolerance) if n else []
    # as many splitters as there are borders between shards, whatever the number of rows
    own = sum((F.when(F.col("key") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    # a shard is many ranges of keys, so that no task has to sort and number a whole one
    ranges = max(shards, -(-n // PART_ROWS))
    dealt = rows.withColumn("shard", own).repartitionByRange(ranges, "key", "doc_id").sortWithinPartitions("key", "doc_id")
    done = materialize(dealt).withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()})
    pieces = done.groupBy("shard", "_part").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    before = W.partitionBy("shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = pieces.select("shard", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    return done.join(starts, ["shard", "_part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_base") + F.col("_seq")).cast("long").alias("slot")
    )
