"""Nearest neighbours by inner product with a forest of hash prefixes.

Every tree gives each vector a long string of bits (sides of random hyperplanes) and keeps the
vectors sorted by it.  A query descends to the longest prefix it shares with stored strings and
ascends to shorter ones for more candidates.

* Descent: in each tree the query looks at the entries next to its place in sorted order, which
  are those with the longest common prefixes.  Their best scores give a first k-th best score.
* Ascent, in all trees at once: the prefix is shortened until a vector as near as the k-th best
  found is, with probability ``SURE``, in one of the trees under the shortened prefix.  That is
  known in advance for hyperplanes: two vectors at angle a share a bit with probability 1 - a/pi.
  Where the prefixes of all trees together would hold as many entries as the whole index, the
  ascent ends at the root of one tree: every vector is looked at.

So queries with close neighbours see a few entries, and queries into unstructured data see much
or all of it; recall, not speed, is held.  Scores are inner products of the original vectors in
double precision.  For unequal lengths vectors get one more coordinate that makes them equally
long, so that the nearest by inner product are the nearest by angle.

Sorted arrays are cut into blocks of bounded size by prefix, and large prefixes further by a
hash, so no task holds a tree.  Equal vectors are one entry with its smallest ids: enough for
every result, however many copies there are.

Cases: vectors that are null, zero, or hold null or non-finite components, and rows without id,
take no part, neither as queries nor as candidates.  Vectors of different dimension never meet.
Ties go to the smaller id.  Repeated ids are candidates each, but never of the query with their
id.  An empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .common import first_rows

TREES = 16
BITS = 62  # of a hash string, held in a long
LEAF = 4096  # entries of a block
ASKERS = 16384  # queries that meet a block in one place
NEAR = 64  # entries on either side of a query's place, per tree, in the descent
SURE = 0.97
BROADCAST_BLOCKS = 1 << 16  # rows of 24 bytes


def planes(dim: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim + 1, trees * BITS)).astype(np.float32)


def hash_strings(x: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """One long per row and tree; the first bit is the highest."""
    signs = x.astype(np.float32) @ planes(x.shape[1] - 1, trees, seed) > 0
    weights = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    return signs.reshape(len(x), trees, BITS) @ weights


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: F.coalesce((~F.isnan(x)) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def entries(vectors: DataFrame, keep: int) -> DataFrame:
    """One row per different vector: vid, its ``keep`` smallest ids, the vector."""
    rows = first_rows(vectors, ["vid"], [F.col("vec_id")], keep, F.xxhash64("vec_id"))
    return rows.groupBy("vid").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("embedding").alias("v"))


def _hashed(rows: DataFrame, longest: float, trees: int, seed: int, query: bool) -> DataFrame:
    """vid, dim, vector bytes and hash strings; entries get the coordinate that evens out lengths."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = b["v"].map(len)
            for dim, group in b.groupby(sizes):
                x = np.stack(group["v"].to_numpy()).astype(np.float64)
                norm = np.linalg.norm(x, axis=1)
                rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(longest**2 - norm**2, 0))
                codes = hash_strings(np.column_stack([x, rest]) / (norm[:, None] if query else longest), trees, seed)
                kept = [r.tobytes() for r in x]
                yield pd.DataFrame({"vid": group["vid"].to_numpy(), "dim": int(dim), "v": kept, "norm": norm, "codes": list(codes)})

    return rows.select("vid", "v").mapInPandas(run, "vid long, dim int, v binary, norm double, codes array<long>")


def _by_tree(hashed: DataFrame, depth: int, *more: str) -> DataFrame:
    rows = hashed.select("vid", "dim", "v", *more, F.posexplode("codes").alias("tree", "code"))
    return rows.withColumn("bucket", F.shiftright("code", BITS - depth) if depth else F.lit(0).cast("long"))


def _best(q: np.ndarray, x: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of each query's k best allowed entries, and all that tie with the last."""
    scores = np.where(ok, q @ x.T, -np.inf)
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, [scores.shape[1] - k]]
        scores = np.where(scores >= least - 1e-9 * (1 + np.abs(least)), scores, -np.inf)
    return np.nonzero(scores > -np.inf)


KEY = ["tree", "dim", "bucket", "sub", "part"]


def _scores(data: DataFrame, asked: DataFrame, k: int, near: int | None) -> DataFrame:
    """(qid, vid, score) of the best entries per query and block.

    With ``near`` a query looks at that many entries on both sides of its place; without, at all
    that share its first ``level`` bits.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"qid": [], "vid": [], "score": []}).astype({"qid": "int64", "vid": "int64", "score": "float64"})
        left = left.sort_values(["code", "vid"])
        codes, vid = left["code"].to_numpy(), left["vid"].to_numpy()
        x = np.frombuffer(b"".join(left["v"]), dtype=np.float64).reshape(len(left), -1)
        out = []
        for at in range(0, len(right), 512):
            r = right.iloc[at : at + 512]
            q = np.frombuffer(b"".join(r["v"]), dtype=np.float64).reshape(len(r), -1)
            code = r["code"].to_numpy()
            if near is None:
                shift = BITS - r["level"].to_numpy().astype(np.int64)
                lo = np.searchsorted(codes, (code >> shift) << shift, side="left")
                hi = np.searchsorted(codes, ((code >> shift) + 1) << shift, side="left")
            else:
                here = np.searchsorted(codes, code)
                lo, hi = here - near, here + near
            place = np.arange(len(codes))
            i, j = _best(q, x, (place >= lo[:, None]) & (place < hi[:, None]), k)
            # the same sum for the same two vectors wherever they meet
            out.append(pd.DataFrame({"qid": r["qid"].to_numpy()[i], "vid": vid[j], "score": np.einsum("ij,ij->i", q[i], x[j])}))
        return pd.concat(out)

    pair = data.groupBy(*KEY).cogroup(asked.groupBy(*KEY))
    return pair.applyInPandas(run, "qid long, vid long, score double")


def search(table: DataFrame, is_query: Column, k: int = 20, trees: int = TREES, seed: int = 0) -> DataFrame:
    """query_id, rank, vec_id and score for ``table`` (vec_id, embedding)."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(usable(F.col("embedding")))
    rows = rows.withColumn("vid", F.xxhash64("embedding"))
    nodes = materialize(entries(rows, k + 1))
    n, longest = nodes.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))).first()
    askers = materialize(rows.filter("asks").select("vid", F.col("vec_id").alias("query_id")))
    wanted = askers.select("vid").distinct()
    depth = min(BITS, max(0, math.ceil(math.log2(max(n, 1) / LEAF))))

    stored = materialize(_by_tree(_hashed(nodes, longest or 1.0, trees, seed, False), depth))
    blocks = materialize(stored.groupBy("tree", "dim", "bucket").agg(F.ceil(F.count("*") / F.lit(LEAF)).cast("int").alias("subs")))
    if blocks.count() <= BROADCAST_BLOCKS:
        blocks = F.broadcast(blocks)
    stored = stored.join(blocks, ["tree", "dim", "bucket"]).withColumn("sub", F.pmod(F.xxhash64("vid"), F.col("subs")).cast("int"))
    asked = materialize(_hashed(nodes.join(wanted, "vid", "left_semi"), longest or 1.0, trees, seed, True).withColumnRenamed("vid", "qid"))
    parts = max(1, -(-asked.count() // ASKERS))
    part = F.pmod(F.xxhash64("qid", F.lit(1)), F.lit(parts)).cast("int")
    data = stored.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(*KEY, "vid", "code", "v")

    def sent(queries: DataFrame) -> DataFrame:
        """Queries with tree and bucket, to all blocks of that bucket."""
        to = queries.join(blocks, ["tree", "dim", "bucket"]).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
        return to.withColumn("part", part).select(*KEY, "qid", "code", "level", "v")

    each = asked.select("qid", "dim", "v", "norm", F.posexplode("codes").alias("tree", "code"))
    bucket = F.shiftright("code", BITS - depth) if depth else F.lit(0).cast("long")
    first = each.withColumn("level", F.lit(0)).withColumn("bucket", bucket)
    seen = materialize(_scores(data, sent(first), k + 1, NEAR).distinct())
    order = W.partitionBy("qid").orderBy(F.col("score").desc(), "vid")
    worst = seen.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") == k + 1).select("qid", F.col("score").alias("worst"))
    # a bit is shared with probability p; the longest prefix that is still sure enough
    level = asked.select("qid", "norm").join(worst, "qid", "left")
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("worst") / (F.col("norm") * F.lit(longest or 1.0))))
    p = 1.0 - F.acos(cos) / math.pi
    hit = 1.0 - (1.0 - SURE) ** (1.0 / trees)  # that one tree must reach
    deep = F.when(p >= 1.0 - 1e-12, F.lit(BITS)).otherwise(F.floor(F.lit(math.log(hit)) / F.log(F.greatest(p, F.lit(1e-9)))))
    level = level.select("qid", F.least(F.lit(BITS), F.coalesce(deep, F.lit(0))).cast("int").alias("level"))
    root = math.log2(trees)
    level = level.select("qid", F.when(F.col("level") <= root, 0).otherwise(F.col("level")).alias("level"))
    second = each.join(level, "qid").filter((F.col("level") > 0) | (F.col("tree") == 0))
    base = F.expr(f"shiftright(code, {BITS} - least(level, {depth}))") if depth else F.lit(0).cast("long")
    width = F.expr(f"shiftleft(1L, {depth} - least(level, {depth}))")
    second = second.withColumn("bucket", F.explode(F.sequence(base * width, (base + 1) * width - 1)))
    found = _scores(data, sent(second), k + 1, None).union(seen).distinct()

    ids = nodes.select("vid", "ids")
    named = found.join(ids, "vid").select("qid", "score", F.explode("ids").alias("vec_id")).distinct()
    best = first_rows(named, ["qid"], [F.col("score").desc(), F.col("vec_id")], k + 1, F.xxhash64("vec_id"))
    answers = askers.join(best, F.col("vid") == F.col("qid")).filter("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return answers.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
