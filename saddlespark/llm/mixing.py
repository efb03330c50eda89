"""Mixing sources to target weights by weighted sampling without replacement.

Each source gets a budget of words from its weight (never more than two times its size; what
that frees is shared among the others by weight).  The budget is spent on complete passes over
the source first.  What is left is filled in the order of exponential keys -ln(u) / quality
(Efraimidis and Spirakis): the smallest keys first, up to the document whose prefix sum of
words comes nearest to the budget.

The order inside a source is found in two levels: keys are cut into buckets that keep their
order, a window runs inside each bucket, and a second one over the bucket totals.  A source
with a third of all rows is thus spread over many tasks.  Buckets are even steps of the mean
distribution function of the keys over ten quality weights from 0.1 to 1, so rows of any one
quality meet a bucket at most ten times as often as they would a fair one, however many rows
have it.  Everything is native DataFrame code.

Cases: a null source is a source of its own, last in order.  Null and empty texts have size 0 and
are taken with no words.  The random part of a key comes from doc_id, of rows without one from
the text.  Repeated rows get equal keys, thus one bucket, and are told apart by order only.
Equal keys go by doc_id, then size.  Sources without any word have target 0 and are not taken.
An empty table gives no rows.  Further columns of the documents come along in ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .common import count_words, unit_hash

WEIGHTS = (5, 2, 1)  # of the sources in order, repeating
SHARE = 1.5  # of all words the mix holds
MOST = 2  # passes over a source at most
BUCKET_ROWS = 5_000  # of a fair bucket
RATES = 10  # quality weights whose distributions the buckets average


def quality(text: Column) -> Column:
    """A weight from 0.1 to 1: how little of the text is made of symbols."""
    size = F.octet_length(F.coalesce(text, F.lit("")))
    marks = F.lit(0)
    for c in "#*$%&|<>!":
        marks = marks + size - F.octet_length(F.replace(F.coalesce(text, F.lit("")), F.lit(c), F.lit("")))
    return F.greatest(F.lit(0.1), 1.0 - F.when(size > 0, 10.0 * marks / size).otherwise(0.0))


def random_key(seed: int, doc_id: Column, text: Column) -> Column:
    """Exponential keys: the higher the quality, the smaller the key tends to be."""
    own = F.coalesce(doc_id.cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(text, F.lit("")))))
    return -F.log(unit_hash(seed, own)) / quality(text)


def bucket(key: Column, buckets: int) -> Column:
    """A number from 0 that never falls as the key grows."""
    above = F.lit(0.0)
    for k in range(1, RATES + 1):
        above = above + F.exp(-key * (k / RATES))
    return F.floor((1.0 - above / RATES) * buckets).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Budget per source from ``source, source_size``: one row a source, so this table is small.

    Sources that reach their limit are those with the smallest limit for their weight, so one
    pass in that order finds them all.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    t = sizes.withColumn("_w", weight.cast("long")).withColumn("_cap", F.col("source_size") * most)
    order = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    done, everything = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    t = t.withColumns({"_all": share * F.sum("source_size").over(everything), "_ws": F.sum("_w").over(everything)})
    t = t.withColumns({"_caps": F.coalesce(F.sum("_cap").over(done), F.lit(0)), "_before": F.coalesce(F.sum("_w").over(done), F.lit(0))})
    level = (F.col("_all") - F.col("_caps")) / (F.col("_ws") - F.col("_before"))
    t = t.withColumn("_full", F.col("_cap") <= F.col("_w") * level)
    full = lambda c: F.coalesce(F.sum(F.when(F.col("_full"), F.col(c))).over(everything), F.lit(0))
    t = t.withColumns({"_fc": full("_cap"), "_fw": full("_w")})
    left = (F.col("_all") - F.col("_fc")) / F.nullif(F.col("_ws") - F.col("_fw"), F.lit(0))
    return t.select("source", "source_size", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.col("_w") * left).alias("target"))


def plan(docs: DataFrame, seed: int = 0, keep: tuple[str, ...] = (), **kw) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (words) for every document.

    ``keep`` names further columns that come along.  The texts are read twice: once for the
    totals of sources and buckets, which are written to the shared folder, once for the rows.
    """
    buckets = max(16, -(-docs.count() // BUCKET_ROWS))
    rows = docs.select(
        "doc_id",
        "source",
        count_words(F.col("text")).alias("size"),
        random_key(seed, F.col("doc_id"), F.col("text")).alias("_key"),
        *keep,
    ).withColumn("_b", bucket(F.col("_key"), buckets))
    totals = materialize(rows.groupBy("source", "_b").agg(F.sum("size").alias("_t")))
    before = W.partitionBy("source").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(F.col("source").alias("_src"), F.col("_b").alias("_bk"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_start"))
    goal = targets(totals.groupBy("source").agg(F.sum("_t").alias("source_size")), **kw).withColumnRenamed("source", "_src2")
    starts = starts.join(goal, F.col("_src").eqNullSafe(F.col("_src2"))).drop("_src2")
    inside = W.partitionBy("source", "_b").orderBy("_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # null-safe, though no bucket is null: else a filter on it would be made, with the key's text work copied into it ten times
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("_src")) & F.col("_b").eqNullSafe(F.col("_bk")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rows = rows.withColumn("_passes", passes)
    rest = F.col("target") - F.col("_passes") * F.col("source_size")
    chosen = F.col("_start") + F.col("_in") + F.col("size") / 2.0 < rest
    copies = (F.col("_passes") + F.when(chosen, 1).otherwise(0)).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *keep)


def mix(docs: DataFrame, seed: int = 0, **kw) -> DataFrame:
    """The mix itself: the documents' own columns, a row for each time a document is taken."""
    names = docs.columns
    packed = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    taken = plan(packed, seed, keep=("_row",), **kw).filter(F.col("copies") > 0)
    return taken.select(F.explode(F.array_repeat("_row", F.col("copies").cast("int"))).alias("_row")).select("_row.*")
