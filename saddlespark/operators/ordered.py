"""Row order and running values without one long window.

A running sum over a whole file, or over all frames of one bin, must not put that file
or bin into one window partition.  The helpers here work in two levels: windows over
bounded blocks of rows, and a second window over one small row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Positions of a long sequence that share one window partition.
BLOCK = 1 << 14


def explode_range(df: DataFrame, first: Column, end: Column, out: str) -> DataFrame:
    """One row per whole number from ``first`` up to but not including ``end``.

    Done in two steps, so that no row ever holds more than ``BLOCK`` numbers.
    """
    df = df.withColumns({"_first": first.cast("long"), "_end": end.cast("long")}).filter(F.col("_end") > F.col("_first"))
    pieces = F.floor((F.col("_end") - F.col("_first") - 1) / F.lit(BLOCK))
    df = df.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces)))
    low = F.col("_first") + F.col("_piece") * F.lit(BLOCK)
    high = F.least(low + F.lit(BLOCK), F.col("_end")) - 1
    return df.withColumn(out, F.explode(F.sequence(low, high))).drop("_first", "_end", "_piece")


def running_sum(
    df: DataFrame, keys: list[str], pos: str, values: dict[str, Column], inclusive: bool = True, levels: int = 1
) -> DataFrame:
    """Add running sums (name -> summed expression) within ``keys``, in order of ``pos``.

    ``pos`` is a whole number.  Rows are cut into blocks of ``BLOCK`` positions; each block
    starts from the total of the blocks before it.  ``levels`` says how often those totals
    are cut into blocks in turn: one level leaves (positions / BLOCK) rows a key to one
    task, two levels (positions / BLOCK**2).
    """
    block = f"_b{levels}"
    name = {v: (f"_t{k}_{levels}", f"_s{k}_{levels}", f"_r{k}_{levels}") for k, v in enumerate(values)}
    df = df.withColumns({block: F.floor(F.col(pos) / F.lit(BLOCK)), **{name[v][2]: c for v, c in values.items()}})
    group = [*keys, block]
    totals = df.groupBy(*group).agg(*[F.sum(r).alias(t) for t, _, r in name.values()])
    if levels > 1:
        starts = running_sum(totals, keys, block, {s: F.col(t) for t, s, _ in name.values()}, False, levels - 1)
    else:
        before = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
        starts = totals.withColumns({s: F.coalesce(F.sum(t).over(before), F.lit(0)) for t, s, _ in name.values()})
    within = W.partitionBy(*group).orderBy(pos).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    df = df.withColumns({r: F.coalesce(F.sum(r).over(within), F.lit(0)) for _, _, r in name.values()})
    joined = df.join(starts.select(*group, *[s for _, s, _ in name.values()]), group)
    joined = joined.withColumns({v: F.col(r) + F.col(s) for v, (_, s, r) in name.items()})
    return joined.drop(block, *[c for _, s, r in name.values() for c in (s, r)])


def carry_forward(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Replace NULLs of ``value`` by the last value before them, by whole-number order."""
    df = df.withColumn("_b", F.floor(F.col(order) / F.lit(BLOCK)))
    group = [*keys, "_b"]
    blocks = df.groupBy(*group).agg(F.expr(f"max_by({value}, {order}) FILTER (WHERE {value} IS NOT NULL)").alias("_last"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    start = blocks.select(*group, F.last("_last", ignorenulls=True).over(before).alias("_start"))
    within = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    filled = df.withColumn(value, F.last(value, ignorenulls=True).over(within))
    return (
        filled.join(start, group)
        .withColumn(value, F.coalesce(F.col(value), F.col("_start")))
        .drop("_b", "_start")
    )


def number_rows(df: DataFrame, files: DataFrame | None, out: str, kind: str | None = None) -> DataFrame:
    """Number rows 0, 1, 2... in reading order without moving them.

    ``df`` has ``part`` (file name) and ``block`` (offset of the input split), straight
    from a scan and filters.  ``files`` (``part, file``) gives the order of the files and
    is carried along as the column ``file``; without it names give the order and ``file``
    is 0.  Only one row per input split is aggregated and shuffled; the rows get their
    number from that small table.

    With ``kind`` every value of that column is numbered from 0 on its own; the rows of a
    kind and split must then follow each other (``sortWithinPartitions`` by kind first).
    """
    kinds = [kind] if kind else []
    df = df.withColumn("_seq", F.monotonically_increasing_id())
    pieces = df.groupBy("part", "block", *kinds).agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    if files is None:
        pieces = pieces.withColumn("file", F.lit(0))
    else:
        unknown = F.raise_error(F.concat(F.lit("file not in the list of inputs: "), F.col("part"))).cast("int")
        pieces = pieces.join(files, "part", "left").withColumn("file", F.coalesce("file", unknown))
    # one window over all splits: a second one over totals of files would scan the rows once more
    before = W.partitionBy(*kinds).orderBy("file", "part", "block").rowsBetween(W.unboundedPreceding, -1)
    base = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    table = pieces.select("part", "block", *kinds, "file", base.alias("_base"))
    # the files are scanned once for the pieces and once for the rows: both must be split alike
    lost = F.raise_error(F.concat(F.lit("input split differently on a second scan: "), F.col("part"))).cast("long")
    found = df.join(table, ["part", "block", *kinds], "left")
    return found.withColumn(out, F.col("_seq") + F.coalesce("_base", lost)).drop("_seq", "_base")
