"""Frames of a PMF history and their deviation from a reference."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.grid import GridSpec
from ..session import materialize
from .histogram import Histogram, bounded
from .ordered import explode_range


def fill_frames(updates: DataFrame, frames: DataFrame, spec: GridSpec) -> DataFrame:
    """Dense frames from the bins each frame lists.

    ``updates``: ``file, frame, addr, value`` (one row per listed bin).
    ``frames``: ``file, frame``, every frame there is.  A bin a frame does not list keeps
    the value of the frame before it in the same file; a file starts from zeros.  Only the
    listed bins (and one zero per file and bin) are shuffled.
    """
    bounds = frames.groupBy("file").agg(F.min("frame").alias("_low"), (F.max("frame") + 1).alias("_high"))
    zeros = explode_range(bounds, F.lit(0), F.lit(spec.size), "addr").select(
        "file", F.col("_low").alias("frame"), "addr", F.lit(0.0).alias("value"), F.lit(0).alias("_listed")
    )
    listed = updates.select("file", "frame", "addr", "value", F.lit(1).alias("_listed"))
    # each value holds until the bin is listed again; a zero whose bin is listed at once holds for no frame
    after = F.lead("frame").over(W.partitionBy("file", "addr").orderBy("frame", "_listed"))
    spans = listed.unionByName(zeros).withColumn("_next", after).join(bounds, "file")
    held = spans.select("file", "addr", F.coalesce("value", F.lit(0.0)).alias("value"), F.col("frame").alias("_from"), F.coalesce("_next", "_high").alias("_to"))
    return explode_range(held, F.col("_from"), F.col("_to"), "frame").select("file", "frame", "addr", "value")


def append_frame(history: DataFrame, hist: Histogram, frame: int, file: int = 0) -> DataFrame:
    """Put one more histogram behind the frames of a history."""
    row = hist.dense().df.select(
        F.lit(file).cast("int").alias("file"), F.lit(frame).cast("long").alias("frame"), "addr", "value"
    )
    return history.unionByName(row)


def last_frame(history: DataFrame, spec: GridSpec) -> Histogram:
    top = history.agg(F.max("frame")).scalar()
    return Histogram(spec, history.filter(F.col("frame") == top).select("addr", "value"))


def same_grid(a: GridSpec, b: GridSpec) -> bool:
    """The same axes, to the nine digits that file headers carry."""

    def alike(x: float, y: float) -> bool:
        return math.isclose(x, y, rel_tol=1e-8, abs_tol=1e-8)

    pairs = zip(a.axes, b.axes)
    return a.ndim == b.ndim and all(
        p.bins == q.bins and p.periodic == q.periodic and alike(p.lower, q.lower) and alike(p.upper, q.upper) for p, q in pairs
    )


def rmsd(history: DataFrame, spec: GridSpec, reference: Histogram | None = None) -> DataFrame:
    """Root mean square deviation of every frame, over all bins of the grid.

    The reference is the last frame unless one is given.  ``history`` holds dense frames.
    """
    if reference is not None and not same_grid(reference.spec, spec):
        raise ValueError("the reference is on another grid than the history")
    if reference is None:
        history = materialize(history)
        reference = last_frame(history, spec)
    ref = reference.df.select("addr", F.col("value").alias("_ref"))
    gap = F.coalesce(F.col("_ref"), F.lit(0.0)) - F.col("value")
    return (
        history.join(bounded(ref, spec), "addr", "left")
        .groupBy("frame")
        .agg(F.sqrt(F.sum(gap * gap) / F.lit(float(spec.size))).alias("rmsd"))
    )


def frame_suffix(frame: Column, count: int) -> Column:
    """Zero-padded frame number as used in the names of split frames."""
    return F.lpad(frame.cast("string"), len(str(count)), "0")
