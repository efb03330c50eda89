"""Additive patches: boxes of the grid raised or lowered by a value.

A few patches from a job's options become one expression.  Any number of patches in a table
becomes a field over the grid by differences: a box adds its value at its lowest corner and,
with alternating signs, just past its other ones (2^N terms), and running sums along each axis in turn
fill the boxes.  Work grows with the patches and with the bins, not with their product.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.axis import Axis
from ..functions.grid import GridSpec
from ..session import materialize
from .histogram import Histogram
from .ordered import running_sum


@dataclass(frozen=True)
class Patch:
    center: tuple[float, ...]
    length: tuple[float, ...]
    value: float


def apply_patches(hist: Histogram, patches: list[Patch]) -> Histogram:
    """Add each patch to every bin whose centre lies in its closed box.

    Overlapping patches add up; boxes do not wrap around periodic axes.  The patch list
    is part of the job's options, so it is compiled into one expression.
    """
    spec = hist.spec
    if any(len(p.center) != spec.ndim or len(p.length) != spec.ndim for p in patches):
        raise ValueError("a patch needs one centre and one length per axis")
    dense = hist.dense()
    if not patches:
        return dense
    x = spec.position(F.col("addr"))
    extra = F.lit(0.0)
    for p in patches:
        box = [
            c.between(F.lit(m - 0.5 * w), F.lit(m + 0.5 * w)) for c, m, w in zip(x, p.center, p.length)
        ]
        extra = extra + F.when(reduce(lambda a, b: a & b, box), F.lit(float(p.value))).otherwise(F.lit(0.0))
    return dense.with_values({"value": F.col("value") + extra})


def _first_at_least(axis: Axis, x: Column) -> Column:
    """Number of the first bin whose centre is not below ``x``, by comparing centres; may be past the end."""
    guess = F.ceil((x - F.lit(axis.lower)) / F.lit(axis.width) - 0.5).cast("long")
    guess = F.least(F.greatest(guess, F.lit(0).cast("long")), F.lit(axis.bins).cast("long"))
    fits = lambda i: (i >= 0) & (i < axis.bins) & (axis.center(i) >= x)
    return F.when(fits(guess - 1), guess - 1).when(fits(guess) | (guess == axis.bins), guess).otherwise(guess + 1)


def _first_above(axis: Axis, x: Column) -> Column:
    """Number of the first bin whose centre is above ``x``."""
    first = _first_at_least(axis, x)
    return F.when((first < axis.bins) & (axis.center(first) == x), first + 1).otherwise(first)


def patch_field(patches: DataFrame, spec: GridSpec) -> Histogram:
    """The sum of all patches on every bin; ``patches`` has ``center0.., length0.., value``.

    Boxes are closed and hold the bins whose centres they hold.  A patch with a NULL, and one
    of negative length, adds nothing.
    """
    low, past = [], []
    for k, axis in enumerate(spec.axes):
        middle, half = F.col(f"center{k}").cast("double"), F.col(f"length{k}").cast("double") * 0.5
        low.append(_first_at_least(axis, middle - half))
        past.append(_first_above(axis, middle + half))
    cols = [c.alias(f"{name}{k}") for name, cs in (("_l", low), ("_p", past)) for k, c in enumerate(cs)]
    boxes = patches.select(F.col("value").cast("double").alias("value"), *cols).filter("value IS NOT NULL")
    for k in range(spec.ndim):
        boxes = boxes.filter(F.col(f"_p{k}") > F.col(f"_l{k}"))
    corners = []
    for ends in itertools.product((0, 1), repeat=spec.ndim):
        at = [F.col(f"_p{k}" if e else f"_l{k}") for k, e in enumerate(ends)]
        inside = reduce(lambda a, b: a & b, [i < axis.bins for i, axis in zip(at, spec.axes)])
        part = F.struct(spec.address_of_index(at).cast("long").alias("addr"), (F.col("value") * (-1.0) ** sum(ends)).alias("value"))
        corners.append(F.when(inside, part))
    terms = boxes.select(F.explode(F.array_compact(F.array(*corners))).alias("c")).select("c.*")
    field = materialize(Histogram(spec, terms.groupBy("addr").agg(F.sum("value").alias("value"))).dense().df)
    for k, (axis, stride) in enumerate(zip(spec.axes, spec.strides)):
        i = spec.index_of_address(F.col("addr"))[k].cast("long")
        rows = field.select("addr", (F.col("addr") - i * F.lit(stride)).alias("_line"), i.alias("_i"), F.col("value").alias("_v"))
        field = running_sum(rows, ["_line"], "_i", {"value": F.col("_v")}, levels=2)
        # a running sum reads its input several times
        field = materialize(field.select("addr", "value"))
    return Histogram(spec, field)


def apply_patch_table(hist: Histogram, patches: DataFrame) -> Histogram:
    """A dense grid with the patches of a table added."""
    field = patch_field(patches, hist.spec).df.withColumnRenamed("value", "_extra")
    df = hist.dense().df.join(field, "addr")
    return Histogram(hist.spec, df.select("addr", (F.col("value") + F.col("_extra")).alias("value")))
