"""Integrate a gradient grid to the potential it comes from.

The finite-difference Laplacian of a box grid is a sum of one operator per axis, and
each of those is diagonal in a cosine basis (open ends) or a Fourier basis (periodic).
So the linear system needs no matrix and no iteration: transform along every axis, divide
by the sum of eigenvalues, transform back.

A line of the grid is never gathered.  Its L positions are written as n1 x n2; groups of n1
positions that are n2 apart are transformed, turned by a phase, and regrouped into n2 groups
across them: two grouped passes, no group beyond a few times the root of L.  Lengths without
such factors are padded to a power of two (the transform becomes a convolution with a chirp,
which is again three such transforms).  A one-dimensional grid needs no transform: two
running sums solve it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.axis import Axis
from ..session import materialize
from .histogram import Histogram
from .ordered import running_sum
from .stencil import divergence

# A factor of a length may exceed its root by this much.
UNEVEN = 8


def _ends(axis: Axis, i: Column) -> Column:
    """1/2 at each open end of an axis, 1 elsewhere."""
    if axis.periodic:
        return F.lit(1.0)
    return F.when((i == 0) | (i == axis.bins - 1), F.lit(0.5)).otherwise(F.lit(1.0))


def _eigenvalue(axis: Axis, m: Column) -> Column:
    angle = 2.0 * math.pi / axis.bins if axis.periodic else math.pi / (axis.bins - 1)
    return -(F.lit(2.0) - F.lit(2.0) * F.cos(m * F.lit(angle))) / F.lit(axis.width**2)


def factors(length: int) -> tuple[int, int] | None:
    """n1 <= n2 with the product ``length`` and n2 near its root, if there are such."""
    n2 = next(n for n in range(math.isqrt(max(length - 1, 0)) + 1, length + 1) if length % n == 0)
    return (length // n2, n2) if n2 <= UNEVEN * math.sqrt(length) else None


def _groups(rows: DataFrame, size: int) -> DataFrame:
    """Discrete Fourier transform inside each group: (base, g, p, re, im) to (base, g, m, re, im); absent places are 0."""

    @F.pandas_udf("array<double>")
    def along(places: pd.Series, re: pd.Series, im: pd.Series) -> pd.Series:
        lines = np.zeros((len(places), size), dtype=np.complex128)
        for line, p, x, y in zip(lines, places, re, im, strict=True):
            line[p] = x + 1j * y
        f = np.fft.fft(lines, axis=1)
        return pd.Series(list(np.concatenate([f.real, f.imag], axis=1)))

    cells = rows.groupBy("base", "g").agg(F.collect_list(F.struct("p", "re", "im")).alias("c"))
    done = cells.select("base", "g", along("c.p", "c.re", "c.im").alias("f"))
    done = done.withColumn("m", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))))
    at = F.col("m").cast("int")
    return done.select("base", "g", "m", F.get("f", at).alias("re"), F.get("f", at + size).alias("im"))


def _turned(df: DataFrame, angle: Column) -> DataFrame:
    """Values times the complex number of an angle."""
    c, s = F.cos(angle), F.sin(angle)
    re, im = F.col("re") * c - F.col("im") * s, F.col("re") * s + F.col("im") * c
    return df.withColumns({"re": re, "im": im})


def fourier(rows: DataFrame, length: int) -> DataFrame:
    """Discrete Fourier transform of lines: (base, i, re, im) to (base, m, re, im) for all m below ``length``."""
    pair = factors(length)
    if pair is None:
        return _by_chirp(rows, length)
    n1, n2 = pair
    if n1 > 1:
        far = rows.select("base", (F.col("i") % n2).alias("g"), F.expr(f"i div {n2}").alias("p"), "re", "im")
        phase = F.col("g") * F.col("m") % F.lit(length) * F.lit(-2.0 * math.pi / length)
        rows = _turned(_groups(far, n1), phase).select("base", F.col("m").alias("g"), F.col("g").alias("p"), "re", "im")
    else:
        rows = rows.select("base", F.lit(0).cast("long").alias("g"), F.col("i").alias("p"), "re", "im")
    return _groups(rows, n2).select("base", (F.col("g") + F.col("m") * n1).alias("m"), "re", "im")


def _by_chirp(rows: DataFrame, length: int) -> DataFrame:
    """The transform as a convolution: m * i is (m^2 + i^2 - (m - i)^2) / 2."""
    wide = 1 << (2 * length - 1).bit_length()
    chirp = lambda i: i * i % F.lit(2 * length) * F.lit(-math.pi / length)
    one = fourier(_turned(rows, chirp(F.col("i"))), wide)
    j = F.col("id")
    t = F.when(j < length, j).when(j > wide - length, F.lit(wide) - j)
    answer = rows.sparkSession.range(wide).withColumn("t", t).filter("t IS NOT NULL")
    answer = answer.select(F.lit(0).cast("long").alias("base"), F.col("id").alias("i"), F.cos(chirp(F.col("t"))).alias("re"), (-F.sin(chirp(F.col("t")))).alias("im"))
    answer = fourier(answer, wide).select("m", F.col("re").alias("x"), F.col("im").alias("y"))
    re, im, x, y = (F.col(c) for c in ("re", "im", "x", "y"))
    # back by the conjugate: its transform is the inverse but for the sign and the length
    both = one.join(answer, "m").select("base", F.col("m").alias("i"), (re * x - im * y).alias("re"), (-(re * y + im * x)).alias("im"))
    back = fourier(both, wide).filter(F.col("m") < length)
    back = back.select("base", "m", (F.col("re") / wide).alias("re"), (-F.col("im") / wide).alias("im"))
    return _turned(back, chirp(F.col("m")))


def transform(hist: Histogram, k: int) -> Histogram:
    """Cosine transform (open ends, end values halved) or Hartley transform along axis ``k`` of a dense grid.

    Twice is ``scale(axis)`` times the identity.
    """
    spec, axis, stride = hist.spec, hist.spec.axes[k], hist.spec.strides[k]
    i = spec.index_of_address(F.col("addr"))[k]
    rows = hist.df.select((F.col("addr") - i * F.lit(stride)).alias("base"), i.cast("long").alias("i"), F.col("value").alias("re"), F.lit(0.0).alias("im"))
    if axis.periodic:
        out = fourier(rows, axis.bins).withColumn("value", F.col("re") - F.col("im"))
    else:
        length = 2 * (axis.bins - 1)
        mirrored = F.array_distinct(F.array(F.col("i"), F.lit(length) - F.col("i")))
        rows = rows.withColumn("i", F.explode(mirrored)).filter(F.col("i") < length)
        out = fourier(rows, length).filter(F.col("m") < axis.bins).withColumn("value", F.col("re") * 0.5)
    return Histogram(spec, out.select((F.col("base") + F.col("m") * F.lit(stride)).alias("addr"), "value"))


def scale(axis: Axis) -> float:
    return float(axis.bins) if axis.periodic else (axis.bins - 1) / 2.0


def laplacian_rows(grad: Histogram) -> DataFrame:
    """``addr, rhs, half``: right-hand side of the Laplace equation of a gradient grid.

    At an open end the mirrored neighbour is replaced by the known gradient.  ``half`` is
    1/2 per open end a bin lies on, the weight that makes the system symmetric.
    """
    spec = grad.spec
    div = divergence(grad).df.select("addr", F.col("value").alias("rhs"))
    df = grad.dense().df.join(div, "addr")
    rhs, half = F.col("rhs"), F.lit(1.0)
    for axis, i, v in zip(spec.axes, spec.index_of_address(F.col("addr")), grad.values):
        half = half * _ends(axis, i)
        if not axis.periodic:
            edge = F.lit(2.0 / axis.width) * F.col(v)
            rhs = rhs + F.when(i == 0, edge).when(i == axis.bins - 1, -edge).otherwise(F.lit(0.0))
    return df.select("addr", rhs.alias("rhs"), half.alias("half"))


def _along_line(rows: DataFrame, mean: float, axis: Axis) -> DataFrame:
    """Solution on a one-dimensional grid: the differences are a running sum, the potential another."""
    source = (F.col("rhs") * F.col("half") - F.lit(mean)) * F.lit(axis.width**2)
    steps = materialize(running_sum(rows, [], "addr", {"step": source}, levels=2).select("addr", "step"))
    if axis.periodic:
        steps = steps.withColumn("step", F.col("step") - F.lit(steps.agg(F.avg("step")).scalar()))
    return running_sum(steps, [], "addr", {"value": F.col("step")}, inclusive=False, levels=2).select("addr", "value")


def _from_zero(spec, df: DataFrame) -> Histogram:
    df = materialize(df)
    low = df.agg(F.min("value")).scalar()
    return Histogram(spec, df.withColumn("value", F.col("value") - low))


def integrate(grad: Histogram) -> Histogram:
    """Potential whose gradient is nearest to ``grad``, shifted so that its minimum is 0.

    The system fixes the potential up to a constant and may contradict itself; as in a
    least-squares solution, the mean of the weighted right-hand side is taken out first.
    """
    spec = grad.spec
    rows = materialize(laplacian_rows(grad))
    mean = rows.agg(F.avg(F.col("rhs") * F.col("half"))).scalar()
    if spec.ndim == 1:
        return _from_zero(spec, _along_line(rows, mean, spec.axes[0]))
    u = Histogram(spec, rows.select("addr", (F.col("rhs") - mean / F.col("half")).alias("value")))
    for k in range(spec.ndim):
        u = transform(u, k)
    modes = spec.index_of_address(F.col("addr"))
    total = F.lit(0.0)
    for axis, m in zip(spec.axes, modes):
        total = total + _eigenvalue(axis, m)
    norm = math.prod(scale(a) for a in spec.axes)
    # all modes 0 is the constant, which the shift below fixes
    u = u.with_values({"value": F.when(F.col("addr") == 0, F.lit(0.0)).otherwise(F.col("value") / (total * F.lit(norm)))})
    for k in range(spec.ndim):
        u = transform(u, k)
    return _from_zero(spec, u.df)
