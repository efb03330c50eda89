"""Finite differences on a grid.

Every bin sends its value, times a coefficient, to the few bins whose derivative
needs it, and the receivers add up.  That is one fixed fan-out and one aggregation
for all axes together: no window has to hold a whole line of the grid.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.axis import Axis
from ..functions.grid import GridSpec
from .histogram import Histogram


def _targets(axis: Axis, i: Column, addr: Column, stride: int, value: Column, k: int) -> list[Column]:
    """What one bin contributes to the first derivative along one axis.

    Central differences inside and across a true period; three-point one-sided
    differences at an open end.
    """
    n, w2 = axis.bins, 2.0 * axis.width

    def send(shift, coef: float, when: Column) -> Column:
        return F.when(
            when,
            F.struct((addr + F.lit(shift * stride)).alias("addr"), F.lit(k).alias("axis"), (value * F.lit(coef / w2)).alias("part")),
        )

    if axis.real_periodic:
        return [
            send(-1, 1.0, i > 0),
            send(n - 1, 1.0, i == 0),
            send(1, -1.0, i < n - 1),
            send(1 - n, -1.0, i == n - 1),
        ]
    return [
        send(-1, 1.0, i >= 2),
        send(1, -1.0, i <= n - 3),
        send(0, -3.0, i == 0),
        send(-1, 4.0, i == 1),
        send(-2, -1.0, i == 2),
        send(0, 3.0, i == n - 1),
        send(1, -4.0, i == n - 2),
        send(2, 1.0, i == n - 3),
    ]


def _check(spec: GridSpec) -> None:
    if any(a.bins < 3 and not a.real_periodic for a in spec.axes):
        raise ValueError("a non-periodic axis needs at least 3 bins for a derivative")


def _parts(hist: Histogram, per_axis: list[Column]):
    spec = hist.spec
    _check(spec)
    addr = F.col("addr")
    idx = spec.index_of_address(addr)
    sends: list[Column] = []
    for k, (axis, stride) in enumerate(zip(spec.axes, spec.strides)):
        # the two stencil halves meet on the middle bin of a three-bin axis, so one
        # bin may send to another more than once; the receiver adds all of them
        sends += _targets(axis, idx[k], addr, stride, per_axis[k], k)
    rows = hist.df.select(F.explode(F.array_compact(F.array(*sends))).alias("s"))
    return rows.select("s.addr", "s.axis", "s.part")


def derivative(hist: Histogram) -> Histogram:
    """Gradient of a scalar grid: value columns ``d0..``, one per axis."""
    names = tuple(f"d{k}" for k in range(hist.spec.ndim))
    parts = _parts(hist, [F.col("value")] * hist.spec.ndim)
    df = parts.groupBy("addr").agg(
        *[F.sum(F.when(F.col("axis") == k, F.col("part")).otherwise(0.0)).alias(n) for k, n in enumerate(names)]
    )
    return Histogram(hist.spec, df, names).dense()


def divergence(grad: Histogram) -> Histogram:
    """Sum over axes of the derivative of component k along axis k."""
    if len(grad.values) != grad.spec.ndim:
        raise ValueError("a divergence needs one component per axis")
    parts = _parts(grad, [F.col(v) for v in grad.values])
    return Histogram(grad.spec, parts.groupBy("addr").agg(F.sum("part").alias("value"))).dense()


def laplacian(hist: Histogram) -> Histogram:
    """Sum over axes of second differences of a dense grid; at an open end the neighbour is mirrored."""
    spec, addr = hist.spec, F.col("addr")
    sends: list[Column] = []
    for axis, stride, i in zip(spec.axes, spec.strides, spec.index_of_address(addr)):
        n, unit = axis.bins, F.col("value") / F.lit(axis.width**2)
        part = lambda to, x: F.struct((addr + to * F.lit(stride)).alias("addr"), x.alias("part"))
        sends.append(part(F.lit(0), unit * -2.0))
        for step, last, wrapped, second in ((-1, 0, n - 1, 1), (1, n - 1, 1 - n, n - 2)):
            across = part(F.lit(wrapped), unit) if axis.periodic else F.lit(None)
            sends.append(F.when(i == last, across).otherwise(part(F.lit(step), unit * (F.lit(1.0) if axis.periodic else F.when(i == second, 2.0).otherwise(1.0)))))
    rows = hist.df.select(F.explode(F.array_compact(F.array(*sends))).alias("s")).select("s.addr", "s.part")
    return Histogram(spec, rows.groupBy("addr").agg(F.sum("part").alias("value")))
