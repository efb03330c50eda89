"""Sum of Gaussian hills: potential of mean force and its gradient.

Each hill is expanded to just the bins its Gaussian can reach, by bin arithmetic, and
the contributions are added per bin.  There is no join with the grid: hills stream
through, partial aggregation keeps one row per touched bin and task, and the shuffle
carries at most (tasks x bins) rows however many hills there are.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.axis import Axis
from ..functions.grid import GridSpec
from ..session import materialize
from .histogram import Histogram
from .ordered import explode_range, running_sum

# Fixed value: a Gaussian whose exponent reaches this counts as 0.
EXPONENT_CUTOFF = 100.0


def _covers_period(axis: Axis) -> bool:
    return axis.real_periodic and abs(axis.bins * axis.width - axis.period) <= 1e-9 * axis.period


def _touched(axis: Axis, center: Column, sigma: Column) -> Column:
    """Bins along one axis within reach of a hill (a superset by a bin or so).

    ``center`` is wrapped already.  On an axis that covers its period the numbers run
    beyond the ends and are to be taken modulo the number of bins.
    """
    n, w = axis.bins, axis.width
    every = F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    if axis.periodic and not _covers_period(axis):
        return every  # only part of the period is on the grid: the distance decides
    reach = F.abs(sigma) * F.lit(math.sqrt(2.0 * EXPONENT_CUTOFF))
    first = F.floor((center - reach - F.lit(axis.lower)) / F.lit(w)) - 1
    last = F.floor((center + reach - F.lit(axis.lower)) / F.lit(w)) + 1
    if axis.periodic:
        return F.when(last - first + 1 >= n, every).otherwise(F.sequence(first, F.greatest(first, last)))
    first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit(n - 1))
    return F.when(first <= last, F.sequence(first, F.greatest(first, last)))


def hill_terms(hills: DataFrame, spec: GridSpec, keep: list[str]) -> DataFrame:
    """One row per hill and touched bin: ``addr, energy, g0..`` plus ``keep`` columns.

    ``hills`` has columns ``c0.., s0.., height``.
    """
    n = spec.ndim
    ready = [a.wrap(F.col(f"c{k}")).alias(f"c{k}") for k, a in enumerate(spec.axes)]
    df = hills.select(*keep, "height", *ready, *[f"s{k}" for k in range(n)])
    for k, axis in enumerate(spec.axes):
        c, s = F.col(f"c{k}"), F.col(f"s{k}")
        # The range is built inside explode and no filter follows: the optimizer would
        # copy a filter's expression, and a named array, below this step and evaluate
        # them twice.  Bins beyond the cutoff add 0 instead.
        df = df.withColumn("_j", F.explode(_touched(axis, c, s)))
        i = F.pmod(F.col("_j"), F.lit(axis.bins)) if _covers_period(axis) else F.col("_j")
        df = df.withColumn(f"_i{k}", i).drop("_j")
        # bin centres outside the period occur only on a grid that is larger than it
        x = axis.center(F.col(f"_i{k}"))
        inside = not axis.periodic or (axis.period_lower <= axis.lower and axis.upper <= axis.period_upper)
        df = df.withColumn(f"_d{k}", (x if inside else axis.wrap(x)) - c)
        if axis.periodic:
            d, half, p = F.col(f"_d{k}"), F.lit(axis.period * 0.5), F.lit(axis.period)
            df = df.withColumn(f"_d{k}", F.when(d > half, d - p).when(d < -half, d + p).otherwise(d))
        df = df.withColumn(f"_r{k}", F.col(f"_d{k}") / (s * s))
    q = reduce(lambda a, b: a + b, (F.lit(0.5) * F.col(f"_d{k}") * F.col(f"_r{k}") for k in range(n)))
    addr = spec.address_of_index([F.col(f"_i{k}") for k in range(n)])
    df = df.select(*keep, addr.alias("addr"), "height", q.alias("_q"), *[f"_r{k}" for k in range(n)])
    energy = F.when(F.col("_q") < F.lit(EXPONENT_CUTOFF), F.col("height") * F.exp(-F.col("_q"))).otherwise(F.lit(0.0))
    df = df.withColumn("energy", energy)
    return df.select(*keep, "addr", "energy", *[(-F.col(f"_r{k}") * F.col("energy")).alias(f"g{k}") for k in range(n)])


def _names(spec: GridSpec) -> tuple[str, ...]:
    return ("value", *[f"g{k}" for k in range(spec.ndim)])


def _totals(terms: DataFrame, spec: GridSpec, keys: list[str]) -> DataFrame:
    return terms.groupBy(*keys, "addr").agg(
        (-F.sum("energy")).alias("value"), *[(-F.sum(f"g{k}")).alias(f"g{k}") for k in range(spec.ndim)]
    )


def sum_hills(hills: DataFrame, spec: GridSpec) -> Histogram:
    """PMF (``value``) and gradient (``g0..``) of all hills: minus the bias they build."""
    return Histogram(spec, _totals(hill_terms(hills, spec, []), spec, []), _names(spec))


def well_tempered(hist: Histogram, bias_temperature: float, temperature: float) -> Histogram:
    """Scale PMF and gradient from the bias of a well-tempered run."""
    factor = (bias_temperature + temperature) / bias_temperature
    return hist.with_values({v: F.col(v) * F.lit(factor) for v in hist.values})


def snapshots(hills: DataFrame, spec: GridSpec, stride: int, order: str = "row") -> DataFrame:
    """Running PMF and gradient after every hill whose step is a multiple of ``stride``.

    ``hills`` also needs ``step`` and a whole-number ``order`` column (the row in the
    file).  Result: ``snapshot`` (0, 1, ..), ``step``, ``addr`` and the values, dense.
    Hills after the last snapshot belong to none.
    """
    hit = (F.col("step") > 0) & (F.col("step") % F.lit(stride) == 0)
    # the hills are read twice rather than copied; what is kept has at most one row per snapshot and bin
    marked = running_sum(hills, [], order, {"snapshot": hit.cast("long")}, inclusive=False, levels=2)
    ends = marked.filter(hit).select("snapshot", "step")
    parts = materialize(_totals(hill_terms(marked, spec, ["snapshot"]), spec, ["snapshot"]))
    names = _names(spec)
    cells = explode_range(ends, F.lit(0), F.lit(spec.size), "addr")
    full = cells.join(parts, ["snapshot", "addr"], "left").fillna(0.0, subset=list(names))
    full = running_sum(full, ["addr"], "snapshot", {v: F.col(v) for v in names})
    return full.select("snapshot", "step", "addr", *names)

