"""One binned coordinate: its bounds, bin width and periodic boundary.

An ``Axis`` is a small value object on the driver.  Everything it does to data is
compiled to a ``Column`` whose constants are literals, so binning stays inside
whole-stage code generation and never leaves the JVM.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


def _half_even(x: float) -> int:
    """Nearest integer, ties to even (the rule used for every bin count)."""
    return int(round(x))


@dataclass(frozen=True)
class Axis:
    lower: float
    upper: float
    bins: int
    periodic: bool = False
    period_lower: float | None = None
    period_upper: float | None = None

    def __post_init__(self):
        if self.bins < 1 or not self.upper > self.lower:
            raise ValueError(f"an axis needs upper > lower and at least one bin: {self}")
        if self.period_lower is None:
            object.__setattr__(self, "period_lower", self.lower)
        if self.period_upper is None:
            object.__setattr__(self, "period_upper", self.upper)

    @classmethod
    def from_width(cls, lower: float, upper: float, width: float, periodic: bool = False) -> "Axis":
        return cls(float(lower), float(upper), _half_even((upper - lower) / width), periodic)

    # ---- properties -------------------------------------------------------
    @property
    def width(self) -> float:
        return (self.upper - self.lower) / self.bins

    @property
    def period(self) -> float:
        return self.period_upper - self.period_lower

    @property
    def real_periodic(self) -> bool:
        """True when the grid itself covers one whole period."""
        w = self.width
        return (
            self.periodic
            and abs(self.lower - self.period_lower) < w
            and abs(self.upper - self.period_upper) < w
        )

    def centers(self) -> list[float]:
        return [self.lower + (0.5 + i) * self.width for i in range(self.bins)]

    def edges(self) -> list[float]:
        return [self.lower + i * self.width for i in range(self.bins + 1)]

    # ---- editing ----------------------------------------------------------
    def with_period(self, periodic: bool, lower: float, upper: float) -> "Axis":
        return replace(self, periodic=periodic, period_lower=lower, period_upper=upper)

    def with_lower(self, lower: float) -> "Axis":
        """Move the lower bound, keeping the width: the bound snaps to a whole bin."""
        w = self.width
        bins = _half_even((self.upper - lower) / w)
        return replace(self, lower=self.upper - bins * w, bins=bins)

    def with_upper(self, upper: float) -> "Axis":
        w = self.width
        bins = _half_even((upper - self.lower) / w)
        return replace(self, upper=self.lower + bins * w, bins=bins)

    def with_width(self, width: float) -> "Axis":
        if width <= 0:
            raise ValueError("bin width must be positive")
        return replace(self, bins=_half_even((self.upper - self.lower) / width))

    # ---- Column expressions -----------------------------------------------
    def wrap(self, x: Column) -> Column:
        """Bring ``x`` into the period by whole periods.

        Values already inside the closed period stay; one lying an exact number of
        periods beyond a bound lands on that same bound (so this is not a modulus).
        """
        if not self.periodic:
            return x
        lo, hi, p = F.lit(self.period_lower), F.lit(self.period_upper), F.lit(self.period)
        return (
            F.when(x < lo, x + F.ceil((lo - x) / p) * p)
            .when(x > hi, x - F.ceil((x - hi) / p) * p)
            .otherwise(x)
        )

    def contains(self, x: Column) -> Column:
        """Closed range test after wrapping; NaN is outside, NULL stays NULL."""
        w = self.wrap(x)
        return (w >= F.lit(self.lower)) & (w <= F.lit(self.upper)) & ~F.isnan(x)

    def index(self, x: Column) -> Column:
        """Bin number of an in-range value; the upper bound belongs to the last bin."""
        k = F.floor((self.wrap(x) - F.lit(self.lower)) / F.lit(self.width))
        return F.least(k, F.lit(self.bins - 1)).cast("long")

    def center(self, i: Column) -> Column:
        return F.lit(self.lower) + (F.lit(0.5) + i) * F.lit(self.width)

    def distance(self, x: Column, ref: Column) -> Column:
        """``x - ref``, by the nearest periodic image; half a period keeps its sign."""
        if not self.periodic:
            return x - ref
        d = self.wrap(x) - self.wrap(ref)
        half, p = F.lit(self.period * 0.5), F.lit(self.period)
        return F.when(d > half, d - p).when(d < -half, d + p).otherwise(d)

    # ---- the same rules for single driver-side values -----------------------
    def wrap_value(self, x: float) -> float:
        if not self.periodic or self.period_lower <= x <= self.period_upper:
            return x
        if x < self.period_lower:
            return x + math.ceil((self.period_lower - x) / self.period) * self.period
        return x - math.ceil((x - self.period_upper) / self.period) * self.period

    def index_value(self, x: float) -> int | None:
        x = self.wrap_value(x)
        if not self.lower <= x <= self.upper:
            return None
        return min(math.floor((x - self.lower) / self.width), self.bins - 1)
