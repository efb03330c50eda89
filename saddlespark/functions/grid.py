"""An N-dimensional grid of bins and its address arithmetic.

Addresses count with axis 0 fastest; files list points with the last axis fastest.
A ``GridSpec`` holds axes only.  Its points are produced by ``spark.range``, so
even a very large grid is enumerated in parallel without a join.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .axis import Axis


@dataclass(frozen=True)
class GridSpec:
    axes: tuple[Axis, ...]

    @classmethod
    def of(cls, *axes: Axis) -> "GridSpec":
        return cls(tuple(axes))

    # ---- metadata ---------------------------------------------------------
    @property
    def ndim(self) -> int:
        return len(self.axes)

    @property
    def size(self) -> int:
        return math.prod(a.bins for a in self.axes)

    @property
    def strides(self) -> tuple[int, ...]:
        out, acc = [], 1
        for a in self.axes:
            out.append(acc)
            acc *= a.bins
        return tuple(out)

    @property
    def index_names(self) -> list[str]:
        return [f"i{k}" for k in range(self.ndim)]

    @property
    def coord_names(self) -> list[str]:
        return [f"x{k}" for k in range(self.ndim)]

    def select(self, dims: list[int]) -> "GridSpec":
        bad = [d for d in dims if not 0 <= d < self.ndim]
        if bad or not dims or len(set(dims)) != len(dims):
            raise ValueError(f"axes {dims} are not distinct axes of a {self.ndim}-D grid")
        return GridSpec(tuple(self.axes[d] for d in dims))

    def to_json(self) -> str:
        return json.dumps([asdict(a) for a in self.axes])

    @classmethod
    def from_json(cls, text: str) -> "GridSpec":
        return cls(tuple(Axis(**a) for a in json.loads(text)))

    # ---- Column expressions -------------------------------------------------
    def _check(self, cols: list) -> None:
        if len(cols) != self.ndim:
            raise ValueError(f"{len(cols)} coordinates given for a {self.ndim}-D grid")

    def contains(self, coords: list[Column]) -> Column:
        self._check(coords)
        return reduce(lambda a, b: a & b, (a.contains(x) for a, x in zip(self.axes, coords)))

    def indexes(self, coords: list[Column]) -> list[Column]:
        self._check(coords)
        return [a.index(x) for a, x in zip(self.axes, coords)]

    def address_of_index(self, idx: list[Column]) -> Column:
        self._check(idx)
        return reduce(lambda a, b: a + b, (i * F.lit(s) for i, s in zip(idx, self.strides))).cast("long")

    def address(self, coords: list[Column]) -> Column:
        """Flat address, NULL for a position outside the grid."""
        return F.when(self.contains(coords), self.address_of_index(self.indexes(coords)))

    def index_of_address(self, addr: Column) -> list[Column]:
        return [_div_mod(addr, s, a.bins) for a, s in zip(self.axes, self.strides)]

    def position(self, addr: Column) -> list[Column]:
        """Bin centre of an address; NULL when the address is not on the grid."""
        ok = (addr >= 0) & (addr < F.lit(self.size))
        return [F.when(ok, a.center(i)) for a, i in zip(self.axes, self.index_of_address(addr))]

    # ---- driver-side helpers -------------------------------------------------
    def address_value(self, position: list[float]) -> int | None:
        self._check(position)
        idx = [a.index_value(x) for a, x in zip(self.axes, position)]
        if any(i is None for i in idx):
            return None
        return sum(i * s for i, s in zip(idx, self.strides))

    def position_value(self, addr: int) -> list[float]:
        return [
            a.lower + (0.5 + (addr // s) % a.bins) * a.width for a, s in zip(self.axes, self.strides)
        ]

    # ---- DataFrames -----------------------------------------------------------
    def points(self, spark: SparkSession) -> DataFrame:
        """Every bin: ``addr, i0.., x0..``."""
        return self.with_coords(spark.range(self.size).select(F.col("id").alias("addr")))

    def with_coords(self, df: DataFrame, addr: str = "addr") -> DataFrame:
        """Add ``i0..`` and ``x0..`` next to an address column."""
        a = F.col(addr)
        df = df.withColumns(dict(zip(self.index_names, self.index_of_address(a))))
        return df.withColumns(
            {n: ax.center(F.col(i)) for n, i, ax in zip(self.coord_names, self.index_names, self.axes)}
        )

    def neighbors(self, addr: Column) -> list[tuple[int, bool, Column]]:
        """``(axis, is_previous, address or NULL)`` in the order previous, next per axis.

        Neighbours wrap on every periodic axis, whatever part of the period the
        grid covers.
        """
        out = []
        for k, (ax, s) in enumerate(zip(self.axes, self.strides)):
            i = _div_mod(addr, s, ax.bins)
            last = ax.bins - 1
            wrap_prev = addr + F.lit(last * s) if ax.periodic else F.lit(None).cast("long")
            wrap_next = addr - F.lit(last * s) if ax.periodic else F.lit(None).cast("long")
            out.append((k, True, F.when(i == 0, wrap_prev).otherwise(addr - F.lit(s))))
            out.append((k, False, F.when(i == last, wrap_next).otherwise(addr + F.lit(s))))
        return out


def _div_mod(addr: Column, stride: int, bins: int) -> Column:
    """``(addr // stride) % bins``; the quotient is exact below 2**53 addresses."""
    q = addr if stride == 1 else F.floor(addr / F.lit(stride))
    return (q % F.lit(bins)).cast("long")
