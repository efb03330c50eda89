"""Gridded histograms as DataFrames.

A ``Histogram`` couples a ``GridSpec`` with a DataFrame of ``addr`` and one or more
value columns.  Rows may be sparse: a bin without a row holds 0, as in a dense array
of zeros.  Binning is a plain ``groupBy(addr)``, so partial aggregation reduces every
input partition to at most one row per bin before anything is shuffled; one hot bin
therefore costs no more than a cold one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import GridSpec
from ..session import materialize

# A grid of at most this many bins may be broadcast: the size is known from its
# axes alone (about 16 bytes a bin and value), so the bound holds for any input.
BROADCAST_BINS = 1 << 18


@dataclass(frozen=True)
class Histogram:
    spec: GridSpec
    df: DataFrame
    values: tuple[str, ...] = ("value",)

    # ---- shapes ------------------------------------------------------------
    def dense(self) -> "Histogram":
        """One row per bin of the grid, with 0 where there was none."""
        spark = self.df.sparkSession
        rows = spark.range(self.spec.size).select(F.col("id").alias("addr"))
        df = rows.join(bounded(self.df.select("addr", *self.values), self.spec), "addr", "left")
        return Histogram(self.spec, df.fillna(0.0, subset=list(self.values)), self.values)

    def settled(self) -> "Histogram":
        """The dense grid, computed once and kept in the shared folder.

        A grid is small beside the rows it was binned from; steps that read it more than
        once must not bin those rows again.
        """
        return Histogram(self.spec, materialize(self.dense().df), self.values)

    def table(self) -> DataFrame:
        """Dense rows with bin numbers, bin centres and values."""
        d = self.dense()
        return self.spec.with_coords(d.df).select(
            "addr", *self.spec.index_names, *self.spec.coord_names, *self.values
        )

    def ordered(self) -> DataFrame:
        """Rows in file order: the last axis varies fastest."""
        return self.table().orderBy(*self.spec.index_names)

    # ---- point access --------------------------------------------------------
    def at(self, addr: int) -> DataFrame:
        """The value stored at one address."""
        return self.dense().df.filter(F.col("addr") == F.lit(addr))

    def set(self, position: list[float], *value: float) -> "Histogram":
        """Assign one bin; a position outside the grid changes nothing."""
        addr = self.spec.address_value(position)
        if addr is None:
            return self
        d = self.dense()
        return d.with_values(
            {v: F.when(F.col("addr") == F.lit(addr), F.lit(float(x))).otherwise(F.col(v)) for v, x in zip(d.values, value)}
        )

    def with_values(self, exprs: dict[str, Column]) -> "Histogram":
        return Histogram(self.spec, self.df.withColumns(exprs), self.values)

    def apply(self, f: Callable[[Column], Column]) -> "Histogram":
        """Map every bin value.  ``f`` builds a Column, or is a pandas UDF."""
        d = self.dense()
        return d.with_values({v: f(F.col(v)) for v in d.values})

    # ---- reductions ----------------------------------------------------------
    def sum(self) -> DataFrame:
        return self.df.agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(v) for v in self.values])

    def minimum(self) -> DataFrame:
        return self.dense().df.agg(*[F.min(v).alias(v) for v in self.values])

    def extent(self) -> DataFrame:
        """Lowest and highest finite value, the range a plot of the grid needs."""
        v = F.col(self.values[0])
        finite = F.when(F.abs(v) < F.lit(float("inf")), v)
        return self.dense().df.agg(F.min(finite).alias("minimum"), F.max(finite).alias("maximum"))

    def merge(self, other: "Histogram") -> "Histogram":
        """Add another histogram, re-binned by the centres of its bins."""
        spec = self.spec
        if other.spec == spec:
            moved = other.df.select("addr", *other.values)
        else:
            centers = other.spec.position(F.col("addr"))
            moved = other.df.select(spec.address(centers).alias("addr"), *other.values).filter(F.col("addr").isNotNull())
        both = self.df.select("addr", *self.values).union(moved)
        return Histogram(spec, both.groupBy("addr").agg(*[F.sum(v).alias(v) for v in self.values]), self.values)


def bounded(df: DataFrame, spec: GridSpec) -> DataFrame:
    """Mark a one-row-per-bin side for broadcast if its grid is small enough.

    Larger grids are left to a shuffled join, which adaptive execution splits where
    one bin is hot.
    """
    return F.broadcast(df) if spec.size <= BROADCAST_BINS else df


def generate(spark: SparkSession, spec: GridSpec, *f: Callable[..., Column]) -> Histogram:
    """Fill a grid from functions of the bin centre, one per value column."""
    names = ("value",) if len(f) == 1 else tuple(f"v{k}" for k in range(len(f)))
    coords = [F.col(c) for c in spec.coord_names]
    pts = spec.points(spark)
    return Histogram(spec, pts.select("addr", *[g(*coords).cast("double").alias(n) for n, g in zip(names, f)]), names)


def address_rows(df: DataFrame, spec: GridSpec, coords: list[Column], *keep: Column) -> DataFrame:
    """``addr`` plus chosen columns for the rows that lie inside the grid.

    The range test is a plain filter, so for a non-periodic axis it reaches the scan.
    """
    inside = df.filter(spec.contains(coords))
    return inside.select(spec.address_of_index(spec.indexes(coords)).alias("addr"), *keep)


def bin_count(df: DataFrame, spec: GridSpec, coords: list[Column]) -> Histogram:
    rows = address_rows(df, spec, coords)
    return Histogram(spec, rows.groupBy("addr").agg(F.count("*").cast("double").alias("value")))


def bin_sum(df: DataFrame, spec: GridSpec, coords: list[Column], values: dict[str, Column]) -> Histogram:
    rows = address_rows(df, spec, coords, *[c.alias(n) for n, c in values.items()])
    agg = rows.groupBy("addr").agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in values])
    return Histogram(spec, agg, tuple(values))


def bin_mean(df: DataFrame, spec: GridSpec, coords: list[Column], values: dict[str, Column], count_all: bool = False) -> Histogram:
    """Mean of each value per bin; an empty bin holds 0.

    A row whose value is NULL (no log entry for it) counts neither to the sum nor to
    the number of samples, unless ``count_all`` asks for the diluted mean.
    """
    rows = address_rows(df, spec, coords, *[c.alias(n) for n, c in values.items()])
    mean = (lambda n: F.sum(n) / F.count("*")) if count_all else F.mean
    agg = rows.groupBy("addr").agg(*[F.coalesce(mean(n), F.lit(0.0)).alias(n) for n in values])
    return Histogram(spec, agg, tuple(values))


def lookup(df: DataFrame, hist: Histogram, coords: list[Column], outside: float | None = 0.0) -> DataFrame:
    """Add the histogram value at each row's position.

    Rows outside the grid get ``outside``; empty bins inside hold 0.
    """
    spec = hist.spec
    # A row outside the grid has no bin.  It gets a negative address spread by hash, so
    # that such rows do not all meet in one shuffle partition.
    away = F.lit(-1) - F.pmod(F.xxhash64(*coords), F.lit(4096))
    keyed = df.withColumn("_addr", F.coalesce(spec.address(coords), away))
    side = hist.df.select(F.col("addr").alias("_addr"), *hist.values)
    joined = keyed.join(bounded(side, spec), "_addr", "left")
    inside = F.col("_addr") >= 0
    fill = {v: F.when(inside, F.coalesce(F.col(v), F.lit(0.0))).otherwise(F.lit(outside).cast("double")) for v in hist.values}
    return joined.withColumns(fill).drop("_addr")


def reduce_dimension(hist: Histogram, dims: list[int]) -> Histogram:
    """Sum over all axes but ``dims``; ``dims`` may also reorder the axes."""
    target = hist.spec.select(dims)
    idx = hist.spec.index_of_address(F.col("addr"))
    addr = target.address_of_index([idx[d] for d in dims])
    rows = hist.df.select(addr.alias("addr"), *hist.values)
    return Histogram(target, rows.groupBy("addr").agg(*[F.sum(v).alias(v) for v in hist.values]), hist.values)
