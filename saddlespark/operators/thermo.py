"""Free energy <-> probability, projection and reweighting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import GridSpec
from .histogram import Histogram, bounded, reduce_dimension


def to_probability(pmf: Histogram, kt: float) -> Histogram:
    """Boltzmann factor of every bin, not normalised."""
    return pmf.apply(lambda x: F.exp(-x / F.lit(kt)))


def from_probability(prob: Histogram, kt: float) -> Histogram:
    """Free energy of a normalised distribution, shifted so that its minimum is 0.

    Empty bins become +infinity.  A distribution without any weight gives zeros.
    """
    dense = prob.settled().df
    norm = dense.agg(F.sum("value")).scalar()
    top = dense.agg(F.max("value")).scalar()
    p = F.col("value")

    def energy(x: Column) -> Column:
        return F.lit(-kt) * F.ln(x / norm)

    df = dense.withColumn(
        "value",
        F.when(norm <= 0, F.lit(0.0)).when(p > 0, energy(p) - energy(top)).otherwise(F.lit(float("inf"))),
    )
    return Histogram(prob.spec, df)


def to_free_energy(prob: Histogram, kt: float) -> Histogram:
    """Free energy of raw weights, minimum 0; empty bins take the highest finite value."""
    f = prob.settled().df.withColumn("value", F.when(F.col("value") > 0, F.lit(-kt) * F.ln("value")))
    high = f.agg(F.coalesce(F.max("value"), F.lit(0.0))).scalar()
    low = f.agg(F.coalesce(F.min("value"), F.lit(0.0))).scalar()
    return Histogram(prob.spec, f.withColumn("value", F.coalesce(F.col("value"), high) - low))


def project(pmf: Histogram, dims: list[int], kt: float) -> Histogram:
    """Project a potential of mean force onto some of its axes."""
    return from_probability(reduce_dimension(to_probability(pmf, kt), dims), kt)


def reweight(
    traj: DataFrame, pmf: Histogram, source: list[Column], target_spec: GridSpec, target: list[Column], kt: float
) -> Histogram:
    """Histogram of a trajectory in which each row weighs ``exp(-F/kT)``.

    The weight depends on the source bin only.  Rows are therefore counted per pair of
    source and target bin before the potential is joined: the join sees bin pairs, not
    trajectory rows, and a hot bin has shrunk to a few rows by then.
    """
    origin = pmf.spec
    pairs = (
        traj.filter(origin.contains(source) & target_spec.contains(target))
        .select(
            origin.address_of_index(origin.indexes(source)).alias("_from"),
            target_spec.address_of_index(target_spec.indexes(target)).alias("addr"),
        )
        .groupBy("_from", "addr")
        .agg(F.count("*").alias("_n"))
    )
    side = pmf.df.select(F.col("addr").alias("_from"), F.col("value").alias("_f"))
    weight = F.col("_n") * F.exp(-F.coalesce(F.col("_f"), F.lit(0.0)) / F.lit(kt))
    df = pairs.join(bounded(side, pmf.spec), "_from", "left").groupBy("addr").agg(F.sum(weight).alias("value"))
    return Histogram(target_spec, df)
