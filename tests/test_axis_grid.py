import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from saddlespark.functions.axis import Axis
from saddlespark.functions.grid import GridSpec


def column(spark, values, f):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    return [r[0] for r in df.select(f(F.col("x"))).collect()]


def test_wrap_keeps_the_bound_a_value_is_a_whole_period_beyond(spark):
    ax = Axis(-180.0, 180.0, 4, True)
    xs = [540, 900, -540, -900, 180, -180, 181, -181, 0, 725]
    assert column(spark, xs, ax.wrap) == [180, 180, -180, -180, 180, -180, -179, 179, 0, 5]
    assert [ax.wrap_value(x) for x in xs] == column(spark, xs, ax.wrap)


def test_range_is_closed_and_nan_is_outside(spark):
    ax = Axis(0.0, 1.0, 4)
    assert column(spark, [0, 1, -1e-9, 1.0000001, math.nan, 0.5], ax.contains) == [True, True, False, False, False, True]
    assert column(spark, [0, 0.25, 0.99, 1.0], ax.index) == [0, 1, 3, 3]


def test_distance_takes_the_nearest_image_and_half_a_period_keeps_its_sign(spark):
    ax = Axis(-180.0, 180.0, 4, True)
    df = spark.createDataFrame([(170.0, -170.0), (-170.0, 170.0), (90.0, -90.0), (-90.0, 90.0), (10.0, 4.0)], "x double, r double")
    got = [r[0] for r in df.select(ax.distance(F.col("x"), F.col("r"))).collect()]
    assert got == [-20.0, 20.0, 180.0, -180.0, 6.0]


def test_real_periodic_needs_the_grid_to_cover_the_period():
    assert Axis(0.0, 6.0, 6, True).real_periodic
    assert not Axis(0.0, 3.0, 6, True).with_period(True, 0.0, 6.0).real_periodic
    assert not Axis(0.0, 6.0, 6).real_periodic


def test_axis_editing_rounds_half_to_even_and_snaps_bounds():
    ax = Axis(0.0, 10.0, 10)
    assert ax.with_lower(-1.4) == Axis(-1.0, 10.0, 11, False, 0.0, 10.0)
    assert ax.with_upper(12.5).bins == 12 and ax.with_upper(12.5).upper == 12.0
    assert ax.with_width(3.0).bins == 3
    assert Axis.from_width(0, 5, 2).bins == 2  # 2.5 rounds to even
    with pytest.raises(ValueError):
        ax.with_width(0)


def test_addresses_count_with_axis_0_fastest_and_come_back(spark):
    spec = GridSpec.of(Axis(0.0, 3.0, 3), Axis(-1.0, 1.0, 4, True), Axis(5.0, 6.0, 2))
    assert spec.strides == (1, 3, 12) and spec.size == 24
    rows = spec.points(spark).withColumn("back", spec.address([F.col(c) for c in spec.coord_names])).collect()
    assert len(rows) == 24 and all(r.addr == r.back for r in rows)
    for r in rows:
        assert r.addr == r.i0 + 3 * r.i1 + 12 * r.i2
        assert spec.position_value(r.addr) == pytest.approx([r.x0, r.x1, r.x2])
        assert spec.address_value([r.x0, r.x1, r.x2]) == r.addr
    out = spark.range(1).select(*spec.position(F.lit(24))).first()
    assert list(out) == [None] * 3


def test_outside_addresses_are_null(spark):
    spec = GridSpec.of(Axis(0.0, 1.0, 2), Axis(0.0, 1.0, 2))
    df = spark.createDataFrame([(0.5, 1.0), (1.5, 0.5), (0.5, math.nan)], "a double, b double")
    assert [r[0] for r in df.select(spec.address([F.col("a"), F.col("b")])).collect()] == [3, None, None]


def test_neighbors_match_brute_force(spark):
    spec = GridSpec.of(Axis(0.0, 3.0, 3), Axis(0.0, 4.0, 4, True), Axis(0.0, 2.0, 2))
    cols = [c.alias(f"n{j}") for j, (_, _, c) in enumerate(spec.neighbors(F.col("addr")))]
    got = {r[0]: list(r)[1:] for r in spec.points(spark).select("addr", *cols).collect()}
    bins = [a.bins for a in spec.axes]
    for idx in itertools.product(*(range(b) for b in bins)):
        want = []
        for k, ax in enumerate(spec.axes):
            for step in (-1, 1):
                j = list(idx)
                j[k] += step
                if ax.periodic:
                    j[k] %= bins[k]
                want.append(sum(a * s for a, s in zip(j, spec.strides)) if 0 <= j[k] < bins[k] else None)
        assert got[sum(a * s for a, s in zip(idx, spec.strides))] == want


def test_spec_survives_json():
    spec = GridSpec.of(Axis(0.0, 1.0, 7), Axis(-3.0, 3.0, 6, True).with_period(True, -4.0, 4.0))
    assert GridSpec.from_json(spec.to_json()) == spec


def test_column_and_value_forms_agree_on_random_values(spark):
    rnd = random.Random(5)
    for ax in (Axis(-2.0, 3.0, 7, True), Axis(-1.0, 1.0, 5, True).with_period(True, -2.0, 2.0), Axis(0.0, 1.0, 3)):
        xs = [rnd.uniform(-20, 20) for _ in range(200)]
        df = spark.createDataFrame([(x,) for x in xs], "x double")
        spec = GridSpec.of(ax)
        got = [r[0] for r in df.select(spec.address([F.col("x")])).collect()]
        assert got == [ax.index_value(x) for x in xs]
