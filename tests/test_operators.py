import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from saddlespark.functions.axis import Axis
from saddlespark.functions.grid import GridSpec
from saddlespark.functions.units import numbers, parse_numbers, thermal_energy
from saddlespark.operators import hills as H
from saddlespark.operators import histogram as B
from saddlespark.operators import ordered, poisson, stencil, thermo
from saddlespark.operators.histogram import Histogram
from saddlespark.operators.patches import Patch, apply_patch_table, apply_patches, patch_field

SPEC = GridSpec.of(Axis(0.0, 4.0, 4), Axis(-180.0, 180.0, 6, True))


def filled(spark, spec, seed=1, comps=1):
    rnd = random.Random(seed)
    names = ("value",) if comps == 1 else tuple(f"g{k}" for k in range(comps))
    rows = [(a, *[rnd.uniform(-2, 3) for _ in names]) for a in range(spec.size)]
    schema = "addr long, " + ", ".join(f"{n} double" for n in names)
    return Histogram(spec, spark.createDataFrame(rows, schema), names)


def dense(h, value=None):
    """Array indexed [i0, i1, ..]."""
    rows = {r.addr: r[value or h.values[0]] for r in h.dense().df.collect()}
    flat = np.array([rows[a] for a in range(h.spec.size)])
    return flat.reshape([a.bins for a in h.spec.axes], order="F")


@pytest.fixture(scope="module")
def points(spark):
    rnd = random.Random(2)
    rows = [(rnd.uniform(-0.5, 4.5), rnd.uniform(-500, 500), rnd.uniform(0, 1), k) for k in range(500)]
    rows += [(4.0, 180.0, 1.0, 500), (0.0, 540.0, 1.0, 501), (float("nan"), 0.0, 1.0, 502)]
    return rows, spark.createDataFrame(rows, "a double, b double, v double, k long")


def test_binning_matches_a_loop(spark, points):
    rows, df = points
    xy = [F.col("a"), F.col("b")]
    n, s = np.zeros((4, 6)), np.zeros((4, 6))
    for a, b, v, _ in rows:
        i, j = SPEC.axes[0].index_value(a), SPEC.axes[1].index_value(b)
        if i is not None and j is not None:
            n[i, j] += 1
            s[i, j] += v
    assert (dense(B.bin_count(df, SPEC, xy)) == n).all()
    assert dense(B.bin_sum(df, SPEC, xy, {"value": F.col("v")})) == pytest.approx(s)
    mean = np.divide(s, n, out=np.zeros_like(s), where=n > 0)
    assert dense(B.bin_mean(df, SPEC, xy, {"value": F.col("v")})) == pytest.approx(mean)


def test_missing_values_do_not_dilute_means_unless_asked(spark):
    df = spark.createDataFrame([(0.5, 1.0), (0.5, None)], "x double, v double")
    spec = GridSpec.of(Axis(0.0, 1.0, 1))
    assert dense(B.bin_mean(df, spec, [F.col("x")], {"value": F.col("v")}))[0] == 1.0
    assert dense(B.bin_mean(df, spec, [F.col("x")], {"value": F.col("v")}, count_all=True))[0] == 0.5


def test_grid_reductions_and_point_access(spark):
    h = filled(spark, SPEC)
    a = dense(h)
    assert h.sum().first()[0] == pytest.approx(a.sum()) and h.minimum().first()[0] == a.min()
    assert h.at(5).first().value == a[1, 1]
    s = h.set([3.5, -170.0], 9.0)
    assert dense(s)[3, 0] == 9.0 and (dense(s) != a).sum() == 1
    assert h.set([5.0, 0.0], 1.0) is h
    assert dense(h.apply(lambda x: x * 2)) == pytest.approx(a * 2)
    sparse = Histogram(SPEC, h.df.filter("addr < 3"))
    assert sparse.minimum().first()[0] == min(0.0, a.flatten(order="F")[:3].min())


def test_pandas_functions_can_map_bins(spark):
    h = filled(spark, SPEC)
    cube = F.pandas_udf(lambda s: s**3, "double")
    assert dense(h.apply(cube)) == pytest.approx(dense(h) ** 3)


def test_lookup_gives_zero_or_blank_outside(spark, points):
    rows, df = points
    h = filled(spark, SPEC)
    a = dense(h)
    for outside in (0.0, None):
        got = {r.k: r.value for r in B.lookup(df, h, [F.col("a"), F.col("b")], outside).collect()}
        for x, y, _, k in rows:
            i, j = SPEC.axes[0].index_value(x), SPEC.axes[1].index_value(y)
            assert got[k] == (outside if i is None or j is None else a[i, j])


def test_merge_adds_by_bin_centre(spark):
    fine = GridSpec.of(Axis(0.0, 8.0, 16), Axis(-180.0, 180.0, 12, True))
    h, g = filled(spark, SPEC), filled(spark, fine, 3)
    want = dense(h).copy()
    b = dense(g)
    for i, j in itertools.product(range(16), range(12)):
        x, y = fine.axes[0].centers()[i], fine.axes[1].centers()[j]
        p = SPEC.address_value([x, y])
        if p is not None:
            want[p % 4, p // 4] += b[i, j]
    assert dense(h.merge(g)) == pytest.approx(want)
    assert dense(h.merge(h)) == pytest.approx(2 * dense(h))


def test_projection_permutes_and_composes(spark):
    spec = GridSpec.of(Axis(0.0, 3.0, 3), Axis(0.0, 2.0, 2), Axis(0.0, 4.0, 4, True))
    h, kt = filled(spark, spec), 0.6
    p = np.exp(-dense(h) / kt)
    def pmf(q):
        f = -kt * np.log(q / q.sum())
        return f - f.min()
    two = thermo.project(h, [2, 0], kt)
    assert two.spec.axes == (spec.axes[2], spec.axes[0])
    assert dense(two) == pytest.approx(pmf(p.sum(axis=1).T))
    assert dense(thermo.project(two, [1], kt)) == pytest.approx(pmf(p.sum(axis=(1, 2))))
    for bad in ([], [3], [0, 0]):
        with pytest.raises(ValueError):
            thermo.project(h, bad, kt)


def test_empty_bins_are_infinite_or_take_the_maximum(spark):
    spec = GridSpec.of(Axis(0.0, 3.0, 3))
    p = Histogram(spec, spark.createDataFrame([(0, 1.0), (1, 3.0)], "addr long, value double"))
    f = dense(thermo.from_probability(p, 1.0))
    assert f[0] == pytest.approx(math.log(3)) and f[1] == 0.0 and f[2] == math.inf
    assert dense(thermo.to_free_energy(p, 1.0)) == pytest.approx([math.log(3), 0.0, math.log(3)])
    none = Histogram(spec, p.df.filter("addr > 5"))
    assert (dense(thermo.from_probability(none, 1.0)) == 0).all() and (dense(thermo.to_free_energy(none, 1.0)) == 0).all()


def test_reweighting_matches_a_loop(spark, points):
    rows, df = points
    h, kt = filled(spark, SPEC), 0.7
    a, target = dense(h), GridSpec.of(Axis(0.0, 1.0, 5))
    want = np.zeros(5)
    for x, y, v, _ in rows:
        i, j, t = SPEC.axes[0].index_value(x), SPEC.axes[1].index_value(y), target.axes[0].index_value(v)
        if None not in (i, j, t):
            want[t] += math.exp(-a[i, j] / kt)
    got = thermo.reweight(df, h, [F.col("a"), F.col("b")], target, [F.col("v")], kt)
    assert dense(got) == pytest.approx(want)


def first_derivative(a, axis, ax):
    out = np.zeros_like(a)
    n, w = ax.bins, ax.width
    v, o = np.moveaxis(a, axis, 0), np.moveaxis(out, axis, 0)
    for i in range(n):
        if ax.real_periodic:
            o[i] = (v[(i + 1) % n] - v[i - 1]) / (2 * w)
        elif i == 0:
            o[i] = (-v[2] + 4 * v[1] - 3 * v[0]) / (2 * w)
        elif i == n - 1:
            o[i] = (3 * v[i] - 4 * v[i - 1] + v[i - 2]) / (2 * w)
        else:
            o[i] = (v[i + 1] - v[i - 1]) / (2 * w)
    return out


@pytest.mark.parametrize("bins", [3, 4, 7])
def test_derivative_and_divergence(spark, bins):
    spec = GridSpec.of(Axis(0.0, 2.0, bins), Axis(-180.0, 180.0, 5, True), Axis(0.0, 1.0, 4, True).with_period(True, 0.0, 9.0))
    h = filled(spark, spec)
    d = stencil.derivative(h)
    for k, ax in enumerate(spec.axes):
        assert dense(d, f"d{k}") == pytest.approx(first_derivative(dense(h), k, ax), abs=1e-9)
    g = filled(spark, spec, 8, 3)
    want = sum(first_derivative(dense(g, f"g{k}"), k, ax) for k, ax in enumerate(spec.axes))
    assert dense(stencil.divergence(g)) == pytest.approx(want, abs=1e-9)
    with pytest.raises(ValueError):
        stencil.derivative(filled(spark, GridSpec.of(Axis(0.0, 1.0, 2))))


def laplace_solution(grad, spec):
    """Least squares with the whole matrix."""
    shape = [a.bins for a in spec.axes]
    n = spec.size
    A, b = np.zeros((n, n)), np.zeros(n)
    div = sum(first_derivative(g, k, ax) for k, (g, ax) in enumerate(zip(grad, spec.axes)))
    for idx in itertools.product(*map(range, shape)):
        row = np.ravel_multi_index(idx, shape)
        half = 1.0
        b[row] = div[idx]
        for k, ax in enumerate(spec.axes):
            near = []
            for s in (-1, 1):
                j = list(idx)
                j[k] += s
                if ax.periodic:
                    j[k] %= shape[k]
                near.append(np.ravel_multi_index(j, shape) if 0 <= j[k] < shape[k] else None)
            for s in (0, 1):
                at = near[s] if near[s] is not None else near[1 - s]
                A[row, at] += 1 / ax.width**2
                A[row, row] -= 1 / ax.width**2
                if near[s] is None:
                    b[row] += (2 if s == 0 else -2) * grad[k][idx] / ax.width
                    half *= 0.5
        A[row] *= half
        b[row] *= half
    u = np.linalg.lstsq(A, b, rcond=None)[0]
    return (u - u.min()).reshape(shape)


@pytest.mark.parametrize(
    "spec",
    [
        GridSpec.of(Axis(0.0, 2.0, 6)),
        GridSpec.of(Axis(-1.0, 1.0, 5, True)),
        GridSpec.of(Axis(0.0, 2.0, 5), Axis(-180.0, 180.0, 6, True)),
        GridSpec.of(Axis(0.0, 1.0, 4), Axis(0.0, 1.0, 3), Axis(0.0, 1.0, 4, True)),
    ],
)
def test_integration_matches_dense_least_squares(spark, spec):
    g = filled(spark, spec, 4, spec.ndim) if spec.ndim > 1 else Histogram(spec, filled(spark, spec, 4).df, ("value",))
    want = laplace_solution([dense(g, v) for v in g.values], spec)
    assert dense(poisson.integrate(g)) == pytest.approx(want, rel=1e-8, abs=1e-8)
    solved = Histogram(spec, spark.createDataFrame([(k, float(v)) for k, v in enumerate(want.ravel(order="F"))], "addr long, value double"))
    rhs = poisson.laplacian_rows(g).withColumn("value", F.col("rhs"))
    mean = rhs.agg(F.avg(F.col("rhs") * F.col("half"))).scalar()
    left = Histogram(spec, rhs.select("addr", (F.col("rhs") - mean / F.col("half")).alias("value")))
    assert dense(stencil.laplacian(solved)) == pytest.approx(dense(left), rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("length", [1, 2, 7, 12, 97, 131, 360, 1009])
def test_fourier_transform_of_lines(spark, length):
    rng = np.random.default_rng(length)
    x = rng.normal(size=(3, length)) + 1j * rng.normal(size=(3, length))
    rows = [(10 * b, i, float(x[b, i].real), float(x[b, i].imag)) for b in range(3) for i in range(length)]
    got = np.zeros_like(x)
    for r in poisson.fourier(spark.createDataFrame(rows, "base long, i long, re double, im double"), length).collect():
        got[r.base // 10, r.m] = r.re + 1j * r.im
    assert got == pytest.approx(np.fft.fft(x, axis=1), abs=1e-9)


def test_no_group_of_a_transform_holds_a_line():
    for length in (2, 12, 198, 1 << 20, 2 * 99_999, 10**6):
        n1, n2 = poisson.factors(length)
        assert n1 * n2 == length and n1 <= n2 <= poisson.UNEVEN * math.sqrt(length)
    assert poisson.factors(1_000_003) is None


@pytest.mark.parametrize("periodic", [False, True])
def test_long_line(spark, monkeypatch, periodic):
    monkeypatch.setattr(ordered, "BLOCK", 64)
    axis = Axis(0.0, 3.0, 20_000, periodic)
    spec = GridSpec.of(axis)
    g = np.random.default_rng(2).normal(size=axis.bins)
    grad = Histogram(spec, spark.createDataFrame([(k, float(v)) for k, v in enumerate(g)], "addr long, g0 double"), ("g0",))
    u = dense(poisson.integrate(grad)).ravel()
    rows = {r.addr: r for r in poisson.laplacian_rows(grad).collect()}
    rhs, half = (np.array([rows[k][c] for k in range(axis.bins)]) for c in ("rhs", "half"))
    around = np.r_[u[-1], u, u[0]] if periodic else np.r_[u[1], u, u[-2]]
    second = (around[2:] - 2 * u + around[:-2]) / axis.width**2
    assert second == pytest.approx(rhs - (rhs * half).mean() / half, rel=1e-6, abs=1e-3) and u.min() == 0


def test_integration_recovers_a_potential(spark):
    spec = GridSpec.of(Axis(-1.0, 1.0, 40), Axis(-math.pi, math.pi, 30, True))
    v = B.generate(spark, spec, lambda x, y: x * x + F.cos(y))
    g = B.generate(spark, spec, lambda x, y: 2 * x, lambda x, y: -F.sin(y))
    got, want = dense(poisson.integrate(g)), dense(v)
    assert got == pytest.approx(want - want.min(), abs=0.03)


def hill_sum(hills, spec):
    shape = [a.bins for a in spec.axes]
    f, g = np.zeros(shape), np.zeros((spec.ndim, *shape))
    for c, s, height in hills:
        for idx in itertools.product(*map(range, shape)):
            x = [a.centers()[i] for a, i in zip(spec.axes, idx)]
            d = []
            for a, p, q in zip(spec.axes, x, c):
                if a.periodic:
                    p, q = a.wrap_value(p), a.wrap_value(q)
                e = p - q
                if a.periodic and abs(e) > a.period / 2:
                    e += -a.period if e > 0 else a.period
                d.append(e)
            expo = sum(e * e / (2 * t * t) for e, t in zip(d, s))
            energy = height * math.exp(-expo) if expo < 100 else 0.0
            f[idx] -= energy
            for k in range(spec.ndim):
                g[(k, *idx)] += d[k] / s[k] ** 2 * energy
    return f, g


def some_hills(spark, ndim, n=40, seed=3):
    rnd = random.Random(seed)
    hills = [([rnd.uniform(-3, 8) for _ in range(ndim)], [rnd.choice([0.05, 0.3, 2.0]) for _ in range(ndim)], rnd.random()) for _ in range(n)]
    rows = [(k, 10 * (k + 1), *c, *s, h) for k, (c, s, h) in enumerate(hills)]
    cols = "row long, step long, " + ", ".join(f"{p}{k} double" for p in "cs" for k in range(ndim)) + ", height double"
    return hills, spark.createDataFrame(rows, cols)


HILL_SPECS = [
    GridSpec.of(Axis(0.0, 5.0, 20)),
    GridSpec.of(Axis(0.0, 5.0, 12), Axis(-3.0, 3.0, 14, True)),
    GridSpec.of(Axis(0.0, 2.0, 7, True).with_period(True, 0.0, 6.0), Axis(-1.0, 1.0, 3, True)),
]


@pytest.mark.parametrize("spec", HILL_SPECS)
def test_hill_sums_match_all_pairs(spark, spec):
    hills, df = some_hills(spark, spec.ndim)
    f, g = hill_sum(hills, spec)
    got = H.sum_hills(df, spec)
    assert dense(got) == pytest.approx(f, abs=1e-12)
    for k in range(spec.ndim):
        assert dense(got, f"g{k}") == pytest.approx(g[k], abs=1e-9)
    tempered = H.well_tempered(got, 900.0, 300.0)
    assert dense(tempered) == pytest.approx(f * 4 / 3, abs=1e-12)


def test_snapshots_are_running_sums(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 4)
    spec = HILL_SPECS[1]
    hills, df = some_hills(spark, 2, 23)
    rows = H.snapshots(df, spec, 50).collect()
    assert sorted({(r.snapshot, r.step) for r in rows}) == [(0, 50), (1, 100), (2, 150), (3, 200)]
    for k in range(4):
        f, g = hill_sum(hills[: 5 * (k + 1)], spec)
        one = {r.addr: r for r in rows if r.snapshot == k}
        assert len(one) == spec.size
        got = np.array([one[a].value for a in range(spec.size)]).reshape(f.shape, order="F")
        grad = np.array([one[a].g1 for a in range(spec.size)]).reshape(f.shape, order="F")
        assert got == pytest.approx(f, abs=1e-12) and grad == pytest.approx(g[1], abs=1e-9)


@pytest.mark.parametrize("levels", [1, 2])
def test_running_sums_across_blocks(spark, monkeypatch, levels):
    monkeypatch.setattr(ordered, "BLOCK", 3)
    rnd = random.Random(6)
    rows = [(k, rnd.choice("ab"), rnd.randint(-5, 5)) for k in range(40)]
    df = spark.createDataFrame(rows, "pos long, key string, v long")
    for inclusive in (True, False):
        got = {r.pos: r.s for r in ordered.running_sum(df, ["key"], "pos", {"s": F.col("v"), "t": -F.col("v")}, inclusive, levels).collect()}
        for p, key, v in rows:
            assert got[p] == sum(x for q, k, x in rows if k == key and (q < p or inclusive and q == p))


def test_ranges_explode_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 4)
    df = spark.createDataFrame([(0, 0), (5, 6), (3, 14), (9, 2), (0, 8)], "a long, b long")
    got = sorted((r.a, r.n) for r in ordered.explode_range(df, F.col("a"), F.col("b"), "n").collect())
    assert got == sorted((a, n) for a, b in [(0, 0), (5, 6), (3, 14), (9, 2), (0, 8)] for n in range(a, b))


def test_values_carry_forward_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 3)
    rnd = random.Random(7)
    rows = [(k, key, rnd.choice([None, None, None, float(k)])) for key in "ab" for k in range(25)]
    df = spark.createDataFrame(rows, "pos long, key string, v double")
    got = {(r.key, r.pos): r.v for r in ordered.carry_forward(df, ["key"], "pos", "v").collect()}
    for key in "ab":
        last = None
        for p, _, v in [r for r in rows if r[1] == key]:
            last = v if v is not None else last
            assert got[key, p] == last


def test_patches_add_up_without_wrapping(spark):
    h = filled(spark, SPEC)
    patches = [Patch((1.0, 0.0), (2.0, 120.0), 5.0), Patch((0.5, 170.0), (1.0, 60.0), -1.0), Patch((0.5, 30.0), (0.0, 0.0), 2.0)]
    want = dense(h).copy()
    for i, j in itertools.product(range(4), range(6)):
        x = [SPEC.axes[0].centers()[i], SPEC.axes[1].centers()[j]]
        for p in patches:
            if all(abs(a - c) <= l / 2 for a, c, l in zip(x, p.center, p.length)):
                want[i, j] += p.value
    assert dense(apply_patches(h, patches)) == pytest.approx(want)
    with pytest.raises(ValueError):
        apply_patches(h, [Patch((1.0,), (1.0,), 1.0)])


def test_units_and_number_lists(spark):
    assert thermal_energy(300, "KCAL/mol") == pytest.approx(0.5961612775923)
    assert thermal_energy(300, "kJ/mol") == pytest.approx(2.4943387854459)
    assert thermal_energy(300, "furlong") == 300
    assert parse_numbers("(1, 2.5, x) 4") == [1.0, 2.5, 0.0, 4.0]
    df = spark.createDataFrame([("(1, 2.5, x) 4",)], "t string")
    assert df.select(numbers(F.col("t"))).first()[0] == [1.0, 2.5, 0.0, 4.0]


def test_nearly_equal_and_extent(spark):
    from saddlespark.functions.units import nearly_equal

    df = spark.createDataFrame([(1.0, 1.0 + 2**-52), (1.0, 1.0 + 1e-9), (0.0, 1e-309)], "a double, b double")
    assert [r[0] for r in df.select(nearly_equal(F.col("a"), F.col("b"))).collect()] == [True, False, True]
    spec = GridSpec.of(Axis(0.0, 3.0, 3))
    h = Histogram(spec, spark.createDataFrame([(0, 2.0), (1, math.inf)], "addr long, value double"))
    assert tuple(h.extent().first()) == (0.0, 2.0)


def test_frames_can_be_appended(spark):
    from saddlespark.operators import history

    spec = GridSpec.of(Axis(0.0, 2.0, 2))
    frames = spark.createDataFrame([(0, 0), (0, 1)], "file int, frame long")
    updates = spark.createDataFrame([(0, 0, 0, 5.0), (0, 1, 1, 7.0)], "file int, frame long, addr long, value double")
    full = history.fill_frames(updates, frames, spec)
    more = history.append_frame(full, filled(spark, spec), 2)
    got = {(r.frame, r.addr): r.value for r in more.collect()}
    assert [got[k] for k in [(0, 0), (0, 1), (1, 0), (1, 1)]] == [5.0, 0.0, 5.0, 7.0] and len(got) == 6


def test_stream_sums_equal_batch_sums(spark, tmp_path):
    from saddlespark.streaming.accumulate import run_to_end, stream_bin_sum

    spec = GridSpec.of(Axis(0.0, 1.0, 4))
    df = spark.range(200).select((F.col("id") / 150.0).alias("x"), F.col("id").cast("double").alias("v"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sums = run_to_end(stream_bin_sum(stream, spec, [F.col("x")], {"value": F.col("v")}))
    want = dense(B.bin_sum(df, spec, [F.col("x")], {"value": F.col("v")}))
    assert dense(Histogram(spec, sums)) == pytest.approx(want)


@pytest.mark.parametrize("spec", [GridSpec.of(Axis(0.0, 4.0, 8)), GridSpec.of(Axis(0.0, 2.0, 2), Axis(0.0, 3.0, 3), Axis(0.0, 4.0, 4, True))])
def test_patches_of_a_table_equal_the_box_test(spark, spec):
    rnd = random.Random(spec.ndim)
    rows = []
    for _ in range(25):
        # some ends fall on centres, some boxes lie beyond the grid, some hold no centre
        centre = [rnd.choice([a.centers()[rnd.randrange(a.bins)], rnd.uniform(a.lower - 1, a.upper + 1), a.lower - 9]) for a in spec.axes]
        length = [rnd.choice([0.0, a.width, 2 * a.width, rnd.uniform(0, 3), 50.0]) for a in spec.axes]
        rows.append((*centre, *length, rnd.choice([1.0, -2.5, 0.125])))
    patches = [Patch(tuple(r[: spec.ndim]), tuple(r[spec.ndim : -1]), r[-1]) for r in rows]
    cols = ", ".join(f"{n}{k} double" for n in ("center", "length") for k in range(spec.ndim)) + ", value double"
    table = spark.createDataFrame([*rows, (None,) * len(rows[0]), (*rows[0][:-1], None)], cols)
    h = filled(spark, spec, 3)
    assert dense(apply_patch_table(h, table)) == pytest.approx(dense(apply_patches(h, patches)), abs=1e-9)


def test_many_patches_are_one_plan(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 8)
    spec = GridSpec.of(Axis(0.0, 40.0, 40), Axis(0.0, 30.0, 30))
    k = F.col("id")
    table = spark.range(100_000).select((k % 41).cast("double").alias("center0"), (k % 7).cast("double").alias("length0"), (k % 31).cast("double").alias("center1"), (k % 5).cast("double").alias("length1"), F.lit(1.0).alias("value"))
    ids = np.arange(100_000)
    want = np.zeros((40, 30))
    x, y = (np.array(a.centers()) for a in spec.axes)
    cases, times = np.unique(np.stack([ids % 41, ids % 7, ids % 31, ids % 5]), axis=1, return_counts=True)
    for c0, l0, c1, l1, n in zip(*cases, times):
        want += n * np.outer((x >= c0 - l0 / 2) & (x <= c0 + l0 / 2), (y >= c1 - l1 / 2) & (y <= c1 + l1 / 2))
    assert dense(patch_field(table, spec)) == pytest.approx(want)
