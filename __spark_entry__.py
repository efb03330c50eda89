"""Queries over the given tables, one per operator, and their SQL counterparts.

``lineitem`` serves as a trajectory (quantity, discount and tax are its coordinates),
``events`` as a record of hills and of a history, ``part`` as a path and ``orders`` as a
simulation log.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from saddlespark.functions.axis import Axis  # noqa: E402
from saddlespark.functions.grid import GridSpec  # noqa: E402
from saddlespark.functions.units import nearly_equal, numbers, thermal_energy  # noqa: E402
from saddlespark.operators import graph as G  # noqa: E402
from saddlespark.operators import hills as H  # noqa: E402
from saddlespark.operators import histogram as B  # noqa: E402
from saddlespark.operators import history as Y  # noqa: E402
from saddlespark.operators import poisson, search, stencil, thermo  # noqa: E402
from saddlespark.operators.histogram import Histogram  # noqa: E402
from saddlespark.operators.ordered import explode_range  # noqa: E402
from saddlespark.operators.patches import Patch, apply_patch_table, apply_patches  # noqa: E402
from saddlespark.session import shared_folder  # noqa: E402
from saddlespark.sources import mdlog, sinks, text  # noqa: E402
from saddlespark.streaming.accumulate import run_to_end, stream_bin_sum  # noqa: E402

try:
    import corpus_pipeline
    from saddlespark.llm import queries as llm
except ImportError:
    llm = None

# ---- grids the queries use --------------------------------------------------------
QTY = Axis(0.0, 50.0, 10)
DISC = Axis(0.0, 0.1, 5)
TAX = Axis(0.0, 0.08, 4)
PRICE = Axis(0.0, 110000.0, 11)
ANGLE = Axis(-180.0, 180.0, 12, True)
PART_ANGLE = Axis(-90.0, 60.0, 5, True).with_period(True, -180.0, 180.0)
VALUE = Axis(0.0, 500.0, 50)
CIRCLE = Axis(0.0, 360.0, 24, True)
FINE_QTY = Axis(0.0, 50.0, 50)
GRID_1D = GridSpec.of(QTY)
GRID_COARSE = GridSpec.of(Axis(0.0, 50.0, 5), DISC)
GRID_2D = GridSpec.of(QTY, DISC)
GRID_3D = GridSpec.of(QTY, DISC, TAX)
GRID_CYC = GridSpec.of(QTY, Axis(0.0, 0.1, 5, True))
# eight discount bins leave some empty, because discounts come in hundredths
GAPS = GridSpec.of(Axis(0.0, 0.2, 40))
HOURS = GridSpec.of(Axis(0.0, 500.0, 25))
HILLS_2D = GridSpec.of(VALUE, CIRCLE)
KT = thermal_energy(300.0, "kcal/mol")
PATCHES = [Patch((12.0, 0.05), (15.0, 0.05), 40.0), Patch((30.0, 0.03), (24.0, 0.03), -7.5)]
START, END = [2.5, 0.01], [47.5, 0.09]
STRIDE = 250
LOG_GRID = GridSpec.of(Axis(0.0, 500.0, 20))
TILE = 16  # bins of a search tile: small enough that these searches cross tiles


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, *exact: str, digits: int = 6) -> DataFrame:
    """Round floating-point columns; adding 0 turns -0 into 0."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        cols.append((F.round(c, digits) + F.lit(0.0)).alias(name) if kind == "double" and name not in exact else c)
    return df.select(*cols)


COORDS = ("l_quantity", "l_discount", "l_tax")


def coords(n: int) -> list:
    """The first ``n`` coordinates of the lineitem trajectory."""
    return [F.col(c) for c in COORDS[:n]]


def counts(spark: SparkSession, sf: str, spec: GridSpec) -> Histogram:
    return B.bin_count(load(spark, sf, "lineitem"), spec, coords(spec.ndim))


def energy_2d(spark: SparkSession, sf: str, spec: GridSpec = GRID_2D) -> Histogram:
    """A potential from the table: -kT ln(count), minimum 0."""
    return thermo.to_free_energy(counts(spark, sf, spec), KT)


def mean_price(spark: SparkSession, sf: str, spec: GridSpec) -> Histogram:
    rows = load(spark, sf, "lineitem")
    return B.bin_mean(rows, spec, coords(spec.ndim), {"value": F.col("l_extendedprice")})


def angle(value: str = "value"):
    return F.col(value) * 7.0 - 900.0


# ---- axes and grids ------------------------------------------------------------------
def q_axis_wrap_index(spark, sf):
    x = angle()
    cols = []
    for n, ax in (("a", ANGLE), ("p", PART_ANGLE)):
        cols += [
            ax.wrap(x).alias(f"{n}_wrapped"),
            ax.contains(x).alias(f"{n}_inside"),
            F.when(ax.contains(x), ax.index(x)).alias(f"{n}_bin"),
        ]
    return rounded(load(spark, sf, "events").select("event_id", *cols))


def q_axis_min_image_dist(spark, sf):
    ref = F.col("user_id") * 11.0 - 700.0
    ev = load(spark, sf, "events")
    return rounded(ev.select("event_id", ANGLE.distance(angle(), ref).alias("cyclic"), VALUE.distance(angle(), ref).alias("plain")))


def q_grid_reverse_address(spark, sf):
    rows = B.address_rows(load(spark, sf, "lineitem"), GRID_3D, coords(3), F.col("l_quantity").alias("q"))
    at = GRID_3D.with_coords(rows)
    out = at.groupBy("addr", "i0", "i1", "i2", "x0", "x1", "x2").agg(
        F.count("*").alias("n"), F.avg(F.col("q") - F.col("x0")).alias("offset")
    )
    return rounded(out)


def q_grid_points(spark, sf):
    """Every bin of a grid whose upper bound comes from the table, and how many rows it holds."""
    return rounded(counts(spark, sf, GRID_3D).table().withColumnRenamed("value", "n"))


# ---- histograms ------------------------------------------------------------------------
def q_hist_count_1d(spark, sf):
    return counts(spark, sf, GRID_1D).table()


def q_hist_count_2d(spark, sf):
    return rounded(counts(spark, sf, GRID_2D).table())


def q_hist_sum(spark, sf):
    rows = load(spark, sf, "lineitem")
    h = B.bin_sum(rows, GRID_2D, coords(2), {"value": F.col("l_extendedprice")})
    return rounded(h.dense().df, digits=2)


def q_hist_mean_dense(spark, sf):
    rows = load(spark, sf, "lineitem")
    return rounded(B.bin_mean(rows, GAPS, [F.col("l_discount")], {"value": F.col("l_extendedprice")}).dense().df)


def q_hist_vector_mean(spark, sf):
    rows = load(spark, sf, "lineitem")
    parts = {"fx": F.col("l_extendedprice"), "fy": F.col("l_quantity") * F.col("l_discount"), "fz": F.col("l_tax") - F.col("l_discount")}
    return rounded(B.bin_mean(rows, GRID_1D, coords(1), parts).dense().df)


def q_hist_merge(spark, sf):
    rows = load(spark, sf, "lineitem")
    early = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp")
    a = B.bin_count(rows.filter(early), GRID_1D, coords(1))
    b = B.bin_count(rows.filter(~early), GridSpec.of(FINE_QTY), coords(1))
    return a.merge(b).dense().df


def q_hist_apply(spark, sf):
    h = counts(spark, sf, GRID_2D).apply(lambda x: F.sqrt(x) * 2.0 - 1.0)
    return rounded(h.df.select("addr", "value"))


def q_hist_generate(spark, sf):
    """Counts minus a plane generated from the bin centres."""
    plane = B.generate(spark, GRID_2D, lambda x, y: -(x * 2.0 + y * 100.0))
    return rounded(counts(spark, sf, GRID_2D).merge(plane).dense().df)


def q_hist_set(spark, sf):
    h = counts(spark, sf, GRID_2D).set([27.0, 0.05], -1.0).set([99.0, 0.0], 5.0)
    return h.df.select("addr", "value")


def q_grid_sum_min(spark, sf):
    h = mean_price(spark, sf, GRID_2D)
    low, total = h.minimum(), h.sum()
    return rounded(low.select(F.col("value").alias("minimum"), total.scalar().alias("total")), digits=3)


def q_pmf_lookup_path(spark, sf):
    place = load(spark, sf, "part").select(
        "p_partkey", (F.col("p_size") + 4.0).alias("x0"), ((F.col("p_retailprice") - 900.0) / 900.0).alias("x1")
    )
    return rounded(B.lookup(place, energy_2d(spark, sf), [F.col("x0"), F.col("x1")], outside=None))


def q_point_lookup(spark, sf):
    rows = load(spark, sf, "lineitem").select("l_partkey", F.col("l_quantity").alias("q"), (F.col("l_discount") * 1.3).alias("d"))
    found = B.lookup(rows, mean_price(spark, sf, GRID_2D), [F.col("q"), F.col("d")])
    return rounded(found.groupBy("q").agg(F.count("*").alias("n"), F.sum("value").alias("total")), digits=2)


# ---- free energies -----------------------------------------------------------------------
def q_prob_to_pmf_norm(spark, sf):
    return rounded(thermo.from_probability(counts(spark, sf, GRID_2D), KT).df)


def q_prob_to_pmf_maxfill(spark, sf):
    h = B.bin_count(load(spark, sf, "lineitem"), GAPS, [F.col("l_discount")])
    return rounded(thermo.to_free_energy(h, KT).df)


def q_project_2d_to_1d(spark, sf):
    return rounded(thermo.project(energy_2d(spark, sf), [0], KT).table())


def q_project_permute_3d_to_2d(spark, sf):
    return rounded(thermo.project(energy_2d(spark, sf, GRID_3D), [2, 0], KT).table())


def q_reweight(spark, sf):
    rows = load(spark, sf, "lineitem")
    pmf = energy_2d(spark, sf)
    h = thermo.reweight(rows, pmf, coords(2), GridSpec.of(PRICE), [F.col("l_extendedprice")], KT)
    return rounded(h.dense().df, digits=4)


def q_reweight_pmf(spark, sf):
    rows = load(spark, sf, "lineitem")
    pmf = energy_2d(spark, sf)
    h = thermo.reweight(rows, pmf, coords(2), GridSpec.of(PRICE, TAX), [F.col("l_extendedprice"), F.col("l_tax")], KT)
    return rounded(thermo.to_free_energy(h, KT).df)


# ---- histories ------------------------------------------------------------------------------
def hourly(spark, sf) -> DataFrame:
    """A history: one frame an hour, listing only the bins that saw an event."""
    hour = F.floor((F.unix_timestamp("ts") - F.lit(1704067200)) / 3600)
    ev = load(spark, sf, "events").select(hour.alias("frame"), "value", HOURS.address([F.col("value")]).alias("addr"))
    updates = ev.filter(F.col("addr").isNotNull()).groupBy("frame", "addr").agg(F.avg("value").alias("value"))
    updates = updates.select(F.lit(0).alias("file"), "frame", "addr", "value")
    frames = load(spark, sf, "events").agg(F.max(hour).alias("top"))
    frames = explode_range(frames.withColumn("file", F.lit(0)), F.lit(0), F.col("top") + 1, "frame")
    return Y.fill_frames(updates, frames, HOURS).select("frame", "addr", "value")


def q_history_frames(spark, sf):
    return rounded(hourly(spark, sf))


def q_history_rmsd_last(spark, sf):
    return rounded(Y.rmsd(hourly(spark, sf), HOURS))


def q_history_rmsd_ref(spark, sf):
    ref = B.generate(spark, HOURS, lambda x: x)
    return rounded(Y.rmsd(hourly(spark, sf), HOURS, ref))


def q_history_text(spark, sf):
    """The same history written as a text file of frames and read back."""
    hour = F.floor((F.unix_timestamp("ts") - F.lit(1704067200)) / 3600)
    ev = load(spark, sf, "events").select(hour.alias("frame"), "value", HOURS.address([F.col("value")]).alias("addr"))
    cells = ev.filter(F.col("addr").isNotNull()).groupBy("frame", "addr").agg(F.avg("value").alias("value"))
    x = HOURS.position(F.col("addr"))[0]
    rows = cells.select("frame", F.lit(1).alias("k"), "addr", F.concat_ws(" ", x.cast("string"), F.col("value").cast("string")).alias("value"))
    heads = sinks.header_lines(HOURS)
    head = F.posexplode(F.array(*[F.lit(h) for h in heads]))
    span = cells.agg(F.min("frame").alias("low"), F.max("frame").alias("high"))
    top = explode_range(span, F.col("low"), F.col("high") + 1, "frame").select("frame", head.alias("p", "value"))
    rows = rows.unionByName(top.select("frame", F.lit(0).alias("k"), F.col("p").cast("long").alias("addr"), "value"))
    folder = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    rows.orderBy("frame", "k", "addr").select("value").write.text(folder)
    _, frames = text.read_history(spark, folder)
    # a text history starts with its first data row, that is in the first hour with events
    low = load(spark, sf, "events").agg(F.min(hour)).scalar()
    return rounded(frames.select((F.col("frame") + low).alias("frame"), "addr", "value"))


# ---- finite differences -------------------------------------------------------------------------
def q_derivative(spark, sf):
    return rounded(stencil.derivative(mean_price(spark, sf, GRID_2D)).df, digits=3)


def q_derivative_periodic(spark, sf):
    spec = GridSpec.of(ANGLE)
    h = B.bin_mean(load(spark, sf, "events"), spec, [angle()], {"value": F.col("value")})
    return rounded(stencil.derivative(h).df)


def price_field(spark, sf, spec) -> Histogram:
    rows = load(spark, sf, "lineitem")
    parts = {"g0": F.col("l_extendedprice") / 1000.0, "g1": F.col("l_quantity") * (F.lit(1.0) - F.col("l_discount")) + F.col("l_tax")}
    return B.bin_mean(rows, spec, coords(2), parts)


def q_divergence(spark, sf):
    return rounded(stencil.divergence(price_field(spark, sf, GRID_CYC)).df, digits=4)


def q_poisson_integrate(spark, sf):
    return rounded(poisson.integrate(price_field(spark, sf, GRID_CYC)).df, digits=4)


def q_poisson_laplacian(spark, sf):
    """Second differences of the integrated grid: the right-hand side they have to meet."""
    return rounded(stencil.laplacian(poisson.integrate(price_field(spark, sf, GRID_CYC))).df, digits=4)


def q_poisson_line(spark, sf):
    """A one-dimensional gradient, integrated by running sums."""
    rows = load(spark, sf, "lineitem")
    grad = B.bin_mean(rows, GRID_1D, coords(1), {"g0": F.col("l_extendedprice") / 1000.0})
    return rounded(poisson.integrate(grad).df, digits=4)


# ---- hills -----------------------------------------------------------------------------------------
def event_hills(spark, sf) -> DataFrame:
    return load(spark, sf, "events").select(
        F.col("event_id").alias("row"),
        (F.col("event_id") + 1).alias("step"),
        F.col("value").alias("c0"),
        (F.col("user_id") * 31.0 - 900.0).alias("c1"),
        F.lit(12.5).alias("s0"),
        (F.lit(10.0) + F.col("value") / 50.0).alias("s1"),
        (F.lit(0.5) + F.col("value") / 1000.0).alias("height"),
    )


def q_sum_hills_1d(spark, sf):
    return rounded(H.sum_hills(event_hills(spark, sf), GridSpec.of(VALUE)).dense().df)


def q_sum_hills_2d_grad(spark, sf):
    return rounded(H.sum_hills(event_hills(spark, sf), HILLS_2D).dense().df)


def q_sum_hills_periodic(spark, sf):
    ev = event_hills(spark, sf).select(F.col("c1").alias("c0"), F.col("s1").alias("s0"), "height")
    return rounded(H.sum_hills(ev, GridSpec.of(CIRCLE)).dense().df)


def q_sum_hills_strided(spark, sf):
    return rounded(H.snapshots(event_hills(spark, sf), GridSpec.of(VALUE), STRIDE), digits=5)


def q_well_tempered(spark, sf):
    h = H.sum_hills(event_hills(spark, sf), GridSpec.of(VALUE))
    return rounded(H.well_tempered(h, 3000.0, 300.0).dense().df)


# ---- neighbours, edges, searches --------------------------------------------------------------------
def q_neighbors(spark, sf):
    rows = counts(spark, sf, GRID_CYC).df.filter(F.col("value") > 0)
    return G.neighbors_table(GRID_CYC, rows.select("addr"))


def q_grid_edges(spark, sf):
    return rounded(G.grid_edges(energy_2d(spark, sf, GRID_CYC)).select("src", "dst", "weight"))


def q_edge_stats(spark, sf):
    return rounded(G.edge_stats(G.grid_edges(energy_2d(spark, sf, GRID_CYC))))


def co_orders(spark, sf, directed: bool) -> DataFrame:
    """A graph from the table: discount steps entered in the order of first appearance."""
    rows = load(spark, sf, "lineitem").select(
        F.round(F.col("l_discount") * 100).cast("long").alias("src"), (F.round(F.col("l_tax") * 100).cast("long") + 11).alias("dst"), F.col("l_quantity").alias("weight"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"),
    )
    rows = rows.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.min("ord").alias("ord"))
    return G.build_graph(rows, 20, directed)


def q_build_graph(spark, sf):
    return rounded(co_orders(spark, sf, False).select("src", "dst", "weight"))


def q_sorted_adjacency(spark, sf):
    from pyspark.sql import Window

    g = G.sort_by_weight(co_orders(spark, sf, False))
    place = F.row_number().over(Window.partitionBy("src").orderBy("ord"))
    return rounded(g.select("src", place.cast("long").alias("place"), "dst", "weight"))


def q_patch_grid(spark, sf):
    return rounded(apply_patches(counts(spark, sf, GRID_2D), PATCHES).df.select("addr", "value"))


def q_patch_table(spark, sf):
    """Every part raises a box of the grid."""
    key = F.col("p_partkey")
    boxes = load(spark, sf, "part").select(
        F.col("p_size").cast("double").alias("center0"), (key % 7 + 0.5).alias("length0"), (key % 11 / 100.0).alias("center1"),
        (key % 5 / 50.0 + 0.003).alias("length1"), (F.col("p_retailprice") / 1000.0).alias("value"),
    )
    return rounded(apply_patch_table(counts(spark, sf, GRID_2D), boxes).df.select("addr", "value"))


def path_lines(spark, name: str, write) -> DataFrame:
    """Lines of a text file just written, in order, as arrays of numbers."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    write(folder)
    lines = spark.read.text(folder).withColumn("x", numbers(F.trim("value")))
    return lines.select("x")


def q_path_file_text(spark, sf):
    """The nodes of a path, written and read back."""
    found = search.find_path(mean_price(spark, sf, GRID_2D), START, END, PATCHES, tile_nodes=TILE)
    x = path_lines(spark, "path", lambda folder: sinks.write_path(found.path, GRID_2D, folder))
    return rounded(x.select(F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"), F.col("x")[2].alias("value")))


def q_region_file_text(spark, sf):
    """The bins visited by a search, written and read back."""
    found = search.find_path(mean_price(spark, sf, GRID_2D), START, END, PATCHES, tile_nodes=TILE)
    x = path_lines(spark, "region", lambda folder: sinks.write_region(found.visited, GRID_2D, folder))
    return rounded(x.select(F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1")))


def q_canonical_order(spark, sf):
    """Places of the bins in a grid file."""
    placed = G.number_sorted(mean_price(spark, sf, GRID_3D).table(), GRID_3D.index_names, "place")
    return rounded(placed.select("place", "addr", "value"))


def q_element_access(spark, sf):
    """The values stored at three addresses, one of them beyond the grid."""
    h = mean_price(spark, sf, GRID_2D)
    return rounded(h.at(7).union(h.at(23)).union(h.at(GRID_2D.size)))


def q_append_frame(spark, sf):
    """An hourly history with the mean of its frames behind it."""
    history = hourly(spark, sf)
    top = history.agg(F.max("frame")).first()[0]
    mean = Histogram(HOURS, history.groupBy("addr").agg(F.avg("value").alias("value")))
    longer = Y.append_frame(history.withColumn("file", F.lit(0)).select("file", "frame", "addr", "value"), mean, top + 1)
    return rounded(longer.filter(F.col("frame") >= top - 1).select("frame", "addr", "value"))


def q_adjacency_print(spark, sf):
    """The printed lines of a graph."""
    return G.adjacency_lines(G.sort_by_weight(co_orders(spark, sf, False)))


def q_label_growth(spark, sf):
    """Labels of two weights, grown by a third; the number each label stands for."""
    label = F.sort_array(F.array("p_retailprice", F.col("p_size").cast("double")), asc=False)
    rows = load(spark, sf, "part").select("p_partkey", label.alias("label"), (F.col("p_partkey") % 1500).cast("double").alias("weight"))
    grown = {m: G.extend_label(m, F.col("label") if m == "mfep" else F.col("label")[0], F.col("weight")) for m in ("mfep", "sum", "max")}
    cols = [F.array_join(F.transform(grown["mfep"], lambda w: F.round(w, 2).cast("decimal(12,2)").cast("string")), ",").alias("label")]
    cols += [G.distance_value(m, c).alias(f"by_{m}") for m, c in grown.items()]
    return rounded(rows.select("p_partkey", *cols), digits=3)


def q_nearly_equal(spark, sf):
    """How often two ways to one price agree exactly, within two units in the last place, and not at all."""
    a, b = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")), F.col("l_extendedprice") - F.col("l_extendedprice") * F.col("l_discount")
    rows = load(spark, sf, "lineitem").select("l_returnflag", (a == b).alias("same"), nearly_equal(a, b).alias("near"))
    return rows.groupBy("l_returnflag").agg(F.count_if("same").alias("same"), F.count_if("near").alias("near"), F.count("*").alias("rows"))


def q_minimax_barrier(spark, sf):
    """Barriers from the start to every bin; none to the start itself (NULL)."""
    found = search.find_distances(mean_price(spark, sf, GRID_2D), START, "max")
    passed = F.when(F.col("distance") > F.lit(float("-inf")), F.col("distance"))
    return rounded(found.withColumn("distance", passed))


def q_shortest_sum(spark, sf):
    return rounded(search.find_distances(mean_price(spark, sf, GRID_2D), START, "sum"), digits=3)


def q_mfep_dijkstra(spark, sf):
    return rounded(search.find_path(mean_price(spark, sf, GRID_2D), START, END, PATCHES, tile_nodes=TILE).path)


def q_mfep_visited(spark, sf):
    return rounded(search.find_path(mean_price(spark, sf, GRID_2D), START, END, PATCHES, tile_nodes=TILE).visited)


def q_mfep_spfa(spark, sf):
    return rounded(search.find_path(mean_price(spark, sf, GRID_2D), START, END, PATCHES, algorithm="spfa").path)


def q_dfs_order(spark, sf):
    return G.dfs_order(G.sort_by_weight(co_orders(spark, sf, False)), 0)


# ---- text formats ----------------------------------------------------------------------------------------
def q_traj_text_parse(spark, sf):
    line = F.concat(
        F.lit(" "), F.col("l_orderkey").cast("string"), F.lit(" ( "), F.col("l_quantity").cast("string"), F.lit(" , "), F.col("l_discount").cast("string"),
        F.lit(" , "), F.col("l_tax").cast("string"), F.lit(" )  "), F.col("l_extendedprice").cast("string"),
    )
    folder = f"{shared_folder(spark)}/traj-{uuid.uuid4().hex}"
    rows = load(spark, sf, "lineitem").select(line.alias("value"))
    remark = load(spark, sf, "region").select(F.concat(F.lit("# "), F.col("r_name")).alias("value"))
    rows.unionByName(remark).write.text(folder)
    traj = text.read_trajectory(spark, folder, {"q": 1, "d": 2, "p": 4})
    h = B.bin_sum(traj, GRID_2D, [F.col("q"), F.col("d")], {"value": F.col("p")})
    return rounded(h.dense().df, digits=2)


def q_number_list_parse(spark, sf):
    """Fields of every text as numbers (0 if they are none): sum of the finite ones, and how many are not."""
    rows = load(spark, sf, "documents").select("doc_id", numbers(F.col("text")).alias("n"))
    finite = F.filter("n", lambda x: F.abs(x) < float("inf"))
    total = F.aggregate(finite, F.lit(0.0), lambda a, x: a + x)
    short = lambda c: F.when(F.abs(c) < 1e9, F.round(c, 3) + 0.0).otherwise(c)  # noqa: E731  digits that a double has
    return rows.select(
        "doc_id", F.size("n").cast("long").alias("pieces"), short(total).alias("total"), short(F.array_max(finite)).alias("most"),
        (F.size("n") - F.size(finite)).cast("long").alias("endless"),
    )


def q_hills_text(spark, sf):
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("step", "c0", "s0", "height")])
    folder = f"{shared_folder(spark)}/hills-{uuid.uuid4().hex}"
    event_hills(spark, sf).select(line.alias("value")).write.text(folder)
    hills = text.read_hills(spark, folder, 1)
    return rounded(H.sum_hills(hills, GridSpec.of(VALUE)).dense().df)


def q_grid_text_round_trip(spark, sf):
    folder = f"{shared_folder(spark)}/grid-{uuid.uuid4().hex}"
    sinks.write_grid(counts(spark, sf, GRID_CYC), folder)
    back = text.read_grid(spark, folder)
    return rounded(back.table())


def q_vector_grid_text(spark, sf):
    folder = f"{shared_folder(spark)}/field-{uuid.uuid4().hex}"
    sinks.write_grid(price_field(spark, sf, GRID_CYC), folder)
    return rounded(text.read_vector_grid(spark, folder).dense().df)


def q_path_text(spark, sf):
    line = F.concat_ws(" ", (F.col("p_size") + 4.0).cast("string"), ((F.col("p_retailprice") - 900.0) / 900.0).cast("string"))
    base = f"{shared_folder(spark)}/path-{uuid.uuid4().hex}"
    load(spark, sf, "part").orderBy("p_partkey").select(line.alias("value")).write.text(base)
    path = text.read_path(spark, base, 2)
    return rounded(B.lookup(path, energy_2d(spark, sf), [F.col("x0"), F.col("x1")], outside=None))


def order_log(spark, sf, short: bool) -> tuple[str, str]:
    """Orders as a log and a trajectory in two text folders; ``short`` leaves the last order out of the log."""
    orders = load(spark, sf, "orders")
    base = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    n = F.lit("ETITLE: TS BOND VDW TS ELECT")
    energy = F.concat_ws(" ", F.lit("ENERGY:"), key, price, -price / 2.0, key, price * 1.5e-3)
    pair = F.concat_ws(" ", F.lit("PAIR INTERACTION: STEP:"), key, F.lit("VDW_FORCE:"), price, key, F.lit("1.5"), F.lit("ELECT_FORCE: 1 2 3"))
    logged = orders.filter(key < orders.agg(F.max("o_orderkey")).scalar()) if short else orders
    # the orders are sorted before they become text; equal keys go by price in both files
    logged = logged.select("o_orderkey", "o_totalprice").orderBy("o_orderkey", "o_totalprice")
    logged.select(F.explode(F.array(n, energy, pair)).alias("value")).write.text(base + "-log")
    traj = F.concat_ws(" ", key, price / 1000.0)
    orders.select("o_orderkey", "o_totalprice").orderBy("o_orderkey", "o_totalprice").select(traj.alias("value")).write.text(base + "-traj")
    return base + "-log", base + "-traj"


def q_mdlog_parse_bin(spark, sf):
    """Orders as a log and a trajectory, paired row by row."""
    log, traj = order_log(spark, sf, False)
    h = mdlog.bin_log(mdlog.read_md_log(spark, log), text.read_lines(spark, traj), LOG_GRID, [1], ["VDW", "ELECT", "TS"], ["VDW_FORCE"])
    return rounded(h.dense().df, digits=4)


def q_mdlog_short_log(spark, sf):
    """A log that ends one row early: the last position counts in diluted means only."""
    log, traj = order_log(spark, sf, True)
    h = mdlog.bin_log(mdlog.read_md_log(spark, log), text.read_lines(spark, traj), LOG_GRID, [1], ["VDW"], ["VDW_FORCE"], count_all=True)
    return rounded(h.dense().df, digits=4)


# ---- text written and read back --------------------------------------------------------------------------
def numbers_of(spark, folder: str, *names: str) -> DataFrame:
    """Lines of a folder that hold data, as named numbers (NULL where there is none)."""
    lines = text.data_fields(spark.read.text(folder), text.WHITESPACE)
    return lines.select(*[F.get("f", F.lit(k)).try_cast("double").alias(n) for k, n in enumerate(names)], *[c for c in lines.columns if c == "name"])


def q_split_frames_text(spark, sf):
    """Every frame of a history as a grid file of its own."""
    prefix = f"{shared_folder(spark)}/split-{uuid.uuid4().hex}"
    sinks.write_frames(hourly(spark, sf), HOURS, prefix)
    rows = numbers_of(spark, prefix + "_frames", "x0", "value")
    frame = F.regexp_extract("name", r"_(\d+)\.pmf$", 1).cast("long")
    return rounded(rows.select(frame.alias("frame"), HOURS.address([F.col("x0")]).alias("addr"), "value"))


def q_rmsd_text(spark, sf):
    folder = f"{shared_folder(spark)}/rmsd-{uuid.uuid4().hex}"
    sinks.write_rmsd(Y.rmsd(hourly(spark, sf), HOURS), folder)
    return rounded(numbers_of(spark, folder, "frame", "rmsd").withColumn("frame", F.col("frame").cast("long")))


def q_patched_grid_text(spark, sf):
    folder = f"{shared_folder(spark)}/patched-{uuid.uuid4().hex}"
    sinks.write_grid(apply_patches(counts(spark, sf, GRID_2D), PATCHES), folder)
    return rounded(text.read_grid(spark, folder).df.select("addr", "value"))


def q_path_pmf_text(spark, sf):
    """Values along a path as written for plotting: blank where the path leaves the grid."""
    place = load(spark, sf, "part").select(
        F.col("p_partkey").alias("row"), (F.col("p_size") + 4.0).alias("x0"), ((F.col("p_retailprice") - 900.0) / 900.0).alias("x1")
    )
    folder = f"{shared_folder(spark)}/pathpmf-{uuid.uuid4().hex}"
    sinks.write_path_pmf(B.lookup(place, energy_2d(spark, sf), [F.col("x0"), F.col("x1")], outside=None), GRID_2D, folder)
    return rounded(numbers_of(spark, folder, "x0", "x1", "value"))


def q_snapshots_text(spark, sf):
    """Running sums of hills, one grid file per snapshot."""
    steps = H.snapshots(event_hills(spark, sf), GridSpec.of(VALUE), STRIDE)
    folder = f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    name = F.concat(F.lit("s_"), F.col("step").cast("string"), F.lit(".pmf"))
    sinks.write_grids(steps.select("step", "addr", "value"), GridSpec.of(VALUE), ["value"], name, folder)
    rows = numbers_of(spark, folder, "x0", "value")
    step = F.regexp_extract("name", r"_(\d+)\.pmf$", 1).cast("long")
    return rounded(rows.select(step.alias("step"), GridSpec.of(VALUE).address([F.col("x0")]).alias("addr"), "value"), digits=5)


def q_files_in_list_order(spark, sf):
    """Grids in two files read as one history: frames follow the list, not the names."""
    base = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    sinks.write_grid(B.bin_count(load(spark, sf, "events"), HOURS, [F.col("value")]), base + "-z")
    sinks.write_grid(B.bin_sum(load(spark, sf, "events"), HOURS, [F.col("value")], {"value": F.col("value")}), base + "-a")
    _, frames = text.read_history(spark, [base + "-z", base + "-a"])
    return rounded(frames.select("frame", "addr", "value"), digits=2)


# ---- small operators --------------------------------------------------------------------------------------
def q_thermal_energy(spark, sf):
    """Sizes of parts taken as temperatures, in both units."""
    part = load(spark, sf, "part")
    return part.select(
        "p_partkey",
        F.round(thermal_energy(F.col("p_size"), "kcal/mol"), 12).alias("kcal"),
        F.round(thermal_energy(F.col("p_size"), "kJ/mol"), 12).alias("kj"),
    )


def q_hist_generate_vector(spark, sf):
    field = price_field(spark, sf, GRID_2D)
    field = Histogram(GRID_2D, field.df.select("addr", F.col("g0").alias("v0"), F.col("g1").alias("v1")), ("v0", "v1"))
    made = B.generate(spark, GRID_2D, lambda x, y: x * 2.0, lambda x, y: -y)
    return rounded(field.merge(made).dense().df)


def q_edited_axis_edges(spark, sf):
    """Counts on an axis of another width and start, with the edges of each bin."""
    axis = QTY.with_width(2.5).with_lower(9.9)
    h = B.bin_count(load(spark, sf, "lineitem"), GridSpec.of(axis), coords(1))
    edges = F.array(*[F.lit(e) for e in axis.edges()])
    at = F.col("addr").cast("int")
    return rounded(h.dense().df.select("addr", F.get(edges, at).alias("low"), F.get(edges, at + 1).alias("high"), "value"))


def q_edge_lookup(spark, sf):
    """One edge that is there and one that is not."""
    g = co_orders(spark, sf, False)
    there = g.agg(F.min(F.struct("src", "dst")).alias("e")).first()["e"]
    found = G.get_edge(g, there.src, there.dst).withColumn("which", F.lit("there"))
    return rounded(found.unionByName(G.get_edge(g, there.src, there.src).withColumn("which", F.lit("absent"))))


# ---- streaming -----------------------------------------------------------------------------------------------
def q_stream_bin_sum(spark, sf):
    rows = spark.readStream.schema(load(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    sums = stream_bin_sum(rows, GridSpec.of(VALUE), [F.col("value")], {"value": F.col("value")})
    return rounded(Histogram(GridSpec.of(VALUE), run_to_end(sums)).dense().df, digits=2)


# ---- SQL counterparts ------------------------------------------------------------------------------------------
def num(x: float) -> str:
    t = repr(float(x))
    return t if "e" in t else t + "e0"


def s_wrap(x: str, a: Axis) -> str:
    if not a.periodic:
        return x
    lo, hi, p = num(a.period_lower), num(a.period_upper), num(a.period)
    return (
        f"(CASE WHEN {x} < {lo} THEN {x} + ceil(({lo} - {x}) / {p}) * {p} "
        f"WHEN {x} > {hi} THEN {x} - ceil(({x} - {hi}) / {p}) * {p} ELSE {x} END)"
    )


def s_in(x: str, a: Axis) -> str:
    return f"({s_wrap(x, a)} BETWEEN {num(a.lower)} AND {num(a.upper)})"


def s_idx(x: str, a: Axis) -> str:
    return f"CAST(least(floor(({s_wrap(x, a)} - {num(a.lower)}) / {num(a.width)}), {a.bins - 1}) AS BIGINT)"


def s_dist(x: str, r: str, a: Axis) -> str:
    if not a.periodic:
        return f"({x} - {r})"
    d = f"({s_wrap(x, a)} - {s_wrap(r, a)})"
    h, p = num(a.period * 0.5), num(a.period)
    return f"(CASE WHEN {d} > {h} THEN {d} - {p} WHEN {d} < -{h} THEN {d} + {p} ELSE {d} END)"


def s_inside(xs: list[str], g: GridSpec) -> str:
    return " AND ".join(s_in(x, a) for x, a in zip(xs, g.axes))


def s_addr(xs: list[str], g: GridSpec) -> str:
    return "(" + " + ".join(f"{s_idx(x, a)} * {s}" for x, a, s in zip(xs, g.axes, g.strides)) + ")"


def s_points(g: GridSpec) -> str:
    """Subquery of all bins: addr, i0.., x0.."""
    idx = [f"((addr // {s}) % {a.bins})" for a, s in zip(g.axes, g.strides)]
    cols = [f"CAST({i} AS BIGINT) AS i{k}" for k, i in enumerate(idx)]
    cols += [f"{num(a.lower)} + (0.5e0 + {i}) * {num(a.width)} AS x{k}" for k, (a, i) in enumerate(zip(g.axes, idx))]
    return f"(SELECT addr, {', '.join(cols)} FROM (SELECT range AS addr FROM range({g.size})))"


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0e0"


LI = list(COORDS)
SA = "(value * 7.0e0 - 900.0e0)"


def s_hist(table: str, xs: list[str], g: GridSpec, agg: str, where: str = "TRUE") -> str:
    """Dense histogram: every bin with its aggregate, 0 where there is none."""
    return (
        f"(SELECT p.*, coalesce(h.value, 0e0) AS value FROM {s_points(g)} p LEFT JOIN (SELECT {s_addr(xs, g)} AS addr, "
        f"CAST({agg} AS DOUBLE) AS value FROM {table} WHERE {s_inside(xs, g)} AND {where} GROUP BY 1) h USING (addr))"
    )


def s_count(g: GridSpec) -> str:
    return s_hist("lineitem", LI[: g.ndim], g, "count(*)")


def s_price(g: GridSpec) -> str:
    return s_hist("lineitem", LI[: g.ndim], g, "avg(l_extendedprice)")


def s_energy(hist: str) -> str:
    """Dense -kT ln(value), empty bins at the maximum, minimum 0."""
    f = f"(SELECT *, CASE WHEN value > 0 THEN -{num(KT)} * ln(value) END AS f FROM {hist})"
    return (
        f"(SELECT * EXCLUDE (value, f, lo, hi), coalesce(f, hi) - lo AS value FROM (SELECT *, coalesce(min(f) OVER (), 0e0) AS lo, "
        f"coalesce(max(f) OVER (), 0e0) AS hi FROM {f}))"
    )


def s_project(energy: str, g: GridSpec, dims: list[int]) -> str:
    t = g.select(dims)
    addr = " + ".join(f"i{d} * {s}" for d, s in zip(dims, t.strides))
    p = f"(SELECT {addr} AS addr, sum(exp(-value / {num(KT)})) AS p FROM {energy} GROUP BY 1)"
    f = f"(SELECT addr, -{num(KT)} * ln(p / sum(p) OVER ()) AS f FROM {p})"
    names = ", ".join([*t.index_names, *[f"{r(c)} AS {c}" for c in t.coord_names]])
    return f"SELECT addr, {names}, {r('f - min(f) OVER ()')} AS value FROM {f} JOIN {s_points(t)} USING (addr)"


def s_axis_query() -> str:
    cols = []
    for n, a in (("a", ANGLE), ("p", PART_ANGLE)):
        cols += [
            f"{r(s_wrap(SA, a))} AS {n}_wrapped",
            f"{s_in(SA, a)} AS {n}_inside",
            f"CASE WHEN {s_in(SA, a)} THEN {s_idx(SA, a)} END AS {n}_bin",
        ]
    return f"SELECT event_id, {', '.join(cols)} FROM events"


def s_reverse() -> str:
    g = GRID_3D
    return (
        f"SELECT addr, i0, i1, i2, {r('x0')} AS x0, {r('x1')} AS x1, {r('x2')} AS x2, count(*) AS n, {r('avg(q - x0)')} AS \"offset\" "
        f"FROM (SELECT {s_addr(LI, g)} AS addr, l_quantity AS q FROM lineitem WHERE {s_inside(LI, g)}) JOIN {s_points(g)} USING (addr) "
        "GROUP BY addr, i0, i1, i2, x0, x1, x2"
    )


def s_table(hist: str, g: GridSpec, value: str = "value") -> str:
    xs = ", ".join(f"{r(c)} AS {c}" for c in g.coord_names)
    return f"SELECT addr, {', '.join(g.index_names)}, {xs}, value AS {value} FROM {hist}"


def s_reweight(target: GridSpec, xs: list[str]) -> str:
    src = ["l_quantity", "l_discount"]
    return (
        f"(SELECT p.*, coalesce(h.value, 0e0) AS value FROM {s_points(target)} p LEFT JOIN (SELECT t.addr, "
        f"sum(exp(-e.value / {num(KT)})) AS value FROM (SELECT {s_addr(src, GRID_2D)} AS f, {s_addr(xs, target)} AS addr FROM lineitem "
        f"WHERE {s_inside(src, GRID_2D)} AND {s_inside(xs, target)}) t JOIN {s_energy(s_count(GRID_2D))} e ON e.addr = t.f GROUP BY 1) h "
        "USING (addr))"
    )


def s_hourly() -> str:
    hour = "CAST(floor((epoch(ts) - 1704067200) / 3600) AS BIGINT)"
    a = HOURS.axes[0]
    return (
        f"(SELECT frame, addr, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY addr ORDER BY frame), 0e0) AS value FROM "
        f"(SELECT f.frame, p.addr, u.value FROM (SELECT unnest(range(0, (SELECT max({hour}) FROM events) + 1)) AS frame) f "
        f"CROSS JOIN (SELECT range AS addr FROM range({a.bins})) p LEFT JOIN (SELECT {hour} AS frame, {s_idx('value', a)} AS addr, "
        f"avg(value) AS value FROM events WHERE {s_in('value', a)} GROUP BY 1, 2) u USING (frame, addr)))"
    )


def s_rmsd(ref: str) -> str:
    return f"SELECT frame, {r('sqrt(avg((h.value - r.value) * (h.value - r.value)))')} AS rmsd FROM {s_hourly()} h JOIN {ref} r USING (addr) GROUP BY frame"


def s_derivative(col: str, k: int, g: GridSpec) -> str:
    """First derivative along axis k by window functions."""
    a = g.axes[k]
    w2 = num(2 * a.width)
    others = ", ".join(i for j, i in enumerate(g.index_names) if j != k)
    over = f"OVER ({'PARTITION BY ' + others if others else ''} ORDER BY i{k} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    lag, lead = f"lag({col}) {over}", f"lead({col}) {over}"
    if a.real_periodic:
        return f"(coalesce({lead}, first_value({col}) {over}) - coalesce({lag}, last_value({col}) {over})) / {w2}"
    return (
        f"CASE WHEN i{k} = 0 THEN (4 * {lead} - 3 * {col} - lead({col}, 2) {over}) / {w2} "
        f"WHEN i{k} = {a.bins - 1} THEN (3 * {col} - 4 * {lag} + lag({col}, 2) {over}) / {w2} ELSE ({lead} - {lag}) / {w2} END"
    )


def s_field(g: GridSpec) -> str:
    return (
        f"(SELECT p.*, coalesce(h.g0, 0e0) AS g0, coalesce(h.g1, 0e0) AS g1 FROM {s_points(g)} p LEFT JOIN (SELECT {s_addr(LI[:2], g)} AS addr, "
        f"avg(l_extendedprice / 1000.0e0) AS g0, avg(l_quantity * (1e0 - l_discount) + l_tax) AS g1 FROM lineitem WHERE {s_inside(LI[:2], g)} "
        "GROUP BY 1) h USING (addr))"
    )


def s_div(g: GridSpec) -> str:
    return f"(SELECT *, {s_derivative('g0', 0, g)} + {s_derivative('g1', 1, g)} AS div FROM {s_field(g)})"


def s_source(g: GridSpec, div: str) -> str:
    """addr, rhs, half of a gradient grid whose axis 0 is open and whose other axes are periodic."""
    n, w = g.axes[0].bins - 1, g.axes[0].width
    half = f"(CASE WHEN i0 = 0 OR i0 = {n} THEN 0.5e0 ELSE 1e0 END)"
    rhs = f"div + CASE WHEN i0 = 0 THEN {num(2 / w)} * g0 WHEN i0 = {n} THEN -{num(2 / w)} * g0 ELSE 0e0 END"
    return f"(SELECT addr, {rhs} AS rhs, {half} AS half FROM {div})"


def s_poisson_laplacian() -> str:
    return f"SELECT addr, {r('rhs - avg(rhs * half) OVER () / half', 4)} AS value FROM {s_source(GRID_CYC, s_div(GRID_CYC))}"


def s_poisson_line() -> str:
    g = GRID_1D
    field = f"(SELECT *, value AS g0 FROM {s_hist('lineitem', LI[:1], g, 'avg(l_extendedprice / 1000.0e0)')})"
    div = f"(SELECT *, {s_derivative('g0', 0, g)} AS div FROM {field})"
    source = f"(SELECT addr, (rhs * half - avg(rhs * half) OVER ()) * {num(g.axes[0].width**2)} AS s FROM {s_source(g, div)})"
    steps = f"(SELECT addr, sum(s) OVER (ORDER BY addr) AS step FROM {source})"
    u = f"(SELECT addr, coalesce(sum(step) OVER (ORDER BY addr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS u FROM {steps})"
    return f"SELECT addr, {r('u - min(u) OVER ()', 4)} AS value FROM {u}"


def s_poisson() -> str:
    """Cosine transform along the open axis 0, Hartley transform along the periodic axis 1."""
    import math

    g = GRID_CYC
    a, b = g.axes
    n, m = a.bins - 1, b.bins
    half = f"(CASE WHEN i0 = 0 OR i0 = {n} THEN 0.5e0 ELSE 1e0 END)"
    rhs = f"div + CASE WHEN i0 = 0 THEN {num(2 / a.width)} * g0 WHEN i0 = {n} THEN -{num(2 / a.width)} * g0 ELSE 0e0 END"
    t0 = f"(SELECT i0, i1, (rhs - avg(rhs * half) OVER () / half) AS v FROM (SELECT i0, i1, {rhs} AS rhs, {half} AS half FROM {s_div(g)}))"
    c = f"cos({num(math.pi)} * m * i0 / {n}) * {half}"
    cas = f"(cos({num(2 * math.pi)} * l * i1 / {m}) + sin({num(2 * math.pi)} * l * i1 / {m}))"

    def along(src: str, v: str) -> str:
        one = f"(SELECT m, i1, sum({v} * {c}) AS v FROM {src}, (SELECT range AS m FROM range({a.bins})) GROUP BY 1, 2)"
        return f"(SELECT m AS i0, l AS i1, sum(v * {cas}) AS v FROM {one}, (SELECT range AS l FROM range({m})) GROUP BY 1, 2)"

    lam = (
        f"(-(2 - 2 * cos({num(math.pi)} * i0 / {n})) / {num(a.width**2)} - (2 - 2 * cos({num(2 * math.pi)} * i1 / {m})) / {num(b.width**2)})"
    )
    scaled = f"(SELECT i0, i1, CASE WHEN i0 = 0 AND i1 = 0 THEN 0e0 ELSE v / ({lam} * {num(n / 2 * m)}) END AS v FROM {along(t0, 'v')})"
    return f"SELECT CAST(i0 + i1 * {a.bins} AS BIGINT) AS addr, {r('v - min(v) OVER ()', 4)} AS value FROM {along(scaled, 'v')}"


HILL_ROWS = (
    "(SELECT event_id AS \"row\", event_id + 1 AS step, value AS c0, user_id * 31.0e0 - 900.0e0 AS c1, 12.5e0 AS s0, "
    "10.0e0 + value / 50.0e0 AS s1, 0.5e0 + value / 1000.0e0 AS height FROM events)"
)


def s_hill_pairs(g: GridSpec, cols: list[tuple[str, str]], keep: str = "") -> str:
    """All pairs of hill and bin: addr, e, g0.. with the exponent cut at 100."""
    d = [s_dist(f"x{k}", c, a) for k, ((c, _), a) in enumerate(zip(cols, g.axes))]
    expo = " + ".join(f"d{k} * d{k} / (2e0 * {s} * {s})" for k, (_, s) in enumerate(cols))
    ds = ", ".join(f"{x} AS d{k}" for k, x in enumerate(d))
    inner = f"(SELECT h.*, p.addr, {ds} FROM {HILL_ROWS} h, {s_points(g)} p)"
    e = f"(SELECT *, CASE WHEN {expo} < 100 THEN height * exp(-({expo})) ELSE 0e0 END AS e FROM {inner})"
    gs = ", ".join(f"-d{k} / ({s} * {s}) * e AS g{k}" for k, (_, s) in enumerate(cols))
    return f"(SELECT {keep} addr, e, {gs} FROM {e})"


def s_hills(g: GridSpec, cols: list[tuple[str, str]], factor: str = "1e0") -> str:
    gs = ", ".join(f"{r(f'-sum(g{k}) * {factor}')} AS g{k}" for k in range(g.ndim))
    return f"SELECT addr, {r(f'-sum(e) * {factor}')} AS value, {gs} FROM {s_hill_pairs(g, cols)} GROUP BY addr"


def s_strided() -> str:
    g = GridSpec.of(VALUE)
    seg = f'CAST((step - 1) // {STRIDE} AS BIGINT) AS snapshot,'
    parts = f"(SELECT snapshot, addr, -sum(e) AS value, -sum(g0) AS g0 FROM {s_hill_pairs(g, [('c0', 's0')], seg)} GROUP BY 1, 2)"
    top = f"(SELECT max(event_id + 1) // {STRIDE} FROM events)"
    run = "OVER (PARTITION BY addr ORDER BY snapshot)"
    return (
        f"SELECT snapshot, (snapshot + 1) * {STRIDE} AS step, addr, {r(f'sum(value) {run}', 5)} AS value, {r(f'sum(g0) {run}', 5)} AS g0 "
        f"FROM {parts} WHERE snapshot < {top}"
    )


def s_neighbor(k: int, prev: bool, g: GridSpec) -> str:
    a, s = g.axes[k], g.strides[k]
    i = f"((addr // {s}) % {a.bins})"
    last = a.bins - 1
    if prev:
        return f"CASE WHEN {i} = 0 THEN {f'addr + {last * s}' if a.periodic else 'NULL'} ELSE addr - {s} END"
    return f"CASE WHEN {i} = {last} THEN {f'addr - {last * s}' if a.periodic else 'NULL'} ELSE addr + {s} END"


def s_neighbors(src: str, g: GridSpec) -> str:
    parts = [
        f"SELECT addr, CAST({k} AS INTEGER) AS axis, {'TRUE' if p else 'FALSE'} AS previous, CAST({s_neighbor(k, p, g)} AS BIGINT) AS neighbor FROM {src}"
        for k in range(g.ndim)
        for p in (True, False)
    ]
    return " UNION ALL ".join(parts)


def s_edges(grid: str, g: GridSpec) -> str:
    nb = f"({s_neighbors(grid, g)})"
    return f"(SELECT n.addr AS src, n.neighbor AS dst, t.value AS weight FROM {nb} n JOIN {grid} t ON t.addr = n.neighbor)"


def s_patch_sum() -> str:
    return " + ".join(
        "CASE WHEN "
        + " AND ".join(f"x{k} BETWEEN {num(c - 0.5 * w)} AND {num(c + 0.5 * w)}" for k, (c, w) in enumerate(zip(p.center, p.length)))
        + f" THEN {num(p.value)} ELSE 0e0 END"
        for p in PATCHES
    )


def s_patch() -> str:
    return f"SELECT addr, {r(f'value + {s_patch_sum()}')} AS value FROM {s_count(GRID_2D)}"


def s_minimax() -> str:
    start = GRID_2D.address_value(START)
    return (
        f"WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {s_edges(s_price(GRID_2D), GRID_2D)}), reach AS ("
        f"SELECT CAST({start} AS BIGINT) AS addr, CAST('-inf' AS DOUBLE) AS b UNION "
        "SELECT e.dst, greatest(r.b, e.weight) FROM reach r JOIN e ON e.src = r.addr) "
        f"SELECT addr, CASE WHEN addr <> {start} THEN {r('min(b)')} END AS distance FROM reach GROUP BY addr"
    )


def s_patch_table() -> str:
    boxes = (
        "(SELECT CAST(p_size AS DOUBLE) AS c0, 0.5e0 * (p_partkey % 7 + 0.5e0) AS h0, (p_partkey % 11) / 100e0 AS c1, "
        "0.5e0 * ((p_partkey % 5) / 50e0 + 0.003e0) AS h1, p_retailprice / 1000e0 AS raised FROM part)"
    )
    inside = "x0 BETWEEN c0 - h0 AND c0 + h0 AND x1 BETWEEN c1 - h1 AND c1 + h1"
    return (
        f"SELECT addr, {r('any_value(value) + coalesce(sum(raised), 0e0)')} AS value FROM {s_count(GRID_2D)} g LEFT JOIN {boxes} b ON {inside} GROUP BY addr"
    )


def s_append_frame() -> str:
    h, top = s_hourly(), "(SELECT max(frame) FROM h)"
    return (
        f"WITH h AS MATERIALIZED (SELECT * FROM {h}) SELECT frame, addr, {r('value')} AS value FROM h WHERE frame >= {top} - 1 "
        f"UNION ALL SELECT {top} + 1, addr, {r('avg(value)')} FROM h GROUP BY addr"
    )


def s_label_growth() -> str:
    label = "list_reverse_sort([p_retailprice, CAST(p_size AS DOUBLE)])"
    grown = f"list_reverse_sort(list_append({label}, CAST(p_partkey % 1500 AS DOUBLE)))"
    told = f"array_to_string(list_transform({grown}, lambda w: CAST(CAST(w AS DECIMAL(12, 2)) AS VARCHAR)), ',')"
    weight = "CAST(p_partkey % 1500 AS DOUBLE)"
    return (
        f"SELECT p_partkey, {told} AS label, {r(f'{grown}[1]', 3)} AS by_mfep, {r(f'{label}[1] + {weight}', 3)} AS by_sum, "
        f"{r(f'greatest({label}[1], {weight})', 3)} AS by_max FROM part"
    )


def s_nearly_equal() -> str:
    a, b = "l_extendedprice * (1e0 - l_discount)", "(l_extendedprice - l_extendedprice * l_discount)"
    near = f"abs({a} - {b}) < {2.0**-51!r} * abs({a} + {b}) OR abs({a} - {b}) < 2.2250738585072014e-308"
    return (
        f"SELECT l_returnflag, count(*) FILTER ({a} = {b}) AS same, count(*) FILTER ({near}) AS near, count(*) AS rows FROM lineitem GROUP BY 1"
    )


def s_numbers(parts: str) -> str:
    shape = r"^[-+]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[-+]?[0-9]+)?|inf(inity)?|nan)$"
    one = f"CASE WHEN regexp_matches(s, '{shape}', 'i') THEN coalesce(try_cast(s AS DOUBLE), 0e0) ELSE 0e0 END"
    short = lambda x: f"CASE WHEN abs({x}) < 1e9 THEN {r(x, 3)} ELSE {x} END"
    return (
        f"WITH d AS (SELECT doc_id, list_transform({parts}, lambda s: {one}) AS n FROM documents), "
        "f AS (SELECT *, list_filter(n, lambda x: abs(x) < CAST('inf' AS DOUBLE)) AS fin FROM d) "
        f"SELECT doc_id, CAST(len(n) AS BIGINT) AS pieces, {short('coalesce(list_sum(fin), 0e0)')} AS total, {short('list_max(fin)')} AS most, "
        "CAST(len(n) - len(fin) AS BIGINT) AS endless FROM f"
    )


def s_shortest() -> str:
    """Rounds of relaxation over all edges, as many as there are bins."""
    g, start = GRID_2D, GRID_2D.address_value(START)
    return (
        f"WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {s_edges(s_price(g), g)} UNION ALL SELECT range, range, 0e0 FROM range({g.size})), "
        f"b AS (SELECT 0 AS it, CAST({start} AS BIGINT) AS addr, 0e0 AS d UNION ALL "
        f"SELECT b.it + 1, e.dst, min(b.d + e.weight) FROM b JOIN e ON e.src = b.addr WHERE b.it < {g.size} GROUP BY 1, 2) "
        f"SELECT addr, {r('d', 3)} AS distance FROM b WHERE it = {g.size}"
    )


def s_label_key(label: str) -> str:
    """A list that sorts like a label: padded with its last weight, then its length."""
    tail = f"CASE WHEN len({label}) = 0 THEN CAST('-inf' AS DOUBLE) ELSE {label}[-1] END"
    return f"list_concat({label}, list_resize(CAST([] AS DOUBLE[]), 600 - len({label}), {tail}), [CAST(len({label}) AS DOUBLE)])"


def s_search(g: GridSpec, result: str) -> str:
    """Label-setting search, one node served per round of the recursion."""
    start, end = g.address_value(START), g.address_value(END)
    grid = f"(SELECT * REPLACE (value + {s_patch_sum()} AS value) FROM {s_price(g)})"
    order = f"(ORDER BY served IS NOT NULL, label IS NULL, {s_label_key('label')}, addr)"
    new = "list_reverse_sort(list_append(ul, e.weight))"
    better = f"(served IS NULL AND addr <> u AND e.weight IS NOT NULL AND (label IS NULL OR {s_label_key(new)} < {s_label_key('label')}))"
    return (
        f"WITH RECURSIVE g AS MATERIALIZED (SELECT * FROM {grid}), e AS MATERIALIZED (SELECT * FROM {s_edges('g', g)}), "
        f"s AS (SELECT 0 AS it, addr, CASE WHEN addr = {start} THEN CAST([] AS DOUBLE[]) END AS label, "
        f"CASE WHEN addr = {start} THEN [addr] END AS path, CAST(NULL AS INTEGER) AS served FROM g UNION ALL "
        f"SELECT it + 1, addr, CASE WHEN {better} THEN {new} ELSE label END, CASE WHEN {better} THEN list_append(up, addr) ELSE path END, "
        "CASE WHEN addr = u THEN it ELSE served END FROM (SELECT *, first_value(addr) OVER w AS u, first_value(label) OVER w AS ul, "
        f"first_value(path) OVER w AS up FROM s WHERE it < {g.size} WINDOW w AS {order}) LEFT JOIN e ON e.src = u AND e.dst = addr), "
        f"last AS (SELECT * FROM s WHERE it = {g.size}), goal AS (SELECT * FROM last WHERE addr = {end}) "
    ) + result


def s_path_rows(g: GridSpec) -> str:
    xs = ", ".join(f"{r(c)} AS {c}" for c in g.coord_names)
    steps = "(SELECT unnest(path) AS addr, CAST(generate_subscripts(path, 1) - 1 AS INTEGER) AS ord, len(path) - 1 AS n FROM goal)"
    return f"SELECT ord, addr, {r('ord / n')} AS s, {xs}, {r('value')} AS value FROM {steps} JOIN g USING (addr)"


def s_visited(g: GridSpec) -> str:
    xs = ", ".join(f"{r(c)} AS {c}" for c in g.coord_names)
    return f"SELECT addr, {xs} FROM last JOIN {s_points(g)} USING (addr) WHERE served < (SELECT served FROM goal)"


def s_queue_search(g: GridSpec) -> str:
    """Queue-based search, one queued node served per round until the queue is empty."""
    start, end = g.address_value(START), g.address_value(END)
    grid = f"(SELECT * REPLACE (value + {s_patch_sum()} AS value) FROM {s_price(g)})"
    cases = " ".join(
        f"WHEN {s_neighbor(k, p, g).replace('addr', 'src')} = dst THEN {2 * k + (0 if p else 1)}" for k in range(g.ndim) for p in (True, False)
    )
    new = "list_reverse_sort(list_append(ul, e.weight))"
    better = f"(uq IS NOT NULL AND e.weight IS NOT NULL AND (label IS NULL OR {s_label_key(new)} < {s_label_key('label')}))"
    return (
        f"WITH RECURSIVE g AS MATERIALIZED (SELECT * FROM {grid}), e AS MATERIALIZED (SELECT *, CASE {cases} END AS adj FROM {s_edges('g', g)}), "
        f"s AS (SELECT 0 AS it, addr, CASE WHEN addr = {start} THEN CAST([] AS DOUBLE[]) END AS label, "
        f"CASE WHEN addr = {start} THEN [addr] END AS path, CASE WHEN addr = {start} THEN 0 END AS q, 1 AS waiting FROM g UNION ALL "
        f"SELECT it + 1, addr, CASE WHEN {better} THEN {new} ELSE label END, CASE WHEN {better} THEN list_append(up, addr) ELSE path END, "
        f"CASE WHEN addr = u THEN NULL WHEN {better} THEN coalesce(q, it * 10 + adj + 1) ELSE q END, uq FROM (SELECT *, first_value(addr) OVER w AS u, "
        "first_value(label) OVER w AS ul, first_value(path) OVER w AS up, first_value(q) OVER w AS uq FROM s WHERE waiting IS NOT NULL "
        "WINDOW w AS (ORDER BY q NULLS LAST)) LEFT JOIN e ON e.src = u AND e.dst = addr), "
        f"goal AS (SELECT * FROM s WHERE waiting IS NULL AND addr = {end}) " + s_path_rows(g)
    )


def s_dfs(start: int, nodes: int) -> str:
    """Smallest path of edge ranks to every node, relaxed as often as there are nodes."""
    rank = f"(SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY weight, dst) AS k FROM {S_BOTH})"
    return (
        f"WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {rank} UNION ALL SELECT range, range, 0 FROM range({nodes})), "
        f"b AS (SELECT 0 AS it, CAST({start} AS BIGINT) AS node, CAST([] AS BIGINT[]) AS path UNION ALL "
        "SELECT b.it + 1, e.dst, min(CASE WHEN e.k = 0 THEN b.path ELSE list_append(b.path, e.k) END) FROM b JOIN e ON e.src = b.node "
        f"WHERE b.it < {nodes} GROUP BY 1, 2) "
        f"SELECT row_number() OVER (ORDER BY path) - 1 AS visit, node FROM b WHERE it = {nodes}"
    )


S_GRAPH = (
    "(SELECT CAST(round(l_discount * 100) AS BIGINT) AS src, CAST(round(l_tax * 100) AS BIGINT) + 11 AS dst, sum(l_quantity) AS weight "
    "FROM lineitem GROUP BY 1, 2)"
)
S_BOTH = f"(SELECT src, dst, weight FROM {S_GRAPH} UNION ALL SELECT dst, src, weight FROM {S_GRAPH})"


def s_lookup_path(key: str) -> str:
    xs = ["x0", "x1"]
    pos = f"(SELECT {key}, p_size + 4.0e0 AS x0, (p_retailprice - 900.0e0) / 900.0e0 AS x1 FROM part)"
    name = "row" if key != "p_partkey" else "p_partkey"
    return (
        f"SELECT t.\"{name}\", {r('t.x0')} AS x0, {r('t.x1')} AS x1, {r('e.value')} AS value FROM (SELECT *, CASE WHEN {s_inside(xs, GRID_2D)} THEN "
        f"{s_addr(xs, GRID_2D)} END AS addr FROM {pos}) t LEFT JOIN {s_energy(s_count(GRID_2D))} e USING (addr)"
    )


def s_mdlog(short: bool = False) -> str:
    a = LOG_GRID.axes[0]
    x = "(o_totalprice / 1000.0e0)"
    cols = {
        "VDW": "-o_totalprice / 2.0e0", "ELECT": "o_totalprice * 1.5e-3", "TS": "CAST(o_orderkey AS DOUBLE)",
        "VDW_FORCE_x": "o_totalprice", "VDW_FORCE_y": "CAST(o_orderkey AS DOUBLE)", "VDW_FORCE_z": "1.5e0",
    }
    if short:
        cols = {n: c for n, c in cols.items() if n not in ("ELECT", "TS")}
    mean = "sum({}) FILTER (o_orderkey < (SELECT max(o_orderkey) FROM orders)) / count(*)" if short else "avg({})"
    means = ", ".join(f'{mean.format(c)} AS "{n}"' for n, c in cols.items())
    out = ", ".join(f'{r(f"coalesce({n}, 0e0)", 4)} AS "{n}"' for n in cols)
    return (
        f"SELECT addr, {out} FROM (SELECT range AS addr FROM range({a.bins})) LEFT JOIN (SELECT {s_idx(x, a)} AS addr, {means} FROM orders "
        f"WHERE {s_in(x, a)} GROUP BY 1) USING (addr)"
    )


def s_small() -> dict[str, str]:
    """Counterparts of what is written and read back, and of small operators; constants are spelt out."""
    hours, both = GridSpec.of(HOURS.axes[0]), "SELECT {} AS frame, addr, {} AS value FROM {}"
    count = both.format(0, "value", s_hist("events", ["value"], hours, "count(*)"))
    total = both.format(1, r("value", 2), s_hist("events", ["value"], hours, "sum(value)"))
    last = f"(SELECT addr, value FROM {s_hourly()} WHERE frame = (SELECT max(frame) FROM {s_hourly()}))"
    first = f"(SELECT min((src, dst)) AS e FROM {S_BOTH})"
    return {
        "split_frames_text": f"SELECT frame, addr, {r('value')} AS value FROM {s_hourly()}",
        "rmsd_text": s_rmsd(last),
        "patched_grid_text": s_patch(),
        "path_pmf_text": f"SELECT x0, x1, value FROM ({s_lookup_path('p_partkey')})",
        "snapshots_text": f"SELECT step, addr, value FROM ({s_strided()})",
        "files_in_list_order": f"{count} UNION ALL {total}",
        "mdlog_short_log": s_mdlog(True),
        "thermal_energy": "SELECT p_partkey, round(p_size * 0.001987204258641e0, 12) AS kcal, round(p_size * 0.008314462618153e0, 12) AS kj FROM part",
        "hist_generate_vector": f"SELECT addr, {r('g0 + x0 * 2e0')} AS v0, {r('g1 - x1')} AS v1 FROM {s_field(GRID_2D)}",
        "edited_axis_edges": "SELECT b AS addr, 10e0 + 2.5e0 * b AS low, 12.5e0 + 2.5e0 * b AS high, CAST(count(l_quantity) AS DOUBLE) AS value "
        "FROM (SELECT range AS b FROM range(16)) LEFT JOIN lineitem ON l_quantity BETWEEN 10 AND 50 "
        "AND b = CAST(least(floor((l_quantity - 10e0) / 2.5e0), 15) AS BIGINT) GROUP BY b",
        "edge_lookup": f"SELECT 'there' AS which, {r('max(weight)')} AS weight, true AS found FROM {S_BOTH} JOIN {first} ON src = e[1] AND dst = e[2] "
        "UNION ALL SELECT 'absent', 0e0, false",
    }


def oracle_sql() -> dict[str, str]:
    """For each query, SQL that computes the same rows from the same tables."""
    e2, c2 = s_energy(s_count(GRID_2D)), s_count(GRID_2D)
    one_d, circle = GridSpec.of(VALUE), GridSpec.of(CIRCLE)
    early = "l_shipdate < TIMESTAMP '1998-01-01'"
    vec = {"fx": "l_extendedprice", "fy": "l_quantity * l_discount", "fz": "l_tax - l_discount"}
    cyc = s_energy(s_count(GRID_CYC))
    ref = "(SELECT addr, x0 AS value FROM " + s_points(HOURS) + ")"
    last = f"(SELECT addr, value FROM {s_hourly()} WHERE frame = (SELECT max(frame) FROM {s_hourly()}))"
    user = "(user_id * 11.0e0 - 700.0e0)"
    price = s_reweight(GridSpec.of(PRICE), ["l_extendedprice"])
    price_tax = s_reweight(GridSpec.of(PRICE, TAX), ["l_extendedprice", "l_tax"])
    parts = "list_filter(regexp_split_to_array(text, '[(),\\s]+'), lambda s: s <> '')"
    sums = s_hist("lineitem", LI[:2], GRID_2D, "sum(l_extendedprice)")
    hills_1d = s_hills(one_d, [("c0", "s0")])
    return text_sql() | s_small() | {
        "axis_wrap_index": s_axis_query(),
        "axis_min_image_dist": f"SELECT event_id, {r(s_dist(SA, user, ANGLE))} AS cyclic, {r(s_dist(SA, user, VALUE))} AS plain FROM events",
        "grid_reverse_address": s_reverse(),
        "grid_points": s_table(s_count(GRID_3D), GRID_3D, "n"),
        "hist_count_1d": s_table(s_count(GRID_1D), GRID_1D),
        "hist_count_2d": s_table(c2, GRID_2D),
        "hist_sum": f"SELECT addr, {r('value', 2)} AS value FROM {sums}",
        "hist_mean_dense": f"SELECT addr, {r('value')} AS value FROM {s_hist('lineitem', ['l_discount'], GAPS, 'avg(l_extendedprice)')}",
        "hist_vector_mean": "SELECT addr, "
        + ", ".join(f"{r(f'coalesce({n}, 0e0)')} AS {n}" for n in vec)
        + f" FROM (SELECT range AS addr FROM range({QTY.bins})) LEFT JOIN (SELECT {s_idx('l_quantity', QTY)} AS addr, "
        + ", ".join(f"avg({c}) AS {n}" for n, c in vec.items())
        + f" FROM lineitem WHERE {s_in('l_quantity', QTY)} GROUP BY 1) USING (addr)",
        "hist_merge": f"SELECT addr, sum(value) AS value FROM (SELECT addr, value FROM {s_hist('lineitem', ['l_quantity'], GRID_1D, 'count(*)', early)} "
        f"UNION ALL SELECT {s_idx('x0', QTY)} AS addr, value FROM {s_hist('lineitem', ['l_quantity'], GridSpec.of(FINE_QTY), 'count(*)', f'NOT ({early})')}) GROUP BY 1",
        "hist_apply": f"SELECT addr, {r('sqrt(value) * 2e0 - 1e0')} AS value FROM {c2}",
        "hist_generate": f"SELECT addr, {r('value - (x0 * 2e0 + x1 * 100e0)')} AS value FROM {c2}",
        "hist_set": f"SELECT addr, CASE WHEN addr = {GRID_2D.address_value([27.0, 0.05])} THEN -1e0 ELSE value END AS value FROM {c2}",
        "grid_sum_min": f"SELECT {r('min(value)', 3)} AS minimum, {r('sum(value)', 3)} AS total FROM {s_price(GRID_2D)}",
        "pmf_lookup_path": s_lookup_path("p_partkey"),
        "point_lookup": f"SELECT q, count(*) AS n, {r('sum(coalesce(value, 0e0))', 2)} AS total FROM (SELECT q, CASE WHEN {s_inside(['q', 'd'], GRID_2D)} THEN "
        f"{s_addr(['q', 'd'], GRID_2D)} END AS addr FROM (SELECT l_quantity AS q, l_discount * 1.3e0 AS d FROM lineitem)) LEFT JOIN {s_price(GRID_2D)} USING (addr) GROUP BY q",
        "prob_to_pmf_norm": f"SELECT addr, {r('f - min(f) OVER ()')} AS value FROM (SELECT addr, CASE WHEN value > 0 THEN -{num(KT)} * ln(value / sum(value) OVER ()) "
        f"ELSE CAST('inf' AS DOUBLE) END AS f FROM {c2})",
        "prob_to_pmf_maxfill": f"SELECT addr, {r('value')} AS value FROM {s_energy(s_hist('lineitem', ['l_discount'], GAPS, 'count(*)'))}",
        "project_2d_to_1d": s_project(e2, GRID_2D, [0]),
        "project_permute_3d_to_2d": s_project(s_energy(s_count(GRID_3D)), GRID_3D, [2, 0]),
        "reweight": f"SELECT addr, {r('value', 4)} AS value FROM {price}",
        "reweight_pmf": f"SELECT addr, {r('value')} AS value FROM {s_energy(price_tax)}",
        "history_frames": f"SELECT frame, addr, {r('value')} AS value FROM {s_hourly()}",
        "history_text": f"SELECT frame, addr, {r('value')} AS value FROM {s_hourly()} WHERE frame >= (SELECT CAST(floor((epoch(min(ts)) - 1704067200) / 3600) AS BIGINT) FROM events)",
        "history_rmsd_last": s_rmsd(last),
        "history_rmsd_ref": s_rmsd(ref),
        "derivative": f"SELECT addr, {r(s_derivative('value', 0, GRID_2D), 3)} AS d0, {r(s_derivative('value', 1, GRID_2D), 3)} AS d1 FROM {s_price(GRID_2D)}",
        "derivative_periodic": f"SELECT addr, {r(s_derivative('value', 0, GridSpec.of(ANGLE)))} AS d0 FROM {s_hist('events', [SA], GridSpec.of(ANGLE), 'avg(value)')}",
        "divergence": f"SELECT addr, {r('div', 4)} AS value FROM {s_div(GRID_CYC)}",
        "poisson_integrate": s_poisson(),
        "poisson_laplacian": s_poisson_laplacian(),
        "poisson_line": s_poisson_line(),
        "sum_hills_1d": hills_1d,
        "sum_hills_2d_grad": s_hills(HILLS_2D, [("c0", "s0"), ("c1", "s1")]),
        "sum_hills_periodic": s_hills(circle, [("c1", "s1")]),
        "sum_hills_strided": s_strided(),
        "well_tempered": s_hills(one_d, [("c0", "s0")], "1.1e0"),
        "neighbors": s_neighbors(f"(SELECT addr FROM {s_count(GRID_CYC)} WHERE value > 0)", GRID_CYC),
        "grid_edges": f"SELECT src, dst, {r('weight')} AS weight FROM {s_edges(cyc, GRID_CYC)}",
        "edge_stats": f"SELECT count(*) AS edges, {r('sum(abs(weight))')} AS abs_weight FROM {s_edges(cyc, GRID_CYC)}",
        "build_graph": f"SELECT src, dst, {r('weight')} AS weight FROM {S_BOTH}",
        "sorted_adjacency": f"SELECT src, row_number() OVER (PARTITION BY src ORDER BY weight, dst) AS place, dst, {r('weight')} AS weight FROM {S_BOTH}",
        "patch_grid": s_patch(),
        "patch_table": s_patch_table(),
        "path_file_text": f"SELECT x0, x1, value FROM ({s_search(GRID_2D, s_path_rows(GRID_2D))})",
        "region_file_text": f"SELECT x0, x1 FROM ({s_search(GRID_2D, s_visited(GRID_2D))})",
        "canonical_order": f"SELECT row_number() OVER (ORDER BY i0, i1, i2) - 1 AS place, addr, {r('value')} AS value FROM {s_price(GRID_3D)}",
        "element_access": f"SELECT addr, {r('value')} AS value FROM {s_price(GRID_2D)} WHERE addr IN (7, 23)",
        "append_frame": s_append_frame(),
        "adjacency_print": f"SELECT row_number() OVER (ORDER BY src, weight, dst) - 1 AS place, src || ' -> ' || dst || ' (' || printf('%.6g', weight) || ')' AS line FROM {S_BOTH}",
        "label_growth": s_label_growth(),
        "nearly_equal": s_nearly_equal(),
        "minimax_barrier": s_minimax(),
        "shortest_sum": s_shortest(),
        "mfep_dijkstra": s_search(GRID_2D, s_path_rows(GRID_2D)),
        "mfep_visited": s_search(GRID_2D, s_visited(GRID_2D)),
        "mfep_spfa": s_queue_search(GRID_2D),
        "dfs_order": s_dfs(0, 20),
        "traj_text_parse": f"SELECT addr, {r('value', 2)} AS value FROM {sums}",
        "number_list_parse": s_numbers(parts),
        "hills_text": hills_1d,
        "grid_text_round_trip": s_table(s_count(GRID_CYC), GRID_CYC),
        "vector_grid_text": f"SELECT addr, {r('g0')} AS v0, {r('g1')} AS v1 FROM {s_field(GRID_CYC)}",
        "path_text": s_lookup_path('row_number() OVER (ORDER BY p_partkey) - 1 AS "row"'),
        "mdlog_parse_bin": s_mdlog(),
        "stream_bin_sum": f"SELECT addr, {r('value', 2)} AS value FROM {s_hist('events', ['value'], one_d, 'sum(value)')}",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name."""
    own = {name[2:]: f for name, f in globals().items() if name.startswith("q_") and callable(f)}
    return own | text_queries()


def text_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The text operators and their pipeline; none where that part of the library is absent."""
    if llm is None:
        return {}
    return llm.queries() | {"pipeline": corpus_pipeline.run}


def text_sql() -> dict[str, str]:
    if llm is None:
        return {}
    return llm.oracle_sql() | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})


def entry(spark: SparkSession) -> DataFrame:
    """Project a two-dimensional free-energy grid onto one axis."""
    return q_project_2d_to_1d(spark, "/root/testdata/sf0.001")
