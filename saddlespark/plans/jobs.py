"""The seven jobs a configuration file can ask for.

Each takes the parsed JSON object and writes its results.  A missing key counts as an
empty string, 0, false or an empty list.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.axis import Axis
from ..functions.grid import GridSpec
from ..functions.units import parse_numbers, thermal_energy
from ..operators import thermo
from ..operators.hills import snapshots, sum_hills, well_tempered
from ..operators.histogram import Histogram, lookup
from ..operators.history import rmsd
from ..operators.patches import Patch
from ..operators.search import find_path
from ..session import materialize
from ..sources import sinks
from ..sources.mdlog import bin_log, read_md_log
from ..sources.text import (
    STRICT,
    read_grid,
    read_hills,
    read_history,
    read_lines,
    read_path,
    read_trajectory,
)


def _axis(cfg: dict) -> Axis:
    lower, upper = float(cfg.get("Lower bound", 0)), float(cfg.get("Upper bound", 0))
    return Axis.from_width(lower, upper, float(cfg.get("Width", 0)), bool(cfg.get("Periodic", False)))


def _kt(cfg: dict) -> float:
    return thermal_energy(float(cfg.get("Temperature", 0)), cfg.get("Unit", ""))


def project(spark: SparkSession, cfg: dict) -> None:
    pmf = read_grid(spark, cfg.get("Input", ""))
    sinks.write_grid(thermo.project(pmf, [int(a) for a in cfg.get("To axis", [])], _kt(cfg)), cfg.get("Output", ""))


def reweighting_axes(pmf: GridSpec, source: list[int], target: list[int]) -> list[dict]:
    """Axes to choose for a reweighting, as rows of a form.

    The PMF axes come first, in order, and keep their periodicity; target columns the PMF
    does not have follow with a single bin from 0 to 1 to be filled in.
    """
    if len(source) != pmf.ndim:
        raise ValueError("one source column is needed per axis of the PMF")
    rows = [{"column": c, "axis": a, "in_pmf": True, "reweight_to": c in target} for c, a in zip(source, pmf.axes)]
    rows += [
        {"column": c, "axis": Axis(0.0, 1.0, 1), "in_pmf": False, "reweight_to": True} for c in target if c not in source
    ]
    return rows


def reweight(spark: SparkSession, cfg: dict) -> None:
    pmf = read_grid(spark, cfg.get("Input", ""))
    source = [int(c) for c in cfg.get("From columns", [])]
    target = [int(c) for c in cfg.get("To columns", [])]
    if len(source) != pmf.spec.ndim:
        raise ValueError("one source column is needed per axis of the PMF")
    # axes are paired with columns by name, whatever order they are listed in
    axes = {int(a.get("Target Column", 0)): _axis(a) for a in cfg.get("Reweighting Axes", [])}
    if set(axes) != set(target):
        raise ValueError(f"axes are given for columns {sorted(axes)}, results are asked for {target}")
    spec = GridSpec(tuple(axes[c] for c in target))
    names = {f"t{c}": c for c in {*source, *target}}
    traj = read_trajectory(spark, cfg.get("Trajectories", []), names, cfg.get("Mode", STRICT))
    kt = _kt(cfg)
    out = thermo.reweight(traj, pmf, [F.col(f"t{c}") for c in source], spec, [F.col(f"t{c}") for c in target], kt)
    if cfg.get("Convert to PMF", False):
        out = thermo.to_free_energy(Histogram(spec, materialize(out.df)), kt)
    sinks.write_grid(out, cfg.get("Output", ""))


def history(spark: SparkSession, cfg: dict) -> None:
    spec, frames = read_history(spark, cfg.get("History PMF Files", []), cfg.get("Mode", STRICT))
    prefix = cfg.get("Output", "")
    if cfg.get("RMSD", False):
        reference = read_grid(spark, cfg["Reference"]) if cfg.get("Reference") else None
        sinks.write_rmsd(rmsd(frames, spec, reference), prefix + "_rmsd.dat")
    if cfg.get("Split", False):
        sinks.write_frames(frames, spec, prefix)


def namdlog(spark: SparkSession, cfg: dict) -> None:
    axes = cfg.get("Axes", [])
    spec = GridSpec(tuple(_axis({**a, "Periodic": False}) for a in axes))
    energies, forces = list(cfg.get("Energies", [])), list(cfg.get("Forces", []))
    log = read_md_log(spark, cfg.get("NAMD log", ""))
    traj = read_lines(spark, cfg.get("Trajectory", ""))
    means = bin_log(log, traj, spec, [int(a.get("Column", 0)) for a in axes], energies, forces, mode=cfg.get("Mode", STRICT))
    means = Histogram(spec, materialize(means.df), means.values)
    prefix = cfg.get("Output", "")
    for t in energies:
        sinks.write_grid(Histogram(spec, means.df, (t,)), f"{prefix}_{t.lower()}.dat")
    for t in forces:
        sinks.write_grid(Histogram(spec, means.df, tuple(f"{t}_{c}" for c in "xyz")), f"{prefix}_{t.lower()}.dat")


# Numbers of the search algorithms in a configuration.
ALGORITHMS = {0: "dijkstra", 1: "spfa"}


def mfep(spark: SparkSession, cfg: dict) -> None:
    pmf = read_grid(spark, cfg.get("Input PMF", ""))
    patches = [
        Patch(tuple(parse_numbers(p.get("Center", ""))), tuple(parse_numbers(p.get("Lengths", ""))), float(p.get("Value", 0)))
        for p in cfg.get("Patches", [])
    ]
    start, end = parse_numbers(cfg.get("Start", "")), parse_numbers(cfg.get("End", ""))
    found = find_path(pmf, start, end, patches, ALGORITHMS[int(cfg.get("Algorithm", 0))])
    prefix = cfg.get("Output", "")
    sinks.write_path(found.path, pmf.spec, prefix + ".path")
    sinks.write_region(found.visited, pmf.spec, prefix + ".region")
    if patches:
        sinks.write_grid(found.grid, prefix + ".patched")


def sumhills(spark: SparkSession, cfg: dict) -> None:
    spec = GridSpec(tuple(_axis(a) for a in cfg.get("Axes", [])))
    stride, prefix = int(cfg.get("Stride", 0)), cfg.get("Output", "")
    hills = read_hills(spark, cfg.get("Trajectory", ""), spec.ndim, cfg.get("Mode", STRICT), with_rows=stride > 0)
    tempered = bool(cfg.get("Well tempered", False))
    factor = (float(cfg.get("Bias temperature", 0)), float(cfg.get("Temperature", 0)))
    grads = tuple(f"g{k}" for k in range(spec.ndim))

    def scaled(h: Histogram) -> Histogram:
        return well_tempered(h, *factor) if tempered else h

    if stride > 0:
        steps = scaled(Histogram(spec, snapshots(hills, spec, stride), ("value", *grads)))
        # of several hills with the same step the last one names the snapshot
        keys = ["step", "addr"]
        rows = steps.df.groupBy(*keys).agg(F.max_by(F.struct("value", *grads), "snapshot").alias("v")).select(*keys, "v.*")
        rows = materialize(rows)
        base = prefix.rstrip("/").rpartition("/")[2]
        label = F.concat(F.lit(base + "_"), F.col("step").cast("string"))
        sinks.write_grids(rows, spec, ["value"], F.concat(label, F.lit(".pmf")), prefix + "_snapshots_pmf")
        sinks.write_grids(rows, spec, list(grads), F.concat(label, F.lit(".grad")), prefix + "_snapshots_grad")
    total = scaled(sum_hills(hills, spec))
    total = Histogram(spec, materialize(total.df), total.values)
    sinks.write_grid(Histogram(spec, total.df, ("value",)), prefix + ".pmf")
    sinks.write_grid(Histogram(spec, total.df, grads), prefix + ".grad")


def pathpmf(spark: SparkSession, cfg: dict) -> None:
    pmf = read_grid(spark, cfg.get("Input PMF", ""))
    path = read_path(spark, cfg.get("Input Path File", ""), pmf.spec.ndim)
    values = lookup(path, pmf, [F.col(c) for c in pmf.spec.coord_names], outside=None)
    sinks.write_path_pmf(values, pmf.spec, cfg.get("Output", ""))


# In order of priority when several are asked for at once.
JOBS: dict[str, Callable[[SparkSession, dict], None]] = {
    "project": project,
    "reweight": reweight,
    "history": history,
    "namdlog": namdlog,
    "mfep": mfep,
    "sumhills": sumhills,
    "pathpmf": pathpmf,
}


def run(spark: SparkSession, job: str, config_path: str) -> None:
    with open(config_path, encoding="utf-8") as f:
        JOBS[job](spark, json.load(f))
