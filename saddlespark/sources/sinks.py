"""Writers of the text formats.

Output is a folder of part files whose concatenation in name order is the text file:
rows are range-partitioned by their place in the grid, so no single task has to hold a
large grid, and a small one ends up in a single part.  The readers take such a folder
wherever they take a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import GridSpec
from ..operators.histogram import Histogram
from ..operators.history import frame_suffix
from ..session import materialize

# Field width and digits of the text formats.
FIELD_WIDTH = 24
DIGITS = 15
HEADER_DIGITS = 9
# How many grids are dealt out to the tasks that write them.
TASKS_PER_CORE = 4
GRIDS_PER_TASK = 16
LINES_PER_TASK = 1 << 20


def header_lines(spec: GridSpec) -> list[str]:
    d = HEADER_DIGITS
    rows = [f"# {a.lower:.{d}f} {a.width:.{d}f} {a.bins} {int(a.periodic)}" for a in spec.axes]
    return [f"# {spec.ndim}", *rows]


def scientific(x: Column) -> Column:
    text = F.format_string(f"%{FIELD_WIDTH}.{DIGITS}e", x)
    inf = F.lit("inf".rjust(FIELD_WIDTH))
    return F.when(x == F.lit(float("inf")), inf).otherwise(text)


def fixed(x: Column) -> Column:
    return F.format_string(f"%{FIELD_WIDTH}.{DIGITS}f", x)


def _grid_lines(df: DataFrame, spec: GridSpec, values: list[str], keys: list[str]) -> DataFrame:
    """``keys.., i0.., value``: header lines sort in front of the rows of their grid."""
    cells = [scientific(F.col(c)) for c in (*spec.coord_names, *values)]
    rows = spec.with_coords(df).select(*keys, *spec.index_names, F.concat_ws(" ", *cells).alias("value"))
    heads = header_lines(spec)
    n = len(heads)
    lines = F.array(*[F.lit(h) for h in heads])
    source = df.select(*keys).distinct() if keys else df.sparkSession.range(1)
    top = source.select(*keys, F.posexplode(lines).alias("_p", "value"))
    first, *others = spec.index_names
    top = top.select(
        *keys, (F.col("_p") - n).cast("long").alias(first), *[F.lit(0).cast("long").alias(c) for c in others], "value"
    )
    return rows.unionByName(top)


def write_grid(hist: Histogram, path: str) -> None:
    """Write a scalar or vector grid file, last axis fastest."""
    lines = _grid_lines(hist.dense().df, hist.spec, list(hist.values), [])
    lines.orderBy(*hist.spec.index_names).select("value").write.mode("overwrite").text(path)


def write_grids(df: DataFrame, spec: GridSpec, values: list[str], name: Column, path: str) -> None:
    """Write many grids at once, each to the subfolder ``name=<name>`` of ``path``.

    ``df`` has ``addr`` and ``values`` for each grid, dense.
    """
    # written once: the lines are counted, sampled for the ranges and dealt out
    lines = materialize(_grid_lines(df.withColumn("name", name), spec, values, ["name"]))
    found = lines.agg(F.count("*").alias("n"), F.approx_count_distinct("name").alias("grids")).first()
    # what a file costs does not show in bytes, by which adaptive execution would leave the files of all grids to a few tasks
    tasks = min(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, found.grids // GRIDS_PER_TASK)
    tasks = max(1, tasks, -(-found.n // LINES_PER_TASK))
    order = ["name", *spec.index_names]
    parts = lines.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    parts.select("name", "value").write.mode("overwrite").partitionBy("name").text(path)


def write_frames(history: DataFrame, spec: GridSpec, prefix: str) -> None:
    """Split a history into one grid file per frame below ``<prefix>_frames``."""
    count = history.agg(F.max("frame")).first()[0] + 1
    base = prefix.rstrip("/").rpartition("/")[2]
    name = F.concat(F.lit(base + "_"), frame_suffix(F.col("frame"), count), F.lit(".pmf"))
    write_grids(history, spec, ["value"], name, prefix + "_frames")


def write_rmsd(rmsd: DataFrame, path: str) -> None:
    line = F.concat_ws(" ", F.format_string(f"%{FIELD_WIDTH}d", "frame"), fixed(F.col("rmsd")))
    rmsd.orderBy("frame").select(line.alias("value")).write.mode("overwrite").text(path)


def write_path(path_rows: DataFrame, spec: GridSpec, path: str) -> None:
    """Nodes of a path with their energy: ``ord, x0.., value``."""
    cells = [scientific(F.col(c)) for c in (*spec.coord_names, "value")]
    path_rows.orderBy("ord").select(F.concat_ws(" ", *cells).alias("value")).write.mode("overwrite").text(path)


def write_region(visited: DataFrame, spec: GridSpec, path: str) -> None:
    """Positions of the visited nodes, by address."""
    cells = [scientific(F.col(c)) for c in spec.coord_names]
    visited.orderBy("addr").select(F.concat_ws(" ", *cells).alias("value")).write.mode("overwrite").text(path)


def write_path_pmf(looked_up: DataFrame, spec: GridSpec, path: str) -> None:
    """Positions and grid value; the value is blank where the position is off the grid."""
    cells = [fixed(F.col(c)) for c in spec.coord_names]
    value = F.coalesce(fixed(F.when(F.col("value").isNotNull(), F.col("value"))), F.lit(""))
    value = F.when(F.col("value").isNull(), F.lit("")).otherwise(value)
    looked_up.orderBy("row").select(F.concat_ws(" ", *cells, value).alias("value")).write.mode("overwrite").text(path)
