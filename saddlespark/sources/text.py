"""Readers for the whitespace-separated text formats.

Every reader is ``spark.read.text`` followed by column expressions, so large files are
split and parsed in parallel.  Where the position of a line matters (frames, row-wise
pairing, "the last line wins"), order comes from the file, the offset of the split in
it and the row inside the split - never from the order of partitions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.axis import Axis
from ..functions.grid import GridSpec
from ..functions.units import FIELD_SEPARATOR, fields, to_number
from ..operators.histogram import Histogram
from ..operators.history import fill_frames
from ..operators.ordered import explode_range, number_rows, running_sum
from ..session import materialize

WHITESPACE = r"\s+"
STRICT, PERMISSIVE = "strict", "permissive"


# ---- lines --------------------------------------------------------------------
def _local(path: str) -> str:
    return unquote(urlparse(path).path if "://" in path or path.startswith("file:") else path).rstrip("/")


# Spark names the files of a folder part-00000, part-00001, ... and adds digits from 100000 on.
NUMBERED = r"^(.*/part-)(\d+)([^/]*)$"
DIGITS = 12


def _part_name(path: str) -> str:
    """A file's name in a form whose text order is the order of the files.

    A local file is spelt file:/x in one place and file:///x in another.
    """
    path = re.sub("^file:/+", "file:/", path)
    return re.sub(NUMBERED, lambda m: m[1] + m[2].rjust(DIGITS, "0") + m[3], path)


def _part_column(path: Column) -> Column:
    """The column form of :func:`_part_name`, which meets every line: without patterns, which cost more than reading the line."""
    path = F.when(path.startswith("file:/"), F.concat(F.lit("file:"), F.lit("/"), F.ltrim(F.substring(path, 6, 1 << 30), F.lit("/")))).otherwise(path)
    name = F.substring_index(path, "/", -1)
    behind = F.substring(name, 6, 1 << 30)  # of "part-"
    rest = F.ltrim(behind, F.lit("0123456789"))
    digits = F.char_length(behind) - F.char_length(rest)
    number = F.lpad(F.left(behind, digits), F.greatest(digits, F.lit(DIGITS)), "0")
    numbered = name.startswith("part-") & (digits > 0) & path.contains("/")
    return F.when(numbered, F.concat(F.left(path, F.char_length(path) - F.char_length(behind)), number, rest)).otherwise(path)


@dataclass(frozen=True)
class Lines:
    """Lines of one or more files with their place: ``value, part, block``.

    ``part`` is the file name and ``block`` the offset of the input split in it.
    ``files`` maps each ``part`` to the position of its path in the list given; one path
    needs no such map, because the parts of a folder are ordered by their names.
    """

    df: DataFrame
    files: DataFrame | None
    first_parts: tuple[str, ...] | None = None

    def map(self, f) -> "Lines":
        return Lines(f(self.df), self.files, self.first_parts)

    def numbered(self, out: str = "row") -> DataFrame:
        return number_rows(self.df, self.files, out)


def read_lines(spark: SparkSession, paths: str | list[str]) -> Lines:
    paths = [paths] if isinstance(paths, str) else list(paths)
    part = _part_column(F.col("_metadata.file_path"))
    df = spark.read.text(paths).select("value", part.alias("part"), F.col("_metadata.file_block_start").alias("block"))
    if len(paths) == 1:
        return Lines(df, None)
    given = {_local(p): k for k, p in reversed(list(enumerate(paths)))}

    def owner(found: str) -> int:
        p = _local(found)
        while p and p not in given:
            p = p.rpartition("/")[0]
        return given.get(p, len(paths))

    table = [(_part_name(f), owner(f)) for f in df.inputFiles()]
    files = spark.createDataFrame(table, "part string, file int")
    return Lines(df, files, tuple(f for f, k in table if k == 0))


def first_lines(lines: Lines, keep: Column, n: int, all_paths: bool = False) -> list[str]:
    """The first ``n`` lines that meet ``keep``, in reading order, from the first path or all.

    Files are asked for one after the other by their name, which leaves the other files
    unread, and of a file no more splits are read than it takes: a header is found in the
    first split of the first file.
    """
    found: list[str] = []
    names = sorted({_part_name(f) for f in lines.df.inputFiles()})
    if lines.first_parts is not None and not all_paths:
        names = [f for f in names if f in lines.first_parts]
    for name in names:
        here = lines.df.filter((F.col("part") == name) & keep).select("value")
        found += [r.value for r in here.take(n - len(found))]
        if len(found) == n:
            break
    return found


def is_data(separator: str = FIELD_SEPARATOR) -> Column:
    """Neither a blank line nor a ``#`` line.

    Looks at the start of the raw line, so a filter on it does not split the line.
    """
    return F.col("value").rlike(r"^\s*[^\s#]" if separator == WHITESPACE else r"^[(),\s]*[^(),\s#]")


def data_fields(lines: DataFrame, separator: str = FIELD_SEPARATOR) -> DataFrame:
    """Add the fields of each line as ``f``; blank lines and ``#`` lines are dropped."""
    return lines.filter(is_data(separator)).withColumn("f", fields(F.col("value"), separator))


def must(x: Column, problem: str, where: Column | None = None, separator: str = FIELD_SEPARATOR) -> Column:
    """``x``, or an error naming the line where it is NULL.

    The optimizer may evaluate an expression before the filter that drops comment lines,
    so the error itself is limited to lines that hold data (and meet ``where``).
    """
    guard = is_data(separator) if where is None else is_data(separator) & where
    return F.coalesce(x, F.when(guard, F.raise_error(F.concat(F.lit(problem + ": "), F.col("value")))))


def number_at(
    pos: int, mode: str = STRICT, where: Column | None = None, shape: Column | None = None, separator: str = FIELD_SEPARATOR
) -> Column:
    """Field ``pos`` as a double; a bad one raises, or is NULL in permissive mode.

    A line that does not meet ``shape`` has no good numbers.
    """
    x = to_number(F.get("f", F.lit(pos)))
    if shape is not None:
        x = F.when(shape, x)
    return x if mode == PERMISSIVE else must(x, f"field {pos} is not a number in its place", where, separator).cast("double")


def parsed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated once per row.

    The optimizer copies a projected expression into every filter that follows and so splits and
    matches each line several times; it does not reach behind a generator.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in {n.lower() for n in columns}]
    return df.select(*kept, F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


# ---- trajectories and hills ------------------------------------------------------
def parse_trajectory(lines: DataFrame, columns: dict[str, int], mode: str = STRICT) -> DataFrame:
    """Pick numeric columns by position.  Permissive mode drops rows it cannot read."""
    df = parsed_once(data_fields(lines), {n: number_at(p, mode) for n, p in columns.items()})
    return df.dropna(subset=list(columns)) if mode == PERMISSIVE else df


def read_trajectory(spark: SparkSession, paths: str | list[str], columns: dict[str, int], mode: str = STRICT) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    return parse_trajectory(spark.read.text(paths), columns, mode).select(*columns)


def parse_hills(lines: DataFrame, ndim: int, mode: str = STRICT) -> DataFrame:
    """``step, c0.., s0.., height`` from lines of exactly 2N+2 fields."""
    df = data_fields(lines)
    width = 2 * ndim + 2
    fits = F.size("f") == width
    step = F.when(fits, F.get("f", F.lit(0)).try_cast("long"))
    if mode != PERMISSIVE:
        step = must(step, f"a hill needs a step and {width - 1} numbers").cast("long")
    cols = {"step": step}
    cols |= {f"c{k}": number_at(1 + k, mode, shape=fits) for k in range(ndim)}
    cols |= {f"s{k}": number_at(1 + ndim + k, mode, shape=fits) for k in range(ndim)}
    cols["height"] = number_at(1 + 2 * ndim, mode, shape=fits)
    df = parsed_once(df, cols)
    return df.dropna(subset=list(cols)) if mode == PERMISSIVE else df


def read_hills(spark: SparkSession, path: str | list[str], ndim: int, mode: str = STRICT, with_rows: bool = False) -> DataFrame:
    keep = ["step", *[f"c{k}" for k in range(ndim)], *[f"s{k}" for k in range(ndim)], "height"]
    if with_rows:
        return read_lines(spark, path).map(lambda d: parse_hills(d, ndim, mode)).numbered().select("row", *keep)
    paths = [path] if isinstance(path, str) else list(path)
    return parse_hills(spark.read.text(paths), ndim, mode).select(*keep)


# ---- grids --------------------------------------------------------------------
def read_header(lines: Lines) -> GridSpec:
    """Grid axes from the first ``# N`` line of the first file and the N lines behind it."""
    comment = F.col("value").rlike(r"^\s*#")
    top = [x.split() for x in first_lines(lines, comment, 1)]
    if not top or len(top[0]) < 2:
        raise ValueError("the file has no '# N' line")
    n = int(top[0][1])
    axes = [x.split() for x in first_lines(lines, comment, n + 1)][1:]
    if len(axes) < n or any(len(a) < 5 for a in axes):
        raise ValueError(f"the header does not describe {n} axes")
    out = []
    for a in axes:
        lower, width, bins = float(a[1]), float(a[2]), int(a[3])
        out.append(Axis(lower, lower + width * bins, bins, int(a[4]) != 0))
    return GridSpec(tuple(out))


def _foreign_header(spec: GridSpec) -> Column:
    """True for a ``# N`` line with another N and for a line of an axis that ``spec`` does not have.

    ``f`` holds the fields of a comment line; comments without these numbers are no headers.
    """
    x = [to_number(F.get("f", F.lit(k))) for k in range(1, 5)]
    own = F.lit(False)
    for a in spec.axes:
        near = [F.abs(x[k] - v) <= 1e-6 * max(a.width, abs(v)) for k, v in ((0, a.lower), (1, a.width))]
        own = own | near[0] & near[1] & (x[2] == a.bins) & ((x[3] != 0) == F.lit(bool(a.periodic)))
    count = (F.size("f") == 2) & (x[0] != spec.ndim)
    axis = (F.size("f") == 5) & x[0].isNotNull() & x[1].isNotNull() & x[2].isNotNull() & x[3].isNotNull() & ~own
    return F.coalesce(count | axis, F.lit(False))


def _grid_rows(lines: Lines, spec: GridSpec, nvalues: int, other_shapes: str) -> DataFrame:
    """``addr, v0..`` of the data rows; of several rows for one bin the last one counts."""
    n = spec.ndim
    rows = data_fields(lines.df, WHITESPACE)
    fits = F.size("f") == n + nvalues
    if other_shapes == "skip":
        rows = rows.filter(fits)
        fits_or_all = fits
    else:
        fits_or_all = F.lit(True)
    here = F.when(fits, spec.address([to_number(F.get("f", F.lit(k))) for k in range(n)]))
    addr = must(here, f"a row needs {n + nvalues} numbers and a place on the grid", fits_or_all, WHITESPACE).cast("long")
    values = F.struct(*[number_at(n + k, where=fits_or_all, separator=WHITESPACE).alias(f"v{k}") for k in range(nvalues)])
    rows = rows.select(
        addr.alias("addr"),
        values.alias("v"),
        F.struct("part", "block", F.monotonically_increasing_id().alias("s")).alias("place"),
    )
    return rows.groupBy("addr").agg(F.max_by("v", "place").alias("v")).select("addr", "v.*")


def read_grid(spark: SparkSession, path: str) -> Histogram:
    """A scalar grid file; a data row of another shape is an error."""
    lines = read_lines(spark, path)
    spec = read_header(lines)
    return Histogram(spec, _grid_rows(lines, spec, 1, "raise").withColumnRenamed("v0", "value"))


def read_vector_grid(spark: SparkSession, path: str, multiplicity: int | None = None) -> Histogram:
    """A vector grid file (N components unless told); rows of another shape are skipped."""
    lines = read_lines(spark, path)
    spec = read_header(lines)
    m = multiplicity or spec.ndim
    return Histogram(spec, _grid_rows(lines, spec, m, "skip"), tuple(f"v{k}" for k in range(m)))


def read_history(spark: SparkSession, paths: str | list[str], mode: str = STRICT) -> tuple[GridSpec, DataFrame]:
    """All frames of history files: grid of the first file, and ``frame, addr, value``.

    A ``# N`` line behind the first data row of a file ends a frame, and so does the end
    of the file.  Bins a frame does not list keep their value from the frame before.  A
    row of another shape, a bad number, a place off the grid and a header line of another
    grid, in whichever file or frame, are errors; permissive mode drops such rows.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = read_lines(spark, paths)
    spec = read_header(lines)
    n = spec.ndim
    f = fields(F.col("value"), WHITESPACE)
    comment = F.col("value").rlike(r"^\s*#")

    def kinds(df: DataFrame) -> DataFrame:
        df = df.withColumn("f", f)
        # headers are checked by the pass that reads the rows; it needs no look at neighbouring lines
        other = comment & _foreign_header(spec)
        sep = comment & (F.size("f") == 2)
        if mode != PERMISSIVE:
            foreign = F.raise_error(F.concat(F.lit("a header of another grid: "), F.col("value"))).cast("boolean")
            sep = F.when(other, foreign).otherwise(sep)
        df = df.withColumn("sep", sep).filter(F.col("sep") | ~comment & (F.size("f") > 0))
        fits, row = F.size("f") == n + 1, ~comment & (F.size("f") > 0)
        x = [F.when(fits, to_number(F.get("f", F.lit(k)))) for k in range(n + 1)]
        addr = F.when(x[n].isNotNull(), spec.address(x[:n]))
        if mode == PERMISSIVE:
            df = df.filter(F.col("sep") | addr.isNotNull())
        else:
            addr = must(addr, f"a row needs {n + 1} numbers and a place on the grid", row, WHITESPACE)
        cell = F.when(~F.col("sep"), F.struct(addr.cast("long").alias("addr"), x[n].alias("v")))
        return df.select("part", "block", "sep", cell.alias("cell"))

    # several steps below read these rows, so the text is parsed once
    rows = materialize(lines.map(kinds).numbered().select("file", "row", "sep", "cell.addr", "cell.v"))
    starts = rows.filter(~F.col("sep")).groupBy("file").agg(F.min("row").alias("_first"))
    rows = rows.join(starts, "file", "left")
    ends = F.coalesce(F.col("sep") & (F.col("row") > F.col("_first")), F.lit(False)).cast("long")
    files = spark.range(len(paths)).select(F.col("id").cast("int").alias("file"))
    per_file = files.join(rows.groupBy("file").agg(F.sum(ends).alias("_ends")), "file", "left")
    per_file = per_file.withColumn("_n", F.coalesce("_ends", F.lit(0)) + 1)
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    per_file = per_file.select("file", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))

    placed = running_sum(rows, ["file"], "row", {"local": ends}, levels=2).filter(~F.col("sep")).join(per_file, "file")
    updates = (
        placed.withColumn("frame", F.col("local") + F.col("_base"))
        .groupBy("file", "frame", "addr")
        .agg(F.max_by("v", "row").alias("value"))
    )
    frames = explode_range(per_file, F.col("_base"), F.col("_base") + F.col("_n"), "frame")
    return spec, materialize(fill_frames(materialize(updates), frames, spec))


def read_path(spark: SparkSession, path: str, ndim: int) -> DataFrame:
    """Positions of a path file, with or without the value column our own paths carry."""
    lines = read_lines(spark, path)
    fits = F.size("f").isin(ndim, ndim + 1)
    rows = lines.map(lambda d: data_fields(d, WHITESPACE).filter(fits))
    return rows.numbered().select("row", *[number_at(k, where=fits, separator=WHITESPACE).alias(f"x{k}") for k in range(ndim)])
