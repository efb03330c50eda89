"""Simulation logs: energy and pair-force lines, and their binning along a trajectory."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import GridSpec
from ..functions.units import fields, to_number
from ..operators.histogram import Histogram, bin_mean
from ..operators.ordered import number_rows
from ..session import materialize
from .text import PERMISSIVE, STRICT, Lines, first_lines, is_data, parse_trajectory, read_lines

# Line prefixes of the log format and the names of its force terms.
TITLE_PREFIX = "ETITLE:"
ENERGY_PREFIX = "ENERGY:"
PAIR_PREFIX = "PAIR INTERACTION:"
FORCE_TITLES = ("VDW_FORCE", "ELECT_FORCE")
STEP, VDW, ELECT = "TS", "VDW", "ELECT"


TITLE, ENERGY = -1, 0  # kinds of rows; force terms follow


@dataclass(frozen=True)
class MDLog:
    """A log and the titles of its energy terms.  Lines stay text until terms are asked for."""

    lines: Lines
    titles: tuple[str, ...]
    _columns: tuple[int, ...]

    def _rows(self, energies: list[str], forces: list[str], mode: str) -> DataFrame:
        """``kind`` and numbers ``v`` of all terms asked for, with ``row`` counted from 0 for each kind.

        The text is scanned once.  A line becomes one small row for each kind of term it
        holds; rows of a kind are put next to each other inside their split, so all kinds
        are numbered from one table of counts per split.
        """
        place = dict(zip(self.titles, self._columns))
        missing = [t for t in energies if t not in place]
        if missing:
            raise KeyError(f"the log has no energy terms {missing}; it has {list(self.titles)}")
        for t in forces:
            if t not in FORCE_TITLES:
                raise KeyError(f"unknown force term {t!r}; a log can have {list(FORCE_TITLES)}")
        line = F.col("value")

        def row(kind: int, numbers: list[Column]) -> Column:
            return F.struct(F.lit(kind).alias("kind"), F.array(*numbers).cast("array<double>").alias("v"))

        # columns of their own below a generator: as parts of ``row`` the lines would be split once per number
        terms, words = F.col("_terms"), F.col("_words")
        own = [F.when(line.startswith(TITLE_PREFIX), row(TITLE, []))]
        own.append(F.when(line.startswith(ENERGY_PREFIX), row(ENERGY, [to_number(F.get(terms, F.lit(place[t]))) for t in energies])))
        for k, t in enumerate(forces):
            at = F.array_position(words, t + ":").cast("int")
            own.append(F.when(line.startswith(PAIR_PREFIX) & (at > 0), row(k + 1, [to_number(F.get(words, at + i)) for i in range(3)])))
        prefixes = F.lit(False)
        for p in (TITLE_PREFIX, ENERGY_PREFIX, PAIR_PREFIX):
            prefixes = prefixes | line.startswith(p)
        df = self.lines.df.filter(prefixes).withColumn("pos", F.monotonically_increasing_id())
        df = df.withColumns({
            "_terms": F.when(line.startswith(ENERGY_PREFIX), fields(F.expr(f"substring(value, {len(ENERGY_PREFIX) + 1})"), r"\s+")),
            "_words": F.when(line.startswith(PAIR_PREFIX), fields(line, r"\s+")),
        })
        df = df.select("part", "block", "pos", "value", F.inline_outer(F.array(*own))).filter(F.col("kind").isNotNull())
        # of lines with bad numbers the text is kept for the message
        df = df.withColumn("bad", F.when(F.exists("v", lambda x: x.isNull()), line)).drop("value")
        df = materialize(df.sortWithinPartitions("kind", "part", "block", "pos"))
        # values in front of the first title line belong to no title
        place_of = F.struct("part", "block", "pos")
        start = df.filter(F.col("kind") == TITLE).agg(F.min(place_of).alias("s")).first().s
        if start is None:
            df = df.filter(F.col("kind") > ENERGY)
        else:
            first = F.struct(*[F.lit(start[c]).cast(t).alias(c) for c, t in (("part", "string"), ("block", "long"), ("pos", "long"))])
            df = df.filter((F.col("kind") > ENERGY) | (F.col("kind") == ENERGY) & (place_of > first))
        if mode != PERMISSIVE:
            titles = F.array(*[F.lit(t) for t in (", ".join(energies), *forces)])
            wrong = F.raise_error(F.concat(F.lit("no number for "), F.get(titles, F.col("kind")), F.lit(": "), F.col("bad")))
            df = df.withColumn("v", F.when(F.col("bad").isNull(), F.col("v")).otherwise(wrong.cast("array<double>")))
        return number_rows(df.select("part", "block", "kind", "v"), self.lines.files, "row", "kind").select("row", "kind", "v")

    def terms(self, energies: list[str], forces: list[str] = (), mode: str = STRICT) -> DataFrame:
        """``row``, one column per energy title and ``<force>_x, _y, _z`` per force term.

        The k-th energy line and the k-th line of each force term make row k; a term with
        fewer lines is NULL behind its last.  A missing or bad number is an error, or NULL
        in permissive mode.
        """
        rows = self._rows(list(energies), list(forces), mode)
        if not energies:
            rows = rows.filter(F.col("kind") > ENERGY)
        number = lambda kind, k: F.max(F.when(F.col("kind") == kind, F.get("v", F.lit(k))))
        out = [number(ENERGY, k).alias(t) for k, t in enumerate(energies)]
        out += [number(j + 1, k).alias(f"{t}_{c}") for j, t in enumerate(forces) for k, c in enumerate("xyz")]
        return rows.groupBy("row").agg(*out)

    def energies(self, titles: list[str] | None = None, mode: str = STRICT) -> DataFrame:
        """``row`` and one column per title, one row per energy line.

        A title listed twice in the log keeps the column of its first mention.
        """
        rows = self._rows(list(self.titles) if titles is None else titles, [], mode)
        names = self.titles if titles is None else titles
        return rows.select("row", *[F.get("v", F.lit(k)).alias(t) for k, t in enumerate(names)])

    def forces(self, title: str, mode: str = STRICT) -> DataFrame:
        """``row`` and the three components ``<title>_x, _y, _z`` of one force term."""
        rows = self._rows([], [title], mode).filter(F.col("kind") > ENERGY)
        return rows.select("row", *[F.get("v", F.lit(k)).alias(f"{title}_{c}") for k, c in enumerate("xyz")])

    def force_titles(self) -> list[str]:
        """Force terms that occur in the log."""
        pairs = self.lines.df.filter(F.col("value").startswith(PAIR_PREFIX))
        found = pairs.agg(*[F.max(F.col("value").contains(t + ":")).alias(t) for t in FORCE_TITLES]).first()
        return [t for t in FORCE_TITLES if found[t]]

    def size(self) -> int:
        return self._rows([], [], STRICT).count()


def read_md_log(spark: SparkSession, path: str | list[str]) -> MDLog:
    return parse_md_log(read_lines(spark, path))


def parse_md_log(lines: Lines) -> MDLog:
    """``lines`` as from :func:`read_lines`.  Only the first title line counts."""
    first = first_lines(lines, F.col("value").startswith(TITLE_PREFIX), 1, all_paths=True)
    if not first:
        return MDLog(lines, (), ())
    names = [t for t in first[0][len(TITLE_PREFIX) :].split() if t != TITLE_PREFIX]
    kept = {}
    for k, t in enumerate(names):
        kept.setdefault(t, k)
    return MDLog(lines, tuple(kept), tuple(kept.values()))


def bin_log(
    log: MDLog,
    trajectory: Lines,
    spec: GridSpec,
    columns: list[int],
    energies: list[str],
    forces: list[str] = (),
    count_all: bool = False,
    mode: str = STRICT,
) -> Histogram:
    """Mean of log terms over the bins of trajectory positions.

    ``trajectory`` is lines as from :func:`read_lines`.  The k-th data row of the
    trajectory goes with the k-th energy (and force) line of the log.
    """
    coords = [f"x{k}" for k in range(spec.ndim)]
    places = dict(zip(coords, columns))
    if mode == PERMISSIVE:
        rows = trajectory.map(lambda d: parse_trajectory(d, places, mode)).numbered()
    else:  # no row is dropped, so the pass that counts the rows need not read their numbers
        rows = parse_trajectory(trajectory.map(lambda d: d.filter(is_data())).numbered(), places, mode)
    rows = rows.select("row", *coords)
    values = [*energies, *[f"{t}_{c}" for t in forces for c in "xyz"]]
    if values:
        rows = rows.join(log.terms(energies, forces, mode), "row", "left")
    return bin_mean(rows, spec, [F.col(c) for c in coords], {v: F.col(f"`{v}`") for v in values}, count_all)
