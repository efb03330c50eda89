"""Thermal energy and small text conversions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Gas constant in the two supported units, per kelvin.
GAS_CONSTANT = {"kcal/mol": 0.001987204258641, "kj/mol": 0.008314462618153}

# Fixed value: what separates fields in trajectories, hills and number lists.
FIELD_SEPARATOR = r"[(),\s]+"


def thermal_energy(temperature: float, unit: str = "kcal/mol") -> float:
    """kT for a temperature; an unknown unit leaves the temperature as it is."""
    return temperature * GAS_CONSTANT.get(unit.lower(), 1.0)


def parse_numbers(text: str) -> list[float]:
    """Numbers in a short option string; a field that is no number counts as 0."""
    out = []
    for field in re.split(FIELD_SEPARATOR, text):
        if field:
            try:
                out.append(float(field))
            except ValueError:
                out.append(0.0)
    return out


def fields(line: Column, separator: str = FIELD_SEPARATOR) -> Column:
    """Split a text line, dropping the empty pieces."""
    return F.array_remove(F.split(line, separator), "")


# How a number is written: Spark's cast would also take Java's suffixes and hexadecimal forms.
NUMBER = r"(?i)^[-+]?((\d+\.?\d*|\.\d+)(e[-+]?\d+)?|inf(inity)?|nan)$"


def to_number(field: Column) -> Column:
    """A field as a double; NULL if it is not written as a number."""
    # the test comes first also because a failed cast is costly
    return F.when(field.rlike(NUMBER), field.try_cast("double"))


def numbers(line: Column, separator: str = FIELD_SEPARATOR) -> Column:
    """Column form of :func:`parse_numbers`."""
    return F.transform(fields(line, separator), lambda s: F.coalesce(to_number(s), F.lit(0.0)))


def nearly_equal(a: Column, b: Column, ulps: int = 2) -> Column:
    """Equality within a few units in the last place, or below the smallest normal double."""
    gap = F.abs(a - b)
    return (gap < F.lit(2.0**-52) * F.abs(a + b) * F.lit(float(ulps))) | (gap < F.lit(2.0**-1022))
