"""Numeric columns: rounding, luminance and units of length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
POINTS_PER_INCH = 72.0
MM_PER_INCH = 25.4
STANDARD_DPIS = (72, 96, 150, 200, 300, 400, 600)


def round_half_up(c: Column) -> Column:
    """Nearest integer with halves going up, also below zero."""
    return F.floor(c + F.lit(0.5)).cast("int")


def luminance(r: Column, g: Column, b: Column) -> Column:
    weighted = r.cast("int") * 299 + g.cast("int") * 587 + b.cast("int") * 114
    return F.floor(weighted / F.lit(1000)).cast("int")


def points_to_inches(c: Column) -> Column:
    return c / F.lit(POINTS_PER_INCH)


def inches_to_mm(c: Column) -> Column:
    return c * F.lit(MM_PER_INCH)


def points_to_mm(c: Column) -> Column:
    return inches_to_mm(points_to_inches(c))


def inches_to_points(c: Column) -> Column:
    return c * F.lit(POINTS_PER_INCH)


def mm_to_points(c: Column) -> Column:
    return inches_to_points(c / F.lit(MM_PER_INCH))


def in_unit(inches: Column, unit: str) -> Column:
    """Length in ``inches`` or ``mm`` as text with four decimals."""
    value = inches_to_mm(inches) if unit.lower() == "mm" else inches
    return F.format_string("%.4f", value)


def snap_dpi(computed: Column) -> Column:
    """First standard resolution less than 10 % away, else the rounded value."""
    near = F.filter(
        F.lit([float(d) for d in STANDARD_DPIS]),
        lambda std: F.abs(computed - std) / std < F.lit(0.10),
    )
    return F.coalesce(F.get(near, 0), F.floor(computed + F.lit(0.5)).cast("double"))
