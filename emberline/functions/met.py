"""Meteorological formulas as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import as_col

KELVIN = 273.15
GRAVITY = 9.80665
#: Days of the year at the middle of the months, for which effective day lengths hold.
MID_MONTH_DAYS = (15, 45, 75, 106, 136, 167, 197, 228, 258, 289, 319, 350)


def to_celsius(k: str | Column) -> Column:
    return as_col(k) - KELVIN


def to_mm(m: str | Column) -> Column:
    return as_col(m) * 1000.0


def to_height(geopotential: str | Column) -> Column:
    return as_col(geopotential) / GRAVITY


def relative_humidity(t2m: str | Column, d2m: str | Column) -> Column:
    """Percent from temperature and dew point in kelvin (August-Roche-Magnus); not clamped."""
    t, d = to_celsius(t2m), to_celsius(d2m)
    return 100.0 * F.exp(17.625 * d / (243.04 + d)) / F.exp(17.625 * t / (243.04 + t))


def wind_speed(u: str | Column, v: str | Column) -> Column:
    u, v = as_col(u), as_col(v)
    return F.sqrt(u * u + v * v)


def day_length(day_of_year: Column, lat: Column) -> Column:
    """Hours of daylight; 24 and 0 beyond the polar circles in season."""
    decl = F.radians(23.45 * F.sin(F.radians(360.0 * (283.0 + day_of_year) / 365.0)))
    x = -F.tan(F.radians(lat)) * F.tan(decl)
    return F.when(x <= -1.0, 24.0).when(x >= 1.0, 0.0).otherwise(F.degrees(F.acos(x)) / 7.5)


def effective_day_length(month: Column, lat: Column) -> Column:
    """Day length in the middle of a month less 3 hours."""
    day = F.element_at(F.array(*(F.lit(float(d)) for d in MID_MONTH_DAYS)), month)
    return F.greatest(day_length(day, lat), F.lit(0.0)) - 3.0


def day_length_hours(day: int, lat: float) -> float:
    """The same for plain numbers."""
    x = -math.tan(math.radians(lat)) * math.tan(math.radians(23.45 * math.sin(math.radians(360.0 * (283.0 + day) / 365.0))))
    return 24.0 if x <= -1 else 0.0 if x >= 1 else math.degrees(math.acos(x)) / 7.5
