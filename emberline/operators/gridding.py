"""Points to cells, dense grids, regridding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import Grid

CELL = ["lonind", "latind"]


def add_cells(df: DataFrame, grid: Grid, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    return df.withColumns({"lonind": grid.lonind(lon), "latind": grid.latind(lat)})


def add_coordinates(df: DataFrame, grid: Grid) -> DataFrame:
    """Centres of the cells; NULL outside of the grid."""
    return df.withColumns({"longitude": grid.longitude(), "latitude": grid.latitude()})


def counts(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def class_counts(df: DataFrame, keys: Sequence[str], class_col: str, classes: Sequence[int]) -> DataFrame:
    """Pixels per class and cell, wide, 0 where none, and their ``total``; the classes are listed, so the schema is fixed."""
    wide = df.groupBy(*keys).agg(*(F.count_if(F.col(class_col) == c).alias(f"class_{c}") for c in classes), F.count_if(F.col(class_col).isin(list(classes))).alias("total"))
    return wide.where("total > 0")


def dense_counts(df: DataFrame, keys: Sequence[str], period: str, periods: Column, every: DataFrame | None = None) -> DataFrame:
    """Counts of each cell in every period, 0 where none.

    ``periods``: array of all periods; ``every``: the cells, by default those with any row.
    """
    cells = (every or df).select(*keys).distinct().withColumn(period, F.explode(periods))
    n = counts(df, [*keys, period])
    return cells.join(n, [*keys, period], "left").fillna(0, ["n"])


def dense_daily(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Counts of each cell on every day from the first to the last of all, 0 where none.

    Each day with rows brings the empty days before it, a cell's last one also
    those after it; only the days with rows are shuffled, not the cube.  Rows
    without a day count for no day, but their cells are in the cube.
    """
    n = counts(df.withColumn(day, F.col(day).cast("date")), [*keys, day])
    ends = df.agg(F.min(F.col(day).cast("date")).alias("low__"), F.max(F.col(day).cast("date")).alias("high__"))
    own = Window.partitionBy(*keys)
    by_day = own.orderBy(F.asc_nulls_last(day))
    dated = n.withColumn("days__", F.count(day).over(own)).where(F.col(day).isNotNull() | (F.col("days__") == 0))
    near = dated.withColumns({"before__": F.lag(day).over(by_day), "last__": F.lead(day).over(by_day).isNull()})
    start = F.coalesce(F.date_add("before__", 1), F.col("low__"))
    every = F.explode(F.sequence(start, F.when(F.col("last__"), F.col("high__")).otherwise(F.col(day))))
    out = near.join(F.broadcast(ends)).where("low__ IS NOT NULL").withColumn("day__", every)  # one row
    return out.select(*keys, F.col("day__").alias(day), F.when(F.col("day__") == F.col(day), F.col("n")).otherwise(0).alias("n"))


def bilinear(points: DataFrame, grid_values: DataFrame, x: str, y: str, value: str, x0: float, y0: float, step: float, gx: str, gy: str) -> DataFrame:
    """Values of a regular grid at points, linear in x and y.

    ``grid_values``: ``gx, gy`` (indices), ``value``.  A point on a grid line
    needs only the nodes of that line; a missing or NULL node gives NULL.
    """
    fx, fy = (F.col(x) - x0) / step, (F.col(y) - y0) / step
    at = points.withColumns({"i__": F.floor(fx).cast("int"), "j__": F.floor(fy).cast("int")}).withColumns({"u__": fx - F.col("i__"), "v__": fy - F.col("j__")})
    corners = F.array(*(F.struct((F.col("i__") + a).alias("i"), (F.col("j__") + b).alias("j"), ((F.col("u__") if a else 1.0 - F.col("u__")) * (F.col("v__") if b else 1.0 - F.col("v__"))).alias("w")) for a in (0, 1) for b in (0, 1)))
    need = at.withColumn("c__", F.explode(F.filter(corners, lambda c: c["w"] > 0)))
    g = grid_values.select(F.col(gx).alias("gi__"), F.col(gy).alias("gj__"), F.col(value).cast("double").alias("gv__"))
    hit = need.join(g, (F.col("c__.i") == F.col("gi__")) & (F.col("c__.j") == F.col("gj__")), "left")
    out = hit.groupBy(*points.columns).agg(F.sum(F.col("c__.w") * F.col("gv__")).alias("s__"), F.count("gv__").alias("k__"), F.count("*").alias("n__"))
    return out.select(*points.columns, F.when(F.col("k__") == F.col("n__"), F.col("s__")).alias(value))


def nearest_node(points: DataFrame, grid_values: DataFrame, x: str, y: str, value: str, x0: float, y0: float, step: float, gx: str, gy: str) -> DataFrame:
    """Value of the nearest node of a regular grid; NULL off the grid."""
    g = grid_values.select(F.col(gx).alias("gi__"), F.col(gy).alias("gj__"), F.col(value))
    i, j = (F.floor((F.col(c) - o) / step + 0.5).cast("int") for c, o in ((x, x0), (y, y0)))
    at = points.withColumns({"i__": i, "j__": j})
    return at.join(g, (F.col("i__") == F.col("gi__")) & (F.col("j__") == F.col("gj__")), "left").select(*points.columns, value)


def masked(df: DataFrame, mask: DataFrame, keys: Sequence[str], flag: str, values: Sequence[str]) -> DataFrame:
    """Values become NULL where the mask is 0 or absent; rows stay."""
    m = mask.select(*keys, F.col(flag).alias("m__"))
    out = df.join(m, list(keys), "left")
    return out.withColumns({v: F.when(F.col("m__") != 0, F.col(v)) for v in values}).drop("m__")


def pure_cells(classes: DataFrame, keys: Sequence[str], class_col: str, total: str, threshold: float, values: DataFrame) -> DataFrame:
    """Values of the cells of which one class makes up more than ``threshold``."""
    pure = classes.where(F.col(class_col) > threshold * F.col(total)).select(*keys)
    return values.join(pure, list(keys), "left_semi")
