"""Forest loss per cell and year, as features of a year or of a detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.met import to_height


def dense_years(loss: DataFrame, cell: str, first: int, last: int, kinds: Sequence[str] = ("prim", "sec")) -> DataFrame:
    """``cell, year`` and one column of loss per kind, 0 where none, for every year of every cell with any loss."""
    wide = loss.groupBy(cell, "year").agg(*(F.sum(F.when(F.col("kind") == k, F.col("loss")).otherwise(0)).alias(k) for k in kinds))
    every = loss.select(cell).distinct().withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return every.join(wide, [cell, "year"], "left").fillna(0, list(kinds))


def loss_features(years: DataFrame, cell: str, total: DataFrame, kinds: Sequence[str] = ("prim", "sec")) -> DataFrame:
    """Loss of the last year, this year, the three years before, all before and all so far, as parts of the cell's total."""
    w = Window.partitionBy(cell).orderBy("year")
    spans = {"last": w.rowsBetween(-1, -1), "this": w.rowsBetween(0, 0), "three": w.rowsBetween(-3, -1), "before": w.rowsBetween(Window.unboundedPreceding, -1), "accum": w.rowsBetween(Window.unboundedPreceding, 0)}
    out = years.join(total, cell)
    share = {f"loss_{s}_{k}": F.coalesce(F.sum(k).over(span), F.lit(0)) / F.col("total") for k in kinds for s, span in spans.items()}
    return out.withColumns(share)


def relative_years(detections: DataFrame, loss: DataFrame, cell: str, year: str, reach: int = 3, anchor: int = 0) -> DataFrame:
    """Loss of the years ``-reach .. reach`` around a detection's year, wide per kind; 0 where none.

    ``anchor``: 0 counts from the year itself, -1 from the year before.
    """
    offsets = range(-reach, reach + 1)
    per = loss.groupBy(cell, "year", "kind").agg(F.sum("loss").alias("loss")).select(F.col(cell).alias("c__"), F.col("year").alias("y__"), "kind", "loss")
    keys = detections.select(cell, year).distinct()  # features are per cell and year, not per detection
    need = keys.withColumn("o__", F.explode(F.array(*map(F.lit, offsets))))
    hit = need.join(per, (F.col(cell) == F.col("c__")) & (F.col("y__") == F.col(year) + F.col("o__") + anchor), "left")
    name = lambda k, o: f"{k}_{'m' if o < 0 else 'p'}{abs(o)}"
    wide = hit.groupBy(cell, year).agg(*(F.coalesce(F.sum(F.when((F.col("kind") == k) & (F.col("o__") == o), F.col("loss"))), F.lit(0)).alias(name(k, o)) for k in ("prim", "sec") for o in offsets))
    return detections.join(wide, [cell, year])


def greatest_loss(loss: DataFrame, cell: str) -> DataFrame:
    """Per cell and kind: the year of the greatest loss (the first on ties), loss up to and with it, and all loss."""
    top = loss.groupBy(cell, "kind").agg(F.min_by("year", F.struct(-F.col("loss"), F.col("year"))).alias("max_year"), F.sum("loss").alias("total_loss"))
    upto = loss.join(top, [cell, "kind"]).groupBy(cell, "kind", "max_year", "total_loss")
    return upto.agg(F.sum(F.when(F.col("year") <= F.col("max_year"), F.col("loss")).otherwise(0)).alias("loss_to_max"))


def loss_around_fire(detections: DataFrame, years: DataFrame, cell: str, year: str, kinds: Sequence[str] = ("prim", "sec")) -> DataFrame:
    """Loss before and after a detection's year: all years before it, and all with it and after."""
    w = Window.partitionBy(cell).orderBy("year")
    w_all = Window.partitionBy(cell)
    cols = {}
    for k in kinds:
        before = F.coalesce(F.sum(k).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cols |= {f"{k}_before_fire": before, f"{k}_after_fire": F.sum(k).over(w_all) - before}
    around = years.withColumns(cols).select(F.col(cell), F.col("year").alias(year), *cols)
    return detections.join(around, [cell, year], "left").fillna(0, list(cols))


def fires_before(months: DataFrame, cell: str, order: str, count: str) -> DataFrame:
    """Fires of a cell in all months before each month; 0 in the first."""
    w = Window.partitionBy(cell).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return months.withColumn("frp_acc", F.coalesce(F.sum(count).over(w), F.lit(0)))


def repeat_burns(fires: DataFrame, cell: str, year: str, most: int = 6) -> DataFrame:
    """Detections by how many years the cell had burnt with theirs; ranks from ``most`` on are one bin; and the share of each per year."""
    seen = fires.groupBy(cell, year).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(cell).orderBy(year))
    binned = seen.withColumn("repeat", F.least(rank, F.lit(most)))
    out = binned.groupBy(year, "repeat").agg(F.sum("n").alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(year)))


def typed_loss(loss: DataFrame, primary: DataFrame, lon: str, lat: str, class_col: str, scale: float = 1e6) -> DataFrame:
    """Loss pixels typed 2 where the primary map has class 2 at the very place, else 1; places compare as scaled integers."""
    key = lambda df, c: F.rint(df[c] * scale).cast("long")
    p = primary.select(key(primary, lon).alias("x__"), key(primary, lat).alias("y__"), F.col(class_col).alias("c__")).where("c__ = 2").distinct()
    left = loss.withColumns({"x__": key(loss, lon), "y__": key(loss, lat)})
    return left.join(p, ["x__", "y__"], "left").withColumn("kind", F.when(F.col("c__") == 2, 2).otherwise(1)).drop("x__", "y__", "c__")


def typed_loss_columns(loss: DataFrame, keys: Sequence[str], year: str, kind: str, years: Sequence[int]) -> DataFrame:
    """Pixels per cell in two columns a year, ``<year>_loss`` (kind 1) and ``<year>_loss_prim`` (kind 2), 0 where none."""
    cols = [F.count_if((F.col(year) == y) & (F.col(kind) == k)).alias(f"{y}_loss{tail}") for y in years for k, tail in ((1, ""), (2, "_prim"))]
    return loss.groupBy(*keys).agg(*cols)


def months_to_year_end(months: DataFrame, keys: Sequence[str], mind: str, value: str) -> DataFrame:
    """The months with a row of every cell from the first to the end of the last year of all, 0 where a cell has none.

    ``mind``: months counted from 1 in a January.
    """
    ends = months.agg(F.min(mind).alias("low__"), (F.ceil(F.max(mind) / 12) * 12).cast("int").alias("high__"))
    every = months.select(*keys).distinct().join(F.broadcast(ends)).where("low__ IS NOT NULL")  # one row
    every = every.select(*keys, F.explode(F.sequence(F.col("low__").cast("int"), "high__")).alias(mind))
    return every.join(months.select(*keys, F.col(mind).cast("int").alias(mind), value), [*keys, mind], "left").fillna(0, [value])


def with_static(df: DataFrame, keys: Sequence[str], elevation: DataFrame, geopotential: str, peat: DataFrame, depth: str) -> DataFrame:
    """Adds ``dem`` (height in m from the cell's geopotential, NULL where unknown) and ``peatd`` (sum of the cell's peat, 0 where none)."""
    dem = elevation.groupBy(*keys).agg(F.avg(to_height(geopotential)).alias("dem"))
    summed = peat.groupBy(*keys).agg(F.sum(depth).alias("peatd"))
    return df.drop("dem", "peatd").join(dem, list(keys), "left").join(summed, list(keys), "left").fillna(0, ["peatd"])


def label_mask(*rasters: DataFrame, value: str) -> DataFrame:
    """Pixels of several rasters of which the value is above 0, with the value 1."""
    out = rasters[0]
    for r in rasters[1:]:
        out = out.unionByName(r)
    return out.where(F.col(value) > 0).withColumn(value, F.lit(1))
