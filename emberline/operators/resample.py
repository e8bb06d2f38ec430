"""Resampling in time, climatologies, rolling and lagged features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import as_col

#: Variables of the monthly bundle and the lags of some of them.
BUNDLE = ("fwi", "ffmc", "dc", "t2m", "w10", "h2m")
LAGGED = ("tp_sum", "t2m_med", "w10_med", "h2m_med")


def day_to_seven(ts: str | Column) -> Column:
    """End of the 24 hours to 07:00 that a time lies in; 07:00:00 itself belongs to the day that ends with it."""
    return F.window(as_col(ts) - F.expr("INTERVAL '1' MICROSECOND"), "24 hours", "24 hours", "7 hours")["end"]


def resample_daily(df: DataFrame, keys: Sequence[str], ts: str, aggs: dict[str, Column]) -> DataFrame:
    """``keys, day_end`` and the aggregates over the 24 hours to 07:00, closed and labelled on the right."""
    return df.groupBy(*keys, day_to_seven(ts).alias("day_end")).agg(*(c.alias(k) for k, c in aggs.items()))


def month_end(day: str | Column) -> Column:
    return F.last_day(as_col(day).cast("date"))


def month_bin_start(ts: str | Column) -> Column:
    """First day of the month that a time falls into where months are closed on the right: the first midnight belongs to the month before."""
    return F.trunc((as_col(ts).cast("timestamp_ntz") - F.expr("INTERVAL '1' MICROSECOND")).cast("date"), "month")


def season_block(day: str | Column, first: int, last: int, month: int = 4, dom: int = 21) -> Column:
    """Year of the block that a day belongs to: blocks run from the day after ``dom.month`` to that day of the next year.

    The first block starts with the year ``first``, the last one (``last - 1``)
    ends with the year ``last``; days of other years are in none.
    """
    d = as_col(day).cast("date")
    own = F.when((F.month(d) * 100 + F.dayofmonth(d)) > month * 100 + dom, F.year(d)).otherwise(F.year(d) - 1)
    return F.when(F.year(d).between(first, last), F.greatest(F.lit(first), F.least(F.lit(last - 1), own))).cast("int")


def month_index_date(mind: str | Column, base: str = "2001-12-31") -> Column:
    """Month end of month index 1, 2, ... after ``base``."""
    return F.last_day(F.add_months(F.lit(base).cast("date"), as_col(mind).cast("int")))


def month_index(year: Column, month: Column, base_year: int) -> Column:
    return ((year - base_year) * 12 + month).cast("int")


def monthly(df: DataFrame, keys: Sequence[str], day: str, aggs: dict[str, Column]) -> DataFrame:
    """``keys, date`` (month end) and the aggregates over each calendar month."""
    return df.groupBy(*keys, month_end(day).alias("date")).agg(*(c.alias(k) for k, c in aggs.items()))


def rolling(value: str | Column, keys: Sequence[str], order: str, rows: int, agg: str = "avg", least: int = 1) -> Column:
    """Aggregate over the last ``rows`` rows; NULL with fewer than ``least`` values."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1), 0)
    v = as_col(value)
    out = getattr(F, agg)(v).over(w)
    return out if least <= 1 else F.when(F.count(v).over(w) >= least, out)


def monthly_features(df: DataFrame, keys: Sequence[str], day: str, variables: Sequence[str] = BUNDLE, rain: str = "tp", lags: int = 5) -> DataFrame:
    """The monthly bundle per cell.

    For each variable: median, 75th percentile (linear), greatest 7-row mean
    and the sum of three months' medians; for rain: sum, least 7-row mean and
    three-month sum; lags 1 to ``lags`` of rain and of temperature, wind and
    humidity where they are among the variables.  NULLs are skipped, so a
    month without values has NULLs; lags go by rows, as months have no gaps.
    """
    base = df.select(*keys, F.col(day).alias("day__"), *(F.col(v).cast("double").alias(v) for v in (*variables, rain)))
    base = base.withColumns({f"{v}__7": F.avg(v).over(Window.partitionBy(*keys).orderBy("day__").rowsBetween(-6, 0)) for v in (*variables, rain)})
    aggs = {}
    for v in variables:
        aggs |= {f"{v}_med": F.median(v), f"{v}_75p": F.percentile(v, F.lit(0.75)), f"{v}_7mm": F.max(f"{v}__7")}
    aggs |= {f"{rain}_sum": F.sum(rain), f"{rain}_7dmin": F.min(f"{rain}__7")}
    m = monthly(base, keys, "day__", aggs)
    w = Window.partitionBy(*keys).orderBy("date")
    w3 = w.rowsBetween(-2, 0)
    out = {f"{v}_3sum": F.sum(f"{v}_med").over(w3) for v in variables} | {f"{rain}_3sum": F.sum(f"{rain}_sum").over(w3)}
    lagged = [(rain, f"{rain}_sum"), *((v, f"{v}_med") for v in ("t2m", "w10", "h2m") if v in variables)]
    out |= {f"{v}_{k}": F.lag(c, k).over(w) for v, c in lagged for k in range(1, lags + 1)}
    return m.withColumns(out)


def climatology(df: DataFrame, keys: Sequence[str], period: Column, values: Sequence[str], name: str = "period") -> DataFrame:
    """Means per cell and calendar period (month, day of the year) over all years."""
    return df.groupBy(*keys, period.alias(name)).agg(*(F.avg(v).alias(v) for v in values))


def expand_climatology(clim: DataFrame, keys: Sequence[str], start: str, end: str, period: str = "doy") -> DataFrame:
    """A row for each cell and day from ``start`` to ``end`` with the climatology of its day of the year."""
    days = clim.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    days = days.withColumn(period, F.dayofyear("day"))
    return clim.join(F.broadcast(days), period)  # days of the asked calendar only


def anomalies(df: DataFrame, keys: Sequence[str], day: str, value: str, decimals: int | None = None) -> DataFrame:
    """Monthly means minus the mean of that month over all years.

    ``decimals``: how many the values have; they are then added up as decimal
    numbers, so the mean of a month doesn't depend on the order of its days.
    """
    v = F.col(value) if decimals is None else F.col(value).cast(f"decimal(18, {decimals})")
    m = df.groupBy(*keys, F.year(day).alias("year"), F.month(day).alias("month")).agg((F.sum(v).cast("double") / F.count(v)).alias("mean"))
    return m.withColumn("anomaly", F.col("mean") - F.avg("mean").over(Window.partitionBy(*keys, "month")))


def stitch(observed: DataFrame, forecast: DataFrame, keys: Sequence[str], day: str, start: str, months_before: int = 6) -> DataFrame:
    """Observations of the ``months_before`` up to ``start``, then the forecast; of a day in both, the forecast."""
    low = F.add_months(F.lit(start).cast("date"), -months_before)
    obs = observed.where(F.col(day).between(low, F.lit(start).cast("date"))).join(forecast.select(*keys, day).distinct(), [*keys, day], "left_anti")
    return obs.withColumn("origin", F.lit("obs")).unionByName(forecast.withColumn("origin", F.lit("fc")), allowMissingColumns=True)


def bridge(runs: DataFrame, run: str, day: str, observed_until: str, start: str) -> DataFrame:
    """Days from earlier runs for the months that end after the observations and up to the forecast's ``start``.

    ``run``: first day of the month that a run was started for.  Of each of
    those months its own run counts, from the day before the month to the
    first day of the next one; days in two of them are kept from both.
    """
    until, begin = F.lit(observed_until).cast("date"), F.lit(start).cast("date")
    first, end = F.col(run).cast("date"), F.last_day(F.col(run))
    wanted = (end > until) & (end <= begin)
    return runs.where(wanted & F.col(day).between(F.date_sub(first, 1), F.add_months(first, 1)))


def deaccumulate(value: str, keys: Sequence[str], order: str) -> Column:
    """Difference to the row before; the first is kept."""
    w = Window.partitionBy(*keys).orderBy(order)
    return F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0.0))


def overlap(long: DataFrame, short: DataFrame, day: str) -> DataFrame:
    """Rows of ``long`` within the days that ``short`` spans."""
    span = short.agg(F.min(day).alias("low__"), F.max(day).alias("high__"))
    return long.join(F.broadcast(span), F.col(day).between(F.col("low__"), F.col("high__"))).drop("low__", "high__")  # one row


def every_nth(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """Rows 1, n + 1, 2 n + 1, ... of each cell in time."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("rn__", rn).where(F.pmod(F.col("rn__") - 1, F.lit(n)) == 0).drop("rn__")
