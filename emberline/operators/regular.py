"""Irregular readings onto a regular daily grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import finite

DAY_S = 86_400.0


def daily_grid(df: DataFrame, keys: Sequence[str], time: str, value: str, max_gap: int, counter: bool = True) -> DataFrame:
    """A daily series per source: ``keys, day, n_readings, amount, status``.

    ``counter``: the value is a cumulative counter.  Consecutive readings are
    differenced; a reading below the one before is a reset, and counts from
    zero.  Otherwise each reading is itself what came in since the one before
    (the running total of the readings is then the counter, with no reset).

    An increment is spread over the days that its interval overlaps, in
    proportion to the overlap.  Where two days with readings lie more than
    ``max_gap`` days apart, nothing is spread: the days between are marked
    and the increment is booked on its own day, so totals are kept.

    ``status``: ``reading`` (the day has one), ``filled`` (none, but an
    interval of at most ``max_gap`` days covers it) or ``uncovered``.  One row
    for each day from a source's first to its last reading.

    Readings are worked off per source and day, then the days of a source are
    linked by their first and last reading, so a hot source is split into its
    days and the window over a source holds one row a day.  A counter's first
    reading has no increment.  NULL, NaN and infinite readings and NULL times
    take no part; readings at the same time are ordered by value.
    """
    k = [f"k{i}" for i in range(len(keys))]
    plain = df.select(*(F.col(c).alias(a) for c, a in zip(keys, k, strict=True)), F.col(time).cast("timestamp_ntz").alias("t"), finite(value).alias("v")).where("t IS NOT NULL AND v IS NOT NULL")
    plain = plain.withColumns({"d": F.to_date("t"), "s": F.unix_micros(F.col("t").cast("timestamp")) / 1e6})
    first, last = F.min(F.struct("s", "v")).alias("first"), F.max(F.struct("s", "v")).alias("last")
    if counter:
        before = F.lag("v").over(Window.partitionBy(*k, "d").orderBy("s", "v"))
        inside = plain.withColumn("i", F.when(before.isNull(), 0.0).when(F.col("v") < before, F.col("v")).otherwise(F.col("v") - before))
        days = inside.groupBy(*k, "d").agg(F.count("*").alias("n"), F.sum("i").alias("inside"), first, last)
        entering = F.when(F.col("prev").isNull(), 0.0).when(F.col("first.v") < F.col("prev.v"), F.col("first.v")).otherwise(F.col("first.v") - F.col("prev.v"))
    else:
        days = plain.groupBy(*k, "d").agg(F.count("*").alias("n"), F.sum("v").alias("total"), first, last).withColumn("inside", F.col("total") - F.col("first.v")).drop("total")
        entering = F.col("first.v")
    over = Window.partitionBy(*k).orderBy("d")
    linked = days.withColumns({"prev": F.lag("last").over(over), "prev_d": F.lag("d").over(over)}).withColumn("entering", entering)
    # a day's own amount, and the interval after it, which the days up to the next reading share
    ahead = {"next_d": F.lead("d").over(over), "s1": F.lead("first.s").over(over), "coming": F.lead("entering").over(over)}
    linked = linked.withColumns(ahead | {"s0": F.col("last.s")})
    near_before = F.coalesce(F.datediff("d", "prev_d") <= max_gap, F.lit(False))
    covered = F.coalesce(F.datediff("next_d", "d") <= max_gap, F.lit(False))

    def share(start, t0, t1):
        """Part of the interval from ``t0`` to ``t1`` that lies in the day from ``start``."""
        overlap = F.greatest(F.lit(0.0), F.least(t1, start + DAY_S) - F.greatest(t0, start))
        return F.when(t1 > t0, overlap / (t1 - t0)).otherwise(0.0)

    def start_of(day):
        return F.unix_seconds(F.col(day).cast("timestamp")).cast("double")

    into_own = F.when(near_before & (F.col("first.s") > F.col("prev.s")), share(start_of("d"), F.col("prev.s"), F.col("first.s"))).otherwise(1.0)
    end = F.when(F.col("next_d").isNotNull(), F.date_sub("next_d", 1)).otherwise(F.col("d"))
    spans = linked.select(*k, "d", "n", (F.col("inside") + F.col("entering") * into_own).alias("own"), "s0", "s1", "coming", covered.alias("covered"), F.explode(F.sequence("d", end)).alias("day"))
    own = F.col("day") == F.col("d")
    spread = F.when(F.col("covered"), F.col("coming") * share(start_of("day"), F.col("s0"), F.col("s1"))).otherwise(0.0)
    out = spans.select(*k, "day", F.when(own, F.col("n")).otherwise(0).alias("n_readings"), (F.when(own, F.col("own")).otherwise(0.0) + spread).alias("amount"), "covered")
    status = F.when(F.col("n_readings") > 0, "reading").when(F.col("covered"), "filled").otherwise("uncovered")
    return out.select(*(F.col(a).alias(c) for c, a in zip(keys, k, strict=True)), "day", "n_readings", "amount", status.alias("status"))
