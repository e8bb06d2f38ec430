"""Totals and averages over trailing calendar periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import finite


def trailing_totals(df: DataFrame, keys: Sequence[str], day: str, values: Sequence[str], periods: Sequence[int] = (7, 30)) -> DataFrame:
    """For each entity and calendar day, totals over the trailing periods.

    One row for every day from an entity's first to its last, with or without
    input rows.  For each value ``v`` and period ``n``: ``v_sum_n`` (0 if there
    is no value), ``v_cnt_n`` (values seen) and ``v_avg_n`` (NULL if none); the
    period ends with the day itself and simply holds less before the first day.

    Rows are first added up per entity and day, which partial aggregation does
    before the shuffle, so the window over an entity holds at most one row a
    day however hot the entity is.  Running totals per entity are carried over
    the days without rows; a trailing total is the difference of two of them.

    NULL, NaN and infinite values count as absent; several rows of a day add
    up; rows with a NULL day take no part; a NULL key is an entity of its own;
    other columns are ignored whatever their names.
    """
    k = [f"k{i}" for i in range(len(keys))]
    plain = df.select(
        *(F.col(c).alias(a) for c, a in zip(keys, k, strict=True)),
        F.col(day).cast("date").alias("d"),
        *(finite(c).alias(f"v{i}") for i, c in enumerate(values)),
    ).where("d IS NOT NULL")
    span = range(len(values))
    daily = plain.groupBy(*k, "d").agg(*(F.coalesce(F.sum(f"v{i}"), F.lit(0.0)).alias(f"v{i}") for i in span), *(F.count(f"v{i}").alias(f"c{i}") for i in span))
    over = Window.partitionBy(*k).orderBy("d")
    running = over.rowsBetween(Window.unboundedPreceding, 0)
    prefix = daily.select(
        *k,
        "d",
        F.lead("d").over(over).alias("until"),
        *(F.sum(f"{p}{i}").over(running).alias(f"{p}{i}") for p in "vc" for i in span),
    )
    days = F.sequence("d", F.coalesce(F.date_sub("until", 1), F.col("d")))
    dense = prefix.select(*k, F.explode(days).alias("d"), *(f"{p}{i}" for p in "vc" for i in span))
    out = []
    for i, v in enumerate(values):
        for n in periods:
            total = F.col(f"v{i}") - F.lag(f"v{i}", n, 0.0).over(over)
            count = F.col(f"c{i}") - F.lag(f"c{i}", n, 0).over(over)
            out += [
                F.when(count > 0, total).otherwise(0.0).alias(f"{v}_sum_{n}"),
                count.alias(f"{v}_cnt_{n}"),
                F.when(count > 0, total / count).alias(f"{v}_avg_{n}"),
            ]
    return dense.select(*(F.col(a).alias(c) for c, a in zip(keys, k, strict=True)), F.col("d").alias(day), *out)
