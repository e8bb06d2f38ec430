"""Exact or bounded-error percentiles per group by cumulative frequencies."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import finite
from ..operators.running import running_totals


def value_counts(df: DataFrame, groups: Sequence[str], value: str, relative_error: float = 0.0) -> DataFrame:
    """``groups, value, n``: the piece that can be computed apart, stored and added to others by ``merge_counts``.

    With ``relative_error`` e > 0 values are counted at the middle of bins
    whose bounds grow by (1 + e), so a group has at most log(range) / log(1 + e)
    of them and any percentile is within e of the true one, relative to it.
    NULL, NaN and infinite values are left out.
    """
    v = finite(value)
    if relative_error > 0:
        ratio = math.log1p(relative_error)
        middle = F.signum(v) * F.exp((F.floor(F.ln(F.abs(v)) / ratio) + 0.5) * ratio)
        v = F.when(v == 0.0, 0.0).otherwise(middle)
    # -0.0 and 0.0 are one value
    return df.select(*groups, (v + F.lit(0.0)).alias("value")).where("value IS NOT NULL").groupBy(*groups, "value").agg(F.count("*").alias("n"))


def merge_counts(*pieces: DataFrame) -> DataFrame:
    """Counts of several partitions or days added up."""
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    groups = [c for c in pieces[0].columns if c not in ("value", "n")]
    return out.groupBy(*groups, "value").agg(F.sum("n").alias("n"))


def cumulative(counts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Counts with ``upto`` (values of the group not above this one) and ``total``.

    Sorted by range over (group, value), so even a group with most of the
    values spreads over many partitions; running sums within each partition,
    and the sums of a group in the partitions before as offsets.
    """
    return running_totals(counts, groups, "value", ["n"]).withColumnsRenamed({"upto_n": "upto", "total_n": "total"})


def percentiles(df: DataFrame, groups: Sequence[str], value: str, pcts: Sequence[float], relative_error: float = 0.0) -> DataFrame:
    """``groups, pct, value, total``: the least value such that at least ``pct`` percent are not above it.

    Exact with ``relative_error`` 0.  A group without values gives no row; a
    NULL group key is a group; a percentile of 0 is the least value.
    """
    return pick(cumulative(value_counts(df, groups, value, relative_error), groups), groups, pcts)


def pick(cum: DataFrame, groups: Sequence[str], pcts: Sequence[float]) -> DataFrame:
    """First values that reach the target ranks; ``cum`` as of ``cumulative``."""
    targets = F.array(*(F.lit(float(p)) for p in pcts))
    reached = F.filter(targets, lambda p: reaches(p))
    hit = cum.withColumn("pct", F.explode(reached))
    return hit.select(*groups, "pct", "value", "total")


def reaches(pct: Column | float) -> Column:
    """Whether the value is the first whose cumulative count reaches ``pct`` percent of the total."""
    p = F.lit(pct) if not isinstance(pct, Column) else pct
    start = F.col("upto") - F.col("n")
    return (F.col("upto") * 100.0 >= p * F.col("total")) & ((start * 100.0 < p * F.col("total")) | (start == 0))
