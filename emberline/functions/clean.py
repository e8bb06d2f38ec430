"""Missing values, current rows and other cleaning at the point of ingest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """The value where it is a finite number, else NULL (Spark's NaN is a value, not a missing one)."""
    c = as_col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def usable(c: str | Column, low: float = 0.0, below: float = 2000.0) -> Column:
    """The value where it lies in ``[low, below)``, else NULL; NaN and every sentinel outside becomes NULL."""
    c = as_col(c).cast("double")
    return F.when((c >= F.lit(low)) & (c < F.lit(below)), c)


def null_if_in(c: str | Column, sentinels: Sequence[float]) -> Column:
    """NULL for NULL, NaN and the listed sentinels."""
    v = finite(c)
    return F.when(~v.isin([float(s) for s in sentinels]), v)


def current_rows(df: DataFrame, keys: Sequence[str], version: str, values: dict[str, Column]) -> DataFrame:
    """One row per key: the values of the row with the greatest ``version``.

    A NULL version loses against any other.  Where versions tie, the row with
    the greatest values wins, so the result doesn't depend on row order.
    Partial aggregation keeps one row per key and task before the shuffle, so
    a key with many deliveries costs no more than one with a single row.
    Columns of ``df`` that are neither keys nor values are dropped, whatever
    their names.
    """
    names = [f"v{i}" for i in range(len(values))]
    packed = F.struct(F.col(version).alias("version"), *(c.alias(n) for n, c in zip(names, values.values(), strict=True)))
    inner = df.select(*keys, packed.alias("packed__"))
    out = inner.groupBy(*keys).agg(F.max("packed__").alias("packed__"))
    return out.select(*keys, *(F.col(f"packed__.{n}").alias(k) for n, k in zip(names, values, strict=True)))


def day_index(c: str | Column, base: str = "2002-01-01") -> Column:
    """Days since ``base`` as INT."""
    return F.datediff(as_col(c).cast("date"), F.lit(base).cast("date"))
