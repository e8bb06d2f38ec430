"""Writing results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), cluster_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet by partitions; ``cluster_by`` sorts inside of the files, so that row groups can be skipped (K1, K2, K5)."""
    if partition_by:
        df = df.repartition(*partition_by, *cluster_by[:1]) if cluster_by else df
    if cluster_by:
        df = df.sortWithinPartitions(*partition_by, *cluster_by)
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_csv(df: DataFrame, path: str, decimals: int = 2, mode: str = "overwrite") -> None:
    """CSV with a header, floating columns with a fixed number of decimals (K3)."""
    fixed = lambda c: F.when(F.col(c).isNotNull(), F.format_string(f"%.{decimals}f", F.col(c).cast("double")))
    out = df.select(*(fixed(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))
    out.write.mode(mode).csv(path, header=True)


def nested_json(df: DataFrame, outer: str, inner: str, order: Sequence[str], values: dict[str, str]) -> DataFrame:
    """``outer, json``: for each outer key (year) an object from inner key (month) to arrays of values by cell (K4).

    ``values``: array name to column.  Arrays are in the order of ``order``.
    One row of an inner key holds its cells once, as the page needs them.
    """
    packed = F.array_sort(F.collect_list(F.struct(*order, *(F.col(c).alias(f"v{i}") for i, c in enumerate(values.values())))))
    per = df.groupBy(outer, inner).agg(packed.alias("rows"))

    def array(i: int):
        return F.transform("rows", lambda r: r[f"v{i}"])

    arrays = F.struct(*(array(i).alias(n) for i, n in enumerate(values)))
    whole = per.select(outer, F.struct(F.col(inner).cast("string").alias("key"), arrays.alias("value")).alias("e"))
    return whole.groupBy(outer).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list("e")))).alias("json"))


def save_state(state: DataFrame, path: str) -> None:
    """The state of the fire-weather recurrence, for a later run (K6)."""
    state.write.mode("overwrite").parquet(path)
