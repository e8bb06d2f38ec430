"""Features of fire detections and their clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keyed import join_per_key
from .linking import linked_groups
from .running import running_totals

FEW_BOXES = 32


def cluster_features(df: DataFrame, label: str, day: str, inclusive: bool = True) -> DataFrame:
    """Adds ``duration`` (days) and ``fsize`` (detections) of each row's cluster.

    Aggregated per cluster and joined back with the hot clusters set aside, so
    that no task holds a cluster with a tenth of all rows, nor the rows without
    a label; those get NULLs.
    """
    per = df.groupBy(label).agg((F.datediff(F.max(day), F.min(day)) + int(inclusive)).alias("duration"), F.count("*").alias("fsize"))
    return join_per_key(df, per, label, "fsize", ["duration", "fsize"])


def monthly_fire_features(df: DataFrame, keys: Sequence[str], ts: str, daynight: str, label: str) -> DataFrame:
    """Per cell and month: detections, by day and by night (NULL where none), median duration and size of their clusters."""
    d = cluster_features(df, label, ts)
    day, night = F.count_if(F.col(daynight) == "D"), F.count_if(F.col(daynight) == "N")
    return d.groupBy(*keys, F.year(ts).alias("year"), F.month(ts).alias("month")).agg(
        F.count("*").alias("frp"), F.when(day > 0, day).alias("frpD"), F.when(night > 0, night).alias("frpN"), F.median("duration").alias("duration"), F.median("fsize").alias("fsize")
    )


def with_first_day(df: DataFrame, label: str, day: str) -> DataFrame:
    """Adds ``first_day`` of each row's cluster; rows without a label are dropped."""
    per = df.groupBy(label).agg(F.min(day).alias("first_day"), F.count("*").alias("n__rows"))
    return join_per_key(df, per, label, "n__rows", ["first_day"], inner=True)


def ignitions(df: DataFrame, long_label: str, short_label: str, day: str, lon: str, lat: str) -> DataFrame:
    """Mean place of each short cluster on the first day of its long cluster."""
    on_first = with_first_day(df.select(long_label, short_label, day, lon, lat), long_label, day).where(F.col(day) == F.col("first_day"))
    return on_first.groupBy(short_label, day).agg(F.avg(lon).alias("longitude"), F.avg(lat).alias("latitude"))


def any_in_cluster(df: DataFrame, label: str, flags: dict[str, str]) -> DataFrame:
    """Adds a boolean for each of ``flags`` (new name to column): whether any detection of the row's cluster has it; NULL without a label."""
    per = df.groupBy(label).agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in flags.items()), F.count("*").alias("n__rows"))
    return join_per_key(df, per, label, "n__rows", list(flags))


def without_clusters_touching(df: DataFrame, label: str, boxes: DataFrame, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Drop every cluster with a detection strictly inside of a box (``west, east, south, north``); rows without a label stay.

    Up to ``FEW_BOXES`` are one filter; the different places of each cluster
    go through the quadtree join where there are more.  Labels of any type.
    """
    from .spatial import inside_regions

    named = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label__"), F.col(lon).alias("lon__"), F.col(lat).alias("lat__"))
    few = boxes.select("west", "east", "south", "north").limit(FEW_BOXES + 1).collect()
    if len(few) <= FEW_BOXES:
        inside = F.lit(False)
        for w, e, s, n in few:
            if None not in (w, e, s, n):
                inside = inside | ((F.col("lon__") > w) & (F.col("lon__") < e) & (F.col("lat__") > s) & (F.col("lat__") < n))
        hit = named.where(inside)
    else:
        regions = boxes.select(F.monotonically_increasing_id().alias("bid__"), F.lit("box").alias("shape"), *(F.lit(None).cast("double").alias(c) for c in ("longitude", "latitude", "radius_km")), "west", "east", "south", "north")
        hit = inside_regions(named.distinct(), "label__", "lon__", "lat__", regions, "bid__")
    touched = hit.groupBy("label__").agg(F.lit(True).alias("touched__"))
    sizes = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label__")).agg(F.count("*").alias("n__"))
    per = sizes.join(touched, "label__").select(F.col("label__").alias(label), "n__", "touched__")
    return join_per_key(df, per, label, "n__", ["touched__"]).where("touched__ IS NULL").drop("touched__")


def dense_labels(groups: DataFrame, group: str, first: int = 0) -> DataFrame:
    """``group`` replaced by consecutive numbers from ``first``, in its order (C4)."""
    sizes = groups.groupBy(group).agg(F.count("*").alias("n__rows"), F.lit(1).alias("one__"))
    rank = running_totals(sizes, [], group, ["one__"]).select(group, "n__rows", (F.col("upto_one__") - 1 + first).alias("rank__"))
    return join_per_key(groups, rank, group, "n__rows", ["rank__"], inner=True).drop(group).withColumnRenamed("rank__", group)


def region_clusters(df: DataFrame, id_col: str, xyz: Sequence[str], day: str, reach: float, durations: Sequence[int] = (1, 8), first: dict[int, int] | None = None) -> DataFrame:
    """``id_col`` and ``labs<d>`` for each duration: clusters of the detections that hang together in space and within ``d`` days.

    A day counts ``reach / d``.  Labels are consecutive in the order of the
    clusters' least ids, from ``first[d]`` on (to go on from another region's);
    a lone detection is a cluster of its own.  Rows without a position or day
    have no label and are left out.
    """
    out = None
    for d in durations:
        p = df.select(F.col(id_col).cast("long").alias("id"), *xyz, (F.col(day) * (reach / d)).alias("t__"))
        g = dense_labels(linked_groups(p, "id", [*xyz, "t__"], reach, keep_single=True), "group", (first or {}).get(d, 0))
        g = g.select(F.col("id").alias(id_col), F.col("group").alias(f"labs{d}"))
        out = g if out is None else out.join(g, id_col)
    return out
