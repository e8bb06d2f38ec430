"""Reading the inputs: long Parquet first, and the text and array formats around it."""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import finite
from ..functions.geo import BBox


def read_table(spark: SparkSession, *paths: str, columns: Sequence[str] | None = None, drop: Sequence[str] = (), bbox: BBox | None = None, hour: int | None = None, time: str = "time") -> DataFrame:
    """Long Parquet tables of one or several paths.

    Only the wanted columns are read and the box reaches the scan as a filter.
    ``hour``: rows at exactly that hour, 0 (midnight) included; None takes all.
    """
    df = spark.read.option("mergeSchema", len(paths) > 1).parquet(*paths)
    aliases = {"lon": "longitude", "lat": "latitude", "long": "longitude"}
    for old, new in aliases.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    if bbox is not None:
        df = df.where(bbox.predicate())
    if hour is not None:
        df = df.where((F.hour(time) == hour) & (F.minute(time) == 0) & (F.second(time) == 0))
    if columns is not None:
        df = df.select(*columns)
    return df.drop(*drop)


def without_nan(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers become NULL in every floating column."""
    return df.select(*(finite(c).cast(t).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def read_space_separated(spark: SparkSession, path: str, names: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """Columns separated by runs of white space, no header (S16); what can't be read as its kind is NULL."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return lines.select(*(F.try_element_at(parts, F.lit(i + 1)).try_cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))))


def read_fire_archive(spark: SparkSession, path: str) -> DataFrame:
    """A fire archive in CSV; ``acq_date`` becomes ``date``."""
    schema = "latitude double, longitude double, brightness double, scan double, track double, acq_date string, acq_time string, satellite string, instrument string, confidence int, version string, bright_t31 double, frp double, daynight string, type int"
    raw = spark.read.option("enforceSchema", False).csv(path, header=True, schema=schema)
    return raw.withColumn("date", F.try_to_date("acq_date", "yyyy-MM-dd")).drop("acq_date")


def tile_of_file(column: str = "file") -> tuple[F.Column, F.Column]:
    """Tile numbers h and v from a file name such as ``X.A2005001.h29v09.006.bin``."""
    h, v = (F.regexp_extract(column, r"\bh(\d{2})v(\d{2})\b", k) for k in (1, 2))
    return F.when(h != "", h.cast("int")), F.when(v != "", v.cast("int"))


def date_of_file(column: str = "file") -> F.Column:
    """Date from the day-of-year code ``yyyyddd`` after an A, or from ``yyyy.mm.dd``, in a file name."""
    code, dotted = F.regexp_extract(column, r"\bA(\d{7})\b", 1), F.regexp_extract(column, r"(\d{4}\.\d{2}\.\d{2})", 1)
    return F.coalesce(F.try_to_date(F.when(code != "", code), "yyyyDDD"), F.try_to_date(F.when(dotted != "", dotted), "yyyy.MM.dd"))


def read_arrays(spark: SparkSession, path: str, no_data: float | None = None, zeros: bool = False) -> DataFrame:
    """``file, row, col, value`` of two-dimensional ``.npy`` arrays, one task per file.

    NaN and ``no_data`` are dropped, and zeros too unless ``zeros``: rasters
    are mostly empty, but 0 is a value of a saved state.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                a = np.atleast_2d(a).astype(float)
                keep = np.isfinite(a) & (zeros | (a != 0)) & ((a != no_data) if no_data is not None else True)
                r, c = np.nonzero(keep)
                for i in range(0, len(r), 500_000):
                    s = slice(i, i + 500_000)
                    yield pd.DataFrame({"file": name, "row": r[s].astype("int32"), "col": c[s].astype("int32"), "value": a[r[s], c[s]]})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content").mapInPandas(run, "file string, row int, col int, value double")


def burned_pixels(df: DataFrame) -> DataFrame:
    """Burnt pixels of good quality from a long table with ``date`` (day of the year) and ``qa``."""
    return df.where("date > 0 AND qa = 3")


def read_tiles(spark: SparkSession, folder: str, years: Sequence[int], bbox: BBox | None = None) -> DataFrame:
    """Burnt pixels of all tiles of some years (``folder/<year>/*.parquet``), with ``tile_h, tile_v, year``; empty tiles bring nothing.

    One scan over all files: a tile without rows, or without burnt pixels of
    good quality, just has none, and a year without files is skipped.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = None
    for year in years:
        at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{year}/*.parquet")
        if not at.getFileSystem(conf).globStatus(at):
            continue
        df = spark.read.parquet(f"{folder}/{year}/*.parquet").withColumn("file", F.input_file_name())
        h, v = tile_of_file("file")
        df = burned_pixels(df).withColumns({"tile_h": h, "tile_v": v, "year": F.lit(int(year))}).drop("file", "qa")
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise FileNotFoundError(f"no tiles of {list(years)} in {folder}")
    return out.where(bbox.predicate()) if bbox is not None else out


def scaled(df: DataFrame, column: str, factor: float, fill_from: float | None = None, missing: float | None = None, bbox: BBox | None = None) -> DataFrame:
    """Scaled integers to values, in a box.

    Rows with a fill value, from ``fill_from`` on, are dropped; ``missing``
    (-9999) becomes NULL and its row stays.
    """
    out = df if bbox is None else df.where(bbox.predicate())
    if fill_from is not None:
        out = out.where(F.col(column) < fill_from)
    value = F.col(column) if missing is None else F.nullif(F.col(column), F.lit(missing))
    return out.withColumn(column, value * factor)


def enough_pixels(df: DataFrame, file: str, least: int = 10) -> DataFrame:
    """Rows of the files that have ``least`` pixels or more (S13); a file's pixels are counted once and its count joined back."""
    full = df.groupBy(file).agg(F.count("*").alias("n__")).where(F.col("n__") >= least).select(file)
    return df.join(full, file, "left_semi")


def union_levels(levels: dict[int, DataFrame]) -> DataFrame:
    """One table of several levels with a ``level`` column."""
    out = None
    for level, df in levels.items():
        part = df.withColumn("level", F.lit(level))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def join_values(values: object) -> object:
    """Values of a retrieval request, separated by slashes; a single one, a text or a number, as it is."""
    if isinstance(values, str) or not isinstance(values, Iterable):
        return values
    return "/".join(str(v) for v in values)


def monthly_dates(start: str, end: str) -> str:
    """First days of the months of a request."""
    return join_values(d.strftime("%Y%m%d") for d in pd.date_range(pd.Timestamp(start).replace(day=1), end, freq="MS"))


def date_range(start: str, end: str) -> str:
    """All days of a request as ``yyyy-mm-dd/to/yyyy-mm-dd``, a single one as it is."""
    a, b = pd.Timestamp(start), pd.Timestamp(end)
    if b < a:
        raise ValueError(f"{end} is before {start}")
    return f"{a:%Y-%m-%d}/to/{b:%Y-%m-%d}" if a < b else f"{a:%Y-%m-%d}"
