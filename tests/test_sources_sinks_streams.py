"""Readers, sinks and streams."""

from __future__ import annotations

import datetime as dt
import json
import os

import numpy as np
from pyspark.sql import functions as F

from emberline.functions.geo import BBox
from emberline.operators.fwi import CODES, fwi_daily
from emberline.sources import readers as R
from emberline.sources import sinks as K
from emberline.streaming.live import counts_to, fire_counts, firsts_to, fwi_stream, merged_counts, merged_firsts, without_repeats


def test_parquet_round_trip_and_pushdown(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 100 * 1.0).alias("lon"), (F.col("id") % 50 * 1.0).alias("lat"), F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz").alias("time"), (F.col("id") % 3).alias("year"))
    K.write_table(df, str(tmp_path / "t"), ["year"], ["lon"])
    got = R.read_table(spark, str(tmp_path / "t"), columns=["k", "time"], bbox=BBox(20.0, 10.0, 5.0, 40.0), hour=7)
    want = {r["k"] for r in df.collect() if 10 < r["lon"] < 40 and 5 < r["lat"] < 20 and r["time"].hour == 7}
    assert {r["k"] for r in got.collect()} == want and want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lat)" in plan or "GreaterThan(lon" in plan
    assert R.read_table(spark, str(tmp_path / "t"), hour=0).count() == 42 and R.read_table(spark, str(tmp_path / "t")).count() == 1000
    assert "year" not in R.read_table(spark, str(tmp_path / "t"), drop=["year"]).columns


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.txt").write_text("2001-01-02  12 03:00   -1.5  110.25\n\n  2001-01-03 13 x bad 111\n")
    rows = R.read_space_separated(spark, str(tmp_path / "a.txt"), ["date", "orb", "time", "lat", "lon"], ["date", "int", "string", "double", "double"]).collect()
    assert rows[0]["date"] == dt.date(2001, 1, 2) and rows[0]["lat"] == -1.5 and rows[1]["lat"] is None and rows[1]["lon"] == 111
    (tmp_path / "f.csv").write_text("latitude,longitude,brightness,scan,track,acq_date,acq_time,satellite,instrument,confidence,version,bright_t31,frp,daynight,type\n-1.0,110.0,300,1,1,2015-09-01,0310,Aqua,X,80,6,290,12.5,D,0\n")
    r = R.read_fire_archive(spark, str(tmp_path / "f.csv")).first()
    assert r["date"] == dt.date(2015, 9, 1) and r["frp"] == 12.5 and "acq_date" not in r.asDict()


def test_names_of_files(spark):
    df = spark.createDataFrame([("X.A2005032.h29v09.006.bin",), ("chirps.2010.02.28.tif",), ("none",), (None,)], "file string")
    h, v = R.tile_of_file()
    got = [tuple(r) for r in df.select(h, v, R.date_of_file()).collect()]
    assert got == [(29, 9, dt.date(2005, 2, 1)), (None, None, dt.date(2010, 2, 28)), (None, None, None), (None, None, None)]


def test_arrays(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.array([[0, 1.5], [np.nan, -9999]]))
    np.save(tmp_path / "b.npy", np.array([2.0, 0.0]))
    got = {(r["row"], r["col"], r["value"]) for r in R.read_arrays(spark, str(tmp_path), -9999.0).collect()}
    assert got == {(0, 1, 1.5), (0, 0, 2.0)}
    assert {(r["row"], r["col"], r["value"]) for r in R.read_arrays(spark, str(tmp_path), -9999.0, zeros=True).collect()} == got | {(0, 0, 0.0), (0, 1, 0.0)}


def test_small_readers(spark):
    df = spark.createDataFrame([(5, 3, 1.0), (0, 3, 2.0), (9, 1, float("nan"))], "date int, qa int, v double")
    assert R.burned_pixels(df).count() == 1
    assert R.without_nan(df).where("v IS NULL").count() == 1
    assert R.scaled(df.where("qa = 3"), "v", 0.1, 1.5).collect()[0]["v"] == 0.1
    assert {r["level"] for r in R.union_levels({0: df, 5: df.drop("qa")}).collect()} == {0, 5}
    assert R.join_values("an") == "an" and R.join_values(7) == 7 and R.date_range("2019-01-01", "2019-02-03") == "2019-01-01/to/2019-02-03" and R.date_range("2019-01-01", "2019-01-01") == "2019-01-01"
    assert R.join_values([1, 2, 3]) == "1/2/3" and R.monthly_dates("2019-01-15", "2019-03-02") == "20190101/20190201/20190301"


def test_tiles_fills_and_small_files(spark, tmp_path):
    tile = "date int, qa int, longitude double, latitude double"
    for year, name, rows in ((2005, "A2005001.h29v09", [(40, 3, 110.0, -1.0), (0, 3, 110.0, -1.0), (7, 1, 110.0, -1.0)]), (2005, "A2005001.h30v09", []), (2007, "A2007032.h28v08", [(9, 3, 120.0, 1.0)])):
        spark.createDataFrame(rows, tile).coalesce(1).write.parquet(str(tmp_path / "w"), mode="overwrite")
        part = next((tmp_path / "w").glob("part-*"))
        (tmp_path / str(year)).mkdir(exist_ok=True)
        part.rename(tmp_path / str(year) / f"X.{name}.006.parquet")
    got = {(r["year"], r["tile_h"], r["tile_v"], r["date"]) for r in R.read_tiles(spark, str(tmp_path), [2005, 2006, 2007]).collect()}
    assert got == {(2005, 29, 9, 40), (2007, 28, 8, 9)}
    assert R.read_tiles(spark, str(tmp_path), [2005, 2007], BBox(0.0, 100.0, -5.0, 115.0)).count() == 1
    px = spark.createDataFrame([("a", 100.0, 0.0, -9999.0), ("a", 101.0, 0.0, 4.0), ("a", 150.0, 0.0, 4.0), ("b", 100.0, 0.0, 32765.0)], "file string, longitude double, latitude double, sm double")
    box = BBox(3.1, 98.9, -3.1, 104.1)
    assert [(r["file"], r["sm"]) for r in R.scaled(px, "sm", 0.5, 32761, -9999.0, box).orderBy("longitude").collect()] == [("a", None), ("a", 2.0)]
    assert {r["file"] for r in R.enough_pixels(px, "file", 3).collect()} == {"a"} and R.enough_pixels(px, "file").count() == 0


def test_csv_and_json(spark, tmp_path):
    df = spark.createDataFrame([(2001, 1, 1, 1.005, "a"), (2001, 1, 2, None, None), (2002, 3, 1, 2.0, "b")], "year int, month int, cell int, v double, s string")
    K.write_csv(df, str(tmp_path / "c"), 2)
    back = {(r["year"], r["cell"]): (r["v"], r["s"]) for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()}
    assert back["2002", "1"] == ("2.00", "b") and back["2001", "2"] == (None, None)
    j = {r["year"]: json.loads(r["json"]) for r in K.nested_json(df, "year", "month", ["cell"], {"values": "v", "cells": "cell"}).collect()}
    assert j[2002] == {"3": {"values": [2.0], "cells": [1]}} and j[2001]["1"]["cells"] == [1, 2]


def _stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def _run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.sql(f"SELECT * FROM {name}").collect()


def test_fwi_stream_equals_batch(spark, tmp_path):
    rows = [(c, dt.date(2019, 1, 1) + dt.timedelta(d), 25.0 + d % 7, 60.0 + 5 * (d % 5), 2.0, 3.0 * (d % 4 == 0), 40.0 * (c == "b")) for c in "ab" for d in range(20)]
    schema = "cell string, day date, t double, h double, w double, rain double, lat double"
    df = spark.createDataFrame(rows, schema)
    for i, (a, b) in enumerate(((0, 8), (8, 15), (15, 20))):
        lo, hi = (dt.date(2019, 1, 1) + dt.timedelta(x) for x in (a, b))
        df.where((F.col("day") >= lo) & (F.col("day") < hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/part={i}"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = {(r["cell"], r["day"]): tuple(round(r[c], 9) for c in CODES) for r in _run(fwi_stream(src), "fwi_live")}
    want = {(r["cell"], r["day"]): tuple(round(r[c], 9) for c in CODES) for r in fwi_daily(df, ["cell"], "day", "t", "h", "w", "rain").collect()}
    assert got == want
    by_lat = {(r["cell"], r["day"]): tuple(round(r[c], 9) for c in CODES) for r in _run(fwi_stream(src, mode="latitude"), "fwi_lat")}
    assert by_lat == {(r["cell"], r["day"]): tuple(round(r[c], 9) for c in CODES) for r in fwi_daily(df, ["cell"], "day", "t", "h", "w", "rain", mode="latitude", lat="lat").collect()}


def test_windowed_counts(spark, tmp_path):
    t0 = dt.datetime(2019, 1, 1)
    rows = [(i % 4, t0 + dt.timedelta(hours=6 * i), "x") for i in range(40)] + [(0, t0, "x"), (9, t0 + dt.timedelta(days=60), "x")]
    schema = "k int, at timestamp, s string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "e"))
    out = _run(fire_counts(_stream(spark, tmp_path / "e", schema), "at", ["s"]), "counts_live")
    assert sum(r["n"] for r in out) == 41 and len(out) == 10
    assert len(_run(without_repeats(_stream(spark, tmp_path / "e", schema), "at", ["k"], "200 days"), "once_live")) == 5


def _in_order(spark, path, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path / f"p{i}"))
        for f in (path / f"p{i}").glob("*.parquet"):  # files are read by time of writing
            os.utime(f, (1e9 + 100 * i, 1e9 + 100 * i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))


def test_rows_of_any_delay_are_counted(spark, tmp_path):
    t = lambda d: dt.datetime(2019, 1, 1, 6) + dt.timedelta(d)
    src = _in_order(spark, tmp_path / "in", [[(1, t(0), "x")], [(2, t(100), "x")], [(3, t(100), "y")], [(4, t(0), "x"), (2, t(103), "z")]], "k int, at timestamp, s string")
    for q in (counts_to(src, "at", ["s"], str(tmp_path / "n")), firsts_to(src, "at", ["k"], str(tmp_path / "f"))):
        run = q.option("checkpointLocation", str(tmp_path / f"c{id(q)}")).start()
        run.processAllAvailable()
        run.stop()
    day = lambda d: t(d).replace(hour=0)
    assert {(r["start"], r["s"]): r["n"] for r in merged_counts(spark, str(tmp_path / "n"), ["s"]).collect()} == {(day(0), "x"): 2, (day(100), "x"): 1, (day(100), "y"): 1, (day(103), "z"): 1}
    assert {(r["k"], r["at"], r["s"]) for r in merged_firsts(spark, str(tmp_path / "f"), "at", ["k"]).collect()} == {(1, t(0), "x"), (2, t(100), "x"), (3, t(100), "y"), (4, t(0), "x")}


def test_late_days_of_the_weather_are_kept(spark, tmp_path):
    row = lambda d: ("a", dt.date(2019, 1, 1) + dt.timedelta(d), 25.0 + d, 60.0, 2.0, 0.0)
    src = _in_order(spark, tmp_path / "in", [[row(0)], [row(2)], [row(1), row(3)]], "cell string, day date, t double, h double, w double, rain double")
    got = _run(fwi_stream(src, keep_late=True), "fwi_late")
    assert {r["day"]: r["late"] for r in got} == {row(d)[1]: d == 1 for d in range(4)}
    assert {tuple(r[c] for c in ("cell", "day", "t", "h", "w", "rain")) for r in got} == {row(d) for d in range(4)}
