"""Boxes, grids, tiles and distances."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from emberline.functions.geo import NAMED_BOXES, BBox, Grid, cell_area_km2, haversine_km, tile_lonlat, tile_of
from emberline.functions.met import MID_MONTH_DAYS, day_length, day_length_hours
from emberline.operators import gridding as G


def test_box_orders():
    b = BBox(8.0, 93.0, -13.0, 143.0)
    assert BBox.from_order("NWSE", (8.0, 93.0, -13.0, 143.0)) == b == BBox.from_order("NSWE", (8.0, -13.0, 93.0, 143.0)) == BBox.from_order("WNES", (93.0, 8.0, 143.0, -13.0))
    with pytest.raises(ValueError):
        BBox.from_order("NNSE", (1, 2, 3, 4))


def test_box_edges(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 0.0), (2.0, 1.0), (None, 1.0), (float("nan"), 1.0)], "longitude double, latitude double")
    for closed, n in ((False, 1), (True, 3)):
        assert df.where(BBox(2.0, 0.0, 0.0, 2.0, closed).predicate()).count() == n


def test_bins(spark):
    g = Grid(NAMED_BOXES["indonesia"], 0.25)
    assert (g.n_lat, g.n_lon, g.lat_bins) == (85, 201, 84)
    cases = {92.874: -1, 92.875: 0, 93.0: 0, 93.124: 0, 93.125: 1, 143.125: 200, 150.0: 200, None: None}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "x double, want int")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", g.lonind("x")).collect())
    lat = {-13.126: -1, -13.125: 0, 7.874: 83, 7.875: 83, 8.0: 83, 9.0: 83}
    df = spark.createDataFrame(list(lat.items()), "y double, want int")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", g.latind("y")).collect())
    assert Grid(NAMED_BOXES["indonesia"], 0.25, legacy_top=False).lat_bins == 85
    back = spark.range(-1, 202).withColumn("lon", g.longitude(F.col("id"))).withColumn("again", g.lonind("lon")).collect()
    assert all((r["lon"] is None) == (not 0 <= r["id"] <= 200) and (r["lon"] is None or r["again"] == r["id"]) for r in back)


def test_tiles_round_trip(spark):
    df = spark.range(500).select((F.col("id") % 25 + 5).alias("h"), (F.col("id") % 13 + 3).alias("v"), (F.col("id") * 7 % 2400).alias("r"), (F.col("id") * 11 % 2400).alias("c"))
    lon, lat = tile_lonlat(F.col("h"), F.col("v"), F.col("r"), F.col("c"))
    # a centre is half a pixel in, where the index's own half pixel begins: nudge inwards
    for r in df.select("*", *(x.alias(k) for k, x in tile_of(lon, lat - 1e-7).items())).collect():
        assert (r["tile_h"], r["tile_v"], r["indx"]) == (r["h"], r["v"], r["r"])
        assert r["indy"] - r["c"] in (0, -1)


def test_distance_and_area(spark):
    row = spark.range(1).select(haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)).alias("q"), haversine_km(F.lit(10.0), F.lit(5.0), F.lit(10.0), F.lit(5.0)).alias("zero"), cell_area_km2(F.lit(0.0), 0.25).alias("a")).first()
    assert abs(row["q"] - 6371.0 * math.pi / 2) < 1e-6 and row["zero"] == 0 and abs(row["a"] - (6371.0 * math.radians(0.25)) ** 2) < 0.01


def test_day_length(spark):
    df = spark.range(-9, 10).select((F.col("id") * 10.0).alias("lat"), F.explode(F.array(*map(F.lit, MID_MONTH_DAYS))).alias("d"))
    for r in df.select("lat", "d", day_length(F.col("d"), F.col("lat")).alias("x")).collect():
        assert abs(r["x"] - day_length_hours(r["d"], r["lat"])) < 1e-9 and 0 <= r["x"] <= 24


def test_bilinear_needs_all_nodes(spark):
    grid = spark.createDataFrame([(0, 0, 0.0), (1, 0, 10.0), (0, 1, 20.0), (1, 1, None), (5, 5, 7.0)], "i int, j int, v double")
    pts = spark.createDataFrame([(1, 0.5, 0.0, 10.0 / 2), (2, 0.0, 0.25, 5.0), (3, 0.5, 0.5, None), (4, 5.0, 5.0, 7.0), (5, 9.0, 9.0, None), (6, 0.0, 0.0, 0.0)], "id int, x double, y double, want double")
    assert {r["id"]: r["v"] for r in G.bilinear(pts, grid, "x", "y", "v", 0.0, 0.0, 1.0, "i", "j").collect()} == {r["id"]: r["want"] for r in pts.collect()}


def test_dense_counts_of_nothing(spark):
    d = spark.createDataFrame([], "lonind int, latind int, m int")
    assert G.dense_counts(d, ["lonind", "latind"], "m", F.sequence(F.lit(1), F.lit(3))).collect() == []


def test_dense_daily(spark, sf_dir):
    from emberline.operators.gridding import dense_daily

    d = lambda k: dt.date(2020, 1, 1) + dt.timedelta(k)
    rows = [(1, d(3)), (1, d(3)), (1, d(6)), (2, d(0)), (3, d(9)), (3, None), (4, None), (None, d(5))]
    got = {(r["c"], r["day"]): r["n"] for r in dense_daily(spark.createDataFrame(rows, "c int, day date"), ["c"], "day").collect()}
    assert got == {(c, d(k)): rows.count((c, d(k))) for c in (1, 2, 3, 4, None) for k in range(10)}
    assert dense_daily(spark.createDataFrame([], "c int, day date"), ["c"], "day").collect() == []


def test_daily_cube_has_every_cell(spark, sf_dir):
    from collections import Counter

    from emberline.queries import spatial

    rows = [tuple(r) for r in spatial.detections(spark, sf_dir).select("lonind", "latind", "day").collect()]
    n, cells = Counter(rows), {r[:2] for r in rows}
    low, high = min(r[2] for r in rows), max(r[2] for r in rows)
    out = spatial.QUERIES["grid_daily_cells"](spark, sf_dir).collect()
    assert len(out) == len(cells) * ((high - low).days + 1) == len({tuple(r)[:3] for r in out})
    assert {tuple(r)[:3]: r["n"] for r in out if r["n"]} == n
