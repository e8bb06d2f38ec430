"""Spatial joins against all pairs."""

from __future__ import annotations

import math
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from emberline.operators.spatial import PackedRTree, Quadtree, circle_boxes, great_circle_km, inside_regions, within_distance


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([0, 1, 15, 16, 17, 300]))
def test_rtree(seed, n):
    rng = np.random.default_rng(seed)
    lo = rng.uniform(0, 10, (n, 2))
    boxes = np.column_stack([lo, lo + rng.uniform(0, 2, (n, 2))])
    q = np.repeat(rng.uniform(0, 12, (50, 2)), 2, axis=0).reshape(50, 4)
    got = {(int(a), int(b)) for p, r in PackedRTree(boxes).probe(q) for a, b in zip(p, r, strict=True)}
    want = {(i, j) for i in range(50) for j in range(n) if boxes[j, 0] <= q[i, 2] and boxes[j, 2] >= q[i, 0] and boxes[j, 1] <= q[i, 3] and boxes[j, 3] >= q[i, 1]}
    assert got == want


def test_quadtree_leaf_is_among_overlapped():
    rng = np.random.default_rng(1)
    lon, lat = rng.normal(110, 1, 2000), rng.normal(0, 1, 2000)
    tree = Quadtree.fit(lon, lat, 200, 0.01)
    leaf = tree.leaf(lon, lat)
    assert leaf.min() >= 0 and np.bincount(leaf).max() < 200
    at, leaves = tree.overlapped(np.column_stack([lon, lat, lon, lat]))
    assert {(i, x) for i, x in enumerate(leaf)} <= set(zip(at.tolist(), leaves.tolist(), strict=True))
    same = Quadtree.fit(np.full(1000, 5.0), np.full(1000, 5.0), 200, 0.01)  # one place: salted, not cut for ever
    assert same.salts.max() > 1


def test_circle_boxes_hold_circles():
    rng = np.random.default_rng(2)
    lon, lat, km = rng.uniform(-180, 180, 300), rng.uniform(-90, 90, 300), rng.uniform(0, 3000, 300)
    box = circle_boxes(lon, lat, km)
    for _ in range(200):
        x, y = rng.uniform(-180, 180, 300), rng.uniform(-90, 90, 300)
        near = great_circle_km(x, y, lon, lat) <= km
        inside = ((box[:, 1] <= y) & (y <= box[:, 3])) & (((box[:, 0] <= x) & (x <= box[:, 2])) | ((box[:, 0] <= x - 360) & (x - 360 <= box[:, 2])) | ((box[:, 0] <= x + 360) & (x + 360 <= box[:, 2])))
        assert not (near & ~inside).any()


def test_inside_regions(spark):
    rng = np.random.default_rng(3)
    lon, lat = np.concatenate([rng.uniform(90, 140, 900), np.full(700, 101.0), rng.uniform(179, 180, 60), rng.uniform(-180, -179, 60)]), np.concatenate([rng.uniform(-10, 8, 900), np.full(700, 5.0), rng.uniform(-1, 1, 120)])
    pts = [(i, float(a), float(b), "x") for i, (a, b) in enumerate(zip(lon, lat, strict=True))]
    bad = [(None, 101.0, 5.0, "x"), (-1, None, 5.0, "x"), (-2, float("nan"), 5.0, "x"), (-3, -999.0, 5.0, "x")]
    p = spark.createDataFrame(pts + bad, "pid long, x double, y double, part string").selectExpr("*", "part AS lon", "part AS rid")
    nan = float("nan")
    regions = [(1, "circle", 101.0, 5.0, 10.0, nan, nan, nan, nan), (2, "circle", 101.05, 5.0, 400.0, nan, nan, nan, nan), (3, "box", 0.0, 0.0, nan, 100.0, 110.0, -5.0, 5.0), (4, "BOX", None, None, None, 101.0, 120.0, 0.0, 6.0),
               (5, "circle", 180.0, 0.0, 60.0, nan, nan, nan, nan), (6, "circle", 101.0, 5.0, None, nan, nan, nan, nan), (7, "box", 1.0, 1.0, nan, None, 3.0, 4.0, 5.0), (8, "circle", -179.9, 0.3, 50.0, nan, nan, nan, nan), (None, "circle", 101.0, 5.0, 10.0, nan, nan, nan, nan)]
    r = spark.createDataFrame(regions, "sid int, shape string, longitude double, latitude double, radius_km double, west double, east double, south double, north double")
    got = [(x["pid"], x["sid"]) for x in inside_regions(p, "pid", "x", "y", r, "sid").collect()]
    want = set()
    for i, a, b, _ in pts:
        for s, shape, cx, cy, km, w, e, so, n in regions:
            if s in (6, 7, None):
                continue
            if (shape == "circle" and great_circle_km(a, b, cx, cy) <= km) or (shape != "circle" and w < a < e and so < b < n):
                want.add((i, s))
    assert len(got) == len(set(got)) and set(got) == want and any(s == 5 and pts[i][1] < 0 for i, s in want)
    assert inside_regions(p.limit(0), "pid", "x", "y", r, "sid").collect() == []
    assert inside_regions(p, "pid", "x", "y", r.limit(0), "sid").collect() == []


def test_within_distance(spark):
    rng = np.random.default_rng(4)
    a = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 3, (300, 2)))]
    p = spark.createDataFrame(a, "a long, x double, y double")
    got = [(r["a"], r["b"], r["km"]) for r in within_distance(p, "a", "x", "y", p.withColumnRenamed("a", "b"), "b", "x", "y", 20.0).collect()]
    want = {(i, j) for i, x, y in a for j, u, v in a if great_circle_km(x, y, u, v) <= 20.0}
    assert len(got) == len(want) and {(i, j) for i, j, _ in got} == want and all(k <= 20.0 for _, _, k in got)


def test_leaves_hot_on_both_sides_and_text_ids(spark, monkeypatch):
    """One place holds half of the rows of either side: its pairs come from a table of tasks, each once."""
    from emberline.operators import spatial as S

    monkeypatch.setattr(S, "LEAF_ROWS", 10)
    rng = np.random.default_rng(7)
    a = [(f"p{i}", *((1.0, 1.0) if i % 2 else map(float, rng.uniform(0, 3, 2)))) for i in range(200)]
    p = spark.createDataFrame(a, "a string, x double, y double")
    o = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(a)], "b long, x double, y double")
    seen = []
    monkeypatch.setattr(S, "Parts", lambda rows, cols, real=S.Parts: seen.append((rows.max(), cols.max())) or real(rows, cols))
    got = [(r["a"], r["b"]) for r in within_distance(p, "a", "x", "y", o, "b", "x", "y", 5.0).collect()]
    want = {(i, j) for i, x, y in a for j, (_, u, v) in enumerate(a) if great_circle_km(x, y, u, v) <= 5.0}
    assert len(got) == len(want) and set(got) == want and seen[0][0] > 1 and seen[0][1] > 1


def test_sites_see_positions_without_degrees(spark, tmp_path):
    from emberline.queries import spatial

    xyz = lambda lon, lat: (math.cos(math.radians(lat)) * math.cos(math.radians(lon)), math.cos(math.radians(lat)) * math.sin(math.radians(lon)), math.sin(math.radians(lat)))
    rows = [(1, 110.0, -2.0, *xyz(110.0, -2.0)), (2, None, None, *xyz(110.05, -2.05)), (3, float("nan"), -2.0, *xyz(110.09, -1.95)), (4, None, None, *xyz(110.3, -2.0)), (5, None, None, None, None, None)]
    fire = spark.createDataFrame(rows, "row_id long, longitude double, latitude double, x double, y double, z double")
    extra = {"frp": "double", "confidence": "int", "date": "timestamp", "daynight": "string", "satellite": "string", "labs1": "long", "labs8": "long"}
    fire.selectExpr("*", *(f"CAST(NULL AS {t}) AS {c}" for c, t in extra.items())).write.parquet(str(tmp_path / "firedata.parquet"))
    spark.createDataFrame([(7, 110.0, -2.0), (8, 100.0, 0.0)], "site_id long, longitude double, latitude double").write.parquet(str(tmp_path / "heat_sites.parquet"))
    assert {tuple(r) for r in spatial.QUERIES["positions_near_sites"](spark, str(tmp_path)).collect()} == {(7, 3)}


def test_sites_and_positions_by_brute_force(spark, sf_dir):
    from collections import Counter

    from emberline.queries import spatial
    from emberline.queries.tables import table

    d = [tuple(r) for r in spatial.detections(spark, sf_dir).select("longitude", "latitude").collect()]
    want = Counter(s for s, a, b in table(spark, sf_dir, "heat_sites").select("site_id", "longitude", "latitude").collect() for x, y in d if a - 0.1 < x < a + 0.1 and b - 0.1 < y < b + 0.1)
    assert {r["site_id"]: r["n"] for r in spatial.QUERIES["positions_near_sites"](spark, sf_dir).collect()} == want
