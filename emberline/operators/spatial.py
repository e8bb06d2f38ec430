"""Points near other points or inside regions, by quadtree partitions and packed R-trees.

Both sides are boxes in degrees (a point is a box without extent).  A sample
of the points places the leaves of a quadtree, so each leaf holds about the
same load; a box goes to every leaf that it overlaps.  One task bulk-loads an
R-tree over a leaf's regions and probes it with the leaf's points, refines the
candidates with exact geometry, and reports a pair only in the leaf that holds
the pair's reference point (the south-west corner of the overlap), so
replicas yield no duplicates.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, valid_degrees

SAMPLE_ROWS = 40_000
LEAF_ROWS = 100_000
MOST_LEAVES = 8_192
DEPTH = 24
FANOUT = 16
CHUNK = 4_000_000
SALT_RANGE = 1 << 24
WORLD = (-180.0, -90.0, 360.0)  # west, south and width of the root square


@dataclass(frozen=True)
class Quadtree:
    """``child[i]``: first of the four children of node ``i``, or ``-1 - leaf``; ``salts[leaf]``: shares of the points of a leaf too hot to cut."""

    child: np.ndarray
    salts: np.ndarray

    @classmethod
    def fit(cls, lon: np.ndarray, lat: np.ndarray, leaves: int, leaf_share: float) -> Quadtree:
        """Quarter the fullest leaf until there are ``leaves`` or each holds at most ``leaf_share`` of the sample."""
        child, tick = [0], itertools.count(1)
        w, s, size = WORLD
        heap = [(-len(lon), 0, 0, (w, s, size, 0), np.arange(len(lon)))]
        done = []
        while heap and len(heap) + len(done) + 3 <= leaves:
            n, _, node, (w, s, size, depth), at = heapq.heappop(heap)
            if -n <= max(1.0, leaf_share * len(lon)) or depth >= DEPTH:
                done.append((node, -n))
                continue
            first = len(child)
            child[node] = first
            child += [0] * 4
            half = size / 2
            quad = (lon[at] >= w + half).astype(int) + 2 * (lat[at] >= s + half)
            for q in range(4):
                part = at[quad == q]
                heapq.heappush(heap, (-len(part), next(tick), first + q, (w + half * (q & 1), s + half * (q >> 1), half, depth + 1), part))
        ends = done + [(node, -n) for n, _, node, _, _ in heap]
        salts = np.ones(len(ends), int)
        for leaf, (node, n) in enumerate(ends):
            child[node] = -1 - leaf
            salts[leaf] = max(1, int(np.ceil(n / max(1.0, 2 * leaf_share * len(lon)))))
        return cls(np.array(child), salts)

    def leaf(self, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        node = np.zeros(len(lon), int)
        w, s, size = np.full(len(lon), WORLD[0]), np.full(len(lon), WORLD[1]), WORLD[2]
        out = np.full(len(lon), -1)
        at = np.arange(len(lon))
        while len(at):
            c = self.child[node[at]]
            ended = c < 0
            out[at[ended]] = -1 - c[ended]
            at, c = at[~ended], c[~ended]
            size /= 2
            east, north = lon[at] >= w[at] + size, lat[at] >= s[at] + size
            w[at] += east * size
            s[at] += north * size
            node[at] = c + east + 2 * north
        return out

    def overlapped(self, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``box index, leaf`` for every leaf that a box (west, south, east, north) overlaps."""
        boxes_, leaves = [], []
        todo = [(0, *WORLD, np.arange(len(boxes)))]
        while todo:
            node, w, s, size, at = todo.pop()
            b = boxes[at]
            at = at[(b[:, 0] <= w + size) & (b[:, 2] >= w) & (b[:, 1] <= s + size) & (b[:, 3] >= s)]
            if not len(at):
                continue
            c = self.child[node]
            if c < 0:
                boxes_.append(at)
                leaves.append(np.full(len(at), -1 - c))
                continue
            half = size / 2
            todo += [(c + q, w + half * (q & 1), s + half * (q >> 1), half, at) for q in range(4)]
        if not boxes_:
            return np.zeros(0, int), np.zeros(0, int)
        return np.concatenate(boxes_), np.concatenate(leaves)


class PackedRTree:
    """An R-tree bulk-loaded by sort-tile-recursion; probes run for all boxes at once, level by level."""

    def __init__(self, boxes: np.ndarray, fanout: int = FANOUT):
        self.levels: list[np.ndarray] = []
        self.fanout = fanout
        mid_x, mid_y = boxes[:, 0] + boxes[:, 2], boxes[:, 1] + boxes[:, 3]
        slabs = max(1, int(np.ceil(np.sqrt(len(boxes) / fanout))))
        per_slab = max(1, -(-len(boxes) // slabs))
        by_x = np.argsort(mid_x, kind="stable")
        self.order = np.concatenate([s[np.argsort(mid_y[s], kind="stable")] for s in np.split(by_x, range(per_slab, len(boxes), per_slab))]) if len(boxes) else np.zeros(0, int)
        level = boxes[self.order]
        while True:
            self.levels.append(level)
            if len(level) <= 1:
                break
            at = np.arange(0, len(level), fanout)
            level = np.column_stack([np.minimum.reduceat(level[:, :2], at, axis=0), np.maximum.reduceat(level[:, 2:], at, axis=0)])

    def probe(self, boxes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``probe index, item index`` of every overlap (edges touch), in blocks of probes."""
        if not len(self.order):
            return
        block = max(1_000, CHUNK // (4 * self.fanout))
        for begin in range(0, len(boxes), block):
            yield from self._descend(boxes, np.arange(begin, min(begin + block, len(boxes))), np.zeros(min(block, len(boxes) - begin), int), len(self.levels) - 1)

    def _descend(self, boxes: np.ndarray, p: np.ndarray, node: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        b, n = boxes[p], self.levels[depth][node]
        hit = (b[:, 0] <= n[:, 2]) & (b[:, 2] >= n[:, 0]) & (b[:, 1] <= n[:, 3]) & (b[:, 3] >= n[:, 1])
        p, node = p[hit], node[hit]
        if not len(p):
            return
        if depth == 0:
            yield p, self.order[node]
            return
        below = len(self.levels[depth - 1])
        for begin in range(0, len(p), CHUNK // self.fanout):
            pp, nn = p[begin : begin + CHUNK // self.fanout], node[begin : begin + CHUNK // self.fanout]
            kids = (nn[:, None] * self.fanout + np.arange(self.fanout)).ravel()
            real = kids < below
            yield from self._descend(boxes, np.repeat(pp, self.fanout)[real], kids[real], depth - 1)


def great_circle_km(lon1, lat1, lon2, lat2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def circle_boxes(lon: np.ndarray, lat: np.ndarray, km: np.ndarray) -> np.ndarray:
    """Boxes that hold the circles; one that reaches a pole spans all longitudes."""
    angle = np.minimum(km / EARTH_KM * (1 + 1e-9) + 1e-12, np.pi)
    dlat = np.degrees(angle)
    ratio = np.sin(angle) / np.maximum(np.cos(np.radians(lat)), 1e-12)
    dlon = np.where((np.abs(lat) + dlat >= 90) | (ratio >= 1), 360.0, np.degrees(np.arcsin(np.minimum(1.0, ratio))))
    dlon = np.where(dlon >= 180.0, 360.0, dlon)
    return np.column_stack([lon - dlon, lat - dlat, lon + dlon, lat + dlat])


REGION = "rid long, circle boolean, clon double, clat double, km double, w double, s double, e double, n double, bw double, bs double, be double, bn double"
_COLS = ["clon", "clat", "km", "w", "s", "e", "n", "bw", "bs", "be", "bn"]


def _region_boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bounding boxes of the regions; a circle over the date line comes once more on the other side."""
    for r in batches:
        box = np.where(r["circle"].to_numpy(bool)[:, None], circle_boxes(r["clon"].to_numpy(float), r["clat"].to_numpy(float), r["km"].fillna(0).to_numpy(float)), r[["w", "s", "e", "n"]].to_numpy(float))
        r[["bw", "bs", "be", "bn"]] = box
        yield r
        for turn, over in ((-360.0, box[:, 2] > 180), (360.0, box[:, 0] < -180)):
            if over.any():
                again = r[over].copy()
                again[["bw", "be", "clon"]] += turn
                yield again


@dataclass(frozen=True)
class Parts:
    """The tasks of each leaf: a hot leaf has a table of them, ``rows[leaf]`` shares of its points by ``cols[leaf]`` shares of its regions."""

    rows: np.ndarray
    cols: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.rows * self.cols)]).astype(int)

    def leaf_of_part(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows)), self.rows * self.cols)


def _expand(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item as many copies as ``times`` says: the item and the number of the copy."""
    item = np.repeat(np.arange(len(times)), times)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(times) - times, times)


def _with_part(tree: Quadtree, parts: Parts, wanted: np.ndarray):
    """The tasks of each point; points of leaves without a region end here."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = parts.first
        for p in batches:
            leaf = tree.leaf(p["lon"].to_numpy(float), p["lat"].to_numpy(float))
            at = np.flatnonzero(wanted[leaf])
            leaf = leaf[at]
            row = p["salt"].to_numpy()[at] % parts.rows[leaf]
            item, col = _expand(parts.cols[leaf])
            out = p.iloc[at[item]].drop(columns="salt")
            out.insert(0, "part", (first[leaf] + row * parts.cols[leaf])[item].astype("int32") + col.astype("int32"))
            yield out

    return run


def _replicate(tree: Quadtree, parts: Parts):
    """The tasks of each region: those of every leaf that it overlaps, in all of which it is in one share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = parts.first
        for r in batches:
            at, leaf = tree.overlapped(r[["bw", "bs", "be", "bn"]].to_numpy(float))
            col = r["salt"].to_numpy()[at] % parts.cols[leaf]
            item, row = _expand(parts.rows[leaf])
            out = r.iloc[at[item]].drop(columns="salt")
            out.insert(0, "part", (first[leaf] + col)[item].astype("int32") + (row * parts.cols[leaf][item]).astype("int32"))
            yield out

    return run


def _probe(tree: Quadtree, leaf_of_part: np.ndarray):
    def run(key: tuple, points: pd.DataFrame, regions: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(points) and len(regions):
            leaf = leaf_of_part[key[0]]
            lon, lat = points["lon"].to_numpy(float), points["lat"].to_numpy(float)
            g = {c: regions[c].to_numpy(float) for c in _COLS}
            circle, rid, pid = regions["circle"].to_numpy(bool), regions["rid"].to_numpy(), points["pid"].to_numpy()
            boxes = regions[["bw", "bs", "be", "bn"]].to_numpy(float)
            for p, r in PackedRTree(boxes).probe(np.column_stack([lon, lat, lon, lat])):
                x, y = lon[p], lat[p]
                km = np.where(circle[r], great_circle_km(x, y, g["clon"][r], g["clat"][r]), np.nan)
                inside = np.where(circle[r], km <= g["km"][r], (x > g["w"][r]) & (x < g["e"][r]) & (y > g["s"][r]) & (y < g["n"][r]))
                p, r, km = p[inside], r[inside], km[inside]
                # the reference point of a point and a box is the point itself
                ref = tree.leaf(np.maximum(lon[p], boxes[r, 0]), np.maximum(lat[p], boxes[r, 1])) == leaf
                found.append(pd.DataFrame({"pid": pid[p[ref]], "rid": rid[r[ref]], "km": km[ref]}))
        return pd.concat(found) if found else pd.DataFrame({"pid": points["pid"].iloc[:0], "rid": np.zeros(0, "int64"), "km": np.zeros(0)})

    return run


def _share(rows: int) -> float:
    return min(1.0, SAMPLE_ROWS / max(1, rows))


def _join(points: DataFrame, regions: DataFrame) -> DataFrame:
    """``points``: pid, lon, lat, salt; ``regions``: as REGION and salt.  Pairs ``pid, rid, km``."""
    spark = points.sparkSession
    pid = points.schema["pid"].dataType.simpleString()
    rows, n_regions = points.count(), regions.count()
    chance = lambda share: F.col("salt") < int(share * SALT_RANGE) + 1
    sample = points.where(chance(_share(rows))).select("lon", "lat").toArrow().to_pandas().to_numpy(float)
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows // LEAF_ROWS))
    tree = Quadtree.fit(sample[:, 0], sample[:, 1], min(MOST_LEAVES, 4 * tasks + 1), 1 / tasks)
    some = regions.where(chance(_share(n_regions))).select("bw", "bs", "be", "bn").toArrow().to_pandas().to_numpy(float)
    load = np.bincount(tree.overlapped(some)[1], minlength=len(tree.salts)) / _share(n_regions)
    parts = Parts(tree.salts, np.maximum(1, np.ceil(load / (2 * LEAF_ROWS))).astype(int))
    spread = regions.mapInPandas(_replicate(tree, parts), "part int, " + REGION)
    used = spread.select("part").distinct().toArrow().to_pandas()["part"].to_numpy()  # bounded by leaves and their shares
    wanted = np.zeros(len(tree.salts), bool)
    wanted[parts.leaf_of_part()[used]] = True
    placed = points.mapInPandas(_with_part(tree, parts, wanted), f"part int, pid {pid}, lon double, lat double")
    return placed.groupBy("part").cogroup(spread.groupBy("part")).applyInPandas(_probe(tree, parts.leaf_of_part()), f"pid {pid}, rid long, km double")


def _salt(*columns: str):
    return F.pmod(F.xxhash64(*columns), F.lit(SALT_RANGE)).cast("int").alias("salt")


def _points(df: DataFrame, id_col: str, lon: str, lat: str) -> DataFrame:
    p = df.where(valid_degrees(lon, lat) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("pid"), F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat"))
    return p.select("*", _salt("pid", "lon", "lat"))


def inside_regions(points: DataFrame, id_col: str, lon: str, lat: str, regions: DataFrame, region_id: str) -> DataFrame:
    """``id_col, region_id, km``: every region that a point lies in.

    ``regions`` has ``shape``; circles ``longitude, latitude, radius_km`` (the
    great-circle distance is at most the radius), boxes ``west, east, south,
    north`` (strictly inside).  ``km`` is the distance from a circle's centre,
    NULL for boxes.  Points without valid degrees or id and regions without
    their measures yield nothing; overlapping regions each yield a row, and so
    does each of several points with the same place.
    """
    circle = F.lower(F.trim("shape")) == "circle"
    r = regions.select(
        F.col(region_id).cast("long").alias("rid"), circle.alias("circle"), F.col("longitude").alias("clon"), F.col("latitude").alias("clat"), F.col("radius_km").alias("km"),
        F.col("west").alias("w"), F.col("south").alias("s"), F.col("east").alias("e"), F.col("north").alias("n"),
    )
    sound = F.when(F.col("circle"), valid_degrees("clon", "clat") & (F.col("km") >= 0) & (F.col("km") < F.lit(float("inf")))).otherwise(valid_degrees("w", "s") & valid_degrees("e", "n"))
    r = r.where(F.col("rid").isNotNull() & F.coalesce(sound, F.lit(False))).select("*", *(F.lit(0.0).alias(c) for c in ("bw", "bs", "be", "bn"))).mapInPandas(_region_boxes, REGION).select("*", _salt("rid"))
    out = _join(_points(points, id_col, lon, lat), r)
    rid_type = regions.schema[region_id].dataType
    return out.select(F.col("pid").alias(id_col), F.col("rid").cast(rid_type).alias(region_id), F.when(F.isnan("km"), None).otherwise(F.col("km")).alias("km"))


def within_distance(points: DataFrame, id_col: str, lon: str, lat: str, others: DataFrame, other_id: str, other_lon: str, other_lat: str, km: float) -> DataFrame:
    """``id_col, other_id, km``: every other location within ``km`` of a point.

    The others are circles around their places; a point is compared only with
    those whose box covers it.  Rows without valid degrees or id yield
    nothing.  Both id columns must have different names.  A leaf that is hot
    on either side, or on both, is a table of tasks: each holds a share of the
    points and a share of the others.
    """
    o = others.where(valid_degrees(other_lon, other_lat) & F.col(other_id).isNotNull()).select(
        F.col(other_id).cast("long").alias("rid"), F.lit(True).alias("circle"), F.col(other_lon).cast("double").alias("clon"), F.col(other_lat).cast("double").alias("clat"),
        F.lit(float(km)).alias("km"), *(F.lit(0.0).alias(c) for c in ("w", "s", "e", "n", "bw", "bs", "be", "bn")),
    ).mapInPandas(_region_boxes, REGION).select("*", _salt("rid", "clon", "clat"))
    return _join(_points(points, id_col, lon, lat), o).select(F.col("pid").alias(id_col), F.col("rid").alias(other_id), "km")
