"""Points that hang together within a distance, exactly and without all pairs.

A sample-driven k-d tree cuts the space of the coordinates (time is one of
them) into boxes of about equal load, so a hot place is cut in space and in
time.  Each point goes to its box and, if it lies within the distance of
another box, there too.  One task then groups the points of a box into leaves
so small that their members are linked for certain, compares leaves by their
boxes and points only where that leaves a doubt, and a contraction over the
few labels of points seen by several boxes joins the rest.
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

from ..plans.materialize import materialize
from .components import component_roots, components

#: Rows that a box aims at, and rows of the sample that places the cuts.
BOX_ROWS = 100_000
SAMPLE_ROWS = 40_000
#: Rows of the sample at the very same place from which on one of them stands for all.
HOT_SEEN = 20
#: Pairs held at once.
CHUNK = 2_000_000


@dataclass(frozen=True)
class KdTree:
    """Cuts as arrays: node ``i`` cuts ``axis[i]`` at ``cut[i]``; children below 0 are boxes ``-1 - child``."""

    axis: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    boxes: int

    @classmethod
    def fit(cls, sample: np.ndarray, boxes: int, least_width: float) -> KdTree:
        """Cut the fullest box at a median until there are ``boxes``, never narrower than ``least_width``."""
        axis, cut, low, high = [], [], [], []
        heap, tick, leaves = [(-len(sample), 0, sample, None)], itertools.count(1), []
        while heap and len(heap) + len(leaves) < boxes:
            _, _, rows, place = heapq.heappop(heap)
            extent = np.ptp(rows, axis=0) if len(rows) > 1 else np.zeros(sample.shape[1])
            k = int(np.argmax(extent)) if len(rows) > 1 else 0
            c = float(np.median(rows[:, k])) if len(rows) > 1 else 0.0
            if len(rows) < 8 or extent[k] < 2 * least_width:
                leaves.append((0, 0, rows, place))
                continue
            left = rows[:, k] < c
            if not left.any():
                c = float(rows[:, k].min() + least_width)
                left = rows[:, k] < c
            if left.all():
                leaves.append((0, 0, rows, place))
                continue
            i = len(axis)
            axis.append(k), cut.append(c), low.append(0), high.append(0)
            if place:
                (low if place[1] else high)[place[0]] = i
            for side, part in ((True, rows[left]), (False, rows[~left])):
                heapq.heappush(heap, (-len(part), next(tick), part, (i, side)))
        for n, (_, _, _, place) in enumerate(heap + leaves):
            if place:
                (low if place[1] else high)[place[0]] = -1 - n
        return cls(np.array(axis, int), np.array(cut, float), np.array(low, int), np.array(high, int), len(heap) + len(leaves))

    def boxes_of(self, points: np.ndarray, reach: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``box, point indices, whether the box is the point's own``, with every box within ``reach`` of a point."""
        todo = [(0 if len(self.axis) else -1, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            node, at, own = todo.pop()
            if not len(at):
                continue
            if node < 0:
                yield -1 - node, at, own
                continue
            v = points[at, self.axis[node]]
            below = v < self.cut[node]
            left, right = v < self.cut[node] + reach, v >= self.cut[node] - reach
            todo.append((self.low[node], at[left], own[left] & below[left]))
            todo.append((self.high[node], at[right], own[right] & ~below[right]))


def _ranges(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices ``start[i] .. start[i] + count[i]`` for all ``i`` in one array, and the ``i`` of each."""
    owner = np.repeat(np.arange(len(start)), count)
    return np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count), owner


def _pairs(sa: np.ndarray, na: np.ndarray, sb: np.ndarray, nb: np.ndarray, most: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs of the ranges ``a[i] x b[i]`` in chunks of about ``most`` pairs (one ``i`` is never split)."""
    size = na * nb
    end = np.cumsum(size)
    begin = 0
    while begin < len(sa):
        stop = max(begin + 1, int(np.searchsorted(end, (end[begin - 1] if begin else 0) + most, "right")))
        s = slice(begin, stop)
        k, owner = _ranges(np.zeros(stop - begin, int), size[s])
        yield sa[s][owner] + k // nb[s][owner], sb[s][owner] + k % nb[s][owner], owner + begin
        begin = stop


def link_in_memory(points: np.ndarray, reach: float) -> np.ndarray:
    """Index of the first point of each point's group, where points within ``reach`` are linked.

    Distances count as within the reach if they exceed it by no more than the
    coordinates are rounded by.
    """
    n, d = points.shape
    if n < 2:
        return np.arange(n)
    k = int(np.ceil(np.sqrt(d)))
    # a tie is a link, also where the coordinates' own rounding makes it a little longer than the reach
    reach *= 1 + 4 * np.finfo(float).eps * np.abs(points).max() / reach
    side = reach * (1 + 1e-9) / k  # a hair more, so that points just the reach apart are in neighbouring blocks however they round
    leaf = np.floor((points - points.min(axis=0)) / side).astype(np.int64)
    block = leaf // k
    spans = block.max(axis=0) + 3
    stride = np.concatenate([np.cumprod(spans[::-1])[::-1][1:], [1]]).astype(np.int64)
    key = (block + 1) @ stride
    sub = (leaf - block * k) @ (k ** np.arange(d))
    full = key * k**d + sub
    order = np.argsort(full, kind="stable")
    full = full[order]
    first = np.flatnonzero(np.concatenate([[True], full[1:] != full[:-1]]))
    size = np.diff(np.concatenate([first, [n]]))
    pts = points[order]
    lo, hi = np.minimum.reduceat(pts, first, axis=0), np.maximum.reduceat(pts, first, axis=0)
    reach2 = reach * reach
    wide = ((hi - lo) ** 2).sum(axis=1) > reach2
    if wide.any():  # that hair: members of such a leaf aren't linked for certain, so each is a leaf of its own
        first = np.union1d(first, _ranges(first[wide], size[wide])[0])
        size = np.diff(np.concatenate([first, [n]]))
        lo, hi = np.minimum.reduceat(pts, first, axis=0), np.maximum.reduceat(pts, first, axis=0)
    leaves = len(first)
    keys = full[first] // k**d
    bfirst = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    bsize = np.diff(np.concatenate([bfirst, [leaves]]))
    bkeys = keys[bfirst]

    sure, doubt = [], []
    offsets = [o for o in itertools.product((-1, 0, 1), repeat=d) if o > (0,) * d]
    for o in [(0,) * d, *offsets]:
        target = bkeys + int(np.dot(o, stride))
        at = np.minimum(np.searchsorted(bkeys, target), len(bkeys) - 1)
        hit = np.flatnonzero(bkeys[at] == target)
        for a, b, _ in _pairs(bfirst[hit], bsize[hit], bfirst[at[hit]], bsize[at[hit]]):
            if not any(o):
                keep = a < b
                a, b = a[keep], b[keep]
            near = np.zeros(len(a))
            far = np.zeros(len(a))
            for j in range(d):
                p, q = lo[b, j] - hi[a, j], lo[a, j] - hi[b, j]
                near += np.maximum(0.0, np.maximum(p, q)) ** 2
                far += np.minimum(p, q) ** 2  # the greater absolute value: both are negative or of opposite sign
            linked = far <= reach2
            sure.append((a[linked], b[linked]))
            open_ = ~linked & (near <= reach2 * (1 + 1e-12))
            doubt.append((a[open_], b[open_], near[open_]))

    none = (np.zeros(0, int),) * 3
    a, b = (np.concatenate(x) for x in list(zip(*sure, strict=True))[:2])
    lab = components(leaves, a, b)
    a, b, near = (np.concatenate(x) for x in (zip(*doubt, strict=True) if doubt else zip(none, strict=True)))
    closest = np.argsort(near, kind="stable")
    a, b = a[closest], b[closest]
    while len(a):
        open_ = lab[a] != lab[b]
        a, b = a[open_], b[open_]
        if not len(a):
            break
        head = max(1, int(np.searchsorted(np.cumsum(size[a] * size[b]), CHUNK, "right")))
        ha, hb, a, b = a[:head], b[:head], a[head:], b[head:]
        if head == 1 and size[ha[0]] * size[hb[0]] > CHUNK:
            met = np.array([_any_within(pts[first[ha[0]] : first[ha[0]] + size[ha[0]]], pts[first[hb[0]] : first[hb[0]] + size[hb[0]]], reach)])
        else:
            met = np.zeros(head, bool)
            for i, j, owner in _pairs(first[ha], size[ha], first[hb], size[hb], 2 * CHUNK):
                close = ((pts[i] - pts[j]) ** 2).sum(axis=1) <= reach2
                met[owner[close]] = True
        lab = components(leaves, ha[met], hb[met], lab)
    least = np.full(leaves, n)
    by_point = np.repeat(lab, size)
    np.minimum.at(least, by_point, order)
    out = np.empty(n, int)
    out[order] = least[by_point]
    return out


def _any_within(a: np.ndarray, b: np.ndarray, reach: float) -> bool:
    """Whether any point of ``a`` is within ``reach`` of one of ``b``; holds a chunk of pairs at a time."""
    a = a[((a >= b.min(axis=0) - reach) & (a <= b.max(axis=0) + reach)).all(axis=1)]
    if not len(a):
        return False
    b = b[((b >= a.min(axis=0) - reach) & (b <= a.max(axis=0) + reach)).all(axis=1)]
    step = max(1, CHUNK // max(1, len(b)))
    return any((((a[i : i + step, None] - b[None]) ** 2).sum(axis=2) <= reach * reach).any() for i in range(0, len(a), step))


def _assign(tree: KdTree, dims: int, reach: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            points = pdf[[f"c{i}" for i in range(dims)]].to_numpy(float)
            ids = pdf["id"].to_numpy()
            found = list(tree.boxes_of(points, reach))
            if not found:
                continue
            at = np.concatenate([x[1] for x in found])
            own = np.concatenate([x[2] for x in found])
            box = np.repeat([x[0] for x in found], [len(x[1]) for x in found])
            times = np.bincount(at, minlength=len(ids))
            # flag: 1 the box is the point's own, 2 other boxes have it too
            out = {"box": box.astype("int32"), "flag": (own + 2 * (times[at] > 1)).astype("int32"), "id": ids[at]}
            yield pd.DataFrame(out | {f"c{i}": points[at, i] for i in range(dims)})

    return run


def _link(dims: int, reach: float, coords: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        pdf = pd.concat(held, ignore_index=True)
        for _, rows in pdf.groupby("box", sort=False) if pdf["box"].nunique() > 1 else [(0, pdf)]:
            ids, flag = rows["id"].to_numpy(), rows["flag"].to_numpy()
            first = link_in_memory(rows[[f"c{i}" for i in range(dims)]].to_numpy(float), reach)
            least = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(least, first, ids)
            many = np.bincount(first, minlength=len(ids))[first] > 1
            keep = (flag & 1 > 0) | (many & (flag > 1))
            out = {"id": ids[keep], "label": least[first][keep], "flag": flag[keep], "alone": ~many[keep]}
            yield pd.DataFrame(out | {f"c{i}": rows[f"c{i}"].to_numpy()[keep] for i in range(dims if coords else 0)})

    return run


def _one_per_place(plain: DataFrame, crowded: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Rows with one for each crowded place, and ``id, first`` of all rows of those places.

    At most some 2,000 places can hold a 2,000th of the sample each, so their
    list is small whatever the rows; which places are on it changes the load
    of the tasks, not the result.
    """
    spark, coords = plain.sparkSession, [c for c in plain.columns if c != "id"]
    listed = F.broadcast(spark.createDataFrame([tuple(map(float, p)) for p in crowded], ", ".join(f"{c} double" for c in coords)).withColumn("place", F.monotonically_increasing_id()))
    inside = plain.join(listed, coords)
    first = inside.groupBy("place").agg(F.min("id").alias("first"))
    hot = inside.join(F.broadcast(first), "place")
    ones = materialize(hot.where("id = first").groupBy(*coords).agg(F.min("id").alias("id")), "places")
    return plain.join(listed, coords, "left_anti").unionByName(ones.select("id", *coords)), hot.select("id", "first")


def boxes_for(rows: int, parallel: int, box_rows: int = BOX_ROWS) -> int:
    return max(1, min(-(-rows // 2_000), max(-(-rows // box_rows), 2 * parallel)))


def linked_groups(df: DataFrame, id_col: str, coords: list[str], reach: float, keep_single: bool = False, keep_coords: bool = False) -> DataFrame:
    """``id, group``: each point's group is the least id that it hangs together with.

    Two points are linked if their Euclidean distance over ``coords`` is at
    most ``reach``; a group is everything linked directly or through others.
    Points of a group of one are left out unless ``keep_single``.  Rows with
    a NULL or NaN id or coordinate take no part.  Repeated positions are
    linked like any others, and places that hold many of the rows are worked
    off by one row each; repeated ids count as one point at each place.
    ``keep_coords`` adds the coordinates as ``c0, c1, ...``.

    The coordinates are worked out once, into a table that is then counted,
    sampled and placed.
    """
    dims = len(coords)
    names = [f"c{i}" for i in range(dims)]
    plain = df.select(F.col(id_col).cast("long").alias("id"), *(F.col(c).cast("double").alias(n) for n, c in zip(names, coords, strict=True)))
    sound = F.col("id").isNotNull()
    for n in names:
        sound = sound & F.col(n).isNotNull() & ~F.isnan(n)
    plain = materialize(plain, "points").where(sound)
    spark = df.sparkSession
    rows = plain.count()
    boxes = boxes_for(rows, spark.sparkContext.defaultParallelism)
    hot = None
    if boxes > 1:
        share = min(1.0, SAMPLE_ROWS / rows)
        chance = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1
        sample = plain.where(chance).drop("id").toArrow().to_pandas().to_numpy(float)
        places, seen = np.unique(sample, axis=0, return_counts=True)
        crowded = places[seen >= max(HOT_SEEN, len(sample) // 2_000)]
        if len(crowded):
            plain, hot = _one_per_place(plain, crowded)
            sample = places
        tree = KdTree.fit(sample, boxes, 2 * reach)
    else:
        tree = KdTree.fit(np.zeros((0, dims)), 1, reach)
    kept = names if keep_coords else []
    doubles = "".join(f", {n} double" for n in names)
    # a hair more than the reach, so that rounding at a cut loses no link
    placed = plain.mapInPandas(_assign(tree, dims, reach * (1 + 1e-9)), "box int, flag int, id long" + doubles).repartitionById(tree.boxes, "box")
    local = materialize(placed.mapInPandas(_link(dims, reach, keep_coords), "id long, label long, flag int, alone boolean" + doubles * keep_coords), "linked")
    seen = local.where("flag > 1 AND NOT alone").select("id", "label")
    edges = seen.groupBy("id").agg(F.min("label").alias("b"), F.collect_set("label").alias("labels")).select(F.explode("labels").alias("a"), "b")
    roots = component_roots(edges)
    own = local.where("flag IN (1, 3)" + ("" if keep_single or hot is not None else " AND NOT alone"))
    out = own.join(roots, own["label"] == roots["node"], "left").select("id", F.coalesce("root", "label").alias("group"), "alone", *kept)
    if hot is None:
        return out.drop("alone")
    # rows of a crowded place are in the group of the one that stood for it; it is never alone
    stood = hot.select("first").distinct()
    for_all = out.join(F.broadcast(stood), out["id"] == stood["first"]).select("first", "group", *kept)  # as many rows as crowded places
    rest = out.join(F.broadcast(stood), out["id"] == stood["first"], "left_anti")
    if not keep_single:
        rest = rest.where("NOT alone")
    return rest.select("id", "group", *kept).unionByName(hot.join(F.broadcast(for_all), "first").select("id", "group", *kept))
