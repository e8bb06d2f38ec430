"""Grouping records into clusters of similar ones, by cluster features.

A cluster feature (CF) is ``n``, the sum and the sum of squares of a set of
rows; two of them add up to the CF of both sets.  The CF tree here is a dyadic
one: a node of level ``l`` is a cube of side ``2^l``, its parent the cube of
side ``2^(l+1)`` around it.  So trees of different partitions have the same
nodes and merge exactly by adding CFs of equal keys.  Each leaf has a level of
its own: where there are too many leaves, only the lightest (rows x side^2,
what a leaf can add to the variance) go up to their parents, so a hot place
stays finely divided however many rows lie elsewhere.

Two ways to agglomerate the leaves:

``ward_clusters``
    partial mixed trees per partition, merged by a tree of reductions into at
    most ``most_leaves`` leaves; Ward's method over the leaves; one pass that
    assigns every row to its nearest centroid and keeps the members nearest to
    each centroid.
``chained_clusters``
    leaves so small that their members are all linked; leaves are chained
    where any two of their members are within reach.  Ward's method can't
    answer "linked directly or through others", this can, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.keyed import join_per_key
from ..operators.linking import linked_groups
from ..plans.materialize import materialize

#: Leaves that Ward's method sees (well above clusters x 2^dims: 200 x 16), and how many times as many the trees before hold.
MOST_LEAVES = 8_192
FINER = 4
#: Points gathered before they are worked into a tree.
HELD = 100_000
REDUCE_BY = 8
FINEST, COARSEST = -60, 1_100


class MixedTree:
    """Leaves of a dyadic CF tree, each with its own level."""

    def __init__(self, dims: int, most: int):
        self.dims, self.most = dims, most
        self.levels, self.keys, self.cf = np.zeros(0, np.int64), np.zeros((0, dims), np.int64), np.zeros((0, 2 * dims + 1))

    def _add_up(self) -> None:
        at = pd.DataFrame(np.column_stack([self.levels, self.keys])).groupby(list(range(self.dims + 1)), sort=True).ngroup().to_numpy()
        first = np.unique(at, return_index=True)[1]
        self.levels, self.keys = self.levels[first], self.keys[first]
        self.cf = np.stack([np.bincount(at, self.cf[:, j], len(first)) for j in range(self.cf.shape[1])], axis=1)

    def _fit(self) -> None:
        self._add_up()
        # the lightest go up to their parents; one that is its own parent's only child just gets a coarser key
        while (over := len(self.keys) - self.most) > 0 and self.levels.min() < COARSEST:
            load = np.where(self.levels < COARSEST, np.log2(self.cf[:, 0]) + 2.0 * self.levels, np.inf)
            # few at a time, never more than the lightest half; ties go along, so it doesn't depend on the order of leaves
            k = min(max(over, len(load) // 16), len(load) // 2)
            up = (load <= np.partition(load, k)[k]) & (load < np.inf)
            self.levels, self.keys = self.levels + up, np.where(up[:, None], self.keys >> 1, self.keys)
            self._add_up()

    def add_points(self, points: np.ndarray) -> None:
        if not len(points):
            return
        # no key beyond an int64, and 20 levels below the extent of these points
        level = max(FINEST, int(np.ceil(np.log2(max(np.abs(points).max(), 1e-300)))) - 40)
        if (wide := np.ptp(points, axis=0).max()) > 0:
            level = max(level, int(np.floor(np.log2(wide))) - 20)
        keys = np.floor(points / 2.0**level).astype(np.int64)
        self.add_leaves(np.full(len(points), level), keys, np.column_stack([np.ones(len(points)), points, points**2]))

    def add_leaves(self, levels: np.ndarray, keys: np.ndarray, cf: np.ndarray) -> None:
        self.levels, self.keys, self.cf = np.concatenate([self.levels, levels]), np.concatenate([self.keys, keys]), np.concatenate([self.cf, cf])
        self._fit()

    def frame(self, group: int) -> pd.DataFrame:
        out = {"grp": np.full(len(self.keys), group, "int64"), "level": self.levels.astype("int32")}
        out |= {f"k{j}": self.keys[:, j] for j in range(self.dims)}
        return pd.DataFrame(out | {f"f{j}": self.cf[:, j] for j in range(self.cf.shape[1])})


def _schema(dims: int) -> str:
    return "grp long, level int, " + ", ".join(f"k{j} long" for j in range(dims)) + ", " + ", ".join(f"f{j} double" for j in range(2 * dims + 1))


def _grow(dims: int, most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        tree, held, rows = MixedTree(dims, most), [], 0
        for b in batches:
            held.append(b[[f"c{j}" for j in range(dims)]].to_numpy(float))
            if (rows := rows + len(b)) >= HELD:
                tree.add_points(np.concatenate(held))
                held, rows = [], 0
        if held:
            tree.add_points(np.concatenate(held))
        if len(tree.keys):
            yield tree.frame(TaskContext.get().partitionId())

    return run


def _fold(dims: int, most: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = MixedTree(dims, most)
        tree.add_leaves(*(rows[c].to_numpy(t) for c, t in (("level", np.int64), ([f"k{j}" for j in range(dims)], np.int64), ([f"f{j}" for j in range(2 * dims + 1)], float))))
        return tree.frame(int(key[0]))

    return run


def ward(cf: np.ndarray, dims: int, clusters: int) -> np.ndarray:
    """Ward's method over CFs: cluster index of each leaf.  Chains of nearest neighbours, O(leaves^2)."""
    n = len(cf)
    weight, centre = cf[:, 0].copy(), np.ascontiguousarray((cf[:, 1 : dims + 1] / cf[:, :1]).T)
    leaf, live, merges, chain = np.arange(n), n, [], []
    for _ in range(n - 1):
        if 2 * live < len(leaf):  # what has been merged into others is left out from time to time
            keep = np.isfinite(centre[0])
            chain = [int(x) for x in (np.cumsum(keep) - 1)[chain]]
            weight, centre, leaf = weight[keep], np.ascontiguousarray(centre[:, keep]), leaf[keep]
        while True:
            if not chain:
                chain = [int(np.argmax(np.isfinite(centre[0])))]
            i = chain[-1]
            off = centre - centre[:, i : i + 1]
            cost = weight * weight[i] / (weight + weight[i]) * np.einsum("dn,dn->n", off, off)
            cost[i] = np.inf
            j = int(np.argmin(cost))
            if len(chain) > 1 and cost[chain[-2]] <= cost[j]:
                j = chain[-2]
                break
            chain.append(j)
        merges.append((float(cost[j]), int(leaf[i]), int(leaf[j])))
        chain = chain[:-2]
        a, b = min(i, j), max(i, j)
        centre[:, a] = (centre[:, a] * weight[a] + centre[:, b] * weight[b]) / (weight[a] + weight[b])
        weight[a] += weight[b]
        centre[:, b] = np.inf  # infinitely far from all
        live -= 1
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    # Ward's costs never fall along a merge tree, so the cheapest n - clusters merges are a cut of it
    for _, i, j in sorted(merges, key=lambda m: m[0])[: max(0, n - clusters)]:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    return np.unique([root(i) for i in range(n)], return_inverse=True)[1]


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest centre, in blocks."""
    at, d2 = np.zeros(len(points), int), np.zeros(len(points))
    own = (centres**2).sum(axis=1)
    step = max(1, 4_000_000 // max(1, len(centres)))
    for b in range(0, len(points), step):
        p = points[b : b + step]
        at[b : b + step] = np.argmin(own - 2 * p @ centres.T, axis=1)
        d2[b : b + step] = ((p - centres[at[b : b + step]]) ** 2).sum(axis=1)
    return at, d2


def fit_centres(df: DataFrame, features: Sequence[str], clusters: int, most_leaves: int = MOST_LEAVES) -> np.ndarray:
    """Centroids of at most ``clusters`` clusters; at most ``most_leaves`` leaves reach the driver."""
    dims = len(features)
    leaves = df.select(*(F.col(c).alias(f"c{j}") for j, c in enumerate(features))).mapInPandas(_grow(dims, FINER * most_leaves), _schema(dims))
    trees = max(1, df.rdd.getNumPartitions())
    while True:
        trees = -(-trees // REDUCE_BY)
        leaves = leaves.groupBy(F.floor(F.col("grp") / REDUCE_BY).alias("grp")).applyInPandas(_fold(dims, most_leaves * (FINER if trees > 1 else 1)), _schema(dims))
        if trees == 1:
            break
    found = leaves.orderBy("level", *(f"k{j}" for j in range(dims))).toArrow().to_pandas()
    if not len(found):
        return np.zeros((0, dims))
    cf = found[[f"f{j}" for j in range(2 * dims + 1)]].to_numpy(float)
    group = ward(cf, dims, clusters)
    total = np.stack([np.bincount(group, cf[:, j]) for j in range(dims + 1)], axis=1)
    return total[:, 1:] / total[:, :1]


def _assign(centres: np.ndarray):
    dims = centres.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, d2 = nearest(b[[f"c{j}" for j in range(dims)]].to_numpy(float), centres)
            yield pd.DataFrame({"id": b["id"], "cluster": at.astype("int32"), "distance": np.sqrt(d2)})

    return run


def _summary(centres: np.ndarray, typical: int):
    """Sizes and nearest members per cluster of one partition: at most clusters x typical rows leave it."""
    dims = centres.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, total, best = np.zeros(len(centres), "int64"), np.zeros(len(centres)), None
        for b in batches:
            at, d2 = nearest(b[[f"c{j}" for j in range(dims)]].to_numpy(float), centres)
            size += np.bincount(at, minlength=len(centres))
            total += np.bincount(at, d2, len(centres))
            rows = pd.DataFrame({"cluster": at, "distance": np.sqrt(d2), "id": b["id"]})
            best = (rows if best is None else pd.concat([best, rows])).sort_values(["cluster", "distance", "id"]).groupby("cluster").head(typical)
        if best is not None:
            first = ~best["cluster"].duplicated()
            yield best.assign(n=np.where(first, size[best["cluster"]], 0), ss=np.where(first, total[best["cluster"]], 0.0)).astype({"cluster": "int32"})

    return run


def _sound(df: DataFrame, id_col: str, features: Sequence[str]) -> DataFrame:
    out = df.select(F.col(id_col).cast("long").alias("id"), *(F.col(c).cast("double").alias(f"c{j}") for j, c in enumerate(features)))
    ok = F.col("id").isNotNull()
    for j in range(len(features)):
        ok = ok & (F.abs(f"c{j}") < F.lit(float("inf"))) & ~F.isnan(f"c{j}")
    return out.where(F.coalesce(ok, F.lit(False)))


def ward_assignment(df: DataFrame, id_col: str, features: Sequence[str], clusters: int, most_leaves: int = MOST_LEAVES) -> DataFrame:
    """``id, cluster, distance`` of every row; rows with a NULL, NaN or infinite feature or id take no part."""
    rows = materialize(_sound(df, id_col, features), "points")  # worked out once, read for the trees and for the pass
    cols = [f"c{j}" for j in range(len(features))]
    centres = fit_centres(rows, cols, clusters, most_leaves)
    return rows.mapInPandas(_assign(centres), "id long, cluster int, distance double") if len(centres) else rows.select("id", F.lit(0).alias("cluster"), F.lit(0.0).alias("distance"))


def ward_clusters(df: DataFrame, id_col: str, features: Sequence[str], clusters: int, typical: int = 5, most_leaves: int = MOST_LEAVES) -> DataFrame:
    """``cluster, size, rms_radius, typical`` (ids, nearest to the centroid first) of each cluster.

    Every row is assigned to its nearest centroid in one pass; only sizes and
    the nearest members of each partition are shuffled.  Rows with a NULL, NaN
    or infinite feature or id take no part; repeated rows count each; ties go
    to the lesser cluster and id; an empty table gives no cluster.
    """
    rows = materialize(_sound(df, id_col, features), "points")  # worked out once, read for the trees and for the pass
    cols = [f"c{j}" for j in range(len(features))]
    centres = fit_centres(rows, cols, clusters, most_leaves)
    if not len(centres):
        return rows.sparkSession.createDataFrame([], "cluster int, size long, rms_radius double, typical array<long>")
    parts = rows.mapInPandas(_summary(centres, typical), "cluster int, distance double, id long, n long, ss double")
    ordered = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("distance", "id"))), 1, typical), lambda m: m["id"])
    return parts.groupBy("cluster").agg(F.sum("n").alias("size"), F.sqrt(F.sum("ss") / F.sum("n")).alias("rms_radius"), ordered.alias("typical"))


def _members(df: DataFrame, id_col: str, features: Sequence[str], reach: float) -> DataFrame:
    """``id, group, c0, ...`` of every row that hangs together with another."""
    return linked_groups(_sound(df, id_col, features), "id", [f"c{j}" for j in range(len(features))], reach, keep_coords=True)


def chained_clusters(df: DataFrame, id_col: str, features: Sequence[str], reach: float) -> DataFrame:
    """``cluster, id`` of every row that hangs together with another: exact, by chaining CF leaves within reach.

    The cluster is the least id in it.  Rows on their own are left out, so are
    rows with a NULL, NaN or infinite feature or id.
    """
    return linked_groups(_sound(df, id_col, features), "id", [f"c{j}" for j in range(len(features))], reach).select(F.col("group").alias("cluster"), "id")


def chained_summary(df: DataFrame, id_col: str, features: Sequence[str], reach: float, typical: int = 3, digits: int = 6) -> DataFrame:
    """``cluster, size, rms_radius, typical`` of the same clusters: ids nearest to the centroid first, ties by id.

    The CFs of a cluster (rows, sums, sums of squares) are added up per task
    and then over the tasks; the centroids go to the members in one pass, hot
    clusters aside, and each task passes on its nearest ones only.  Distances
    are compared in units of the reach, to ``digits`` decimals.
    """
    dims = range(len(features))
    rows = materialize(_members(df, id_col, features, reach), "members")
    cf = rows.groupBy("group").agg(F.count("*").alias("n"), *(F.avg(f"c{j}").alias(f"m{j}") for j in dims), *(F.var_pop(f"c{j}").alias(f"s{j}") for j in dims))
    spread = sum((F.col(f"s{j}") for j in dims), F.lit(0.0))
    cf = cf.select("group", F.col("n").alias("size"), F.sqrt(spread).alias("rms_radius"), *(f"m{j}" for j in dims))
    far = sum(((F.col(f"c{j}") - F.col(f"m{j}")) ** 2 for j in dims), F.lit(0.0))
    near = join_per_key(rows, cf, "group", "size", [c for c in cf.columns if c != "group"], inner=True)
    near = near.select("group", "size", "rms_radius", F.round(F.sqrt(far) / reach, digits).alias("off"), "id")
    # the rank is limited in each map task, before the shuffle: no cluster is gathered in one task
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy("off", "id"))).where(F.col("rank") <= typical)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda m: m["id"])
    return best.groupBy(F.col("group").alias("cluster"), "size", "rms_radius").agg(ordered.alias("typical"))
