"""Cluster features, Ward's method and percentiles."""

from __future__ import annotations

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberline.llm.cf_cluster import MixedTree, chained_clusters, nearest, ward, ward_assignment, ward_clusters
from emberline.llm.percentiles import cumulative, merge_counts, percentiles, pick, value_counts


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_trees_merge_in_any_order(seed):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(rng.uniform(-9, 9), 1, (rng.integers(0, 200), 2)) for _ in range(4)]
    whole = np.concatenate(parts)
    for order in ((0, 1, 2, 3), (3, 1, 0, 2)):
        total = MixedTree(2, 50)
        for k in order:
            t = MixedTree(2, 50)
            t.add_points(parts[k])
            if len(t.keys):
                total.add_leaves(t.levels, t.keys, t.cf)
        assert len(total.keys) <= 50
        assert np.allclose(total.cf.sum(axis=0), [len(whole), *whole.sum(axis=0), *(whole**2).sum(axis=0)])


def test_ward_equals_plain_agglomeration():
    rng = np.random.default_rng(1)
    p = rng.normal(0, 1, (60, 2))
    cf = np.column_stack([np.ones(60), p, p**2])
    groups = [[i] for i in range(60)]
    while len(groups) > 6:
        def cost(a, b):
            ca, cb = p[a].mean(axis=0), p[b].mean(axis=0)
            return len(a) * len(b) / (len(a) + len(b)) * ((ca - cb) ** 2).sum()
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda x: cost(groups[x[0]], groups[x[1]]))
        groups[j] += groups[i]
        del groups[i]
    got = ward(cf, 2, 6)
    assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(got == k).tolist()) for k in range(6)}


def test_ward_clusters_of_separate_clouds(spark):
    rng = np.random.default_rng(2)
    centres = np.array([[0, 0], [10, 0], [0, 10], [10, 10.0]])
    k = rng.integers(0, 4, 2000)
    p = centres[k] + rng.normal(0, 0.4, (2000, 2))
    rows = [(i, float(a), float(b), "x") for i, (a, b) in enumerate(p)] + [(None, 1.0, 1.0, "x"), (-1, None, 1.0, "x"), (-2, float("nan"), 0.0, "x"), (-3, float("inf"), 0.0, "x")]
    df = spark.createDataFrame(rows, "key long, a double, b double, cluster string").repartition(9)
    got = {r["id"]: r["cluster"] for r in ward_assignment(df, "key", ["a", "b"], 4).collect()}
    assert len(got) == 2000 and len({(got[i], k[i]) for i in range(2000)}) == 4
    out = ward_clusters(df, "key", ["a", "b"], 4, typical=3).collect()
    assert sorted(r["size"] for r in out) == sorted(np.bincount(k).tolist())
    for r in out:
        mine = np.array([i for i in range(2000) if got[i] == r["cluster"]])
        order = mine[np.argsort(((p[mine] - p[mine].mean(axis=0)) ** 2).sum(axis=1))][:3]
        assert r["typical"] == order.tolist()
    assert ward_clusters(df.limit(0), "key", ["a", "b"], 4).collect() == []
    same = ward_clusters(df.select("key", F.lit(1.0).alias("a"), F.lit(2.0).alias("b")), "key", ["a", "b"], 4).collect()
    assert len(same) == 1 and same[0]["rms_radius"] == 0


def test_nearest_and_chains(spark):
    at, d2 = nearest(np.array([[0.0], [4.0]]), np.array([[1.0], [5.0]]))
    assert at.tolist() == [0, 1] and d2.tolist() == [1.0, 1.0]
    df = spark.createDataFrame([(i, float(x), "q") for i, x in enumerate([0, 1, 2, 9, 9, 30])], "id long, x double, cluster string")
    assert {tuple(r) for r in chained_clusters(df, "id", ["x"], 1.0).collect()} == {(0, 0), (0, 1), (0, 2), (3, 3), (3, 4)}


def least_reaching(vs, p):
    vs = sorted(vs)
    return next(v for i, v in enumerate(vs, 1) if i * 100 >= p * len(vs))


def test_percentiles(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(v), "z") for v in np.round(rng.gamma(2, 5, 3000), 1)] + [(g, float(v), "z") for g in ("b", None) for v in rng.integers(-4, 4, 37)] + [("one", 5.0, "z"), ("none", None, "z"), ("none", float("nan"), "z"), ("b", float("inf"), "z"), ("b", -0.0, "z")]
    df = spark.createDataFrame(rows, "g string, v double, n string").selectExpr("*", "n AS part", "n AS upto").repartition(5)
    by = {}
    for g, v, _ in rows:
        if v is not None and math.isfinite(v):
            by.setdefault(g, []).append(v + 0.0)
    ps = [0, 1, 50, 90, 99, 100]
    got = {(r["g"], r["pct"]): (r["value"], r["total"]) for r in percentiles(df, ["g"], "v", ps).collect()}
    assert got == {(g, float(p)): (least_reaching(vs, p), len(vs)) for g, vs in by.items() for p in ps}
    # pieces counted apart add up to the whole
    pieces = [value_counts(df.where(F.col("v") < 3), ["g"], "v"), value_counts(df.where(F.col("v") >= 3), ["g"], "v")]
    again = {(r["g"], r["pct"]): (r["value"], r["total"]) for r in pick(cumulative(merge_counts(*pieces), ["g"]), ["g"], ps).collect()}
    assert again == got
    near = {(r["g"], r["pct"]): r["value"] for r in percentiles(df, ["g"], "v", ps, relative_error=0.01).collect()}
    assert all(abs(near[k] - v) <= 0.01 * abs(v) + 1e-12 for k, (v, _) in got.items())
    assert percentiles(df.limit(0), ["g"], "v", ps).collect() == []


def test_hot_place_is_divided(spark):
    rng = np.random.default_rng(4)
    hot = np.array([[30.0, 40.0], [50.0, 40.0]])  # in one cube of side 64, which 256 leaves of one level can't divide
    p = np.concatenate([rng.uniform(0, 1000, (3000, 2)), hot[np.repeat([0, 1], 1500)] + rng.normal(0, 0.5, (3000, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "id long, a double, b double").repartition(5)
    got = {r["id"]: r["cluster"] for r in ward_assignment(df, "id", ["a", "b"], 60, most_leaves=256).collect()}
    one, two = ({got[i] for i in range(lo, lo + 1500)} for lo in (3000, 4500))
    assert not one & two
    tree = MixedTree(2, 256)
    for k in range(0, 6000, 1000):
        tree.add_points(p[k : k + 1000])
    assert len(tree.keys) <= 256 and np.ptp(tree.levels) >= 3
    assert np.allclose(tree.cf.sum(axis=0), [6000, *p.sum(axis=0), *(p**2).sum(axis=0)])
