"""Linking within a distance, components, and the search tree, against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emberline.operators.components import component_roots, components
from emberline.operators.linking import KdTree, link_in_memory, linked_groups


def brute(p: np.ndarray, reach: float) -> np.ndarray:
    near = ((p[:, None] - p[None]) ** 2).sum(axis=2) <= reach * reach * (1 + 1e-12)  # ties however they round
    lab = np.arange(len(p))
    while True:
        new = np.array([lab[row].min() for row in near]) if len(p) else lab
        if (new == lab).all():
            return lab
        lab = new


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([1, 2, 3, 4]), st.sampled_from([0.5, 3.0, 9.0]))
def test_link_in_memory(seed, dims, size):
    rng = np.random.default_rng(seed)
    p = np.round(rng.uniform(0, size, (rng.integers(0, 120), dims)), rng.integers(0, 4))
    assert (link_in_memory(p, 1.0) == brute(p, 1.0)).all()


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_components(seed):
    rng = np.random.default_rng(seed)
    n, m = 40, rng.integers(0, 60)
    a, b = rng.integers(0, n, m), rng.integers(0, n, m)
    lab = np.arange(n)
    for _ in range(n):
        for x, y in zip(a, b, strict=True):
            lab[x] = lab[y] = min(lab[x], lab[y])
    assert (components(n, a, b) == lab).all()


def test_tree_covers_neighbours():
    rng = np.random.default_rng(5)
    p = rng.normal(0, 1, (3000, 3))
    tree = KdTree.fit(p[:500], 16, 0.1)
    owned = np.zeros(len(p), int)
    boxes = [set() for _ in p]
    own_box = np.full(len(p), -1)
    for box, at, own in tree.boxes_of(p, 0.1):
        owned[at] += own
        own_box[at[own]] = box
        for i in at:
            boxes[i].add(box)
    assert (owned == 1).all()
    near = ((p[:, None] - p[None]) ** 2).sum(axis=2) <= 0.01
    assert all(own_box[i] in boxes[j] for i, j in np.argwhere(near))


@pytest.mark.parametrize("n", [0, 1, 400, 6000])
def test_linked_groups(spark, n):
    rng = np.random.default_rng(n)
    p = np.column_stack([rng.uniform(0, max(2.0, n**0.5 / 2), n), rng.uniform(0, 6, n), rng.integers(0, 3, n)])
    p[: n // 10] = p[n // 10 : 2 * (n // 10)]  # repeated places
    rows = [(int(i) * 3 + 7, *map(float, x), "x") for i, x in enumerate(p)]
    rows += [(None, 1.0, 1.0, 1.0, "x"), (-5, None, 1.0, 1.0, "x"), (-6, float("nan"), 1.0, 1.0, None)]
    # extra columns carry the names that the operator uses inside
    df = spark.createDataFrame(rows, "key long, a double, b double, c double, box string").selectExpr("*", "box AS id", "box AS label", "box AS flag")
    got = {r["id"]: r["group"] for r in linked_groups(df, "key", ["a", "b", "c"], 0.5, keep_single=True).collect()}
    want = brute(p, 0.5) if n else np.zeros(0, int)
    assert got == {int(i) * 3 + 7: int(w) * 3 + 7 for i, w in enumerate(want)}
    several = {r["id"] for r in linked_groups(df, "key", ["a", "b", "c"], 0.5).collect()}
    size = np.bincount(want, minlength=max(1, n))
    assert several == {int(i) * 3 + 7 for i, w in enumerate(want) if size[w] > 1}


def test_star_rounds_equal_one_task(spark):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(None, 3), (4, None)]
    df = spark.createDataFrame(edges, "a long, b long")
    one = {tuple(r) for r in component_roots(df).collect()}
    assert one == {tuple(r) for r in component_roots(df, one_task=0).collect()}
    assert (1060, 1000) in one


def test_crowded_places(spark):
    """A third of all rows at one place, more at another on its own: one row stands for all, the result is whole."""
    rng = np.random.default_rng(11)
    p = np.concatenate([rng.uniform(0, 40, (4000, 2)), np.full((2500, 2), 3.0), np.full((900, 2), 99.0), np.full((60, 2), 3.4)])
    rows = [(int(i), float(a), float(b)) for i, (a, b) in zip(rng.permutation(len(p)), p, strict=True)]
    df = spark.createDataFrame(rows, "id long, a double, b double").repartition(6)
    order = np.argsort([r[0] for r in rows])
    want = brute(p[order], 0.3)
    for keep in (True, False):
        got = linked_groups(df, "id", ["a", "b"], 0.3, keep_single=keep).collect()
        size = np.bincount(want, minlength=len(p))
        assert sorted((r["id"], r["group"]) for r in got) == [(i, int(w)) for i, w in enumerate(want) if keep or size[w] > 1]


def test_dbscan_of_detections_links_different_places(spark, sf_dir):
    from emberline.functions.geo import position_degrees
    from emberline.queries import spatial
    from emberline.queries.tables import table

    lon, lat = position_degrees()
    d = table(spark, sf_dir, "firedata").select("row_id", lon.alias("lon"), lat.alias("lat")).where("lon IS NOT NULL").toPandas().sort_values("row_id")
    ids, a, b = d["row_id"].to_numpy(), np.radians(d["lon"].to_numpy()), np.radians(d["lat"].to_numpy())
    h = np.sin((b[:, None] - b) / 2) ** 2 + np.cos(b[:, None]) * np.cos(b) * np.sin((a[:, None] - a) / 2) ** 2
    near = 2 * 6371.0 * np.arcsin(np.sqrt(h)) <= 0.8
    lab = np.arange(len(d))
    while (new := np.array([lab[row].min() for row in near])).tolist() != lab.tolist():
        lab = new
    want = {(int(i), int(ids[k]) if row.sum() > 1 else -1) for i, k, row in zip(ids, lab, near, strict=True)}
    assert {tuple(r) for r in spatial.QUERIES["dbscan_detections"](spark, sf_dir).collect()} == want
    # places that differ are linked
    assert (near & (h > 1e-15)).any()


def test_points_just_the_reach_apart():
    """A day is an eighth of the reach: eight days at one place are a tie, however the multiples round."""
    for reach in (2770 / 6371007.181, 0.1, 1 / 3):
        for start in (0, 1, 777, 6100):
            days = np.array([start, start + 8, start + 16, start + 25]) * (reach / 8)
            p = np.column_stack([np.full(4, 0.3), np.full(4, -0.9), np.full(4, 0.31), days])
            assert link_in_memory(p, reach).tolist() == [0, 0, 0, 3]
