"""Scores against their definitions, sampling, and the fitted models."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import models as M
from emberline.operators import scores as S


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), int(y), float(p)) for g, y, p in zip(rng.integers(0, 3, 300), rng.integers(0, 2, 300), np.round(rng.uniform(0, 1, 300), 2), strict=True)]
    rows += [(0, None, 0.5), (1, 1, None), (5, 1, 0.3), (5, 1, 0.9)]
    return rows, spark.createDataFrame(rows, "g int, y int, p double")


def test_scores(scored):
    rows, df = scored
    got = {r["g"]: r for r in S.scores(df, ["g"], "y", "p").collect()}
    for g in (0, 1, 2):
        d = [(y, p) for k, y, p in rows if k == g and y is not None and p is not None]
        pos, neg = [p for y, p in d if y], [p for y, p in d if not y]
        auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
        assert abs(got[g]["auc"] - auc) < 1e-9 and got[g]["n"] == len(d)
        assert abs(got[g]["recall"] - sum(p > 0.5 for p in pos) / len(pos)) < 1e-9
        assert abs(got[g]["brier"] - np.mean([(p - y) ** 2 for y, p in d])) < 1e-9
    assert got[5]["auc"] is None and got[5]["avg_precision"] == 1.0
    grid = {(r["g"], r["k"]): r["tpr"] for r in S.roc_on_grid(df.where("g < 3"), ["g"], "y", "p", 11).collect()}
    assert len(grid) == 33 and all(grid[g, 10] == 1.0 and all(grid[g, k] <= grid[g, k + 1] + 1e-12 for k in range(10)) for g in range(3))


def test_samples(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    b = S.balance(df, "y", ["id"], 5)
    assert {r["y"]: r["count"] for r in b.groupBy("y").count().collect()} == {0: 100, 1: 100} and b.columns == ["y", "id"] or set(b.columns) == {"y", "id"}
    assert {r["id"] for r in b.collect()} == {r["id"] for r in S.balance(df.repartition(7), "y", ["id"], 5).collect()}
    s = S.systematic_sample(df, "y", "id", 4)
    neg = [i for i in range(1000) if i % 10]
    assert {r["id"] for r in s.collect()} == set(neg[::4]) | {i for i in range(1000) if i % 10 == 0}
    assert S.systematic_sample(df.limit(0), "y", "id", 4).collect() == []


def test_two_segments(spark):
    x = np.arange(60.0)
    y = np.where(x < 30, x, 30 + 3 * (x - 30))
    b, s1, s2, r2 = M.two_segments(x, y)
    assert abs(b - 30) < 2 and abs(s1 - 1) < 0.1 and abs(s2 - 3) < 0.1 and r2 > 0.99
    df = spark.createDataFrame([("a", float(i), float(v)) for i, v in zip(x, y, strict=True)] + [("b", 1.0, 2.0), ("b", None, 3.0)], "k string, x double, y double")
    out = {r["k"]: r for r in M.piecewise_linear(df, ["k"], "x", "y").collect()}
    assert out["b"]["r2"] is None and abs(out["a"]["slope_after"] - 3) < 0.1


def test_draws_and_folds(spark):
    df = spark.range(500).select("id", F.when(F.col("id") < 490, (F.col("id") % 7 == 0).cast("int")).alias("y"))
    once, again = S.draw(df, 100, ["id"], 1), S.draw(df, 700, ["id"], 1, replace=True)
    assert once.distinct().count() == once.count() == 100 and S.draw(df, 9_999, ["id"]).count() == 500
    assert again.count() == 700 and again.distinct().count() < 500 and S.draw(df.limit(0), 10, ["id"], replace=True).count() == 0
    sizes = {(r["fold"], r["y"]): r["count"] for r in S.stratified_folds(df, "y", ["id"], 4).groupBy("fold", "y").count().collect()}
    assert len(sizes) == 8 and all(max(v) - min(v) <= 1 for v in ([n for (_, y), n in sizes.items() if y == k] for k in (0, 1)))
    assert {r["y"]: r["count"] for r in S.balance(df, "y", ["id"], 5, most=20).groupBy("y").count().collect()} == {0: 20, 1: 20}


def test_rows_without_a_feature_stay(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 2, float(v), 1.0, int(v > 0)) for i, v in enumerate(rng.normal(0, 1, 200))] + [(900, 0, None, 1.0, 1), (901, 1, float("nan"), 1.0, 0), (902, None, 0.5, 1.0, 1), (903, 0, 0.1, 1.0, None)]
    df = spark.createDataFrame(rows, "id int, year int, a double, same double, label int")
    out = {r["id"]: r["prob"] for r in M.leave_one_out(df, ["a", "same"], "label", "year").collect()}
    assert len(out) == 204 and all(out[i] is None for i in (900, 901, 902)) and out[903] is not None
    one = M.fit_predict(df.where("label = 1"), df, ["a"], "label", ["id"])
    assert one.count() == 204 and one.where("prob IS NOT NULL").count() == 0
    f = {r["fold"]: r for r in M.fold_scores(df.where("id < 200"), ["a"], "label", ["id"], 2).collect()}
    assert set(f) == {0, 1} and all(r["accuracy"] > 0.8 and r["kappa"] > 0.6 and r["auc"] > 0.9 for r in f.values())


@pytest.mark.parametrize("kind", M.MODELS)
def test_models_learn(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (400, 2))
    df = spark.createDataFrame([(i, 2001 + i % 2, float(a), float(b), int(a + 0.3 * b > 0)) for i, (a, b) in enumerate(x)], "id int, year int, a double, b double, label int")
    p = M.leave_one_out(df, ["a", "b"], "label", "year", kind)
    got = S.scores(p, [], "label", "prob").first()
    assert got["n"] == 400 and got["auc"] > 0.9


def test_two_segments_finds_the_best_break():
    def error(x, y, b):
        a = np.column_stack([np.ones_like(x), x, np.maximum(0.0, x - b)])
        return ((y - a @ np.linalg.lstsq(a, y, rcond=None)[0]) ** 2).sum()

    rng = np.random.default_rng(5)
    for k in range(12):
        x = rng.integers(0, 60, 80).astype(float) + 9000 if k % 2 else np.sort(rng.uniform(-1, 1, 50))
        y = rng.normal(0, 1, len(x)) + 0.1 * k * np.abs(x - np.median(x))
        b, _, _, r2 = M.two_segments(x, y)
        least = min(error(x, y, t) for t in np.concatenate([np.linspace(x.min(), x.max(), 3001)[1:-1], np.unique(x)[1:-1]]))
        found = (1 - r2) * ((y - y.mean()) ** 2).sum()
        assert found <= least * (1 + 1e-9) and abs(error(x, y, b) - found) <= 1e-6 * found
    # a break in the first twentieth, and between two x of a long series
    x = np.arange(2300.0)
    for at in (40.3, 1001.5, 2280.25):
        b, s1, s2, r2 = M.two_segments(x, np.where(x < at, 5 * x, 5 * at - 2 * (x - at)))
        assert abs(b - at) < 1e-6 and abs(s1 - 5) < 1e-6 and abs(s2 + 2) < 1e-6 and r2 > 1 - 1e-9
