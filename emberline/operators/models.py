"""Classifiers and per-cell fits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .scores import balance, confusion, scores, stratified_folds

#: Training rows that a task of a pass takes at least.
ROWS_PER_TASK = 100_000
MODELS = ("logistic", "svm_linear", "neural", "forest")


def classifier(kind: str, features: int, label: str = "label"):
    """An estimator of Spark ML.  Kernel machines and maximum-entropy packages have no counterpart and aren't offered."""
    from pyspark.ml import classification as c

    common = {"featuresCol": "scaled", "labelCol": label}
    if kind == "logistic":
        return c.LogisticRegression(**common, elasticNetParam=1.0, regParam=1e-4, weightCol="weight__", maxIter=20, tol=1e-4)
    if kind == "svm_linear":
        return c.LinearSVC(**common, weightCol="weight__", maxIter=50)
    if kind == "neural":
        return c.MultilayerPerceptronClassifier(**common, layers=[features, 14, 2], solver="l-bfgs", seed=1)
    if kind == "forest":
        return c.RandomForestClassifier(**common, numTrees=100, maxDepth=4, seed=1, weightCol="weight__")
    raise ValueError(f"{kind!r} is none of {MODELS}")


@dataclass(frozen=True)
class Fitted:
    """A classifier with the means and deviations of its training rows."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]
    model: object

    def scaled(self, df: DataFrame) -> DataFrame:
        """Adds the vector ``scaled`` of the features less their means over their (population) deviations."""
        z = [((F.col(c).cast("double") - m) / (s or 1.0)) for c, m, s in zip(self.features, self.means, self.deviations, strict=True)]
        return df.withColumn("scaled", array_to_vector(F.array(*z)))


def _complete(features: Sequence[str]) -> Column:
    ok = F.lit(True)
    for c in features:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return ok


def fit(df: DataFrame, features: Sequence[str], label: str, kind: str = "logistic", positive_weight: float = 1.0) -> Fitted | None:
    """A classifier of the rows with all features and a label; None where there are none of them or all have one label."""
    d = df.where(_complete(features) & F.col(label).isNotNull())
    stats = d.agg(F.countDistinct(label), F.count("*"), *(f(F.col(c).cast("double")) for c in features for f in (F.avg, F.stddev_pop))).first()
    if stats[0] < 2:
        return None
    plain = Fitted(tuple(features), tuple(stats[2::2]), tuple(stats[3::2]), None)
    d = d.coalesce(-(-stats[1] // ROWS_PER_TASK))  # each of the many passes is over few tasks where there are few rows
    d = plain.scaled(d.withColumns({"weight__": F.when(F.col(label) == 1, positive_weight).otherwise(1.0), label: F.col(label).cast("double")}))
    return replace(plain, model=classifier(kind, len(features), label).fit(d))


def predict(fitted: Fitted | None, df: DataFrame, name: str = "prob") -> DataFrame:
    """Adds the probability of label 1 (for machines without one: the logistic of the margin); NULL where a feature is missing."""
    from pyspark.ml.functions import vector_to_array

    none = F.lit(None).cast("double")
    if fitted is None:
        return df.withColumn(name, none)
    ok = _complete(fitted.features)
    out = fitted.model.transform(fitted.scaled(df.where(ok).withColumn("weight__", F.lit(1.0))))
    if "probability" in out.columns:
        p = vector_to_array("probability")[1]
    else:
        p = 1.0 / (1.0 + F.exp(-vector_to_array("rawPrediction")[1]))
    kept = [c for c in df.columns if c != name]
    return out.withColumn(name, p).select(*kept, name).unionByName(df.where(~ok).withColumn(name, none).select(*kept, name))


def leave_one_out(df: DataFrame, features: Sequence[str], label: str, group: str, kind: str = "logistic", positive_weight: float = 1.0) -> DataFrame:
    """Every row with the probability by a model of all other groups (years, folds); one fit per group, of which there are few.

    Rows with a missing feature have a NULL probability; so have those of a
    NULL group, which train all the models.
    """
    d = materialize(df, "training")
    out = d.where(F.col(group).isNull()).withColumn("prob", F.lit(None).cast("double"))
    for (g,) in sorted(d.where(F.col(group).isNotNull()).select(group).distinct().collect()):
        out = out.unionByName(predict(fit(d.where(~F.col(group).eqNullSafe(g)), features, label, kind, positive_weight), d.where(F.col(group) == g)))
    return out


def fit_predict(train: DataFrame, target: DataFrame, features: Sequence[str], label: str, order: Sequence[str], kind: str = "logistic", most: int | None = None, seed: int = 0) -> DataFrame:
    """Probabilities for a target table by a model of the balanced training rows: balance, sample, scale, fit and predict in one call."""
    return predict(fit(balance(train, label, order, seed, most), features, label, kind), target)


def fold_scores(df: DataFrame, features: Sequence[str], label: str, order: Sequence[str], folds: int = 5, kind: str = "logistic", seed: int = 0) -> DataFrame:
    """``fold`` and its AUC, balanced accuracy, accuracy, precision, recall and kappa, by stratified folds."""
    p = leave_one_out(stratified_folds(df, label, order, folds, seed), features, label, "fold", kind)
    c = confusion(p, ["fold"], label, "prob")
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double"))
    c = c.select("fold", ((rate("tp", "fn") + rate("tn", "fp")) / 2).alias("balanced_accuracy"), ((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("accuracy"), "precision", "recall", "kappa")
    return scores(p, ["fold"], label, "prob").select("fold", "auc").join(c, "fold")


def _two_lines(n, sx, sy, sxx, sxy, syy):
    """Intercept, slope and squared error of the line through the points of these sums."""
    vx, cxy, vy = sxx - sx * sx / n, sxy - sx * sy / n, syy - sy * sy / n
    slope = cxy / vx
    return (sy - slope * sx) / n, slope, np.maximum(0.0, vy - slope * cxy)


def two_segments(x: np.ndarray, y: np.ndarray, least: int = 3) -> tuple[float, float, float, float]:
    """Break, slopes before and after, r2 of the best continuous two-segment line over all breaks within the range of x.

    Within a gap of neighbouring x the squared error is least where the lines
    through the points before and after cross, or else at an end of the gap
    (Hudson 1966).  So the crossings and the x are all that can be the break;
    running sums give the error of each.  Of equally good breaks the least counts.
    """
    ok = np.isfinite(x) & np.isfinite(y)
    x, y = x[ok], y[ok]
    at, of = np.unique(x, return_inverse=True)
    if len(at) < 2 * least:
        return (np.nan,) * 4
    # centred and scaled, so that the sums keep their digits
    mid, scale, level = x.mean(), np.ptp(x), y.mean()
    u, v, w = (at - mid) / scale, (x - mid) / scale, y - level
    before = [np.cumsum(np.bincount(of, s, len(at))) for s in (np.ones(len(v)), v, w, v * v, v * w, w * w)]
    total = float((w * w).sum())
    # breaks at an x: one least-squares fit of 1, x and max(0, x - break) each
    b = u[1:-1]
    n, sx, sy, sxx, sxy, _ = (s[-1] for s in before)
    rn, rx, ry, rxx, rxy, _ = (s[-1] - s[1:-1] for s in before)
    h, hx, hh, hy = rx - b * rn, rxx - b * rx, rxx - 2 * b * rx + b * b * rn, rxy - b * ry
    size = np.sqrt(hh)
    h, hx, hy = h / size, hx / size, hy / size
    one = np.ones_like(b)
    m = np.stack([n * one, sx * one, h, sx * one, sxx * one, hx, h, hx, one], axis=1).reshape(-1, 3, 3)
    rhs = np.stack([sy * one, sxy * one, hy], axis=1)
    coef = np.linalg.solve(m, rhs[:, :, None])[:, :, 0]
    breaks, errors = [b], [total - (coef * rhs).sum(axis=1)]
    # breaks within a gap: two places at least on each side
    left = [s[1:-2] for s in before]
    a1, s1, e1 = _two_lines(*left)
    a2, s2, e2 = _two_lines(*(s[-1] - p for s, p in zip(before, left, strict=True)))
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = (a1 - a2) / (s2 - s1)
    inside = (cross > u[1:-2]) & (cross < u[2:-1])
    breaks, errors = np.concatenate([*breaks, cross[inside]]), np.concatenate([*errors, (e1 + e2)[inside]])
    # the few best again from the points themselves: the sums lose digits where a fit is all but perfect
    best = None
    for k in sorted(np.argsort(errors, kind="stable")[:8], key=lambda i: breaks[i]):
        a = np.column_stack([np.ones_like(v), v, np.maximum(0.0, v - breaks[k])])
        coef = np.linalg.lstsq(a, w, rcond=None)[0]
        sse = float(((w - a @ coef) ** 2).sum())
        if best is None or sse < best[0]:
            best = (sse, float(breaks[k] * scale + mid), float(coef[1] / scale), float((coef[1] + coef[2]) / scale))
    return best[1], best[2], best[3], 1.0 - best[0] / total if total > 0 else np.nan


def piecewise_linear(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """``keys, break_at, slope_before, slope_after, r2`` per cell; a cell with too few places has NULLs.

    A cell's series goes to one task; it has one row per time step.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = two_segments(rows["x"].to_numpy(float), rows["y"].to_numpy(float))
        return pd.DataFrame([[*key, *(None if np.isnan(v) else v for v in found)]], columns=[*keys, "break_at", "slope_before", "slope_after", "r2"])

    plain = df.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return plain.groupBy(*keys).applyInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", break_at double, slope_before double, slope_after double, r2 double")
