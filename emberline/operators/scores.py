"""Scoring probabilities against labels, per group, in plain aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import running_totals

EPS = 1e-15


def _by_score(df: DataFrame, group: Sequence[str], label: str, prob: str) -> DataFrame:
    """Positives and negatives per distinct score."""
    return df.groupBy(*group, F.col(prob).alias("p")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))


def _curve(df: DataFrame, group: Sequence[str], label: str, prob: str) -> DataFrame:
    """Per distinct score, from the highest down: true and false positives so far (``tp, fp``) and of the whole group (``P, N``)."""
    run = running_totals(_by_score(df, group, label, prob), group, "p", ["pos", "neg"], descending=True)
    return run.withColumnsRenamed({"upto_pos": "tp", "upto_neg": "fp", "total_pos": "all_pos", "total_neg": "all_neg"})


def scores(df: DataFrame, group: Sequence[str], label: str, prob: str) -> DataFrame:
    """Per group: ``n, auc, brier, logloss, avg_precision, recall`` (at 0.5).

    AUC counts ties half; it and the average precision are NULL without
    positives or (AUC) negatives.  Rows with a NULL label or score don't count.
    """
    if not group:
        return scores(df.withColumn("all__", F.lit(1)), ["all__"], label, prob).drop("all__")
    d = df.where(F.col(label).isNotNull() & F.col(prob).isNotNull())
    s = _curve(d, group, label, prob)
    ranked = s.groupBy(*group).agg(
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) + F.col("neg") * F.col("pos") * 0.5).alias("wins"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))).alias("ap"),
    )
    y, p = F.col(label).cast("double"), F.col(prob)
    q = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))
    plain = d.groupBy(*group).agg(
        F.count("*").alias("n"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("logloss"),
        F.try_divide(F.sum(F.when((y == 1) & (p > 0.5), 1.0).otherwise(0.0)), F.sum(y)).alias("recall"),
    )
    auc = F.try_divide(F.col("wins").cast("double"), (F.col("P") * F.col("N")).cast("double"))
    return plain.join(ranked.select(*group, auc.alias("auc"), F.try_divide("ap", F.col("P").cast("double")).alias("avg_precision")), list(group))


def roc_points(df: DataFrame, group: Sequence[str], label: str, prob: str) -> DataFrame:
    """``group, threshold, tpr, fpr`` at every distinct score."""
    s = _curve(df, group, label, prob)
    return s.select(*group, F.col("p").alias("threshold"), F.try_divide("tp", "all_pos").alias("tpr"), F.try_divide("fp", "all_neg").alias("fpr"))


def roc_on_grid(df: DataFrame, group: Sequence[str], label: str, prob: str, points: int = 100) -> DataFrame:
    """True-positive rates of each group at ``points`` even false-positive rates, linear between the curve's points."""
    roc = roc_points(df, group, label, prob).groupBy(*group, "fpr").agg(F.max("tpr").alias("tpr"))
    start = roc.select(*group).distinct().withColumns({"fpr": F.lit(0.0), "tpr": F.lit(0.0)})
    roc = roc.unionByName(start).groupBy(*group, "fpr").agg(F.max("tpr").alias("tpr"))
    w = Window.partitionBy(*group).orderBy("fpr")
    seg = roc.withColumns({"f1": F.lead("fpr").over(w), "t1": F.lead("tpr").over(w)})
    last = points - 1
    # the grid points that a segment covers follow from its ends: no range join
    first_k = F.ceil(F.col("fpr") * last)
    end_k = F.when(F.col("f1").isNull(), F.lit(last)).otherwise(F.ceil(F.col("f1") * last) - 1)
    seg = seg.where(end_k >= first_k).withColumn("k", F.explode(F.sequence(first_k, end_k)))
    x = F.col("k") / last
    y = F.when(F.col("f1").isNull(), F.col("tpr")).otherwise(F.col("tpr") + (F.col("t1") - F.col("tpr")) * (x - F.col("fpr")) / (F.col("f1") - F.col("fpr")))
    return seg.select(*group, F.col("k").cast("int").alias("k"), y.alias("tpr"))


def confusion(df: DataFrame, group: Sequence[str], label: str, prob: str, threshold: float = 0.5) -> DataFrame:
    """``tp, fp, fn, tn``, precision, recall, AUC on the labels, Cohen's kappa and Brier score of the hard decision."""
    y, p = F.col(label) == 1, F.col(prob) > threshold
    c = df.where(F.col(label).isNotNull() & F.col(prob).isNotNull()).groupBy(*group).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    chance = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    tpr, fpr = F.try_divide(tp, tp + fn), F.try_divide(fp, fp + tn)
    return c.withColumns({
        "precision": F.try_divide(tp, tp + fp), "recall": tpr, "auc_labels": (1.0 + tpr - fpr) / 2.0,
        "kappa": F.try_divide((tp + tn) / n - chance, 1.0 - chance), "brier": (fp + fn) / n,
    })


def reliability(df: DataFrame, group: Sequence[str], label: str, prob: str, bins: int = 20) -> DataFrame:
    """Observed frequency in ``bins`` even bins, closed on the right; a score of exactly 0 is in none."""
    b = F.ceil(F.col(prob) * bins).cast("int")
    d = df.withColumn("bin", b).where(F.col("bin").between(1, bins))
    return d.groupBy(*group, "bin").agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("hits")).withColumn("ratio", F.col("hits") / F.col("n"))


def hash_order(seed: int, order: Sequence[str]) -> Column:
    """A number of 60 bits that depends on the seed and the columns only."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], seed: int) -> DataFrame:
    """Adds ``rank__`` (from 1) within the group in the order of a seeded hash, and the group's rows ``size__``."""
    d = running_totals(df.withColumns({"h__": hash_order(seed, order), "one__": F.lit(1)}), group, "h__", ["one__"])
    return d.withColumnsRenamed({"upto_one__": "rank__", "total_one__": "size__"}).drop("h__", "one__")


def balance(df: DataFrame, label: str, order: Sequence[str], seed: int = 0, most: int | None = None) -> DataFrame:
    """As many rows of each label as the rarest has (at most ``most``), the first by a seeded hash of ``order``.

    Rows with a NULL label are left out; no label is sorted in one task.
    """
    d = _ranked(df.where(F.col(label).isNotNull()), [label], order, seed)
    least = d.groupBy(label).agg(F.max("size__").alias("n")).agg(F.min("n")).first()[0] or 0
    return d.where(F.col("rank__") <= min(least, least if most is None else most)).select(*df.columns)


def draw(df: DataFrame, n: int, order: Sequence[str], seed: int = 0, replace: bool = False) -> DataFrame:
    """``n`` rows at random, the same wherever they are computed; with ``replace`` a row may come several times (M5).

    Without it, all rows where there are fewer.
    """
    d = _ranked(df, [], order, seed)
    if not replace:
        return d.where(F.col("rank__") <= n).select(*df.columns)
    rows = d.agg(F.max("size__")).first()[0] or 0
    wanted = df.sparkSession.range(n if rows else 0).select((F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, rows))) + 1).alias("rank__"))
    return d.join(wanted.groupBy("rank__").agg(F.count("*").alias("times__")), "rank__").withColumn("t__", F.explode(F.sequence(F.lit(1), F.col("times__").cast("int")))).select(*df.columns)


def stratified_folds(df: DataFrame, label: str, order: Sequence[str], folds: int = 5, seed: int = 0) -> DataFrame:
    """Adds ``fold`` (0 .. folds - 1): each fold has the same number of rows of every label, but for one."""
    d = _ranked(df.where(F.col(label).isNotNull()), [label], order, seed)
    return d.withColumn("fold", F.pmod(F.col("rank__") - 1, F.lit(folds)).cast("int")).drop("rank__", "size__")


def systematic_sample(df: DataFrame, label: str, order: str, keep_each: int | None = None) -> DataFrame:
    """All positives and every ``keep_each``-th of the others along ``order``, the first of them included.

    Without ``keep_each`` it is half of the others for each positive, rounded
    down, and at least 1, so that about two of the others come to each positive.
    Ranks are running sums by range, so neither the order's distribution nor
    ties matter for the load.  Rows with a NULL label are left out.
    """
    if keep_each is None:
        n = {r[0]: r[1] for r in df.where(F.col(label).isNotNull()).groupBy((F.col(label) == 1).alias("y")).count().collect()}  # two rows
        keep_each = max(1, n.get(False, 0) // (2 * max(1, n.get(True, 0))))
    others = running_totals(df.where(F.col(label) == 0).withColumn("one__", F.lit(1)), [], order, ["one__"])
    kept = others.where(F.pmod(F.col("upto_one__") - 1, F.lit(keep_each)) == 0)
    return kept.select(*df.columns).unionByName(df.where(F.col(label) == 1))
