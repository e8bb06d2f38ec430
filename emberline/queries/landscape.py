"""Land cover, model scores and sampling, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gridding as G
from ..operators import landcover as L
from ..operators import models as M
from ..operators import scores as S
from ..operators.resample import month_index
from ..plans.views import view, with_views
from ..sources.sinks import nested_json
from .tables import table

FIRST, LAST = 1995, 2001
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return put


_YEARS = f"""y AS (SELECT cell, CAST(year AS INT) AS year, coalesce(prim, 0) AS prim, coalesce(sec, 0) AS sec FROM (SELECT DISTINCT cell FROM v_loss_long), (SELECT unnest(range({FIRST}, {LAST + 1})) AS year)
  LEFT JOIN (SELECT cell AS c2, year AS y2, sum(CASE WHEN kind = 'prim' THEN loss ELSE 0 END) AS prim, sum(CASE WHEN kind = 'sec' THEN loss ELSE 0 END) AS sec FROM v_loss_long GROUP BY ALL) ON c2 = cell AND y2 = year),
t AS (SELECT cell, CAST(sum(loss) * 2 AS DOUBLE) AS total FROM v_loss_long GROUP BY cell)"""


def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.dense_years(view(spark, sf_dir, "v_loss_long"), "cell", FIRST, LAST)


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_loss_long").groupBy("cell").agg((F.sum("loss") * 2).cast("double").alias("total"))


_FRAMES = {"last": "ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING", "this": "ROWS BETWEEN CURRENT ROW AND CURRENT ROW", "three": "ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING", "before": "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING", "accum": "ROWS UNBOUNDED PRECEDING"}


@query(f"WITH {_YEARS} SELECT cell, year, {', '.join(f'coalesce(sum({k}) OVER (PARTITION BY cell ORDER BY year {fr}), 0) / total AS loss_{s}_{k}' for k in ('prim', 'sec') for s, fr in _FRAMES.items())}, 0.6 - sum(prim) OVER (PARTITION BY cell ORDER BY year) / total AS f_prim FROM y JOIN t USING (cell)")
def loss_last_this_three_accum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of the last, this, the last three, all earlier and all years; primary forest left."""
    f = L.loss_features(years(spark, sf_dir), "cell", totals(spark, sf_dir))
    return f.select("cell", "year", *(f"loss_{s}_{k}" for k in ("prim", "sec") for s in _FRAMES), (0.6 - F.col("loss_accum_prim")).alias("f_prim"))


_REL = ", ".join(f"CAST(coalesce(sum(loss) FILTER (l.kind = '{k}' AND l.year = f.year + {o}), 0) AS BIGINT) AS {k}_{'m' if o < 0 else 'p'}{abs(o)}" for k in ("prim", "sec") for o in range(-3, 4))
_FIRES = "f AS (SELECT s_suppkey AS cell, CAST(1996 + s_suppkey % 5 AS INT) AS year FROM supplier)"


def fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell"), (1996 + F.col("s_suppkey") % 5).cast("int").alias("year"))


@query(f"WITH {_FIRES} SELECT f.cell, f.year, {_REL} FROM f LEFT JOIN v_loss_long l ON l.cell = f.cell GROUP BY f.cell, f.year")
def relative_year_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of the years around a fire."""
    return L.relative_years(fires(spark, sf_dir), view(spark, sf_dir, "v_loss_long"), "cell", "year")


@query("""WITH m AS (SELECT cell, kind, arg_min(year, -loss * 10000 + year) AS max_year, CAST(sum(loss) AS BIGINT) AS total_loss FROM v_loss_long GROUP BY ALL)
  SELECT m.cell, m.kind, m.max_year, m.total_loss, CAST(sum(CASE WHEN l.year <= m.max_year THEN l.loss ELSE 0 END) AS BIGINT) AS loss_to_max FROM m JOIN v_loss_long l ON l.cell = m.cell AND l.kind = m.kind GROUP BY ALL""")
def argmax_loss_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year of the greatest loss and loss up to it."""
    return L.greatest_loss(view(spark, sf_dir, "v_loss_long"), "cell")


_AROUND = ", ".join(f"CAST(coalesce(sum({k}) FILTER (y.year < f.year), 0) AS BIGINT) AS {k}_before_fire, CAST(coalesce(sum({k}) FILTER (y.year >= f.year), 0) AS BIGINT) AS {k}_after_fire" for k in ("prim", "sec"))


@query(f"WITH {_YEARS}, {_FIRES} SELECT f.cell, f.year, {_AROUND} FROM f LEFT JOIN y ON y.cell = f.cell GROUP BY f.cell, f.year")
def loss_around_fire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss before and after a fire."""
    return L.loss_around_fire(fires(spark, sf_dir), years(spark, sf_dir), "cell", "year")


@query("""WITH m AS (SELECT labs8 % 25 AS cell, CAST(date_trunc('week', date) AS DATE) AS week, count(*) AS fires FROM v_fire_points GROUP BY ALL)
  SELECT cell, week, fires, CAST(coalesce(sum(fires) OVER (PARTITION BY cell ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS frp_acc FROM m""")
def fire_accumulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fires before each period."""
    m = view(spark, sf_dir, "v_fire_points").groupBy((F.col("labs8") % 25).alias("cell"), F.trunc("date", "week").alias("week")).agg(F.count("*").alias("fires"))
    return L.fires_before(m, "cell", "week", "fires")


@query("""WITH b AS (SELECT l_suppkey AS cell, CAST(year(l_shipdate) AS INT) AS year, count(*) AS n FROM lineitem GROUP BY ALL),
  r AS (SELECT *, CAST(least(row_number() OVER (PARTITION BY cell ORDER BY year), 4) AS INT) AS repeat FROM b), g AS (SELECT year, repeat, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY ALL) SELECT year, repeat, n, n / sum(n) OVER (PARTITION BY year) AS share FROM g""")
def repeat_burns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections by the number of years the cell had burnt."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell"), F.year("l_shipdate").alias("year"))
    return L.repeat_burns(d, "cell", "year", 4)


@query("SELECT cell, " + ", ".join(f"count(*) FILTER (class = {c}) AS class_{c}" for c in (1, 2, 3, 4)) + ", count(*) FILTER (class IN (1, 2, 3, 4)) AS total FROM v_cell_class GROUP BY cell HAVING count(*) FILTER (class IN (1, 2, 3, 4)) > 0")
def class_pivot_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels per class and cell with their total."""
    return G.class_counts(view(spark, sf_dir, "v_cell_class"), ["cell"], "class", [1, 2, 3, 4])


@query("""WITH k AS (SELECT cell, count(*) FILTER (class = 1) AS one, count(*) AS total FROM v_cell_class GROUP BY cell) SELECT pixel, cell, v FROM v_cell_class SEMI JOIN (SELECT cell FROM k WHERE one > 0.2 * total) USING (cell)""")
def pure_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the cells of which one class makes up more than a part."""
    c = view(spark, sf_dir, "v_cell_class")
    return G.pure_cells(G.class_counts(c, ["cell"], "class", [1, 2, 3, 4, 5]), ["cell"], "class_1", "total", 0.2, c).select("pixel", "cell", "v")


@query("""SELECT a.pixel, CASE WHEN b.pixel IS NOT NULL THEN 2 ELSE 1 END AS kind FROM v_cell_class a LEFT JOIN (SELECT pixel FROM v_cell_class WHERE class = 2 AND pixel % 3 = 0) b USING (pixel)""")
def typed_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss pixels typed by the primary map at the same place, by scaled integers."""
    place = view(spark, sf_dir, "v_cell_class").withColumns({"lon": F.col("pixel") / 7.0, "lat": -F.col("pixel") / 11.0})
    primary = place.where("pixel % 3 = 0")
    return L.typed_loss(place.select("pixel", "lon", "lat"), primary.select("lon", "lat", "class"), "lon", "lat", "class").select("pixel", "kind")


@query("""WITH p AS (SELECT cell, count(*) FILTER (class = 1) AS prim, count(*) FILTER (class = 2) AS gain, count(*) AS total FROM v_cell_class GROUP BY cell), l AS (SELECT cell % 50 + 1 AS cell, sum(loss) AS loss FROM v_loss_long GROUP BY ALL)
  SELECT p.cell, prim / total AS f_prim, gain / total AS gain, coalesce(loss, 0) / total AS loss FROM p LEFT JOIN l ON p.cell = l.cell""")
def forest_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary, gain and loss fractions merged on the cell."""
    c = G.class_counts(view(spark, sf_dir, "v_cell_class"), ["cell"], "class", [1, 2, 3, 4, 5])
    lost = view(spark, sf_dir, "v_loss_long").groupBy((F.col("cell") % 50 + 1).alias("cell")).agg(F.sum("loss").alias("loss"))
    return c.join(lost, "cell", "left").select("cell", (F.col("class_1") / F.col("total")).alias("f_prim"), (F.col("class_2") / F.col("total")).alias("gain"), (F.coalesce("loss", F.lit(0)) / F.col("total")).alias("loss"))


@query("SELECT cell, CAST(substr(name, 2) AS INT) AS year, loss FROM (UNPIVOT (SELECT cell, " + ", ".join(f"coalesce(sum(loss) FILTER (year = {y}), 0) AS y{y}" for y in range(FIRST, LAST + 1)) + " FROM v_loss_long GROUP BY cell) ON COLUMNS(* EXCLUDE (cell)) INTO NAME name VALUE loss)")
def wide_and_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivot to one column per year, pick columns by a pattern, and back to long."""
    import re

    wide = view(spark, sf_dir, "v_loss_long").groupBy("cell").pivot("year", list(range(FIRST, LAST + 1))).agg(F.sum("loss")).fillna(0)
    wide = wide.select("cell", *(F.col(str(y)).alias(f"y{y}") for y in range(FIRST, LAST + 1)))
    chosen = [c for c in wide.columns if re.fullmatch(r"y\d+", c)]
    return wide.unpivot("cell", chosen, "name", "loss").select("cell", F.regexp_extract("name", r"(\d+)", 1).cast("int").alias("year"), "loss")


_S = "v_scores"


@query(f"""WITH s AS (SELECT year, prob, sum(label) AS pos, sum(1 - label) AS neg FROM {_S} GROUP BY ALL),
  r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM s WINDOW w AS (PARTITION BY year ORDER BY prob DESC ROWS UNBOUNDED PRECEDING)),
  a AS (SELECT year, CAST(sum(neg * (tp - pos) + neg * pos * 0.5) AS DOUBLE) / CAST(sum(pos) * sum(neg) AS DOUBLE) AS auc, sum(pos * (tp / (tp + fp))) / sum(pos) AS ap FROM r GROUP BY year),
  b AS (SELECT year, count(*) AS n, avg((prob - label) * (prob - label)) AS brier, avg(-(label * ln(prob) + (1 - label) * ln(1 - prob))) AS logloss, sum(CASE WHEN label = 1 AND prob > 0.5 THEN 1.0 ELSE 0.0 END) / sum(label) AS recall FROM {_S} GROUP BY year)
  SELECT year, n, round(auc, 6) AS auc, round(brier, 6) AS brier, round(logloss, 6) AS logloss, round(ap, 6) AS avg_precision, round(CAST(recall AS DOUBLE), 6) AS recall FROM a JOIN b USING (year)""")
def scores_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC, Brier, log loss, average precision and recall per year (M9)."""
    out = S.scores(view(spark, sf_dir, _S), ["year"], "label", "prob")
    return out.select("year", "n", *(F.round(c, 6).alias(c) for c in ("auc", "brier", "logloss", "avg_precision", "recall")))


@query(f"""WITH s AS (SELECT year, prob, sum(label) AS pos, sum(1 - label) AS neg FROM {_S} GROUP BY ALL)
  SELECT year, prob AS threshold, round(sum(pos) OVER w / sum(pos) OVER y, 6) AS tpr, round(sum(neg) OVER w / sum(neg) OVER y, 6) AS fpr FROM s WINDOW w AS (PARTITION BY year ORDER BY prob DESC ROWS UNBOUNDED PRECEDING), y AS (PARTITION BY year)""")
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ROC curve of each year."""
    return S.roc_points(view(spark, sf_dir, _S), ["year"], "label", "prob").select("year", "threshold", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query(f"""WITH s AS (SELECT year, prob, sum(label) AS pos, sum(1 - label) AS neg FROM {_S} GROUP BY ALL),
  c AS (SELECT year, sum(neg) OVER w / sum(neg) OVER y AS fpr, sum(pos) OVER w / sum(pos) OVER y AS tpr FROM s WINDOW w AS (PARTITION BY year ORDER BY prob DESC ROWS UNBOUNDED PRECEDING), y AS (PARTITION BY year)),
  p AS (SELECT year, fpr, max(tpr) AS tpr FROM (SELECT * FROM c UNION ALL SELECT DISTINCT year, 0, 0 FROM c) GROUP BY ALL), l AS (SELECT *, lead(fpr) OVER w AS f1, lead(tpr) OVER w AS t1 FROM p WINDOW w AS (PARTITION BY year ORDER BY fpr)),
  g AS (SELECT year, k, CASE WHEN f1 IS NULL THEN tpr ELSE tpr + (t1 - tpr) * (k / 99.0 - fpr) / (f1 - fpr) END AS tpr FROM l, (SELECT unnest(range(100)) AS k) WHERE k / 99.0 >= fpr AND (f1 IS NULL OR k / 99.0 < f1))
  SELECT CAST(k AS INT) AS k, round(avg(tpr), 6) AS mean_tpr, round(stddev_pop(tpr), 6) AS sd_tpr FROM g GROUP BY k""")
def roc_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of the yearly curves on an even grid of 100."""
    g = S.roc_on_grid(view(spark, sf_dir, _S), ["year"], "label", "prob", 100)
    return g.groupBy("k").agg(F.round(F.avg("tpr"), 6).alias("mean_tpr"), F.round(F.stddev_pop("tpr"), 6).alias("sd_tpr"))


@query(f"""WITH c AS (SELECT year, count(*) FILTER (label = 1 AND prob > 0.5) AS tp, count(*) FILTER (label = 0 AND prob > 0.5) AS fp, count(*) FILTER (label = 1 AND prob <= 0.5) AS fn, count(*) FILTER (label = 0 AND prob <= 0.5) AS tn, CAST(count(*) AS DOUBLE) AS n FROM {_S} GROUP BY year),
  e AS (SELECT *, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) AS pe FROM c)
  SELECT year, tp, fp, fn, tn, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round((1 + tp / (tp + fn) - fp / (fp + tn)) / 2, 6) AS auc_labels, round(((tp + tn) / n - pe) / (1 - pe), 6) AS kappa, round((fp + fn) / n, 6) AS brier FROM e""")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion matrix and what follows from it."""
    c = S.confusion(view(spark, sf_dir, _S), ["year"], "label", "prob")
    return c.select("year", "tp", "fp", "fn", "tn", *(F.round(x, 6).alias(x) for x in ("precision", "recall", "auc_labels", "kappa", "brier")))


@query(f"SELECT year, CAST(ceil(prob * 20) AS INT) AS bin, count(*) AS n, CAST(sum(label) AS BIGINT) AS hits, sum(label) / count(*) AS ratio FROM {_S} WHERE prob > 0 GROUP BY ALL")
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed frequency per probability bin."""
    return S.reliability(view(spark, sf_dir, _S), ["year"], "label", "prob", 20)


@query(f"WITH n AS (SELECT row_id, label, row_number() OVER (ORDER BY row_id) AS rn FROM {_S} WHERE label = 0) SELECT row_id, label FROM n WHERE (rn - 1) % 3 = 0 UNION ALL SELECT row_id, label FROM {_S} WHERE label = 1")
def systematic_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All positives, every third of the others in order (M1, M3)."""
    return S.systematic_sample(view(spark, sf_dir, _S).select("row_id", "label"), "label", "row_id", 3)


_HASHED = "CAST('0x' || substr(md5('{seed}|' || CAST({id} AS VARCHAR)), 1, 15) AS BIGINT)"


@query(f"WITH r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {_HASHED.format(seed=3, id='row_id')}) AS k FROM {_S}) SELECT row_id, label FROM r WHERE k <= (SELECT min(c) FROM (SELECT count(*) AS c FROM {_S} GROUP BY label))")
def random_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random under-sampling to the rarest class (M2)."""
    return S.balance(view(spark, sf_dir, _S).select("row_id", "label"), "label", ["row_id"], 3)


@query(f"WITH r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {_HASHED.format(seed=4, id='row_id')}) AS k FROM {_S}) SELECT row_id, label FROM r WHERE k <= least(2000, (SELECT min(c) FROM (SELECT count(*) AS c FROM {_S} GROUP BY label)))")
def capped_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 2,000 positives and as many of the others: the sampling operator's own limit (M4)."""
    return S.balance(view(spark, sf_dir, _S).select("row_id", "label"), "label", ["row_id"], 4, 2_000)


@query(f"SELECT row_id, label FROM {_S} ORDER BY {_HASHED.format(seed=5, id='row_id')} LIMIT 500")
def random_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 rows at random (M5)."""
    return S.draw(view(spark, sf_dir, _S).select("row_id", "label"), 500, ["row_id"], 5)


@query(f"SELECT CAST((k - 1) % 5 AS INT) AS fold, label, count(*) AS n, sum(row_id) AS ids FROM (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {_HASHED.format(seed=6, id='row_id')}) AS k FROM {_S}) GROUP BY ALL")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds with the same number of rows of either label."""
    d = S.stratified_folds(view(spark, sf_dir, _S).select("row_id", "label"), "label", ["row_id"], 5, 6)
    return d.groupBy("fold", "label").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"))


@query(f"""WITH c AS (SELECT greatest(1, count(*) FILTER (label = 0) // (2 * greatest(1, count(*) FILTER (label = 1)))) AS k FROM {_S}), n AS (SELECT row_id, label, row_number() OVER (ORDER BY row_id) AS rn FROM {_S} WHERE label = 0)
  SELECT row_id, label FROM n, c WHERE (rn - 1) % k = 0 UNION ALL SELECT row_id, label FROM {_S} WHERE label = 1""")
def balanced_by_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All positives and so many of the others, in order, that two come to each (M3)."""
    return S.systematic_sample(view(spark, sf_dir, _S).select("row_id", "label"), "label", "row_id")


@query(f"SELECT h.year AS held_out, count(*) FILTER (s.year <> h.year) AS n_train, count(*) FILTER (s.year = h.year) AS n_test FROM {_S} s, (SELECT DISTINCT year FROM {_S}) h GROUP BY h.year")
def leave_year_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the leave-one-year-out splits (M6)."""
    s = view(spark, sf_dir, _S).groupBy("year").count()
    whole = s.agg(F.sum("count").alias("all"))
    return s.join(F.broadcast(whole)).select(F.col("year").alias("held_out"), (F.col("all") - F.col("count")).alias("n_train"), F.col("count").alias("n_test"))  # one row


@query("""WITH j AS (SELECT c.cell, c.month, c.v AS clim, y.v AS now FROM (SELECT cell, CAST(month(day) AS INT) AS month, avg(v) AS v FROM v_series_long GROUP BY ALL) c LEFT JOIN (SELECT cell, CAST(month(day) AS INT) AS month, avg(v) AS v FROM v_series_long WHERE year(day) = 2000 GROUP BY ALL) y ON c.cell = y.cell AND c.month = y.month)
  SELECT cell, month, round(now - clim, 6) AS difference FROM j""")
def forecast_minus_climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One year's values against the climatology."""
    s = view(spark, sf_dir, "v_series_long").withColumn("month", F.month("day"))
    clim = s.groupBy("cell", "month").agg(F.avg("v").alias("clim"))
    now = s.where(F.year("day") == 2000).groupBy("cell", "month").agg(F.avg("v").alias("now"))
    return clim.join(now, ["cell", "month"], "left").select("cell", "month", F.round(F.col("now") - F.col("clim"), 6).alias("difference"))


@query("""WITH o AS (SELECT o_orderkey AS k, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS VARCHAR) AS month, CAST(((o_orderkey * 7919) % 1000) // 10 AS INT) AS p, CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS y FROM orders),
  m AS (SELECT year, month, '"' || month || '":{"probs":[' || string_agg(CAST(p AS VARCHAR), ',' ORDER BY k) || '],"labels":[' || string_agg(CAST(y AS VARCHAR), ',' ORDER BY k) || ']}' AS part FROM o GROUP BY year, month)
  SELECT year, '{' || string_agg(part, ',' ORDER BY month) || '}' AS json FROM m GROUP BY year""")
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By year an object from month to arrays of probabilities and labels in the order of the cells (K4)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.expr("CAST(((o_orderkey * 7919) % 1000) div 10 AS INT)").alias("p"), (F.col("o_totalprice") > 100000).cast("int").alias("y"))
    return nested_json(o, "year", "month", ["o_orderkey"], {"probs": "p", "labels": "y"})


@query("SELECT cell, mind, " + ", ".join(f"max(v) FILTER (number = {k}) AS level_{k}" for k in range(1, 8)) + " FROM v_ensemble GROUP BY cell, mind")
def levels_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels or members side by side."""
    out = view(spark, sf_dir, "v_ensemble").groupBy("cell", "mind").pivot("number", list(range(1, 8))).agg(F.max("v"))
    return out.select("cell", "mind", *(F.col(str(k)).alias(f"level_{k}") for k in range(1, 8)))


@query("SELECT p_partkey, p_size, legend FROM part JOIN (SELECT unnest(range(1, 14)) AS class, 'cover ' || CAST(unnest(range(1, 14)) AS VARCHAR) AS legend) ON class = p_size WHERE p_retailprice > 0")
def legend_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class rasters with their legend, class 0 and empty pixels dropped."""
    legend = spark.range(1, 14).select(F.col("id").cast("int").alias("class"), F.concat(F.lit("cover "), F.col("id").cast("string")).alias("legend"))
    p = table(spark, sf_dir, "part").where("p_retailprice > 0")
    return p.join(F.broadcast(legend), p["p_size"] == legend["class"]).select("p_partkey", "p_size", "legend")  # 13 rows


@query()
def piecewise_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-segment linear fit per cell: break, slopes, r2."""
    s = view(spark, sf_dir, "v_series_long").select("cell", F.datediff("day", F.lit("1995-01-01").cast("date")).cast("double").alias("x"), "v")
    return M.piecewise_linear(s, ["cell"], "x", "v")


@query()
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaler and L1 logistic regression, each year predicted from the others, scored per year."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_nationkey"), "o_custkey")
    d = o.select(F.col("o_orderkey").alias("row_id"), F.year("o_orderdate").alias("year"), (F.col("o_totalprice") > 100000).cast("int").alias("label"), F.col("c_acctbal").alias("a"), F.month("o_orderdate").cast("double").alias("b"), F.col("c_nationkey").cast("double").alias("c"))
    p = M.leave_one_out(d, ["a", "b", "c"], "label", "year", "logistic")
    return S.scores(p, ["year"], "label", "prob").select("year", "n", F.round("auc", 3).alias("auc"), F.round("brier", 3).alias("brier"))


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_nationkey")
    o = table(spark, sf_dir, "orders").join(c, "o_custkey")
    return o.select(F.col("o_orderkey").alias("row_id"), F.year("o_orderdate").alias("year"), (F.col("o_totalprice") > 100000).cast("int").alias("label"), (F.col("o_totalprice") % 1000 + F.col("c_acctbal") / 100).alias("a"), F.month("o_orderdate").cast("double").alias("b"), (F.col("o_totalprice") / 1000 + F.col("c_nationkey")).alias("c"))


@query()
def leave_year_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision of each year by a model of all others."""
    p = M.leave_one_out(_training(spark, sf_dir), ["a", "b", "c"], "label", "year", "logistic")
    return S.confusion(p, ["year"], "label", "prob").select("year", F.round("precision", 3).alias("precision"))


@query()
def fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six scores by stratified folds."""
    out = M.fold_scores(_training(spark, sf_dir), ["a", "b", "c"], "label", ["row_id"], 5)
    return out.select("fold", *(F.round(c, 3).alias(c) for c in ("auc", "balanced_accuracy", "accuracy", "precision", "recall", "kappa")))


@query()
def target_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last year predicted from a balanced sample of the earlier ones in one call."""
    d = _training(spark, sf_dir)
    p = M.fit_predict(d.where("year < 1998"), d.where("year >= 1998"), ["a", "b", "c"], "label", ["row_id"], most=20_000)
    return p.select("row_id", "label", F.round("prob", 3).alias("prob"))


_TYPED = ", ".join(f"count(*) FILTER (year(l_shipdate) = {y} AND l_linenumber = {k}) AS \"{y}_loss{t}\"" for y in range(FIRST, LAST + 1) for k, t in ((1, ""), (2, "_prim")))


@query(f"SELECT l_suppkey AS cell, {_TYPED} FROM lineitem GROUP BY l_suppkey")
def typed_loss_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss per year in two typed columns each, added up over all files."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell"), F.year("l_shipdate").alias("year"), F.col("l_linenumber").alias("kind"))
    return L.typed_loss_columns(d, ["cell"], "year", "kind", range(FIRST, LAST + 1))


_MIND = "CAST((year(day) - 1995) * 12 + month(day) AS INT)"


@query(f"""WITH m AS (SELECT cell, {_MIND} AS mind, sum(n) AS fires FROM v_series_long GROUP BY ALL), e AS (SELECT min(mind) AS a, CAST(ceil(max(mind) / 12.0) * 12 AS INT) AS z FROM m), k AS (SELECT cell, CAST(unnest(range(a, z + 1)) AS INT) AS mind FROM (SELECT DISTINCT cell FROM m), e)
  SELECT k.cell, k.mind, CAST(coalesce(fires, 0) AS BIGINT) AS fires FROM k LEFT JOIN m ON m.cell = k.cell AND m.mind = k.mind""")
def months_to_year_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly counts with the rest of the last year as zeros."""
    m = view(spark, sf_dir, "v_series_long").groupBy("cell", month_index(F.year("day"), F.month("day"), 1995).alias("mind")).agg(F.sum("n").alias("fires"))
    return L.months_to_year_end(m, ["cell"], "mind", "fires")


@query("""WITH e AS (SELECT CAST(p_size AS INT) AS cell, avg(p_retailprice * 9.0 / 9.80665) AS dem FROM part WHERE p_size % 7 > 0 GROUP BY 1), p AS (SELECT CAST(p_size AS INT) AS cell, CAST(sum(p_partkey % 5) AS BIGINT) AS peatd FROM part WHERE p_size % 3 = 0 GROUP BY 1)
  SELECT c.cell, c.pixel, round(dem, 6) AS dem, coalesce(peatd, 0) AS peatd FROM v_cell_class c LEFT JOIN e ON e.cell = c.cell LEFT JOIN p ON p.cell = c.cell""")
def static_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height from the geopotential, and peat, joined to the cells."""
    p = table(spark, sf_dir, "part").withColumn("cell", F.col("p_size").cast("int"))
    z = p.where("p_size % 7 > 0").select("cell", (F.col("p_retailprice") * 9.0).alias("z"))
    peat = p.where("p_size % 3 = 0").select("cell", (F.col("p_partkey") % 5).alias("depth"))
    out = L.with_static(view(spark, sf_dir, "v_cell_class"), ["cell"], z, "z", peat, "depth")
    return out.select("cell", "pixel", F.round("dem", 6).alias("dem"), "peatd")


@query("SELECT p_partkey AS pixel, CAST(1 AS INT) AS peatd FROM (SELECT p_partkey, p_size % 4 AS d FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, p_size % 3 FROM part WHERE p_partkey % 5 < 3) WHERE d > 0")
def peat_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with peat in either of two rasters."""
    p = table(spark, sf_dir, "part")
    a = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("pixel"), (F.col("p_size") % 4).alias("peatd"))
    b = p.where("p_partkey % 5 < 3").select(F.col("p_partkey").alias("pixel"), (F.col("p_size") % 3).alias("peatd"))
    return L.label_mask(a, b, value="peatd")


@query("""SELECT n_regionkey AS g, min(n_name) AS first, count(DISTINCT length(n_name)) AS sizes, round(avg(n_nationkey), 6) AS mean FROM nation GROUP BY n_regionkey""")
def mixed_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First value, number of distinct ones and mean in one aggregation."""
    n = table(spark, sf_dir, "nation")
    return n.groupBy(F.col("n_regionkey").alias("g")).agg(F.min("n_name").alias("first"), F.countDistinct(F.length("n_name")).alias("sizes"), F.round(F.avg("n_nationkey"), 6).alias("mean"))
