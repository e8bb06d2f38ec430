"""Weather, fire-weather index, resampling and feature queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import current_rows, day_index, finite, usable
from ..functions.met import day_length, effective_day_length, relative_humidity, to_celsius, to_mm, wind_speed
from ..operators import resample as R
from ..operators.fwi import final_state, fwi_daily
from ..operators.units import H2M, T2M, stated_in_remark, with_source_units, with_units
from ..plans.views import view, with_views
from .problems import _FIRE_ROWS, _REMARK, _UNITS
from .tables import table

CELL = ["lonind", "latind"]
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return put


def daily_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current daily weather of each cell, humidity in percent; unusable values are NULL."""
    raw = table(spark, sf_dir, "fwi_climatology").select(*CELL, "time", "loaded_at", "t2m", "h2m", "w10", "tp", "remark")
    raw = with_units(raw, H2M, "h2m", stated_in_remark(H2M, "remark")).withColumn("day", F.to_date("time"))
    return current_rows(raw, [*CELL, "day"], "loaded_at", {"t2m": finite("t2m"), "h2m": F.col("h2m_nominal"), "w10": finite("w10"), "tp": usable("tp")})


def _fwi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fwi_daily(daily_inputs(spark, sf_dir), CELL, "day", "t2m", "h2m", "w10", "tp")


_INPUTS = rf"""
m0 AS (SELECT lonind, latind, CAST(time AS DATE) AS day, loaded_at, CASE WHEN NOT isnan(t2m) THEN t2m END AS t2m, CASE WHEN NOT isnan(w10) THEN w10 END AS w10,
  CASE WHEN NOT isnan(tp) AND tp >= 0 AND tp < 2000 THEN tp END AS tp, CASE WHEN NOT isnan(h2m) AND h2m > 0 THEN h2m END AS h, {_REMARK} AS m FROM fwi_climatology),
m1 AS (SELECT *, CASE WHEN regexp_matches(m, 'fraction|0\.\.1|share of one|pecahan|ratio not') THEN h * 100 WHEN regexp_matches(m, 'x10|by ten|tenths|per mille') THEN h * 0.1 WHEN h < 2 THEN h * 100 WHEN h > 200 THEN h * 0.1 ELSE h END AS h2m FROM m0),
wx AS (SELECT lonind, latind, day, t2m, CASE WHEN h2m > 100 THEN 100 ELSE h2m END AS h2m, w10, tp, row_number() OVER (PARTITION BY lonind, latind ORDER BY day) AS rn FROM
  (SELECT *, row_number() OVER (PARTITION BY lonind, latind, day ORDER BY loaded_at DESC, t2m DESC NULLS LAST, h2m DESC NULLS LAST, w10 DESC NULLS LAST, tp DESC NULLS LAST) AS k FROM m1) WHERE k = 1)"""
_STEP = """SELECT {key} lonind, latind, day, rn, ok,
  147.2 * (101.0 - s_f) / (59.5 + s_f) AS m_0, greatest(r - 0.5, 1e-12) AS rf,
  m_0 + 42.5 * rf * exp(-100.0 / greatest(251.0 - m_0, 1e-12)) * (1.0 - exp(-6.93 / rf)) AS m_w,
  CASE WHEN m_0 > 150.0 THEN m_w + 0.0015 * power(m_0 - 150.0, 2) * sqrt(rf) ELSE m_w END AS m_x,
  CASE WHEN r > 0.5 THEN least(m_x, 250.0) ELSE m_0 END AS m_1,
  0.942 * power(h, 0.679) + 11.0 * exp((h - 100.0) / 10.0) + 0.18 * (21.1 - t) * (1.0 - exp(-0.115 * h)) AS e_d,
  0.618 * power(h, 0.753) + 10.0 * exp((h - 100.0) / 10.0) + 0.18 * (21.1 - t) * (1.0 - exp(-0.115 * h)) AS e_w,
  (0.424 * (1.0 - power(h / 100.0, 1.7)) + 0.0694 * sqrt(w) * (1.0 - power(h / 100.0, 8))) * 0.581 * exp(0.0365 * t) AS k_d,
  (0.424 * (1.0 - power((100.0 - h) / 100.0, 1.7)) + 0.0694 * sqrt(w) * (1.0 - power((100.0 - h) / 100.0, 8))) * 0.581 * exp(0.0365 * t) AS k_w,
  CASE WHEN m_1 > e_d THEN e_d + (m_1 - e_d) / power(10.0, k_d) WHEN m_1 < e_d AND m_1 <= e_w THEN e_w - (e_w - m_1) / power(10.0, k_w) ELSE m_1 END AS m_2,
  greatest(0.0, least(101.0, 59.5 * (250.0 - m_2) / (147.2 + m_2))) AS n_f,
  1.894 * (greatest(t, -1.1) + 1.1) * (100.0 - h) * {le} * 1e-4 AS rk, 0.92 * r - 1.27 AS rw,
  CASE WHEN s_p <= 33.0 THEN 100.0 / (0.5 + 0.3 * s_p) WHEN s_p <= 65.0 THEN 14.0 - 1.3 * ln(greatest(s_p, 1e-12)) ELSE 6.2 * ln(greatest(s_p, 1e-12)) - 17.2 END AS b_,
  20.0 + 280.0 / exp(0.023 * s_p) + 1000.0 * rw / (48.77 + b_ * rw) AS mo,
  greatest(greatest(CASE WHEN r > 1.5 THEN 43.43 * (5.6348 - ln(greatest(mo - 20.0, 1e-12))) ELSE s_p END, 0.0) + rk, 1.0) AS n_p,
  CASE WHEN r > 2.8 THEN greatest(0.0, 400.0 * ln(800.0 / greatest(800.0 * exp(-s_d / 400.0) + 3.937 * (0.83 * r - 1.27), 1e-12))) ELSE s_d END AS d_1,
  d_1 + 0.5 * greatest(CASE WHEN t < -2.8 THEN 1.4 ELSE 0.36 * (t + 2.8) + 1.4 END, 0.0) AS n_d,
  147.2 * (101.0 - n_f) / (59.5 + n_f) AS m_3,
  19.115 * exp(-0.1386 * m_3) * (1.0 + power(m_3, 5.31) / 4.93e7) * exp(0.05039 * w) AS isi_,
  greatest(0.0, CASE WHEN n_p <= 0.4 * n_d THEN 0.8 * n_d * n_p / (n_p + 0.4 * n_d) ELSE n_p - (1.0 - 0.8 * n_d / (n_p + 0.4 * n_d)) * (0.92 + power(0.0114 * n_p, 1.7)) END) AS bui_,
  0.1 * isi_ * CASE WHEN bui_ <= 80.0 THEN 0.626 * power(bui_, 0.809) + 2.0 ELSE 1000.0 / (25.0 + 108.64 / exp(0.023 * bui_)) END AS bb,
  CASE WHEN bb <= 1.0 THEN bb ELSE exp(2.72 * power(0.434 * ln(greatest(bb, 1.0)), 0.647)) END AS fwi_,
  CASE WHEN ok THEN n_f ELSE s_f END AS c_f, CASE WHEN ok THEN n_p ELSE s_p END AS c_p, CASE WHEN ok THEN n_d ELSE s_d END AS c_d
  FROM (SELECT {wkey} wx.lonind, wx.latind, wx.day, wx.rn, (t2m + h2m + w10 + tp) IS NOT NULL AS ok, coalesce(t2m, 20.0) AS t, coalesce(h2m, 50.0) AS h, coalesce(w10, 0.0) AS w, coalesce(tp, 0.0) AS r, {state} FROM {source})"""
_PLAIN = {"key": "", "wkey": "", "le": "9.0"}
_FIRST = _STEP.format(**_PLAIN, state="85.0 AS s_f, 6.0 AS s_p, 15.0 AS s_d", source="wx WHERE wx.rn = 1")
_NEXT = _STEP.format(**_PLAIN, state="rec.c_f AS s_f, rec.c_p AS s_p, rec.c_d AS s_d", source="rec JOIN wx ON wx.lonind = rec.lonind AND wx.latind = rec.latind AND wx.rn = rec.rn + 1")
_KEEP = "lonind, latind, day, rn, ok, c_f, c_p, c_d, isi_, bui_, fwi_"
_MEMBER = {"key": "number, le,", "wkey": "wx.number, wx.le,", "le": "le"}
_MX = """mx AS (SELECT n AS number, lonind, latind, day, t2m + n * 0.5 AS t2m, h2m, w10, tp, rn, greatest(CASE WHEN x <= -1 THEN 24.0 WHEN x >= 1 THEN 0.0 ELSE degrees(acos(x)) / 7.5 END, 0) - 3.0 AS le
    FROM (SELECT *, -tan(radians(-13.0 + latind * 0.25)) * tan(radians(23.45 * sin(radians(360.0 * (283.0 + [15, 45, 75, 106, 136, 167, 197, 228, 258, 289, 319, 350][month(day)]) / 365.0)))) AS x FROM wx), (SELECT unnest([1, 2]) AS n))"""
_MFIRST = _STEP.format(**_MEMBER, state="85.0 AS s_f, 6.0 AS s_p, 15.0 AS s_d", source="mx AS wx WHERE wx.rn = 1")
_MNEXT = _STEP.format(**_MEMBER, state="rec.c_f AS s_f, rec.c_p AS s_p, rec.c_d AS s_d", source="rec JOIN mx AS wx ON wx.number = rec.number AND wx.lonind = rec.lonind AND wx.latind = rec.latind AND wx.rn = rec.rn + 1")
_FWI = f"WITH RECURSIVE {_INPUTS}, rec AS (SELECT {_KEEP} FROM ({_FIRST}) UNION ALL SELECT {_KEEP} FROM ({_NEXT}))"


@query(f"{_FWI} SELECT lonind, latind, day, {', '.join(f'CASE WHEN ok THEN round({c}, 4) END AS {n}' for c, n in zip(('c_f', 'c_p', 'c_d', 'isi_', 'bui_', 'fwi_'), ('ffmc', 'dmc', 'dc', 'isi', 'bui', 'fwi'), strict=True))} FROM rec")
def fwi_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six indices of every cell and day (W1 - W10, tropical tables)."""
    out = _fwi(spark, sf_dir)
    return out.select(*CELL, "day", *(F.round(c, 4).alias(c) for c in out.columns[3:]))


@query(f"{_FWI} SELECT lonind, latind, round(max_by(c_f, day), 4) AS ffmc, round(max_by(c_p, day), 4) AS dmc, round(max_by(c_d, day), 4) AS dc FROM rec WHERE ok GROUP BY lonind, latind")
def fwi_state_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State at the end of the archive, to hand over to a forecast."""
    return final_state(_fwi(spark, sf_dir), CELL).select(*CELL, *(F.round(c, 4).alias(c) for c in ("ffmc", "dmc", "dc")))


@query(f"{_FWI} SELECT lonind, latind, day, CASE WHEN ok THEN round(fwi_, 4) END AS fwi FROM rec WHERE day >= DATE '2019-07-01'")
def fwi_handover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The season from July 2019 on, started from the state of the archive before it (W11): equal to one unbroken run."""
    wx = daily_inputs(spark, sf_dir)
    args = (CELL, "day", "t2m", "h2m", "w10", "tp")
    before = final_state(fwi_daily(wx.where("day < DATE '2019-07-01'"), *args), CELL)
    return fwi_daily(wx.where("day >= DATE '2019-07-01'"), *args, initial_state=before).select(*CELL, "day", F.round("fwi", 4).alias("fwi"))


@query(f"WITH RECURSIVE {_INPUTS}, {_MX}, rec AS (SELECT number, {_KEEP} FROM ({_MFIRST}) UNION ALL SELECT number, {_KEEP} FROM ({_MNEXT})) SELECT lonind, latind, day, round(avg(CASE WHEN ok THEN fwi_ END), 4) AS fwi_mean FROM rec GROUP BY ALL")
def fwi_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recurrence for each member of an ensemble (W12), day lengths by latitude."""
    wx = daily_inputs(spark, sf_dir).withColumn("number", F.explode(F.array(F.lit(1), F.lit(2))))
    wx = wx.withColumns({"t2m": F.col("t2m") + F.col("number") * 0.5, "lat": -13.0 + F.col("latind") * 0.25})
    out = fwi_daily(wx, ["number", *CELL], "day", "t2m", "h2m", "w10", "tp", mode="latitude", lat="lat")
    return out.groupBy(*CELL, "day").agg(F.round(F.avg("fwi"), 4).alias("fwi_mean"))


_KELVIN = "CASE unit WHEN 'C' THEN {v} + 273.15 WHEN 'F' THEN ({v} + 459.67) * (5.0 / 9) ELSE {v} END"


@query(f"""WITH {_UNITS}, k AS (SELECT c.obs_id, unit, c.t2m, CASE WHEN NOT isnan(d2m) THEN d2m END AS d2m, CASE WHEN NOT isnan(u10) AND abs(u10) < 900 THEN u10 END AS u10, CASE WHEN NOT isnan(v10) AND abs(v10) < 900 THEN v10 END AS v10
    FROM clim_dataset c LEFT JOIN case_ x ON x.obs_id = c.obs_id AND x.table_name = 'clim_dataset' AND x.field = 't2m'),
  m AS (SELECT obs_id, CASE WHEN unit IS NOT NULL THEN {_KELVIN.format(v="t2m")} - 273.15 END AS t, CASE WHEN unit IS NOT NULL AND {_KELVIN.format(v="d2m")} BETWEEN 180 AND 345 THEN {_KELVIN.format(v="d2m")} - 273.15 END AS d, u10, v10 FROM k)
  SELECT obs_id, round(100.0 * exp(17.625 * d / (243.04 + d)) / exp(17.625 * t / (243.04 + t)), 4) AS rh, round(sqrt(u10 * u10 + v10 * v10), 4) AS wind, round(t, 4) AS t_c FROM m""")
def rel_humidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative humidity, wind speed and Celsius of every row, in whatever unit it came; the dew point has the temperature's."""
    d = table(spark, sf_dir, "clim_dataset").select("obs_id", "feed", "time", "t2m", "d2m", "u10", "v10", "remark")
    d = with_source_units(d, table(spark, sf_dir, "feeds"), "feed", "time", "valid_from", "description", [T2M])
    d = with_units(d.drop("feed", "time"), T2M, "t2m", stated_in_remark(T2M, "remark"), F.col("t2m_source_unit"))
    dew = finite("d2m")
    kelvin = None
    for u in T2M.units:
        kelvin = F.when(F.col("t2m_unit") == u.name, u.to_nominal(dew)) if kelvin is None else kelvin.when(F.col("t2m_unit") == u.name, u.to_nominal(dew))
    d = d.withColumns({"d": F.when(kelvin.between(T2M.low, T2M.high), kelvin), "u": F.when(F.abs(finite("u10")) < 900, F.col("u10")), "v": F.when(F.abs(finite("v10")) < 900, F.col("v10"))})
    return d.select("obs_id", F.round(relative_humidity("t2m_nominal", "d"), 4).alias("rh"), F.round(wind_speed("u", "v"), 4).alias("wind"), F.round(to_celsius("t2m_nominal"), 4).alias("t_c"))


_CLEAN_TP = "CASE WHEN NOT isnan(tp) AND tp >= 0 AND tp < 2000 THEN tp END"


@query(f"""SELECT feed, latitude, longitude, time_bucket(INTERVAL '24 hours', time - INTERVAL '1 microsecond', TIMESTAMP '2000-01-01 07:00:00') + INTERVAL '24 hours' AS day_end,
  round(sum({_CLEAN_TP} * 1000), 4) AS tp, round(max(CASE WHEN NOT isnan(u10) THEN u10 END), 4) AS u_max FROM clim_dataset GROUP BY ALL""")
def daily_precip_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 h sums and maxima to 07:00, closed and labelled on the right (A1, A2)."""
    d = table(spark, sf_dir, "clim_dataset")
    return R.resample_daily(d, ["feed", "latitude", "longitude"], "time", {"tp": F.round(F.sum(to_mm(usable("tp"))), 4), "u_max": F.round(F.max(finite("u10")), 4)})


_DOUBLES = ["fwi_med", "ffmc_med", "dc_med", "t2m_med", "h2m_med", "w10_med", "tp_med"]
_ALL = ", ".join(f"CASE WHEN NOT isnan({c}) AND {c} >= 0 AND {c} < 2000 THEN {c} END AS {c[:-4]}" for c in _DOUBLES)
_ORDER = ", ".join(f"{c[:-4]} DESC NULLS LAST" for c in _DOUBLES)
_DAILY = f"""a0 AS (SELECT lonind, latind, date, loaded_at, {_ALL} FROM fwi_fire),
a1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lonind, latind, date ORDER BY loaded_at DESC, {_ORDER}) AS k FROM a0) WHERE k = 1)"""


def daily_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_rows(table(spark, sf_dir, "fwi_fire"), [*CELL, "date"], "loaded_at", {c[:-4]: usable(c) for c in _DOUBLES})


def _bundle_sql() -> str:
    vs = list(R.BUNDLE)
    seven = ", ".join(f"avg({v}) OVER w7 AS {v}__7" for v in [*vs, "tp"])
    aggs = ", ".join([*(f"median({v}) AS {v}_med, quantile_cont({v}, 0.75) AS {v}_75p, max({v}__7) AS {v}_7mm" for v in vs), "sum(tp) AS tp_sum, min(tp__7) AS tp_7dmin"])
    outs = [f"round({v}_{s}, 4) AS {v}_{s}" for v in vs for s in ("med", "75p", "7mm")] + ["round(tp_sum, 4) AS tp_sum", "round(tp_7dmin, 4) AS tp_7dmin"]
    outs += [f"round(sum({v}_med) OVER w3, 4) AS {v}_3sum" for v in vs] + ["round(sum(tp_sum) OVER w3, 4) AS tp_3sum"]
    outs += [f"round(lag({c}, {k}) OVER w, 4) AS {v}_{k}" for v, c in (("tp", "tp_sum"), ("t2m", "t2m_med"), ("w10", "w10_med"), ("h2m", "h2m_med")) for k in range(1, 6)]
    return f"""WITH {_DAILY}, a2 AS (SELECT *, {seven} FROM a1 WINDOW w7 AS (PARTITION BY lonind, latind ORDER BY date ROWS 6 PRECEDING)),
    a3 AS (SELECT lonind, latind, last_day(date) AS date, {aggs} FROM a2 GROUP BY ALL)
    SELECT lonind, latind, date, {", ".join(outs)} FROM a3 WINDOW w AS (PARTITION BY lonind, latind ORDER BY date), w3 AS (PARTITION BY lonind, latind ORDER BY date ROWS 2 PRECEDING)"""


@query(_bundle_sql())
def monthly_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly bundle: medians, percentiles, 7-day extremes, 3-month sums, lags (M-FEAT; A4, A5, N1, N2, N5)."""
    out = R.monthly_features(daily_indices(spark, sf_dir), CELL, "date")
    return out.select(*CELL, "date", *(F.round(c, 4).alias(c) for c in out.columns[3:]))


@query(f"WITH {_DAILY} SELECT lonind, latind, CAST(dayofyear(date) AS INT) AS doy, round(avg(fwi), 4) AS fwi, round(avg(dc), 4) AS dc FROM a1 GROUP BY ALL")
def doy_climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day-of-year climatology."""
    out = R.climatology(daily_indices(spark, sf_dir), CELL, F.dayofyear("date"), ["fwi", "dc"], "doy")
    return out.select(*CELL, "doy", F.round("fwi", 4).alias("fwi"), F.round("dc", 4).alias("dc"))


@query(f"""WITH {_DAILY}, c AS (SELECT lonind, latind, dayofyear(date) AS doy, avg(fwi) AS fwi FROM a1 GROUP BY ALL), d AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2020-01-01', TIMESTAMP '2020-12-31', INTERVAL 1 DAY)) AS DATE) AS day)
  SELECT lonind, latind, day, round(fwi, 4) AS fwi FROM c JOIN d ON dayofyear(day) = doy""")
def calendar_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The climatology laid out over the days of 2020."""
    clim = R.climatology(daily_indices(spark, sf_dir), CELL, F.dayofyear("date"), ["fwi"], "doy")
    return R.expand_climatology(clim, CELL, "2020-01-01", "2020-12-31").select(*CELL, "day", F.round("fwi", 4).alias("fwi"))


@query(f"""WITH {_DAILY}, m AS (SELECT lonind, latind, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, CAST(sum(CAST(fwi AS DECIMAL(18, 1))) AS DOUBLE) / nullif(count(fwi), 0) AS mean FROM a1 GROUP BY ALL)
  SELECT lonind, latind, year, month, round(mean + 1e-9, 4) AS mean, round(mean - avg(mean) OVER (PARTITION BY lonind, latind, month) + 1e-9, 4) AS anomaly FROM m""")
def anomaly_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly means against their climatology."""
    out = R.anomalies(daily_indices(spark, sf_dir), CELL, "date", "fwi", decimals=1)
    # means of one-decimal values often end in a half: moved a little, no tie decides the rounding
    return out.select(*CELL, "year", "month", *(F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("mean", "anomaly")))


@query("SELECT cell, mind, avg(v) AS mean, median(v) AS med FROM v_ensemble GROUP BY cell, mind".replace("avg(v) AS mean", "round(avg(v), 6) AS mean"))
def ensemble_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and median over the members."""
    return view(spark, sf_dir, "v_ensemble").groupBy("cell", "mind").agg(F.round(F.avg("v"), 6).alias("mean"), F.median("v").alias("med"))


@query("SELECT cell, CAST(month(day) AS INT) AS month, round(avg(n), 6) AS mean_count FROM (SELECT cell, date_trunc('month', day) AS day, count(*) AS n FROM v_series_long GROUP BY ALL) GROUP BY ALL")
def month_counts_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per year and month, then the mean over the years with any."""
    per = view(spark, sf_dir, "v_series_long").groupBy("cell", F.year("day").alias("year"), F.month("day").alias("month")).count()
    return per.groupBy("cell", "month").agg(F.round(F.avg("count"), 6).alias("mean_count"))


@query("SELECT cell, CAST(year(day) AS INT) AS year, sum(nullif(v, 0)) AS total, round(avg(nullif(v, 0)), 6) AS mean, quantile_cont(nullif(v, 0), 0.25) AS q25, quantile_cont(nullif(v, 0), 0.75) AS q75 FROM v_series_long GROUP BY ALL")
def yearly_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly sum, mean and quartiles with zeros masked."""
    v = F.nullif("v", F.lit(0.0))
    return view(spark, sf_dir, "v_series_long").groupBy("cell", F.year("day").alias("year")).agg(F.sum(v).alias("total"), F.round(F.avg(v), 6).alias("mean"), F.percentile(v, F.lit(0.25)).alias("q25"), F.percentile(v, F.lit(0.75)).alias("q75"))


@query("SELECT day, round(avg(v), 6) AS region_mean, sum(v) AS region_sum FROM v_series_long GROUP BY day")
def region_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over all cells (A10)."""
    return view(spark, sf_dir, "v_series_long").groupBy("day").agg(F.round(F.avg("v"), 6).alias("region_mean"), F.sum("v").alias("region_sum"))


@query("SELECT cell, max(m) AS max_month, max_by(v, day) - min_by(v, day) AS last_minus_first FROM (SELECT cell, day, v, sum(v) OVER (PARTITION BY cell, date_trunc('month', day)) AS m FROM v_series_long) GROUP BY cell")
def month_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest monthly sum, and last minus first of an accumulated field."""
    s = view(spark, sf_dir, "v_series_long")
    per = s.groupBy("cell", F.trunc("day", "month").alias("m")).agg(F.sum("v").alias("s")).groupBy("cell").agg(F.max("s").alias("max_month"))
    ends = s.groupBy("cell").agg((F.max_by("v", "day") - F.min_by("v", "day")).alias("last_minus_first"))
    return per.join(ends, "cell")


@query("SELECT cell, day, v - coalesce(lag(v) OVER w, 0) AS step FROM v_series_long WINDOW w AS (PARTITION BY cell ORDER BY day)")
def deaccumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of an accumulated field, first kept."""
    return view(spark, sf_dir, "v_series_long").select("cell", "day", R.deaccumulate("v", ["cell"], "day").alias("step"))


@query("""WITH m AS (SELECT cell, last_day(day) AS date, sum(v) AS v FROM v_series_long GROUP BY ALL)
  SELECT cell, date, v, sum(v) OVER w3 AS sum3, CASE WHEN count(v) OVER w3 >= 2 THEN sum(v) OVER w3 END AS sum3_of_2, sum(v) OVER (PARTITION BY cell ORDER BY date ROWS UNBOUNDED PRECEDING) AS cum,
    sum(v) OVER (PARTITION BY cell ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cum_before, lag(v) OVER w AS lag1, lag(v, 5) OVER w AS lag5, lead(v) OVER w AS lead1, row_number() OVER w AS rank
  FROM m WINDOW w AS (PARTITION BY cell ORDER BY date), w3 AS (PARTITION BY cell ORDER BY date ROWS 2 PRECEDING)""")
def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling, cumulative, shifted and ranked monthly values."""
    from pyspark.sql import Window

    m = R.monthly(view(spark, sf_dir, "v_series_long"), ["cell"], "day", {"v": F.sum("v")})
    w = Window.partitionBy("cell").orderBy("date")
    cum = w.rowsBetween(Window.unboundedPreceding, 0)
    return m.select(
        "cell", "date", "v", R.rolling("v", ["cell"], "date", 3, "sum").alias("sum3"), R.rolling("v", ["cell"], "date", 3, "sum", 2).alias("sum3_of_2"), F.sum("v").over(cum).alias("cum"),
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("cum_before"), F.lag("v").over(w).alias("lag1"), F.lag("v", 5).over(w).alias("lag5"), F.lead("v").over(w).alias("lead1"), F.row_number().over(w).alias("rank"),
    )


@query("""WITH d AS (SELECT cell, day, v, sum(v) OVER (PARTITION BY cell ORDER BY day ROWS 2 PRECEDING) AS s3, avg(v) OVER (PARTITION BY cell ORDER BY day ROWS 6 PRECEDING) AS m7 FROM v_series_long)
  SELECT cell, last_day(day) AS date, sum(s3) AS s3_sum, round(max(m7), 6) AS m7_max, round(min(m7), 6) AS m7_min FROM d GROUP BY ALL""")
def rolling_then_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rolling sums and means, then monthly sums and extremes."""
    d = view(spark, sf_dir, "v_series_long").withColumns({"s3": R.rolling("v", ["cell"], "day", 3, "sum"), "m7": R.rolling("v", ["cell"], "day", 7)})
    return R.monthly(d, ["cell"], "day", {"s3_sum": F.sum("s3"), "m7_max": F.round(F.max("m7"), 6), "m7_min": F.round(F.min("m7"), 6)})


_OBS, _FC = "day <= DATE '2000-06-30'", "day >= DATE '2000-06-25'"


@query(f"""SELECT cell, day, v, 'obs' AS origin FROM v_series_long o WHERE day BETWEEN DATE '1999-12-30' AND DATE '2000-06-30' AND NOT EXISTS (SELECT 1 FROM v_series_long f WHERE f.cell = o.cell AND f.day = o.day AND f.{_FC})
  UNION ALL SELECT cell, day, v, 'fc' FROM v_series_long WHERE {_FC}""")
def stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations up to the start, then the forecast; days in both are the forecast's."""
    s = view(spark, sf_dir, "v_series_long").select("cell", "day", "v")
    return R.stitch(s.where(_OBS), s.where(_FC), ["cell"], "day", "2000-06-30")


@query("SELECT cell, day, v FROM (SELECT cell, day, v, row_number() OVER (PARTITION BY cell ORDER BY day) AS rn FROM v_series_long) WHERE (rn - 1) % 6 = 0")
def stride_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sixth step of each cell."""
    return R.every_nth(view(spark, sf_dir, "v_series_long").select("cell", "day", "v"), ["cell"], "day", 6)


@query("WITH s AS (SELECT min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS z FROM events) SELECT lonind, latind, date FROM fwi_fire, s WHERE date BETWEEN DATE '2019-01-01' AND DATE '2019-12-31' AND date + INTERVAL 5 YEAR BETWEEN a AND z")
def time_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice of the index archive within the days that another series spans."""
    long = table(spark, sf_dir, "fwi_fire").where(F.col("date").between("2019-01-01", "2019-12-31")).select(*CELL, "date", F.add_months("date", 60).alias("moved"))
    short = table(spark, sf_dir, "events").select(F.to_date("ts").alias("moved"))
    return R.overlap(long, short, "moved").drop("moved")


@query("SELECT obs_id, CAST(hour(time) AS INT) AS hour FROM clim_dataset WHERE (hour(time) = 7 AND minute(time) = 0 AND second(time) = 0) OR hour(time) IN (6, 12)")
def hour_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows at exactly 07:00, or in the hours 6 and 12."""
    h = F.hour("time")
    exact = (h == 7) & (F.minute("time") == 0) & (F.second("time") == 0)
    return table(spark, sf_dir, "clim_dataset").where(exact | h.isin(6, 12)).select("obs_id", h.alias("hour"))


@query("""SELECT row_id, CAST(datediff('day', DATE '2002-01-01', CAST(date AS DATE)) AS INT) AS day_index, CAST((year(date) - 2002) * 12 + month(date) AS INT) AS mind, last_day(CAST(date AS DATE)) AS mend,
  CAST(year(date) AS INT) AS y, CAST(month(date) AS INT) AS m, CAST(day(date) AS INT) AS d, CAST(hour(date) AS INT) AS h, CAST(dayofyear(date) AS INT) AS doy, CAST(day(last_day(CAST(date AS DATE))) AS INT) AS dim, CAST(date_trunc('day', date) AS DATE) AS midnight, strftime(date, '%Y%j') AS code FROM firedata""")
def time_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day and month indices, month ends, calendar parts."""
    d = F.col("date")
    mind = R.month_index(F.year(d), F.month(d), 2002)
    return table(spark, sf_dir, "firedata").select(
        "row_id", day_index("date").alias("day_index"), mind.alias("mind"), R.month_index_date(mind).alias("mend"), F.year(d).alias("y"), F.month(d).alias("m"), F.dayofmonth(d).alias("d"), F.hour(d).alias("h"),
        F.dayofyear(d).alias("doy"), F.dayofmonth(F.last_day(d)).alias("dim"), F.to_date(F.date_trunc("day", d)).alias("midnight"), F.date_format(d, "yyyyDDD").alias("code"),
    )


_DL = "-tan(radians(lat)) * tan(radians(23.45 * sin(radians(360.0 * (283.0 + doy) / 365.0))))"


@query(f"""WITH g AS (SELECT l.k AS k, -90.0 + l.k AS lat, m.month, [15, 45, 75, 106, 136, 167, 197, 228, 258, 289, 319, 350][m.month] AS doy FROM (SELECT unnest(range(181)) AS k) l, (SELECT unnest(range(1, 13)) AS month) m)
  SELECT CAST(lat AS DOUBLE) AS lat, CAST(month AS INT) AS month, round(CASE WHEN {_DL} <= -1 THEN 24.0 WHEN {_DL} >= 1 THEN 0.0 ELSE degrees(acos({_DL})) / 7.5 END, 4) AS hours,
    round(CASE WHEN {_DL} <= -1 THEN 24.0 WHEN {_DL} >= 1 THEN 0.0 ELSE degrees(acos({_DL})) / 7.5 END - 3.0, 4) AS effective FROM g""")
def day_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day length and effective day length by latitude and month."""
    from ..functions.met import MID_MONTH_DAYS

    g = spark.range(181).select((F.col("id") - 90.0).alias("lat"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    doy = F.element_at(F.array(*(F.lit(float(d)) for d in MID_MONTH_DAYS)), F.col("month"))
    return g.select("lat", "month", F.round(day_length(doy, F.col("lat")), 4).alias("hours"), F.round(effective_day_length(F.col("month"), F.col("lat")), 4).alias("effective"))


@query("""SELECT obs_id, CASE WHEN NOT isnan(h2m) AND h2m > 0 AND h2m <= 1100 THEN least(h2m, 100.0) END AS rh, CASE WHEN NOT isnan(tp) AND tp NOT IN (-9999, -999, 9999) THEN greatest(tp, 0) ELSE 0 END AS rain, CASE WHEN tp > 10 AND NOT isnan(tp) AND tp < 2000 THEN 1 ELSE 0 END AS wet FROM fwi_climatology""")
def clamp_and_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clamps, missing values to zero, indicator columns."""
    from ..functions.clean import null_if_in

    rain = null_if_in("tp", (-9999, -999, 9999))
    rh = usable("h2m", 1e-12, 1100.000001)  # least() alone would turn a missing value into 100
    return table(spark, sf_dir, "fwi_climatology").select(
        "obs_id", F.when(rh.isNotNull(), F.least(rh, F.lit(100.0))).alias("rh"), F.coalesce(F.greatest(rain, F.lit(0.0)), F.lit(0.0)).alias("rain"), (F.coalesce(usable("tp"), F.lit(0.0)) > 10).cast("int").alias("wet")
    )


@query("SELECT cell, " + ", ".join(f"round(avg(CASE WHEN month(day) = {m} THEN v END), 6) AS v_{m}" for m in range(1, 13)) + " FROM v_series_long GROUP BY cell")
def dense_pivot_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide features: one column of means per month (A20, L18's inverse)."""
    out = view(spark, sf_dir, "v_series_long").withColumn("m", F.month("day")).groupBy("cell").pivot("m", list(range(1, 13))).agg(F.avg("v"))
    return out.select("cell", *(F.round(F.col(str(m)), 6).alias(f"v_{m}") for m in range(1, 13)))


@query(f"WITH {_FIRE_ROWS} SELECT o.lonind, o.latind, o.date, o.dc_med, p.dc_med AS dc_before FROM c o LEFT JOIN c p ON o.lonind = p.lonind AND o.latind = p.latind AND p.date = o.date - 365")
def same_day_last_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left equi-join on cell and date."""
    from .problems import current_indices

    c = current_indices(spark, sf_dir).select(*CELL, "date", "dc_med")
    before = c.select(*CELL, F.date_add("date", 365).alias("date"), F.col("dc_med").alias("dc_before"))
    return c.join(before, [*CELL, "date"], "left")


@query("SELECT cell, CAST(date_trunc('month', CAST(day AS TIMESTAMP) - INTERVAL 1 MICROSECOND) AS DATE) AS month, median(v) AS med FROM v_series_long GROUP BY ALL")
def month_start_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly medians labelled by the month's first day, months closed on the right."""
    return view(spark, sf_dir, "v_series_long").groupBy("cell", R.month_bin_start("day").alias("month")).agg(F.median("v").alias("med"))


_RUNS = "runs AS (SELECT cell, day, v + k AS v, CAST(date_trunc('month', day) - k * INTERVAL 1 MONTH AS DATE) AS run FROM v_series_long, (SELECT unnest([0, 1]) AS k) UNION ALL SELECT cell, day, v - 1, CAST(date_trunc('month', day) + INTERVAL 1 MONTH AS DATE) FROM v_series_long WHERE day = last_day(day))"


@query(f"""WITH {_RUNS} SELECT cell, day, v, run FROM runs WHERE last_day(run) > DATE '2000-02-15' AND last_day(run) <= DATE '2000-06-01' AND day BETWEEN run - 1 AND CAST(run + INTERVAL 1 MONTH AS DATE)""")
def bridge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months between the observations and a forecast, each from the run that started with it."""
    s = view(spark, sf_dir, "v_series_long").select("cell", "day", "v")
    runs = s.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select("cell", "day", (F.col("v") + F.col("k")).alias("v"), F.add_months(F.trunc("day", "month"), -F.col("k")).alias("run"))
    eve = s.where(F.col("day") == F.last_day("day")).select("cell", "day", F.col("v") - 1, F.add_months(F.trunc("day", "month"), 1))
    return R.bridge(runs.union(eve), "run", "day", "2000-02-15", "2000-06-01")


_DAYS = range(31)


@query("SELECT cell, " + ", ".join(f"round(avg(v) FILTER (day = DATE '2000-01-01' + {i}), 6) AS v_{i}" for i in _DAYS) + " FROM v_series_long GROUP BY cell")
def daily_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide features: a column of means for each day of a forecast's first month."""
    d = view(spark, sf_dir, "v_series_long").withColumn("k", F.datediff("day", F.lit("2000-01-01").cast("date")))
    out = d.groupBy("cell").pivot("k", list(_DAYS)).agg(F.avg("v"))
    return out.select("cell", *(F.round(F.col(str(i)), 6).alias(f"v_{i}") for i in _DAYS))
