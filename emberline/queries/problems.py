"""Queries of the general problems over the project's tables: p1, p3, p4 and p6."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clean import current_rows, day_index, finite, usable
from ..functions.geo import open_cell, position_degrees
from ..operators.regular import daily_grid
from ..operators.rolling import trailing_totals
from ..operators.spatial import inside_regions
from ..operators.units import H2M, T2M, TP, Recorded, in_common_units, stated_in_remark, with_source_units, with_units
from .tables import table

CELL = ["lonind", "latind"]
INDICES = ["tp_med", "dc_med", "fwi_med"]


def current_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current row of each fwi_fire cell and day, usable values only."""
    return current_rows(table(spark, sf_dir, "fwi_fire"), [*CELL, "date"], "loaded_at", {v: usable(v) for v in INDICES})


def p1_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, counts and averages over 7 and 30 days for every cell and calendar day."""
    out = trailing_totals(current_indices(spark, sf_dir), CELL, "date", INDICES, (7, 30))
    measures = [F.round(c, 6).alias(c) if "_cnt_" not in c else F.col(c).cast("long").alias(c) for c in out.columns[3:]]
    return out.select(*CELL, day_index("date").alias("day_since"), *measures)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which a trailing total or average is beyond its threshold."""
    r = trailing_totals(current_indices(spark, sf_dir), CELL, "date", INDICES, (7, 30))
    kinds = {
        "wet7": F.col("tp_med_sum_7") > 150.05,
        "dry30": (F.col("tp_med_sum_30") < 10.05) & (F.col("tp_med_cnt_30") >= 20),
        "dc30": (F.col("dc_med_avg_30") > 700.0333) & (F.col("dc_med_cnt_30") >= 20),
        "fwi7": (F.col("fwi_med_avg_7") > 30.0333) & (F.col("fwi_med_cnt_7") >= 4),
    }
    hits = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in kinds.items())))
    return r.select(*CELL, day_index("date").alias("day_since"), F.explode(hits).alias("kind"))


def frp_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with a position and a finite frp above 0, in their cells."""
    lon, lat = position_degrees()
    d = table(spark, sf_dir, "firedata").select(lon.alias("lon"), lat.alias("lat"), finite("frp").alias("frp"), "date").where("lon IS NOT NULL AND frp > 0")
    i, j = open_cell("lon", "lat")
    return d.select(i.alias("lonind"), j.alias("latind"), "date", "frp")


def p3_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily frp series of every cell: readings, filled days and uncovered days."""
    g = daily_grid(frp_readings(spark, sf_dir), CELL, "date", "frp", 10, counter=False)
    return g.select(*CELL, day_index("day").alias("day_since"), "n_readings", F.round("amount", 3).alias("frp_amount"), "status")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days without a reading to which an interval of at most 10 days gives a share of its increment (each is above 0)."""
    g = daily_grid(frp_readings(spark, sf_dir), CELL, "date", "frp", 10, counter=False)
    return g.where("status = 'filled' AND amount > 0").select(*CELL, day_index("day").alias("day_since"))


def p3_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each day of the series is: a reading, filled or uncovered."""
    return p3_series(spark, sf_dir).select(*CELL, "day_since", "status")


def _read_as_counter(spark: SparkSession, sf_dir: str, *restart: Column) -> DataFrame:
    """Each detection of a cell as a reading of a counter of detections, which starts anew with each value of ``restart``.

    The days before are added up per day and the readings of a day numbered,
    so no window holds more than a day's readings or a cell's days.
    """
    r = frp_readings(spark, sf_dir).withColumn("d", F.to_date("date"))
    per = r.groupBy(*CELL, "d").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*CELL, *restart).orderBy("d").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select(*CELL, "d", F.coalesce(before, F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy(*CELL, "d").orderBy("date", "frp"))
    return r.withColumn("number", number).join(per, [*CELL, "d"]).select(*CELL, "date", (F.col("before") + F.col("number")).alias("total"))


def _counted(readings: DataFrame) -> DataFrame:
    g = daily_grid(readings, CELL, "date", "total", 10)
    return g.select(*CELL, day_index("day").alias("day_since"), "n_readings", F.round("amount", 3).alias("detections"), "status")


def p3_accumulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counter form of the operator: a cell's detections so far, read at each detection, spread back over the days."""
    return _counted(_read_as_counter(spark, sf_dir))


def p3_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a counter that starts anew each year: resets are found and counted from zero."""
    return _counted(_read_as_counter(spark, sf_dir, F.year("d")))


def _weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    clim = table(spark, sf_dir, "clim_dataset").select("obs_id", "feed", "time", "t2m", "tp", "remark")
    clim = with_source_units(clim, table(spark, sf_dir, "feeds"), "feed", "time", "valid_from", "description", [T2M, TP])
    return in_common_units(clim.drop("feed", "time"), [Recorded(q, q.field, stated_in_remark(q, "remark"), F.col(f"{q.field}_source_unit")) for q in (T2M, TP)])


def _humidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_units(table(spark, sf_dir, "fwi_climatology").select("obs_id", "h2m", "remark"), H2M, "h2m", stated_in_remark(H2M, "remark"))


def _case(name: str, field: str, wanted: Column, *extra: Column) -> Column:
    """A struct of the result's columns, NULL where the value isn't wanted."""
    return F.when(wanted, F.struct(F.lit(name).alias("table_name"), "obs_id", F.lit(field).alias("field"), F.col(f"{field}_unit").alias("unit"), *extra))


def _rows(df: DataFrame, *cases: Column) -> DataFrame:
    return df.select(F.explode(F.array_compact(F.array(*cases))).alias("case")).select("case.*")


def p4_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every measured value in its common unit, with the unit it was recorded in and how that is known."""

    def case(name: str, f: str) -> Column:
        return _case(name, f, F.col(f"{f}_unit").isNotNull(), F.col(f"{f}_by").alias("known_by"), F.col(f"{f}_uncertain").alias("uncertain"), F.round(f"{f}_nominal", 6).alias("common"))

    clim = _rows(_weather(spark, sf_dir), case("clim_dataset", "t2m"), case("clim_dataset", "tp"))
    return clim.unionByName(_rows(_humidity(spark, sf_dir), case("fwi_climatology", "h2m")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that aren't in the nominal unit of their column, with their unit."""
    clim = _rows(_weather(spark, sf_dir), _case("clim_dataset", "t2m", F.col("t2m_unit") != "K"), _case("clim_dataset", "tp", (F.col("tp_unit") != "m") & (F.col("tp") != 0)))
    return clim.unionByName(_rows(_humidity(spark, sf_dir), _case("fwi_climatology", "h2m", (F.col("h2m_unit") != "%") & (F.col("h2m") != 0))))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = position_degrees()
    return table(spark, sf_dir, "firedata").select("row_id", "labs8", lon.alias("lon"), lat.alias("lat")).where("lon IS NOT NULL")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heat sites whose area a detection lies in."""
    return inside_regions(_placed(spark, sf_dir), "row_id", "lon", "lat", table(spark, sf_dir, "heat_sites"), "site_id").select("row_id", "site_id")


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labs8 groups that touch a heat site, with their size and the detections inside: those to set aside."""
    placed = _placed(spark, sf_dir)
    hit = p6_found(spark, sf_dir).select("row_id").distinct()
    marked = placed.where("labs8 IS NOT NULL").join(hit.withColumn("hit", F.lit(1)), "row_id", "left")
    per = marked.groupBy("labs8").agg(F.count("*").alias("n_rows"), F.count("hit").alias("n_inside"))
    return per.where("n_inside > 0")


QUERIES = {
    "p1_found": p1_found,
    "p1_rolling": p1_rolling,
    "p3_found": p3_found,
    "p3_series": p3_series,
    "p3_status": p3_status,
    "p3_accumulated": p3_accumulated,
    "p3_counter": p3_counter,
    "p4_found": p4_found,
    "p4_values": p4_values,
    "p6_found": p6_found,
    "p6_groups": p6_groups,
}

_USABLE = "CASE WHEN NOT isnan({c}) AND {c} >= 0 AND {c} < 2000 THEN {c} END"
_FIRE_ROWS = f"""
u AS (SELECT lonind, latind, date, loaded_at, {_USABLE.format(c="tp_med")} AS tp_med, {_USABLE.format(c="dc_med")} AS dc_med, {_USABLE.format(c="fwi_med")} AS fwi_med FROM fwi_fire),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lonind, latind, date ORDER BY loaded_at DESC, tp_med DESC NULLS LAST, dc_med DESC NULLS LAST, fwi_med DESC NULLS LAST) AS rn FROM u) WHERE rn = 1),
b AS (SELECT lonind, latind, min(date) AS a, max(date) AS z FROM c GROUP BY lonind, latind),
k AS (SELECT lonind, latind, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM b),
j AS (SELECT k.lonind, k.latind, k.date, tp_med, dc_med, fwi_med FROM k LEFT JOIN c USING (lonind, latind, date)),
w AS (SELECT lonind, latind, CAST(datediff('day', DATE '2002-01-01', date) AS INTEGER) AS day_since, {", ".join(f"coalesce(sum({v}) OVER w{n}, 0) AS {v}_sum_{n}, count({v}) OVER w{n} AS {v}_cnt_{n}, avg({v}) OVER w{n} AS {v}_avg_{n}" for v in INDICES for n in (7, 30))}
  FROM j WINDOW w7 AS (PARTITION BY lonind, latind ORDER BY date ROWS 6 PRECEDING), w30 AS (PARTITION BY lonind, latind ORDER BY date ROWS 29 PRECEDING))"""
_POSITIONS = """
pos AS (SELECT row_id, labs8, frp, date,
  CASE WHEN ok THEN longitude WHEN abs(x * x + y * y + z * z - 1) < 1e-6 THEN degrees(atan2(y, x)) END AS lon,
  CASE WHEN ok THEN latitude WHEN abs(x * x + y * y + z * z - 1) < 1e-6 THEN degrees(asin(z)) END AS lat
  FROM (SELECT *, coalesce(NOT isnan(longitude) AND NOT isnan(latitude) AND longitude BETWEEN -180 AND 180 AND latitude BETWEEN -90 AND 90, false) AS ok FROM firedata))"""
_READING_DAYS = """
d AS (SELECT CAST(floor((lon - 92.875) / 0.25) AS INTEGER) AS lonind, CAST(floor((lat + 13.125) / 0.25) AS INTEGER) AS latind, CAST(datediff('day', DATE '2002-01-01', CAST(date AS DATE)) AS INTEGER) AS day_since, count(*) AS n
  FROM pos WHERE lon IS NOT NULL AND NOT isnan(frp) AND NOT isinf(frp) AND frp > 0 GROUP BY ALL),
g AS (SELECT *, lead(day_since) OVER (PARTITION BY lonind, latind ORDER BY day_since) AS nx FROM d)"""
_INSIDE = """
hit AS (SELECT row_id, site_id FROM pos, heat_sites h WHERE lon IS NOT NULL AND CASE WHEN shape = 'circle'
  THEN 2 * 6371.0 * asin(sqrt(least(1, power(sin(radians(h.latitude - lat) / 2), 2) + cos(radians(lat)) * cos(radians(h.latitude)) * power(sin(radians(h.longitude - lon) / 2), 2)))) <= radius_km
  ELSE lon > west AND lon < east AND lat > south AND lat < north END)"""
_REMARK = r"regexp_replace(lower(remark), '[^;,/]*\b(was|before|checked against)\b[^;,/]*', ' ', 'g')"
_UNITS = rf"""
r AS (SELECT obs_id, time, feed, t2m, tp, {_REMARK} AS m FROM clim_dataset),
f AS (SELECT feed, valid_from, lead(valid_from) OVER (PARTITION BY feed ORDER BY valid_from) AS valid_to, lower(description) AS txt FROM feeds),
j AS (SELECT r.*,
  CASE WHEN regexp_matches(m, 'fahrenheit|°f|degf|temp\.f|temp [0-9.]+ f|grados f\b') THEN 'F' WHEN regexp_matches(m, 'celsius|centigrad|°c|degc|temp [0-9.]+ c') THEN 'C' WHEN regexp_matches(m, 'kelvin|t2m in k|temp [0-9.]+ k') THEN 'K' END AS t_said,
  CASE WHEN regexp_matches(m, '(tp|rain|precip|lluvia|hujan|gauge reading)[^;,/]*(\bmm\b|\[mm\]|mill?imet|milímet)') THEN 'mm' WHEN regexp_matches(m, '(tp|rain|precip|lluvia|hujan)[^;,/]*(\[in\]| in\.|inch|inci|pulgada|")') THEN 'in'
       WHEN regexp_matches(m, '(tp|rain|precip|hujan)[^;,/]*(in m$|in m[^a-z]|metre|meter|[0-9] m$|[0-9] m[^a-z])') THEN 'm' END AS p_said,
  CASE WHEN txt LIKE '%fahrenheit%' THEN 'F' WHEN txt LIKE '%celsius%' THEN 'C' WHEN regexp_matches(txt, 'kelvin|\[k\]|\bk for') THEN 'K' END AS t_feed,
  CASE WHEN txt LIKE '%inches of rain%' THEN 'in' WHEN regexp_matches(txt, 'millimet|\bmm\b') THEN 'mm' WHEN regexp_matches(txt, '\bmetres?\b|\[m\]|in m\.') THEN 'm' END AS p_feed
  FROM r LEFT JOIN f ON r.feed = f.feed AND r.time >= f.valid_from AND (valid_to IS NULL OR r.time < valid_to)),
h AS (SELECT obs_id, h2m, {_REMARK} AS m FROM fwi_climatology WHERE NOT isnan(h2m) AND h2m > 0),
case_ AS (SELECT 'clim_dataset' AS table_name, obs_id, 't2m' AS field, coalesce(t_said, t_feed, CASE WHEN t2m < 50 THEN 'C' WHEN t2m < 150 THEN 'F' ELSE 'K' END) AS unit FROM j WHERE NOT isnan(t2m) AND t2m > -300
  UNION ALL SELECT 'clim_dataset', obs_id, 'tp', coalesce(p_said, p_feed) FROM j WHERE NOT isnan(tp) AND tp > 0
  UNION ALL SELECT 'fwi_climatology', obs_id, 'h2m', CASE WHEN regexp_matches(m, 'fraction|0\.\.1|share of one|pecahan|ratio not') THEN 'fraction' WHEN regexp_matches(m, 'x10|by ten|tenths|per mille') THEN 'tenths' WHEN h2m < 2 THEN 'fraction' WHEN h2m > 200 THEN 'tenths' ELSE '%' END FROM h)"""


def _counter_sql(restart: str) -> str:
    return f"""WITH {_POSITIONS}, r0 AS (SELECT CAST(floor((lon - 92.875) / 0.25) AS INTEGER) AS lonind, CAST(floor((lat + 13.125) / 0.25) AS INTEGER) AS latind, datediff('day', DATE '2002-01-01', CAST(date AS DATE)) AS day,
        epoch(date) - epoch(TIMESTAMP '2002-01-01') AS t, date, frp FROM pos WHERE lon IS NOT NULL AND NOT isnan(frp) AND NOT isinf(frp) AND frp > 0),
      r1 AS (SELECT *, row_number() OVER (PARTITION BY lonind, latind{restart} ORDER BY date, frp) AS v FROM r0),
      r2 AS (SELECT *, lag(v) OVER w AS pv, lag(t) OVER w AS pt, lag(day) OVER w AS pd, lead(t) OVER w AS nt, lead(day) OVER w AS nd, lead(v) OVER w AS nv FROM r1 WINDOW w AS (PARTITION BY lonind, latind ORDER BY t, v)),
      r3 AS (SELECT *, CASE WHEN pv IS NULL THEN 0 WHEN v < pv THEN v ELSE v - pv END AS inc, CASE WHEN nv < v THEN nv ELSE nv - v END AS coming FROM r2),
      own AS (SELECT lonind, latind, day, count(*) AS n, sum(inc * CASE WHEN day > pd AND day - pd <= 10 AND t > pt THEN (t - greatest(pt, day * 86400.0)) / (t - pt) ELSE 1 END) AS amount FROM r3 GROUP BY ALL),
      gap AS (SELECT lonind, latind, day, nd, t, nt, coming, unnest(range(day, coalesce(nd, day + 1))) AS dd FROM r3 WHERE nd IS NULL OR nd > day),
      share AS (SELECT lonind, latind, dd, nd - day <= 10 AS covered, CASE WHEN nd - day <= 10 AND nt > t THEN coming * greatest(0, least(nt, (dd + 1) * 86400.0) - greatest(t, dd * 86400.0)) / (nt - t) ELSE 0 END AS part FROM gap)
      SELECT s.lonind, s.latind, CAST(dd AS INTEGER) AS day_since, coalesce(n, 0) AS n_readings, round(coalesce(amount, 0) + part, 3) AS detections, CASE WHEN n > 0 THEN 'reading' WHEN covered THEN 'filled' ELSE 'uncovered' END AS status
      FROM share s LEFT JOIN own o ON o.lonind = s.lonind AND o.latind = s.latind AND o.day = s.dd"""


SQL = {
    "p3_accumulated": _counter_sql(""),
    "p3_counter": _counter_sql(", year(date)"),
    "p1_found": f"""WITH {_FIRE_ROWS} SELECT lonind, latind, day_since, kind FROM w, unnest([CASE WHEN tp_med_sum_7 > 150.05 THEN 'wet7' END,
      CASE WHEN tp_med_sum_30 < 10.05 AND tp_med_cnt_30 >= 20 THEN 'dry30' END, CASE WHEN dc_med_avg_30 > 700.0333 AND dc_med_cnt_30 >= 20 THEN 'dc30' END,
      CASE WHEN fwi_med_avg_7 > 30.0333 AND fwi_med_cnt_7 >= 4 THEN 'fwi7' END]) AS t(kind) WHERE kind IS NOT NULL""",
    "p1_rolling": f"""WITH {_FIRE_ROWS} SELECT lonind, latind, day_since, {", ".join(f"round({v}_sum_{n}, 6) AS {v}_sum_{n}, {v}_cnt_{n}, round({v}_avg_{n}, 6) AS {v}_avg_{n}" for v in INDICES for n in (7, 30))} FROM w""",
    "p3_found": f"WITH {_POSITIONS}, {_READING_DAYS} SELECT lonind, latind, CAST(unnest(range(day_since + 1, nx)) AS INTEGER) AS day_since FROM g WHERE nx - day_since BETWEEN 2 AND 10",
    "p3_status": f"""WITH {_POSITIONS}, {_READING_DAYS} , s AS (SELECT *, unnest(range(day_since, coalesce(nx, day_since + 1))) AS day FROM g)
      SELECT lonind, latind, CAST(day AS INTEGER) AS day_since, CASE WHEN day = day_since THEN 'reading' WHEN nx - day_since <= 10 THEN 'filled' ELSE 'uncovered' END AS status FROM s""",
    "p4_found": f"WITH {_UNITS} SELECT * FROM case_ WHERE unit NOT IN ('K', 'm', '%')",
    "p6_found": f"WITH {_POSITIONS}, {_INSIDE} SELECT row_id, site_id FROM hit",
    "p6_groups": f"""WITH {_POSITIONS}, {_INSIDE} SELECT labs8, count(*) AS n_rows, count(h.row_id) AS n_inside FROM pos LEFT JOIN (SELECT DISTINCT row_id FROM hit) h USING (row_id)
      WHERE labs8 IS NOT NULL AND lon IS NOT NULL GROUP BY labs8 HAVING count(h.row_id) > 0""",
    "p3_series": f"""WITH {_POSITIONS}, r AS (SELECT CAST(floor((lon - 92.875) / 0.25) AS INTEGER) AS lonind, CAST(floor((lat + 13.125) / 0.25) AS INTEGER) AS latind, datediff('day', DATE '2002-01-01', CAST(date AS DATE)) AS day,
        epoch(date) - epoch(TIMESTAMP '2002-01-01') AS t, frp FROM pos WHERE lon IS NOT NULL AND NOT isnan(frp) AND NOT isinf(frp) AND frp > 0),
      d AS (SELECT lonind, latind, day, count(*) AS n, sum(frp) AS total, min(t) AS t0, max(t) AS t1, min(frp) FILTER (rn = 1) AS v0 FROM (SELECT *, row_number() OVER (PARTITION BY lonind, latind, day ORDER BY t, frp) AS rn FROM r) GROUP BY ALL),
      s AS (SELECT *, lag(t1) OVER w AS pt, lag(day) OVER w AS pd, lead(t0) OVER w AS nt, lead(v0) OVER w AS nv, lead(day) OVER w AS nx FROM d WINDOW w AS (PARTITION BY lonind, latind ORDER BY day)),
      x AS (SELECT *, unnest(range(day, coalesce(nx, day + 1))) AS dd FROM s)
      SELECT lonind, latind, CAST(dd AS INTEGER) AS day_since, CASE WHEN dd = day THEN n ELSE 0 END AS n_readings,
        round(CASE WHEN dd = day THEN total - v0 + v0 * CASE WHEN day - pd <= 10 AND t0 > pt THEN (t0 - greatest(pt, day * 86400.0)) / (t0 - pt) ELSE 1 END ELSE 0 END
          + CASE WHEN nx - day <= 10 AND nt > t1 THEN nv * greatest(0, least(nt, (dd + 1) * 86400.0) - greatest(t1, dd * 86400.0)) / (nt - t1) ELSE 0 END, 3) AS frp_amount,
        CASE WHEN dd = day THEN 'reading' WHEN nx - day <= 10 THEN 'filled' ELSE 'uncovered' END AS status FROM x""",
    "p4_values": f"""WITH {_UNITS}, every AS (
        SELECT 'clim_dataset' AS table_name, obs_id, 't2m' AS field, coalesce(t_said, t_feed, CASE WHEN t2m < 50 THEN 'C' WHEN t2m < 150 THEN 'F' ELSE 'K' END) AS unit, CASE WHEN t_said IS NOT NULL THEN 'remark' WHEN t_feed IS NOT NULL THEN 'source' ELSE 'value' END AS known_by, t2m AS v FROM j WHERE NOT isnan(t2m) AND t2m > -300
        UNION ALL SELECT 'clim_dataset', obs_id, 'tp', coalesce(p_said, p_feed), CASE WHEN p_said IS NOT NULL THEN 'remark' ELSE 'source' END, tp FROM j WHERE NOT isnan(tp) AND tp >= 0
        UNION ALL SELECT table_name, c.obs_id, field, unit, CASE WHEN regexp_matches(m, 'fraction|0\\.\\.1|share of one|pecahan|ratio not|x10|by ten|tenths|per mille') THEN 'remark' ELSE 'value' END, h2m FROM case_ c JOIN h ON c.obs_id = h.obs_id WHERE field = 'h2m')
      SELECT table_name, obs_id, field, unit, known_by, false AS uncertain, round(CASE unit WHEN 'C' THEN v + 273.15 WHEN 'F' THEN (v + 459.67) * (5.0 / 9) WHEN 'mm' THEN v * 0.001 WHEN 'in' THEN v * 0.0254 WHEN 'fraction' THEN v * 100 WHEN 'tenths' THEN v * 0.1 ELSE v END, 6) AS common FROM every""",
}
