"""Fire detections, gridding, boxes and joins, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import day_index, finite
from ..functions.geo import NAMED_BOXES, BBox, Grid, cell_area_km2, haversine_km, position_degrees, position_xyz, tile_lonlat, tile_of, unit_xyz
from ..operators import fires as C
from ..operators import gridding as G
from ..operators.linking import linked_groups
from ..operators.resample import month_index, season_block
from ..operators.spatial import inside_regions, within_distance
from ..plans.views import VIEWS, view, with_views
from ..sources.readers import tile_of_file
from .problems import _FIRE_ROWS, _POSITIONS, current_indices
from .tables import table

CELL = ["lonind", "latind"]
GRID = Grid(NAMED_BOXES["indonesia"], 0.25)
NEAR_KM = 0.8  # reach of the detections' clusters
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return put


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with a position, in their cells of the grid (binned as the gridder does: clamped at the top)."""
    lon, lat = position_degrees()
    d = table(spark, sf_dir, "firedata").select("row_id", lon.alias("longitude"), lat.alias("latitude"), finite("frp").alias("frp"), "confidence", "date", F.to_date("date").alias("day"), "daynight", "satellite", "labs1", "labs8")
    return G.add_cells(d.where("longitude IS NOT NULL"), GRID)


def _bin(v: str, edge: float, bins: int) -> str:
    return f"CAST(CASE WHEN {v} < {edge} THEN -1 ELSE least(floor(({v} - {edge}) / 0.25), {bins - 1}) END AS INT)"


_LON, _LAT = _bin("lon", GRID.lon_edge, GRID.n_lon), _bin("lat", GRID.lat_edge, GRID.lat_bins)
_DET = f"""WITH {_POSITIONS}, det AS (SELECT p.row_id, lon AS longitude, lat AS latitude, CASE WHEN NOT isnan(f.frp) AND NOT isinf(f.frp) THEN f.frp END AS frp, confidence, f.date, CAST(f.date AS DATE) AS day, daynight, satellite, labs1, f.labs8, {_LON} AS lonind, {_LAT} AS latind
  FROM pos p JOIN firedata f USING (row_id) WHERE lon IS NOT NULL)"""


@query(f"{_DET} SELECT lonind, latind, count(*) AS n, round(sum(frp), 3) AS frp FROM det GROUP BY lonind, latind")
def grid_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections per cell."""
    return detections(spark, sf_dir).groupBy(*CELL).agg(F.count("*").alias("n"), F.round(F.sum("frp"), 3).alias("frp"))


@query(f"{_DET} SELECT DISTINCT lonind, latind, CASE WHEN lonind BETWEEN 0 AND {GRID.n_lon - 1} THEN 93.0 + lonind * 0.25 END AS longitude, CASE WHEN latind BETWEEN 0 AND {GRID.n_lat - 1} THEN -13.0 + latind * 0.25 END AS latitude FROM det")
def grid_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres of the cells with detections."""
    return G.add_coordinates(detections(spark, sf_dir).select(*CELL).distinct(), GRID)


_MONTHS = "SELECT CAST(unnest(range((SELECT min(mind) FROM m), (SELECT max(mind) FROM m) + 1)) AS INT) AS mind"


@query(f"""{_DET}, m AS (SELECT lonind, latind, CAST((year(day) - 2002) * 12 + month(day) AS INT) AS mind, count(*) AS n FROM det GROUP BY ALL),
  e AS (SELECT lonind, latind, mind FROM (SELECT DISTINCT lonind, latind FROM m), ({_MONTHS})) SELECT lonind, latind, mind, coalesce(n, 0) AS n FROM e LEFT JOIN m USING (lonind, latind, mind)""")
def grid_monthly_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of every cell in every month, 0 where none."""
    d = detections(spark, sf_dir).select(*CELL, month_index(F.year("day"), F.month("day"), 2002).alias("mind"))
    low, high = d.agg(F.min("mind"), F.max("mind")).first()
    return G.dense_counts(d, CELL, "mind", F.sequence(F.lit(low or 0), F.lit(high or 0)))


@query(f"""{_DET}, n AS (SELECT lonind, latind, day, count(*) AS n FROM det GROUP BY ALL), b AS (SELECT min(day) AS a, max(day) AS z FROM n), e AS (SELECT * FROM (SELECT DISTINCT lonind, latind FROM n), (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM b))
  SELECT lonind, latind, day, coalesce(n, 0) AS n FROM e LEFT JOIN n USING (lonind, latind, day)""")
def grid_daily_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense daily count cube: every cell with a detection, all days."""
    return G.dense_daily(detections(spark, sf_dir).select(*CELL, "day"), CELL, "day")


@query(f"""{_DET}, b AS (SELECT datediff('day', min(day), max(day)) + 1 AS days FROM det) SELECT lonind, latind, days, days - count(DISTINCT day) AS empty, CAST(count(*) AS BIGINT) AS n FROM det, b GROUP BY lonind, latind, days""")
def grid_daily_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days, days without a detection and detections of each cell in that cube."""
    cube = grid_daily_cells(spark, sf_dir)
    return cube.groupBy(*CELL).agg(F.count("*").alias("days"), F.count_if(F.col("n") == 0).alias("empty"), F.sum("n").alias("n"))


@query(f"""{_DET}, s AS (SELECT *, CASE WHEN labs8 IS NOT NULL THEN datediff('day', min(CAST(date AS DATE)) OVER (PARTITION BY labs8), max(CAST(date AS DATE)) OVER (PARTITION BY labs8)) + 1 END AS dur, CASE WHEN labs8 IS NOT NULL THEN count(*) OVER (PARTITION BY labs8) END AS size FROM det)
  SELECT lonind, latind, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, count(*) AS frp, nullif(count(*) FILTER (daynight = 'D'), 0) AS frpD, nullif(count(*) FILTER (daynight = 'N'), 0) AS frpN, median(dur) AS duration, median(size) AS fsize FROM s GROUP BY ALL""")
def grid_daynight_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly features of the detections and their clusters."""
    return C.monthly_fire_features(detections(spark, sf_dir), CELL, "date", "daynight", "labs8")


@query(f"{_DET} SELECT labs8, CAST(datediff('day', min(day), max(day)) AS INT) AS duration, count(*) AS fsize, round(max(frp), 3) AS frp_max, round(sum(frp), 3) AS frp_sum FROM det WHERE labs8 IS NOT NULL GROUP BY labs8")
def cluster_duration_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duration (exclusive), size, greatest and total power of each earlier cluster."""
    d = detections(spark, sf_dir).where("labs8 IS NOT NULL")
    return d.groupBy("labs8").agg(F.datediff(F.max("day"), F.min("day")).alias("duration"), F.count("*").alias("fsize"), F.round(F.max("frp"), 3).alias("frp_max"), F.round(F.sum("frp"), 3).alias("frp_sum"))


@query(f"""{_DET}, f AS (SELECT *, min(day) OVER (PARTITION BY labs8) AS first FROM det WHERE labs8 IS NOT NULL)
  SELECT labs1, day, round(avg(longitude) + 1e-8, 6) AS longitude, round(avg(latitude) + 1e-8, 6) AS latitude FROM f WHERE day = first GROUP BY labs1, day""")
def ignition_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where fires were first seen."""
    out = C.ignitions(detections(spark, sf_dir).where("labs8 IS NOT NULL"), "labs8", "labs1", "day", "longitude", "latitude")
    # positions have five decimals, so halves are common: moved a little, no tie decides the rounding
    return out.select("labs1", "day", *(F.round(F.col(c) + 1e-8, 6).alias(c) for c in ("longitude", "latitude")))


_DURS = (1, 2, 4, 8)


@query("\nUNION ALL\n".join(f"SELECT * FROM ({_DET}, f AS (SELECT *, min(day) OVER (PARTITION BY labs8) AS first FROM det WHERE labs8 IS NOT NULL) SELECT lonind, latind, day, {d} AS dur, count(*) AS n FROM f WHERE datediff('day', first, day) < {d} GROUP BY lonind, latind, day)" for d in _DURS))
def ignition_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of detections within the first 1, 2, 4 and 8 days of their cluster."""
    d = detections(spark, sf_dir).where("labs8 IS NOT NULL")
    age = C.with_first_day(d.select(*CELL, "day", "labs8"), "labs8", "day").withColumn("age", F.datediff("day", "first_day"))
    dur = F.explode(F.filter(F.array(*map(F.lit, _DURS)), lambda x: x > F.col("age")))
    return age.select(*CELL, "day", dur.alias("dur")).groupBy(*CELL, "day", "dur").agg(F.count("*").alias("n"))


@query(f"{_DET} SELECT lonind, latind, CAST(year(day) AS INT) AS year, count(*) AS n FROM det GROUP BY ALL")
def annual_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual sums."""
    return detections(spark, sf_dir).groupBy(*CELL, F.year("day").alias("year")).agg(F.count("*").alias("n"))


@query(f"{_DET} SELECT lower(left(satellite, 1)) AS sat, daynight, count(*) AS n, count(DISTINCT labs8) AS clusters FROM det GROUP BY ALL")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value counts by satellite (spelling variants folded) and time of day."""
    return detections(spark, sf_dir).groupBy(F.lower(F.left("satellite", F.lit(1))).alias("sat"), "daynight").agg(F.count("*").alias("n"), F.countDistinct("labs8").alias("clusters"))


@query(f"{_DET} SELECT row_id, round(cos(radians(latitude)) * cos(radians(longitude)), 9) AS x, round(cos(radians(latitude)) * sin(radians(longitude)), 9) AS y, round(sin(radians(latitude)), 9) AS z FROM det")
def xyz_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors of the positions."""
    x, y, z = unit_xyz("longitude", "latitude")
    return detections(spark, sf_dir).select("row_id", F.round(x, 9).alias("x"), F.round(y, 9).alias("y"), F.round(z, 9).alias("z"))


_TX, _TY = "(6371007.181 * radians(longitude) * cos(radians(latitude)) + 20015109.0)", "(10007555.0 - 6371007.181 * radians(latitude))"


@query(f"{_DET} SELECT row_id, CAST(floor({_TX} / 1111950.0) AS INT) AS tile_h, CAST(floor({_TY} / 1111950.0) AS INT) AS tile_v, CAST(floor(({_TY} % 1111950.0) / 463.31271653 - 0.5) AS INT) AS indx, CAST(floor(({_TX} % 1111950.0) / 463.31271653 - 0.5) AS INT) AS indy FROM det")
def tile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sinusoidal tile and pixel of each detection (F8)."""
    return detections(spark, sf_dir).select("row_id", *(c.alias(k) for k, c in tile_of("longitude", "latitude").items()))


_PY = "((10007555.0 - (p_size * 40 + 0.5) * 463.31271653 - (p_partkey % 18) * 1111950.0) / 6371007.181)"


@query(f"SELECT p_partkey, round(degrees({_PY}), 6) AS lat, round(degrees(((p_size * 31 + 0.5) * 463.31271653 + (p_partkey % 36) * 1111950.0 - 20015109.0) / (6371007.181 * cos({_PY}))), 6) AS lon FROM part")
def tile_pixel_lonlat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees of pixels in sinusoidal tiles."""
    lon, lat = tile_lonlat(F.col("p_partkey") % 36, F.col("p_partkey") % 18, F.col("p_size") * 40, F.col("p_size") * 31)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


_AREA = "2 * 6371.0 * asin(sin(radians(0.25) / 2)) * 2 * 6371.0 * asin(abs(cos(radians(lat)) * sin(radians(0.25) / 2)))"


@query(f"SELECT CAST(l AS INT) AS latind, round({_AREA}, 4) AS cell_area FROM (SELECT l, -13.0 + l * 0.25 AS lat FROM (SELECT unnest(range(85)) AS l))")
def cell_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell areas by latitude."""
    g = spark.range(GRID.n_lat).select(F.col("id").cast("int").alias("latind"))
    return g.select("latind", F.round(cell_area_km2(GRID.latitude(), 0.25), 4).alias("cell_area"))


@query(f"{_DET} SELECT row_id, round(2 * 6371.0 * asin(sqrt(power(sin(radians(-2.0 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(-2.0)) * power(sin(radians(114.0 - longitude) / 2), 2))), 4) AS km FROM det")
def distance_to_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Haversine distance to a place."""
    return detections(spark, sf_dir).select("row_id", F.round(haversine_km(F.col("longitude"), F.col("latitude"), F.lit(114.0), F.lit(-2.0)), 4).alias("km"))


@query(f"{_DET} SELECT row_id, longitude > 99 AND longitude < 104 AND latitude > -2 AND latitude < 3 AS riau, longitude BETWEEN 95 AND 106 AND latitude BETWEEN -6 AND 6 AS sumatra FROM det WHERE NOT (longitude > 118 AND latitude < -2.5)")
def bbox_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes, open and closed, and an exclusion rectangle."""
    sumatra = BBox.from_order("WNES", (95.0, 6.0, 106.0, -6.0), closed=True)
    d = detections(spark, sf_dir).where(~((F.col("longitude") > 118) & (F.col("latitude") < -2.5)))
    return d.select("row_id", NAMED_BOXES["riau"].predicate().alias("riau"), sumatra.predicate().alias("sumatra"))


@query(f"{_DET} SELECT row_id, CASE WHEN longitude < 109 THEN 'west' WHEN longitude < 119 THEN 'middle' ELSE 'east' END AS region FROM det WHERE lonind BETWEEN 10 AND 180 AND latind BETWEEN 5 AND 75")
def region_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subset by cell indices, split into regions."""
    region = F.when(F.col("longitude") < 109, "west").when(F.col("longitude") < 119, "middle").otherwise("east")
    return detections(spark, sf_dir).where(F.col("lonind").between(10, 180) & F.col("latind").between(5, 75)).select("row_id", region.alias("region"))


_BOXES = ((100.0, 101.0, 6.5, 8.0), (113.0, 114.5, -3.5, -1.0))


@query(f"{_DET} SELECT row_id, labs8 FROM det WHERE labs8 IS NULL OR labs8 NOT IN (SELECT labs8 FROM det WHERE labs8 IS NOT NULL AND ({' OR '.join(f'(longitude > {w} AND longitude < {e} AND latitude > {s} AND latitude < {n})' for w, e, s, n in _BOXES)}))")
def exclude_clusters_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop every cluster that touches a box."""
    boxes = spark.createDataFrame(list(_BOXES), "west double, east double, south double, north double")
    return C.without_clusters_touching(detections(spark, sf_dir).select("row_id", "labs8", "longitude", "latitude"), "labs8", boxes).select("row_id", "labs8")


def _linked(points: str, reach: float) -> str:
    """Label propagation over all links of ``points`` (a table ``id, x, y, z, t``): the least id of each point's group."""
    return f"""pts AS ({points}), link AS (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON b.x >= a.x - {reach!r} AND b.x <= a.x + {reach!r} WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 + (a.t - b.t) ** 2 <= {reach * reach * (1 + 4e-12)!r}),
  lab(id, label) USING KEY (id) AS (SELECT id, id FROM pts UNION SELECT l.b, min(r.label) FROM lab r JOIN link l ON l.a = r.id JOIN recurring.lab c ON c.id = l.b WHERE r.label < c.label GROUP BY l.b)"""


def _xyz(lon: str, lat: str) -> str:
    return f"cos(radians({lat})) * cos(radians({lon})) AS x, cos(radians({lat})) * sin(radians({lon})) AS y, sin(radians({lat})) AS z"


_REACH_20 = 2770 / 6371007.181 * 20
_REACH = 2770 / 6371007.181
_CHORD = 2 * math.sin(NEAR_KM / 6371.0 / 2)
_FIRE_XYZ = "SELECT row_id AS id, CASE WHEN ok THEN cos(radians(latitude)) * cos(radians(longitude)) ELSE x END AS x, CASE WHEN ok THEN cos(radians(latitude)) * sin(radians(longitude)) ELSE y END AS y, CASE WHEN ok THEN sin(radians(latitude)) ELSE z END AS z, {t} AS t FROM (SELECT *, coalesce(NOT isnan(longitude) AND NOT isnan(latitude) AND longitude BETWEEN -180 AND 180 AND latitude BETWEEN -90 AND 90, false) AS ok FROM firedata) WHERE ok OR abs(x * x + y * y + z * z - 1) < 1e-6"


@query(f"""WITH RECURSIVE vfp AS ({VIEWS["v_fire_points"]}), {_linked(f"SELECT row_id AS id, {_xyz('longitude', 'latitude')}, datediff('day', DATE '2024-01-01', date) * {_REACH_20 / 8!r} AS t FROM vfp", _REACH_20)} SELECT id AS row_id, label FROM lab""")
def cluster_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Space-time clusters of the event points for 8 days, a label for every point."""
    x, y, z = unit_xyz("longitude", "latitude")
    p = view(spark, sf_dir, "v_fire_points").select("row_id", x.alias("x"), y.alias("y"), z.alias("z"), (F.datediff("date", F.lit("2024-01-01")) * (_REACH_20 / 8)).alias("t"))
    return linked_groups(p, "row_id", ["x", "y", "z", "t"], _REACH_20, keep_single=True).select(F.col("id").alias("row_id"), F.col("group").alias("label"))


_DAYS_SINCE = "datediff('day', DATE '2002-01-01', CAST(date AS DATE))"
_BY_DURATION = ", ".join(f"l{d} AS (WITH RECURSIVE {_linked(_FIRE_XYZ.format(t=_DAYS_SINCE + f' * {_REACH / d!r}'), _REACH)} SELECT id, dense_rank() OVER (ORDER BY label) - 1 + {first} AS labs{d} FROM lab)" for d, first in ((1, 0), (8, 1000)))


@query(f"WITH {_BY_DURATION} SELECT id AS row_id, labs1, labs8 FROM l1 JOIN l8 USING (id)")
def region_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all detections for 1 and 8 days, numbered on from another region's for the latter."""
    x, y, z = position_xyz()
    d = table(spark, sf_dir, "firedata").select("row_id", x.alias("x"), y.alias("y"), z.alias("z"), day_index("date").alias("day"))
    return C.region_clusters(d, "row_id", ["x", "y", "z"], "day", _REACH, (1, 8), {8: 1000})


@query(f"""{_DET}, b AS (SELECT *, CASE WHEN month(day) * 100 + day(day) > 421 THEN year(day) ELSE year(day) - 1 END AS own FROM det) SELECT CAST(greatest(2017, least(2018, own)) AS INT) AS block, count(*) AS n, min(day) AS first, max(day) AS last FROM b WHERE year(day) BETWEEN 2017 AND 2019 GROUP BY ALL""")
def season_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections by blocks from 22 April to 21 April."""
    d = detections(spark, sf_dir).withColumn("block", season_block("day", 2017, 2019)).where("block IS NOT NULL")
    return d.groupBy("block").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))


@query(f"""{_DET}, a AS (SELECT labs8 AS l, bool_or(coalesce(daynight = 'N', false)) AS night_any, bool_or(coalesce(frp > 100, false)) AS strong_any FROM det WHERE labs8 IS NOT NULL GROUP BY 1) SELECT row_id, labs8, night_any, strong_any FROM det LEFT JOIN a ON labs8 = l""")
def cluster_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any detection of the row's cluster was at night or strong (L17's form of any-primary and any-peat)."""
    d = detections(spark, sf_dir).select("row_id", "labs8", (F.col("daynight") == "N").alias("night"), (F.col("frp") > 100).alias("strong"))
    return C.any_in_cluster(d, "labs8", {"night_any": "night", "strong_any": "strong"}).select("row_id", "labs8", "night_any", "strong_any")


_HOURS = "CAST(year({t}) AS INT) AS y, CAST(month({t}) AS INT) AS m, CAST(day({t}) AS INT) AS d, CAST(hour({t}) AS INT) AS h"


@query(f"""{_DET}, f AS (SELECT {_HOURS.format(t="date")}, count(*) AS fires FROM det GROUP BY ALL), w AS (SELECT {_HOURS.format(t="time")}, count(*) AS readings, max(CASE WHEN NOT isnan(ssrd) AND ssrd < 1e9 THEN ssrd END) AS ssrd FROM clim_dataset GROUP BY ALL) SELECT y, m, d, h, fires, readings, ssrd FROM f JOIN w USING (y, m, d, h)""")
def hourly_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two series joined on year, month, day and hour."""
    parts = lambda t: [f(t).alias(n) for f, n in ((F.year, "y"), (F.month, "m"), (F.dayofmonth, "d"), (F.hour, "h"))]
    f = detections(spark, sf_dir).groupBy(*parts("date")).agg(F.count("*").alias("fires"))
    sun = finite("ssrd")
    w = table(spark, sf_dir, "clim_dataset").groupBy(*parts("time")).agg(F.count("*").alias("readings"), F.max(F.when(sun < 1e9, sun)).alias("ssrd"))
    return f.join(w, ["y", "m", "d", "h"])


@query(f"""WITH {_POSITIONS}, s AS (SELECT site_id, longitude AS sx, latitude AS sy FROM heat_sites),
  d AS (SELECT site_id, row_id, 2 * 6371.0 * asin(sqrt(least(1, power(sin(radians(sy - lat) / 2), 2) + cos(radians(lat)) * cos(radians(sy)) * power(sin(radians(sx - lon) / 2), 2)))) AS km FROM pos, s WHERE lon IS NOT NULL)
  SELECT site_id, count(*) AS n, round(min(km), 4) AS nearest_km FROM d WHERE km <= 5.0 GROUP BY site_id""")
def p6_nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections within 5 km of each heat site's position: how many and how near (points near points)."""
    sites = table(spark, sf_dir, "heat_sites").select("site_id", "longitude", "latitude")
    pairs = within_distance(detections(spark, sf_dir), "row_id", "longitude", "latitude", sites, "site_id", "longitude", "latitude", 5.0)
    return pairs.groupBy(F.col("site_id").cast("int").alias("site_id")).agg(F.count("*").alias("n"), F.round(F.min("km"), 4).alias("nearest_km"))


@query(f"""WITH RECURSIVE {_linked(_FIRE_XYZ.format(t="0.0"), _CHORD)}, k AS (SELECT label, count(*) AS k FROM lab GROUP BY label) SELECT id AS row_id, CASE WHEN k > 1 THEN label ELSE -1 END AS label FROM lab JOIN k USING (label)""")
def dbscan_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the detections by great-circle distance, two points at least; the least row_id is the label, lone ones are -1."""
    x, y, z = position_xyz()
    p = table(spark, sf_dir, "firedata").select("row_id", x.alias("x"), y.alias("y"), z.alias("z")).where("x IS NOT NULL")
    # great-circle distance <= d  <=>  chord <= 2 sin(d / 2R)
    g = linked_groups(p, "row_id", ["x", "y", "z"], _CHORD).select(F.col("id").alias("row_id"), "group")
    return p.select("row_id").join(g, "row_id", "left").select("row_id", F.coalesce("group", F.lit(-1)).alias("label"))


@query("""WITH g AS (SELECT CAST(floor((longitude - 95) / 2) AS INT) AS i, CAST(floor((latitude + 10) / 2) AS INT) AS j, avg(frp) AS v FROM v_fire_points GROUP BY ALL),
  p AS (SELECT p_partkey, 95 + (p_partkey % 880) / 20.0 AS x, -10 + (p_partkey % 310) / 20.0 AS y FROM part),
  c AS (SELECT p.*, floor((x - 95) / 2) + a AS ci, floor((y + 10) / 2) + b AS cj, (CASE WHEN a = 1 THEN (x - 95) / 2 - floor((x - 95) / 2) ELSE 1 - ((x - 95) / 2 - floor((x - 95) / 2)) END) * (CASE WHEN b = 1 THEN (y + 10) / 2 - floor((y + 10) / 2) ELSE 1 - ((y + 10) / 2 - floor((y + 10) / 2)) END) AS w
    FROM p, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b))
  SELECT p_partkey, CASE WHEN count(*) = count(v) THEN round(sum(w * v), 4) END AS v FROM c LEFT JOIN g ON i = ci AND j = cj WHERE w > 0 GROUP BY p_partkey""")
def bilinear_regrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a coarse grid at points, bilinear."""
    g = view(spark, sf_dir, "v_fire_points").groupBy(F.floor((F.col("longitude") - 95) / 2).cast("int").alias("i"), F.floor((F.col("latitude") + 10) / 2).cast("int").alias("j")).agg(F.avg("frp").alias("v"))
    p = table(spark, sf_dir, "part").select("p_partkey", (95 + (F.col("p_partkey") % 880) / 20.0).alias("x"), (-10 + (F.col("p_partkey") % 310) / 20.0).alias("y"))
    return G.bilinear(p, g, "x", "y", "v", 95.0, -10.0, 2.0, "i", "j").select("p_partkey", F.round("v", 4).alias("v"))


@query("""WITH g AS (SELECT CAST(floor((longitude - 95) / 2) AS INT) AS i, CAST(floor((latitude + 10) / 2) AS INT) AS j, max(frp) AS v FROM v_fire_points GROUP BY ALL),
  p AS (SELECT p_partkey, 95 + (p_partkey % 880) / 20.0 AS x, -10 + (p_partkey % 310) / 20.0 AS y FROM part)
  SELECT p_partkey, v FROM p LEFT JOIN g ON i = floor((x - 95) / 2 + 0.5) AND j = floor((y + 10) / 2 + 0.5)""")
def nearest_regrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the nearest node."""
    g = view(spark, sf_dir, "v_fire_points").groupBy(F.floor((F.col("longitude") - 95) / 2).cast("int").alias("i"), F.floor((F.col("latitude") + 10) / 2).cast("int").alias("j")).agg(F.max("frp").alias("v"))
    p = table(spark, sf_dir, "part").select("p_partkey", (95 + (F.col("p_partkey") % 880) / 20.0).alias("x"), (-10 + (F.col("p_partkey") % 310) / 20.0).alias("y"))
    return G.nearest_node(p, g, "x", "y", "v", 95.0, -10.0, 2.0, "i", "j").select("p_partkey", "v")


@query(f"WITH {_FIRE_ROWS}, land AS (SELECT DISTINCT lonind, latind FROM fwi_climatology WHERE (lonind + latind) % 2 = 0) SELECT c.lonind, c.latind, c.date, c.dc_med FROM c SEMI JOIN land USING (lonind, latind)")
def semi_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of land cells only."""
    land = table(spark, sf_dir, "fwi_climatology").select(*CELL).distinct().where((F.col("lonind") + F.col("latind")) % 2 == 0)
    return current_indices(spark, sf_dir).select(*CELL, "date", "dc_med").join(land, CELL, "left_semi")


@query(f"WITH {_FIRE_ROWS}, land AS (SELECT DISTINCT lonind, latind FROM fwi_climatology WHERE (lonind + latind) % 2 = 0) SELECT c.lonind, c.latind, c.date FROM c ANTI JOIN land USING (lonind, latind)")
def anti_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the other cells."""
    land = table(spark, sf_dir, "fwi_climatology").select(*CELL).distinct().where((F.col("lonind") + F.col("latind")) % 2 == 0)
    return current_indices(spark, sf_dir).select(*CELL, "date").join(land, CELL, "left_anti")


@query(f"WITH {_FIRE_ROWS}, land AS (SELECT DISTINCT lonind, latind, (lonind + latind) % 2 AS lsm FROM fwi_climatology) SELECT c.lonind, c.latind, c.date, CASE WHEN lsm <> 0 THEN dc_med END AS dc_med FROM c LEFT JOIN land USING (lonind, latind)")
def ocean_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values masked by a land flag; rows stay."""
    land = table(spark, sf_dir, "fwi_climatology").select(*CELL).distinct().withColumn("lsm", (F.col("lonind") + F.col("latind")) % 2)
    return G.masked(current_indices(spark, sf_dir).select(*CELL, "date", "dc_med"), land, CELL, "lsm", ["dc_med"])


@query(f"""{_DET}, n AS (SELECT lonind, latind, day AS date, count(*) AS fires FROM det GROUP BY ALL), {_FIRE_ROWS} SELECT lonind, latind, date, fwi_med, fires FROM c FULL JOIN n USING (lonind, latind, date)""")
def outer_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two datasets aligned on all coordinates of either."""
    n = detections(spark, sf_dir).groupBy(*CELL, F.col("day").alias("date")).agg(F.count("*").alias("fires"))
    return current_indices(spark, sf_dir).select(*CELL, "date", "fwi_med").join(n, [*CELL, "date"], "full_outer")


@query("SELECT c_custkey, c_name, o_orderkey, n_name FROM customer JOIN (SELECT o_custkey AS c_custkey, o_orderkey FROM orders) USING (c_custkey) JOIN (SELECT n_nationkey AS c_nationkey, n_name FROM nation) USING (c_nationkey)")
def natural_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joins on all common columns."""
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    for other in (o, n):
        c = c.join(other, sorted(set(c.columns) & set(other.columns)))
    return c.select("c_custkey", "c_name", "o_orderkey", "n_name")


@query(f"WITH {_FIRE_ROWS} SELECT lonind, latind, date, dc_med, dc_med > 0.8 * max(dc_med) OVER () AS extreme FROM c WHERE fwi_med > 5.0")
def threshold_of_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold relative to the greatest value of all, found by an aggregate and not by one window."""
    c = current_indices(spark, sf_dir).select(*CELL, "date", "dc_med", "fwi_med").where("fwi_med > 5.0")
    top = c.agg(F.max("dc_med").alias("top"))
    return c.join(F.broadcast(top)).select(*CELL, "date", "dc_med", (F.col("dc_med") > 0.8 * F.col("top")).alias("extreme"))  # one row


@query(f"WITH {_FIRE_ROWS}, one AS (SELECT min(lonind) AS lonind FROM c) SELECT date, latind, tp_med FROM c SEMI JOIN one USING (lonind)")
def cell_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series of some cells."""
    c = current_indices(spark, sf_dir)
    k = c.agg(F.min("lonind").alias("lonind"))
    return c.join(k, "lonind", "left_semi").select("date", "latind", "tp_med")


@query("""SELECT DISTINCT p_brand AS v FROM part UNION SELECT DISTINCT p_type FROM part UNION ALL SELECT CAST(k AS VARCHAR) FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal < 5000)
  UNION ALL SELECT CAST(k AS VARCHAR) FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, union all, intersect and except all of columns that overlap in part."""
    p, c, s = (table(spark, sf_dir, t) for t in ("part", "customer", "supplier"))
    both = c.where("c_acctbal < 0").select("c_nationkey").intersect(s.where("s_acctbal < 5000").select("s_nationkey"))
    left = c.select("c_nationkey").exceptAll(s.select("s_nationkey"))
    text = lambda df: df.select(F.col("c_nationkey").cast("string"))
    return p.select(F.col("p_brand").alias("v")).union(p.select("p_type")).distinct().union(text(both)).union(text(left))


@query(f"WITH {_FIRE_ROWS}, listed AS (SELECT DISTINCT lonind, latind FROM c ORDER BY lonind, latind LIMIT 5) SELECT lonind, latind, " + ", ".join(f"round(avg(tp_med) FILTER (month(date) = {m}), 6) AS m_{m}" for m in range(1, 13)) + " FROM c SEMI JOIN listed USING (lonind, latind) GROUP BY lonind, latind")
def cells_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a list of cells, wide by month (P23); the list is the first five cells."""
    c = current_indices(spark, sf_dir).select(*CELL, "date", "tp_med")
    listed = c.select(*CELL).distinct().orderBy(*CELL).limit(5)
    out = c.join(F.broadcast(listed), CELL, "left_semi").withColumn("m", F.month("date"))  # five rows
    out = out.groupBy(*CELL).pivot("m", list(range(1, 13))).agg(F.avg("tp_med"))
    return out.select(*CELL, *(F.round(F.col(str(m)), 6).alias(f"m_{m}") for m in range(1, 13)))


@query(f"{_DET} SELECT row_id, frp FROM det WHERE frp > 0 ORDER BY frp DESC, row_id LIMIT 100")
def strongest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred strongest detections (O1 - O3)."""
    return detections(spark, sf_dir).where("frp > 0").orderBy(F.desc("frp"), "row_id").limit(100).select("row_id", "frp")


@query("SELECT row_id, CAST(CASE WHEN c IS NULL THEN NULL WHEN c < 30 THEN 0 WHEN c < 80 THEN 1 ELSE 2 END AS INT) AS class, CAST(row_id % 36 AS INT) AS h, CAST(row_id % 18 AS INT) AS v FROM (SELECT row_id, confidence AS c FROM firedata)")
def text_and_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of a value, parts of a tile name."""
    tag = F.concat(F.lit("h"), F.lpad((F.col("row_id") % 36).cast("string"), 2, "0"), F.lit("v"), F.lpad((F.col("row_id") % 18).cast("string"), 2, "0"))
    bins = F.when(F.col("confidence") < 30, 0).when(F.col("confidence") < 80, 1).when(F.col("confidence").isNotNull(), 2)
    h, v = tile_of_file("tag")
    return table(spark, sf_dir, "firedata").withColumn("tag", F.concat(F.lit("x."), tag, F.lit(".b"))).select("row_id", bins.cast("int").alias("class"), h.alias("h"), v.alias("v"))


@query("SELECT site_id, count(*) AS n FROM heat_sites h JOIN firedata f ON f.longitude > h.longitude - 0.1 AND f.longitude < h.longitude + 0.1 AND f.latitude > h.latitude - 0.1 AND f.latitude < h.latitude + 0.1 WHERE NOT isnan(f.longitude) AND NOT isnan(f.latitude) GROUP BY site_id")
def detections_near_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with degrees in a square around each site; those placed by x, y, z too: ``positions_near_sites``."""
    return _near_sites(spark, sf_dir, table(spark, sf_dir, "firedata"))


@query(f"WITH {_POSITIONS} SELECT site_id, count(*) AS n FROM heat_sites h JOIN pos ON lon > h.longitude - 0.1 AND lon < h.longitude + 0.1 AND lat > h.latitude - 0.1 AND lat < h.latitude + 0.1 GROUP BY site_id")
def positions_near_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections, wherever their position comes from, in a square around each site, by the quadtree join (J10, points near points)."""
    return _near_sites(spark, sf_dir, detections(spark, sf_dir))


def _near_sites(spark: SparkSession, sf_dir: str, points: DataFrame) -> DataFrame:
    s = table(spark, sf_dir, "heat_sites")
    half = 0.1
    boxes = s.select("site_id", F.lit("box").alias("shape"), "longitude", "latitude", F.lit(None).cast("double").alias("radius_km"), (F.col("longitude") - half).alias("west"), (F.col("longitude") + half).alias("east"), (F.col("latitude") - half).alias("south"), (F.col("latitude") + half).alias("north"))
    return inside_regions(points, "row_id", "longitude", "latitude", boxes, "site_id").groupBy("site_id").agg(F.count("*").alias("n"))
