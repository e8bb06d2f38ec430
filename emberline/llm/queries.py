"""Queries of the problems tagged llm (p2, p5, p7, p8, p9) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import current_rows, day_index, usable
from ..functions.geo import EARTH_M_SINUSOIDAL, position_xyz
from ..queries.tables import table
from .cf_cluster import chained_clusters, chained_summary, ward_clusters
from .leakage import leaked_passages
from .mixing import Mix
from .percentiles import cumulative, merge_counts, pick, reaches, value_counts
from .reading import BACKGROUND, BUCKETS, LEVELS, SMOOTHING, SPREAD, LevelModels, is_hard, label_levels, reading_levels
from .words import INLINE_TAGS

REACH = 2770 / EARTH_M_SINUSOIDAL
DAY = REACH / 8  # a day as long as so much of the unit sphere
CELL = ["field", "lonind", "latind"]


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = position_xyz()
    d = table(spark, sf_dir, "firedata").select("row_id", x.alias("px"), y.alias("py"), z.alias("pz"), (day_index("date") * DAY).alias("pt"))
    return d.where("px IS NOT NULL AND pt IS NOT NULL")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fires: detections that hang together in space and time."""
    return chained_clusters(_detections(spark, sf_dir), "row_id", ["px", "py", "pz", "pt"], REACH).select(F.col("cluster").alias("cluster_row_id"), F.col("id").alias("row_id"))


def p2_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fire with its size and its most typical detections, those nearest to its centroid."""
    return chained_summary(_detections(spark, sf_dir), "row_id", ["px", "py", "pz", "pt"], REACH).select(F.col("cluster").alias("cluster_row_id"), "size", F.array_join("typical", " ").alias("typical"))


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 Ward clusters of all detections with their sizes and most typical members."""
    out = ward_clusters(_detections(spark, sf_dir), "row_id", ["px", "py", "pz", "pt"], 200)
    return out.select("cluster", "size", F.round("rms_radius", 6).alias("rms_radius"), "typical")


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable values of current rows, as ``field, lonind, latind, value, year``."""
    fire = current_rows(table(spark, sf_dir, "fwi_fire"), ["lonind", "latind", "date"], "loaded_at", {v: usable(v) for v in ("dc_med", "fwi_med")})
    clim = table(spark, sf_dir, "fwi_climatology").withColumn("day", F.to_date("time"))
    clim = current_rows(clim, ["lonind", "latind", "day"], "loaded_at", {"tp": usable("tp")})
    one = lambda field: F.struct(F.lit(field).alias("field"), F.col(field).alias("value"))
    long = fire.select("lonind", "latind", F.year("date").alias("year"), F.explode(F.array(one("dc_med"), one("fwi_med"))).alias("v")).unionByName(clim.select("lonind", "latind", F.year("day").alias("year"), one("tp").alias("v")))
    return long.select("v.field", "lonind", "latind", "v.value", "year").where("value IS NOT NULL")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose percentile reaches the limit: each field's wanted percentiles are picked first, then held against its limits."""
    cum = cumulative(value_counts(_values(spark, sf_dir), CELL, "value"), CELL)
    limits = table(spark, sf_dir, "pct_limits").select("limit_id", "field", F.col("pct").cast("double").alias("pct"), "limit_value").where(F.col("field").isin("dc_med", "fwi_med", "tp") & F.col("pct").between(0, 100))
    wanted = limits.groupBy("field").agg(F.collect_set("pct").alias("pcts"))  # three fields at most, 101 whole percentages each
    hit = cum.join(F.broadcast(wanted), "field").withColumn("pct", F.explode(F.filter("pcts", lambda p: reaches(p))))
    return hit.select("field", "pct", "lonind", "latind", "value").join(F.broadcast(limits) if limits.count() <= 10_000 else limits, ["field", "pct"]).where("value >= limit_value").select("limit_id", "lonind", "latind")


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, 75th, 90th and 99th percentile of each field and cell, exact."""
    cum = cumulative(value_counts(_values(spark, sf_dir), CELL, "value"), CELL)
    return pick(cum, CELL, [50, 75, 90, 99]).select(*CELL, F.col("pct").cast("int").alias("pct"), "value", F.col("total").alias("n"))


def p5_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within 1 %, from pieces counted apart for even and odd years (NULL: even) and then combined."""
    v = _values(spark, sf_dir)
    pieces = [value_counts(v.where(F.coalesce(F.pmod(F.col("year"), F.lit(2)), F.lit(0)) == k), CELL, "value", 0.01) for k in (0, 1)]
    return pick(cumulative(merge_counts(*pieces), CELL), CELL, [50, 75, 90, 99]).select(*CELL, F.col("pct").cast("int").alias("pct"), F.round("value", 6).alias("value"), F.col("total").alias("n"))


def p7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked passages with their places in the reviews; questions and answers of 5 to 11 words where they stand whole."""
    return leaked_passages(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", ["text", "answer"], whole=5)


def p7_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without the places: the words of each run."""
    return p7_passages(spark, sf_dir).select("doc_id", "item_id", "n_words")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews and the items of which 12 words or more in a row leaked into them."""
    return leaked_passages(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", ["text"]).select("doc_id", "item_id").distinct()


def _mix(spark: SparkSession, sf_dir: str) -> Mix:
    return Mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source", table(spark, sf_dir, "mix_targets"))


def _word_mix(spark: SparkSession, sf_dir: str) -> Mix:
    """The same with the size in words, which SQL can count."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", F.regexp_count("text", F.lit(r"[^ \t\n\r]+")).alias("n_words"))
    return Mix(docs, "doc_id", "text", "source", table(spark, sf_dir, "mix_targets"), size="n_words")


def _shares(mix: Mix) -> DataFrame:
    r = mix.report()
    return r.select(F.col("source_key").alias("source"), "target_share", "max_repeats", "docs", "tokens", "mixed_docs", "mixed_tokens", "least_copies", "most_copies", F.round("share_of_size", 5).alias("share_of_size"), F.round("share_of_mix", 5).alias("share_of_mix"), "short")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that stay below their target in the mix although all their documents are in it as often as is allowed."""
    return _mix(spark, sf_dir).report().where("short").select(F.col("source_key").alias("source"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of every source in the mix, in tokens."""
    return _shares(_mix(spark, sf_dir))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix itself, shuffled."""
    return _mix(spark, sf_dir).records()


def p8_word_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares in a mix by words."""
    return _shares(_word_mix(spark, sf_dir))


def p8_word_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies that a mix by words holds."""
    return _word_mix(spark, sf_dir).records().select("doc_id", F.col("source_key").alias("source"), "copy", F.length("text").alias("n_chars"))


def _english(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.regexp_extract(F.lower(F.trim("lang")), r"^([a-z]+)", 1)
    return table(spark, sf_dir, "documents").where(lang.isin("en", "eng", "english")).select("doc_id", "text")


def _models(spark: SparkSession, sf_dir: str, docs: DataFrame) -> LevelModels:
    return LevelModels.fit(docs, "doc_id", "text", table(spark, sf_dir, "reading_labels"), "level_name")


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading level of every English review, by models trained on other reviews."""
    docs = _english(spark, sf_dir)
    return reading_levels(docs, "doc_id", "text", _models(spark, sf_dir, docs), ()).select("doc_id", "level", F.round("odds", 4).alias("odds"), "n_tokens")


def p9_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the models' levels agree with the judged ones, all of them held out."""
    judged = label_levels(table(spark, sf_dir, "reading_labels"), "doc_id", "level_name").withColumnRenamed("label", "judged")
    return p9_levels(spark, sf_dir).select("doc_id", "level").join(judged, "doc_id").groupBy("judged", "level").agg(F.count("*").alias("n"))


def p9_model_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English reviews that the models alone call hard, whatever their length; no formula."""
    return p9_levels(spark, sf_dir).where("level = 'hard'").select("doc_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English reviews whose text is hard: those the models call so, with the lines of the problem checked after."""
    docs = _english(spark, sf_dir)
    return reading_levels(docs, "doc_id", "text", _models(spark, sf_dir, docs), ("hard",)).where((F.col("level") == "hard") & is_hard()).select("doc_id")


QUERIES = {
    "p2_found": p2_found,
    "p2_fires": p2_fires,
    "p2_clusters": p2_clusters,
    "p5_found": p5_found,
    "p5_percentiles": p5_percentiles,
    "p5_bounded": p5_bounded,
    "p7_found": p7_found,
    "p7_passages": p7_passages,
    "p7_runs": p7_runs,
    "p8_found": p8_found,
    "p8_report": p8_report,
    "p8_mix": p8_mix,
    "p8_word_report": p8_word_report,
    "p8_word_mix": p8_word_mix,
    "p9_found": p9_found,
    "p9_levels": p9_levels,
    "p9_agreement": p9_agreement,
    "p9_model_hard": p9_model_hard,
}

_USABLE = "CASE WHEN NOT isnan({c}) AND {c} >= 0 AND {c} < 2000 THEN {c} END"
_COUNTED = f"""
fa AS (SELECT lonind, latind, date, loaded_at, {_USABLE.format(c="dc_med")} AS dc_med, {_USABLE.format(c="fwi_med")} AS fwi_med FROM fwi_fire),
fb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lonind, latind, date ORDER BY loaded_at DESC, dc_med DESC NULLS LAST, fwi_med DESC NULLS LAST) AS rn FROM fa) WHERE rn = 1),
ta AS (SELECT lonind, latind, CAST(time AS DATE) AS date, loaded_at, {_USABLE.format(c="tp")} AS tp FROM fwi_climatology),
tb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lonind, latind, date ORDER BY loaded_at DESC, tp DESC NULLS LAST) AS rn FROM ta) WHERE rn = 1),
v AS (SELECT 'dc_med' AS field, lonind, latind, dc_med AS value FROM fb UNION ALL SELECT 'fwi_med', lonind, latind, fwi_med FROM fb UNION ALL SELECT 'tp', lonind, latind, tp FROM tb),
r AS (SELECT *, row_number() OVER (PARTITION BY field, lonind, latind ORDER BY value) AS k, count(*) OVER (PARTITION BY field, lonind, latind) AS n FROM v WHERE value IS NOT NULL)"""

#: The models of reading levels over all documents: bucket counts and sums of logarithms.
_LEVELS = rf"""english AS (SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) AS UBIGINT) % 2 AS fold,
    regexp_replace(regexp_replace(text, '[\x{{00AD}}\x{{200B}}-\x{{200D}}\x{{2060}}\x{{FEFF}}]', '', 'g'), '(?i)<[^<>]*>|(?:https?://|www\.)\S+|[^\s<>]+@[^\s<>]+\.\w+|&#?\w{{1,10}};', ' ', 'g') AS c
    FROM documents WHERE regexp_extract(lower(trim(lang)), '^([a-z]+)', 1) IN ('en', 'eng', 'english')),
  rated AS (SELECT doc_id, CASE lower(trim(level_name)) WHEN 'easy' THEN 0 WHEN 'middle' THEN 1 WHEN 'hard' THEN 2 END AS k, count(*) AS n FROM reading_labels GROUP BY ALL),
  judged AS (SELECT doc_id, ['easy', 'middle', 'hard'][k + 1] AS judged, k FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, k DESC) AS rn FROM rated WHERE k IS NOT NULL) WHERE rn = 1),
  sized AS (SELECT doc_id, fold, c, len(regexp_extract_all(c, '[\pL\pN]+(?:[''’\-‐‑][\pL\pN]+)*')) AS w, greatest(1, len(regexp_extract_all(c, '[.!?…]+["''”’)\]]*(?:\s|$)'))) AS s, length(regexp_replace(c, '[^\pL]', '', 'g')) AS n FROM english),
  trained AS (SELECT z.doc_id, fold, coalesce(j.k, CASE WHEN w = 0 THEN NULL WHEN w > 18 * s AND n > 5.6 * w THEN 2 WHEN w < 9 * s AND n < 5 * w THEN 0 ELSE 1 END) AS k FROM sized z LEFT JOIN judged j USING (doc_id)),
  words AS (SELECT doc_id, fold, CAST('0x' || substr(md5(CASE WHEN regexp_matches(t, '^[.!?…]') THEN '.' ELSE t END), 1, 8) AS UBIGINT) % {BUCKETS} AS b FROM (SELECT doc_id, fold, unnest(regexp_extract_all(lower(c), '[\pL\pN]+|[.!?…]+')) AS t FROM english)),
  lengths AS (SELECT doc_id, count(*) AS n_tokens FROM words GROUP BY doc_id),
  levels_ AS (SELECT unnest(range({len(LEVELS)})) AS k), folds AS (SELECT unnest([0, 1]) AS fold),
  seen AS (SELECT t.doc_id, fold, k FROM trained t SEMI JOIN lengths USING (doc_id) WHERE k IS NOT NULL),
  counted AS (SELECT 1 - s.fold AS fold, s.k, b, CAST(count(*) AS DOUBLE) AS n FROM words w JOIN seen s USING (doc_id) GROUP BY ALL),
  sums AS (SELECT fold, k, coalesce(sum(n), 0) AS n FROM folds CROSS JOIN levels_ LEFT JOIN counted USING (fold, k) GROUP BY fold, k),
  alls AS (SELECT fold, sum(n) + {SMOOTHING} * {BUCKETS} AS n FROM sums GROUP BY fold),
  priors AS (SELECT fold, k, ln((coalesce(d, 0) + 1) / sum(coalesce(d, 0) + 1) OVER (PARTITION BY fold)) AS prior FROM folds CROSS JOIN levels_ LEFT JOIN (SELECT 1 - fold AS fold, k, count(*) AS d FROM seen GROUP BY ALL) USING (fold, k)),
  vocabulary AS (SELECT f.fold, w.b, (coalesce(c.n, 0) + {SMOOTHING}) / a.n AS common FROM (SELECT DISTINCT b FROM words) w CROSS JOIN folds f JOIN alls a ON a.fold = f.fold LEFT JOIN (SELECT fold, b, sum(n) AS n FROM counted GROUP BY ALL) c ON c.fold = f.fold AND c.b = w.b),
  model AS (SELECT v.fold, s.k, v.b, ln({1 - BACKGROUND} * (coalesce(c.n, 0) + {SMOOTHING * BUCKETS * SPREAD} * common) / (s.n + {SMOOTHING * BUCKETS * SPREAD}) + {BACKGROUND} * common) AS logp FROM vocabulary v JOIN sums s ON s.fold = v.fold LEFT JOIN counted c ON c.fold = v.fold AND c.k = s.k AND c.b = v.b),
  ll AS (SELECT doc_id, m.k, any_value(p.prior) + sum(logp) AS ll FROM words w JOIN model m ON m.fold = w.fold AND m.b = w.b JOIN priors p ON p.fold = m.fold AND p.k = m.k GROUP BY doc_id, m.k),
  levels AS (SELECT e.doc_id, level, odds, CAST(coalesce(n_tokens, 0) AS INT) AS n_tokens FROM english e LEFT JOIN lengths USING (doc_id)
    LEFT JOIN (SELECT doc_id, ['easy', 'middle', 'hard'][arg_max(k, ll) + 1] AS level, round((max(ll) - max(ll, 2)[2]) / any_value(n_tokens), 4) AS odds FROM ll JOIN lengths USING (doc_id) GROUP BY doc_id) USING (doc_id))"""

_KEY = r"lower(regexp_replace(source, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g'))"
_PMF = "exp({k} * ln({rate}) - {rate} - lgamma({k} + 1))"
_CAPPED = f"(cap - list_sum(list_transform(range(cap), lambda k: (cap - k) * {_PMF.format(k='k', rate='{rate}')})))"
#: The mix by words: rates by bisection, copies by the cumulative probabilities up to a document's number.
_WORD_MIX = rf"""d AS (SELECT doc_id, text, {_KEY} AS source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+')) AS n, CAST('0x' || substr(md5('7|' || CAST(doc_id AS VARCHAR)), 1, 13) AS UBIGINT) / CAST(1::UBIGINT << 52 AS DOUBLE) AS u FROM documents),
  h AS (SELECT source, count(*) AS docs, sum(n) AS size FROM d GROUP BY source), t AS (SELECT {_KEY} AS source, target_share AS share, max_repeats AS cap FROM mix_targets),
  m AS (SELECT t.source, share, cap, coalesce(docs, 0) AS docs, coalesce(size, 0) AS size, (SELECT sum(size) FROM h) AS total, CASE WHEN size > 0 THEN share * (SELECT sum(size) FROM h) / size ELSE 0 END AS mean FROM t LEFT JOIN h ON t.source = h.source),
  b AS (SELECT source, cap, mean, 0 AS step, CAST(0 AS DOUBLE) AS low, list_filter(list_transform(range(60), lambda i: greatest(1.0, 2 * mean) * pow(2.0, i)), lambda r: {_CAPPED.format(rate='r')} >= mean)[1] AS high FROM m WHERE mean > 0 AND mean < cap
    UNION ALL SELECT source, cap, mean, step + 1, CASE WHEN {_CAPPED.format(rate='((low + high) / 2)')} < mean THEN (low + high) / 2 ELSE low END, CASE WHEN {_CAPPED.format(rate='((low + high) / 2)')} < mean THEN high ELSE (low + high) / 2 END FROM b WHERE step < 100),
  p AS (SELECT source, list_transform(range(cap), lambda k: list_sum(list_transform(range(k + 1), lambda j: {_PMF.format(k='j', rate='high')}))) AS upto FROM b WHERE step = 100),
  c AS (SELECT d.doc_id, d.text, d.source, d.n, m.cap, CASE WHEN mean <= 0 OR m.cap <= 0 THEN 0 WHEN mean >= m.cap THEN m.cap ELSE len(list_filter(upto, lambda x: x <= u)) END AS copies FROM d JOIN m ON d.source = m.source LEFT JOIN p ON p.source = d.source)"""
#: Fires by label propagation along the links of all detections.
_LINKED = f"""pts AS (SELECT row_id AS id, CASE WHEN ok THEN cos(radians(latitude)) * cos(radians(longitude)) ELSE x END AS px, CASE WHEN ok THEN cos(radians(latitude)) * sin(radians(longitude)) ELSE y END AS py, CASE WHEN ok THEN sin(radians(latitude)) ELSE z END AS pz,
    datediff('day', DATE '2002-01-01', CAST(date AS DATE)) * {DAY!r} AS pt FROM (SELECT *, coalesce(NOT isnan(longitude) AND NOT isnan(latitude) AND longitude BETWEEN -180 AND 180 AND latitude BETWEEN -90 AND 90, false) AS ok FROM firedata) WHERE ok OR abs(x * x + y * y + z * z - 1) < 1e-6),
  link AS (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON b.px >= a.px - {REACH!r} AND b.px <= a.px + {REACH!r} AND a.id <> b.id WHERE (a.px - b.px) ** 2 + (a.py - b.py) ** 2 + (a.pz - b.pz) ** 2 + (a.pt - b.pt) ** 2 <= {REACH * REACH * (1 + 4e-12)!r}),
  lab(id, label) USING KEY (id) AS (SELECT DISTINCT a, a FROM link UNION SELECT l.b, min(r.label) FROM lab r JOIN link l ON l.a = r.id JOIN recurring.lab c ON c.id = l.b WHERE r.label < c.label GROUP BY l.b)"""
_WIDE = "".join(map(chr, range(0xFF10, 0xFF5B)))
_NARROW = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)
_INLINE = "|".join(sorted(INLINE_TAGS))


def _words_sql(source: str, key: str) -> str:
    """Normalised words of the texts, step by step as ``words_of`` does it, for the characters that occur."""
    joined = rf"regexp_replace(text, '([\pL\pN])[-‐‑\x{{00AD}}](?:[ \t\x{{200B}}]*(?:\r?\n|<(?:br|BR)\s*/?>)[ \t]*)+', '\1', 'g')"
    untagged = rf"regexp_replace(regexp_replace({joined}, '(?i)</?(?:{_INLINE})(?:\s[^<>]*)?/?>', '', 'g'), '(?i)</?[a-z][a-z0-9]*(?:\s[^<>]*)?/?>|<!--.*?-->', ' ', 'g')"
    decoded = rf"list_reduce([replace({untagged}, '&nbsp;', ' ')] || list_transform(range(33, 592), lambda i: '&#' || i || ';'), lambda a, e: replace(a, e, chr(CAST(substr(e, 3, length(e) - 3) AS INT))))"
    plain = rf"lower(strip_accents(translate(regexp_replace({decoded}, '[\x{{00AD}}\x{{200B}}-\x{{200F}}\x{{2060}}\x{{FEFF}}]', '', 'g'), '{_WIDE}', '{_NARROW}')))"
    return rf"SELECT {key}, regexp_extract_all({plain}, '[\pL\pN]+') AS w FROM {source} WHERE text IS NOT NULL"


_LEAKED = f"""dw AS ({_words_sql("documents", "doc_id")}), iw AS ({_words_sql("eval_items", "item_id")}),
  dg AS (SELECT doc_id, i, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw)), ig AS (SELECT item_id, j, array_to_string(w[j : j + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS j FROM iw)),
  met AS (SELECT doc_id, item_id, i, i - j AS line FROM dg JOIN ig USING (g))"""
_E = "ln(1.01)"
SQL = {
    "p5_bounded": f"""WITH {_COUNTED}, z AS (SELECT field, lonind, latind, CASE WHEN value = 0 THEN 0 ELSE exp((floor(ln(value) / {_E}) + 0.5) * {_E}) END AS value FROM v WHERE value IS NOT NULL),
      r2 AS (SELECT *, row_number() OVER (PARTITION BY field, lonind, latind ORDER BY value) AS k, count(*) OVER (PARTITION BY field, lonind, latind) AS n FROM z)
      SELECT field, lonind, latind, pct, round(min(value), 6) AS value, n FROM r2, (SELECT unnest([50, 75, 90, 99]) AS pct) WHERE k * 100 >= pct * n GROUP BY field, lonind, latind, pct, n""",
    "p2_found": f"WITH RECURSIVE {_LINKED} SELECT label AS cluster_row_id, id AS row_id FROM lab",
    "p2_fires": f"""WITH RECURSIVE {_LINKED}, m AS (SELECT label, p.* FROM lab JOIN pts p ON p.id = lab.id), c AS (SELECT label, count(*) AS size, avg(px) AS cx, avg(py) AS cy, avg(pz) AS cz, avg(pt) AS ct FROM m GROUP BY label),
      o AS (SELECT m.label, size, m.id, row_number() OVER (PARTITION BY m.label ORDER BY round(sqrt((px - cx) ** 2 + (py - cy) ** 2 + (pz - cz) ** 2 + (pt - ct) ** 2) / {REACH!r}, 6), m.id) AS k FROM m JOIN c ON c.label = m.label)
      SELECT label AS cluster_row_id, size, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY k) AS typical FROM o WHERE k <= 3 GROUP BY label, size""",
    "p5_found": f"""WITH {_COUNTED}, q AS (SELECT limit_id, lonind, latind, limit_value, min(value) AS value FROM r JOIN pct_limits p ON r.field = p.field WHERE k * 100 >= p.pct * n GROUP BY ALL)
      SELECT limit_id, lonind, latind FROM q WHERE value >= limit_value""",
    "p5_percentiles": f"""WITH {_COUNTED} SELECT field, lonind, latind, pct, min(value) AS value, n FROM r, (SELECT unnest([50, 75, 90, 99]) AS pct) WHERE k * 100 >= pct * n GROUP BY field, lonind, latind, pct, n""",
    "p7_found": f"WITH {_LEAKED} SELECT DISTINCT doc_id, item_id FROM met",
    "p7_runs": f"""WITH {_LEAKED}, runs AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, line ORDER BY i) AS run FROM met),
      spans AS (SELECT DISTINCT doc_id, item_id, min(i) AS a, count(*) + 11 AS n FROM runs GROUP BY doc_id, item_id, line, run) SELECT doc_id, item_id, CAST(n AS INT) AS n_words FROM spans""",
    "p8_found": f"""WITH d AS (SELECT {_KEY} AS source, length(text) AS n FROM documents), t AS (SELECT {_KEY} AS source, target_share, max_repeats FROM mix_targets), h AS (SELECT source, sum(n) AS n FROM d GROUP BY source)
      SELECT t.source FROM t LEFT JOIN h ON t.source = h.source WHERE coalesce(n, 0) * max_repeats < target_share * (SELECT sum(n) FROM h)""",
    "p8_word_mix": f"WITH RECURSIVE {_WORD_MIX} SELECT doc_id, source, CAST(unnest(range(1, copies + 1)) AS INT) AS copy, CAST(length(text) AS INT) AS n_chars FROM c",
    "p8_word_report": f"""WITH RECURSIVE {_WORD_MIX}, r AS (SELECT source, sum(n * copies) AS tokens, sum(copies) AS docs, min(copies) FILTER (copies > 0) AS least, max(copies) AS most FROM c GROUP BY source), s AS (SELECT sum(tokens) AS tokens FROM r)
      SELECT m.source, share AS target_share, CAST(cap AS INT) AS max_repeats, m.docs, CAST(size AS BIGINT) AS tokens, CAST(coalesce(r.docs, 0) AS BIGINT) AS mixed_docs, CAST(coalesce(r.tokens, 0) AS BIGINT) AS mixed_tokens, CAST(coalesce(least, 0) AS INT) AS least_copies, CAST(coalesce(most, 0) AS INT) AS most_copies,
        round(coalesce(r.tokens, 0) / total, 5) AS share_of_size, round(coalesce(r.tokens, 0) / s.tokens, 5) AS share_of_mix, size * cap < share * total AS short FROM m LEFT JOIN r ON r.source = m.source, s""",
    "p9_found": r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[\x{00AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}]', '', 'g'), '(?i)<[^<>]*>|(?:https?://|www\.)\S+|&#?\w{1,10};', ' ', 'g') AS c
        FROM documents WHERE regexp_extract(lower(trim(lang)), '^([a-z]+)', 1) IN ('en', 'eng', 'english') AND text IS NOT NULL),
      m AS (SELECT doc_id, len(regexp_extract_all(c, '[\pL\pN]+(?:[\'’\-‐‑][\pL\pN]+)*')) AS w, greatest(1, len(regexp_extract_all(c, '[.!?…]+["\'”’)\]]*(?:\s|$)'))) AS s, length(regexp_replace(c, '[^\pL]', '', 'g')) AS n FROM t)
      SELECT doc_id FROM m WHERE w >= 40 AND w > 18 * s AND n > 5.6 * w""".replace("\\'", "''"),
    "p9_levels": f"WITH {_LEVELS} SELECT doc_id, level, odds, n_tokens FROM levels",
    "p9_agreement": f"WITH {_LEVELS} SELECT judged, level, count(*) AS n FROM levels JOIN judged USING (doc_id) GROUP BY ALL",
    "p9_model_hard": f"WITH {_LEVELS} SELECT doc_id FROM levels WHERE level = 'hard'",
}
