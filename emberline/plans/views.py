"""Tables derived from the general test tables; the same SQL runs in both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_MONTH = "CAST(YEAR(l_shipdate) * 12 + MONTH(l_shipdate) AS INT)"
VIEWS = {
    "v_fire_points": """
        SELECT event_id AS row_id, ts, CAST(ts AS DATE) AS date, 95 + ((user_id * 37) % 180) / CAST(4 AS DOUBLE) AS longitude,
          -10 + ((event_id * 13) % 64) / CAST(4 AS DOUBLE) AS latitude, value AS frp, CAST(event_id % 101 AS INT) AS confidence,
          CASE WHEN HOUR(ts) BETWEEN 6 AND 17 THEN 'D' ELSE 'N' END AS daynight, user_id AS labs8
        FROM events""",
    "v_loss_long": """
        SELECT l_suppkey AS cell, CAST(YEAR(l_shipdate) AS INT) AS year, CASE WHEN l_returnflag = 'R' THEN 'prim' ELSE 'sec' END AS kind, COUNT(*) AS loss
        FROM lineitem GROUP BY l_suppkey, CAST(YEAR(l_shipdate) AS INT), CASE WHEN l_returnflag = 'R' THEN 'prim' ELSE 'sec' END""",
    "v_series_long": """
        SELECT CAST(o_custkey % 20 AS INT) AS cell, CAST(o_orderdate AS DATE) AS day, (SUM(o_orderkey) % 4000) / CAST(8 AS DOUBLE) AS v, COUNT(*) AS n
        FROM orders GROUP BY CAST(o_custkey % 20 AS INT), CAST(o_orderdate AS DATE)""",
    "v_ensemble": f"""
        SELECT l_suppkey AS cell, {_MONTH} AS mind, l_linenumber AS number, MAX(l_quantity) AS v
        FROM lineitem GROUP BY l_suppkey, {_MONTH}, l_linenumber""",
    "v_scores": """
        SELECT o_orderkey AS row_id, CAST(YEAR(o_orderdate) AS INT) AS year, CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS label,
          ((o_orderkey * 7919) % 1000 + 0.5) / CAST(1000 AS DOUBLE) AS prob
        FROM orders""",
    "v_cell_class": """
        SELECT CAST(p_size AS INT) AS cell, CAST(p_partkey % 5 + 1 AS INT) AS class, p_partkey AS pixel, p_retailprice AS v FROM part""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(re.sub(r"\bFROM (events|lineitem|orders|part)\b", lambda m: f"FROM parquet.`{sf_dir}/{m[1]}.parquet`", VIEWS[name]))


def with_views(sql: str) -> str:
    """SQL with the views that it names in front."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    heads = ", ".join(f"{n} AS ({VIEWS[n]})" for n in used)
    body = sql.strip()
    if not used:
        return body
    return f"WITH {heads}, {body[5:]}" if body.upper().startswith("WITH ") and not body.upper().startswith("WITH RECURSIVE") else f"WITH {heads} {body}"
