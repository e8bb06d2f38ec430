"""Running sums and joins by key where a group holds most of the rows; the folder for written tables."""

from __future__ import annotations

import os
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import fires
from emberline.operators.components import component_roots
from emberline.operators.fires import any_in_cluster, cluster_features, ignitions, without_clusters_touching
from emberline.operators.keyed import join_per_key
from emberline.operators.running import running_totals
from emberline.operators.scores import scores, systematic_sample
from emberline.plans import materialize as P


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    rng = np.random.default_rng(1)
    rows = [(None if g == 3 else int(g), "ab"[g % 2], int(o), int(n), float(n) / 4) for g, o, n in zip(np.where(rng.random(2000) < 0.5, 0, rng.integers(0, 9, 2000)), rng.permutation(2000), rng.integers(0, 9, 2000), strict=True)]
    df = spark.createDataFrame(rows, "g int, h string, o long, n long, v double").repartition(7)
    got = {r["o"]: r for r in running_totals(df, ["g", "h"], "o", ["n", "v"], descending).collect()}
    assert len(got) == 2000
    for g, h, o, _, v in rows:
        same = [(r[2], r[3], r[4]) for r in rows if r[:2] == (g, h)]
        upto = [r for r in same if (r[0] >= o if descending else r[0] <= o)]
        assert (got[o]["upto_n"], got[o]["total_n"]) == (sum(r[1] for r in upto), sum(r[1] for r in same))
        assert (got[o]["upto_v"], got[o]["total_v"], got[o]["v"]) == (sum(r[2] for r in upto), sum(r[2] for r in same), v)
    assert running_totals(df.limit(0), ["g"], "o", ["n"]).collect() == []
    whole = running_totals(df.withColumn("n", F.when(F.col("o") > 5, 1)), [], "o", ["n"]).orderBy("o").collect()
    assert [r["upto_n"] for r in whole] == [max(0, i - 5) for i in range(2000)] and whole[0]["total_n"] == 1994


def hot_rows(spark):
    rows = [(i, None if i % 5 == 0 else "hot" if i % 5 < 4 else f"k{i % 5000}") for i in range(20_000)]
    return rows, spark.createDataFrame(rows, "id long, k string").repartition(4)


def test_join_per_key(spark):
    rows, df = hot_rows(spark)
    per = df.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("v")).where("k IS NULL OR k <> 'k49'")
    want = {i: max(j for j, q in rows if q == k) if k and k != "k49" else None for i, k in rows[:300]}
    got = {r["id"]: r["v"] for r in join_per_key(df, per, "k", "n", ["v"]).collect()}
    assert len(got) == 20_000 and all(got[i] == v for i, v in want.items())
    assert join_per_key(df, per, "k", "n", ["v"], inner=True).count() == sum(k is not None and k != "k49" for _, k in rows)
    # the shuffle of the join deals hot and missing keys out evenly
    out = join_per_key(df, per, "k", "n", ["v"])
    spark.conf.set("spark.sql.adaptive.enabled", "false"), spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        loads = sorted(r["count"] for r in join_per_key(df, per, "k", "n", ["v"]).groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true"), spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(loads) < 2 * loads[len(loads) // 2] and out.columns == ["id", "k", "v"]


def test_clusters_with_a_hot_label(spark, monkeypatch):
    rows, df = hot_rows(spark)
    df = df.withColumns({"day": F.expr("date_add(DATE '2020-01-01', CAST(id % 7 AS INT))"), "lon": F.col("id") / 1000.0, "lat": F.lit(0.5), "flag": F.col("id") == 4})
    sizes = {r["k"]: (r["duration"], r["fsize"]) for r in cluster_features(df, "k", "day").select("k", "duration", "fsize").distinct().collect()}
    assert sizes[None] == (None, None) and sizes["hot"] == (7, 12_000) and sizes["k4"] == (6, 4)
    boxes = spark.createDataFrame([(0.0035, 0.0045, 0.0, 1.0), (50.0, 51.0, 0.0, 1.0)], "west double, east double, south double, north double")
    for few in (32, 1):  # one filter, and the quadtree join
        monkeypatch.setattr(fires, "FEW_BOXES", few)
        left = {r["k"] for r in without_clusters_touching(df, "k", boxes, "lon", "lat").select("k").distinct().collect()}
        assert left == {k for _, k in rows} - {"k4"}
    got = {r["k"]: r["any"] for r in any_in_cluster(df, "k", {"any": "flag"}).select("k", "any").distinct().collect()}
    assert got[None] is None and got["k4"] is True and got["hot"] is False
    assert ignitions(df, "k", "k", "day", "lon", "lat").count() == len({k for _, k in rows if k})


def test_scores_of_one_large_group(spark):
    df = spark.range(200_000).select(F.lit(1).alias("g"), (F.xxhash64("id") % 2 == 0).cast("int").alias("y"), (F.col("id") / 200_000.0).alias("p"))
    r = scores(df, ["g"], "y", "p").first()
    y = np.array([x["y"] for x in df.orderBy("p").collect()])
    rank = np.arange(1, len(y) + 1)
    pos = y.sum()
    assert abs(r["auc"] - (rank[y == 1].sum() - pos * (pos + 1) / 2) / pos / (len(y) - pos)) < 1e-9
    skewed = spark.range(1000).select(F.when(F.col("id") < 990, F.lit(5)).otherwise(F.col("id") * 10**12).alias("o"), F.lit(0).alias("y"))
    assert systematic_sample(skewed, "y", "o", 10).count() == 100
    assert systematic_sample(spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y")), "y", "id").where("y = 0").count() == 225


def test_folder_off_local_mode(spark, monkeypatch):
    far = types.SimpleNamespace(sparkContext=types.SimpleNamespace(master="spark://far:7077", getConf=lambda: {}), conf=types.SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        P.shared_folder(far)
    far.conf.get = lambda *_: "hdfs:///shared/"
    assert P.shared_folder(far) == "hdfs:///shared"


def test_star_rounds_leave_one_table(spark):
    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    before = set(P._written)
    roots = component_roots(edges, one_task=0)
    assert {(r["node"], r["root"]) for r in roots.collect()} == {(i, 0) for i in range(41)}
    made = set(P._written) - before
    assert len(made) == 1 and all(os.path.exists(p.removeprefix("file://")) for p in made)
