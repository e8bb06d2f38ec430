"""Small operators at their edges: months closed on the right, season blocks, bridged runs, padded months, labels, masks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from emberline.operators import fires as C
from emberline.operators import landcover as L
from emberline.operators import resample as R


def test_months_closed_on_the_right(spark):
    df = spark.createDataFrame([("2001-02-01 00:00:00",), ("2001-02-01 00:00:01",), ("2001-03-01 00:00:00",), (None,)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    assert [r[0] and r[0].month for r in df.select(R.month_bin_start("t")).collect()] == [1, 2, 2, None]


def test_season_blocks(spark):
    days = [dt.date(2001, 12, 31), dt.date(2002, 1, 1), dt.date(2003, 4, 21), dt.date(2003, 4, 22), dt.date(2004, 4, 21), dt.date(2005, 12, 31), dt.date(2006, 1, 1), None]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    assert [r[0] for r in df.select(R.season_block("d", 2002, 2005)).collect()] == [None, 2002, 2002, 2003, 2003, 2004, None, None]


def test_bridge(spark):
    rows = [(dt.date(2000, m, 1), dt.date(2000, 1, 31) + dt.timedelta(k)) for m in (1, 2, 3, 4) for k in range(-20, 100)]
    got = R.bridge(spark.createDataFrame(rows, "run date, day date"), "run", "day", "2000-02-10", "2000-04-10")
    spans = {r["run"].month: (r["a"], r["z"]) for r in got.groupBy("run").agg(F.min("day").alias("a"), F.max("day").alias("z")).collect()}
    assert spans == {2: (dt.date(2000, 1, 31), dt.date(2000, 3, 1)), 3: (dt.date(2000, 2, 29), dt.date(2000, 4, 1))}


def test_months_to_year_end(spark):
    df = spark.createDataFrame([("a", 3, 5), ("b", 14, 2), (None, 4, 1)], "cell string, mind int, n long")
    got = {(r["cell"], r["mind"]): r["n"] for r in L.months_to_year_end(df, ["cell"], "mind", "n").where("cell IS NOT NULL").collect()}
    assert set(got) == {(c, m) for c in "ab" for m in range(3, 25)} and got["a", 3] == 5 and got["b", 14] == 2 and sum(got.values()) == 7
    assert L.months_to_year_end(df.limit(0), ["cell"], "mind", "n").collect() == []


def test_static_features_and_masks(spark):
    cells = spark.createDataFrame([(1, "x"), (2, "y")], "cell int, dem string")
    z = spark.createDataFrame([(1, 9.80665), (1, 29.41995)], "cell int, z double")
    peat = spark.createDataFrame([(2, 3), (2, 4)], "cell int, d int")
    assert {(r["cell"], r["dem"] and round(r["dem"], 9), r["peatd"]) for r in L.with_static(cells, ["cell"], z, "z", peat, "d").collect()} == {(1, 2.0, 0), (2, None, 7)}
    assert sorted(map(tuple, L.label_mask(peat, z.select("cell", F.lit(0).alias("d")), value="d").collect())) == [(2, 1), (2, 1)]
    loss = spark.createDataFrame([(1, 2001, 1), (1, 2001, 2), (1, 2002, 2), (2, 2003, 1), (2, None, 1)], "cell int, year int, kind int")
    got = {r["cell"]: r.asDict() for r in L.typed_loss_columns(loss, ["cell"], "year", "kind", [2001, 2002]).collect()}
    assert got[1]["2001_loss"] == got[1]["2001_loss_prim"] == got[1]["2002_loss_prim"] == 1 and got[2]["2001_loss"] == 0


def test_region_clusters(spark):
    rows = [(1, 0.0, 0), (2, 0.5, 0), (3, 0.5, 3), (4, 9.0, 0), (5, None, 0), (6, 20.0, 0), (7, 20.0, 12)]
    df = spark.createDataFrame(rows, "row_id long, x double, day int").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    got = {r["row_id"]: (r["labs1"], r["labs8"]) for r in C.region_clusters(df, "row_id", ["x", "y", "z"], "day", 1.0, (1, 8), {8: 100}).collect()}
    assert got == {1: (0, 100), 2: (0, 100), 3: (1, 100), 4: (2, 101), 6: (3, 102), 7: (4, 103)}
