"""Units from remarks, descriptions and values."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators.units import H2M, T2M, TP, fit_mixture, stated_in_description, stated_in_remark, with_source_units, with_units

REMARKS = {
    "T (°C)": ("C", None, None), "TEMPERATURE ALREADY CELSIUS": ("C", None, None), "grados centigrados": ("C", None, None), "temp 25.6 C": ("C", None, None), "t2m in degC": ("C", None, None),
    "Temp.F": ("F", None, None), "temperatura en grados F": ("F", None, None), "thermometer reads fahrenheit": ("F", None, None), "temp 72.9 F": ("F", None, None), "t2m in K": ("K", None, None), "suhu dalam Kelvin": ("K", None, None), "temp 299.1 K": ("K", None, None),
    "tp in mm": (None, "mm", None), "hujan dalam milimeter": (None, "mm", None), "lluvia en milímetros": (None, "mm", None), "LLUVIA EN MILÍMETROS": (None, "mm", None), "gauge reading in millimetres": (None, "mm", None), "rain 0.2 mm": (None, "mm", None),
    'rain 0.019"': (None, "in", None), "rain 0.0 in.": (None, "in", None), "precip [in]": (None, "in", None), "hujan dalam inci": (None, "in", None), "tp in inches": (None, "in", None),
    "tp in m": (None, "m", None), "rain 6e-05 m": (None, "m", None), "hujan dalam meter": (None, "m", None), "precipitation in metres of water": (None, "m", None),
    "h2m 0..1": (None, None, "fraction"), "RH as fraction": (None, None, "fraction"), "kelembapan sebagai pecahan": (None, None, "fraction"), "ratio not percent": (None, None, "fraction"), "per mille": (None, None, "tenths"), "h2m x10": (None, None, "tenths"), "humidity scaled by ten": (None, None, "tenths"),
    "T (°C); tp in mm": ("C", "mm", None), "lluvia en pulgadas / Temp.F": ("F", "in", None), "absolute temperature, kelvin": ("K", None, None),
    "display shows % and F, fixed": (None, None, None), "fan replaced, 5 C test ok": (None, None, None), "checked against 12 mm gauge": (None, None, None), "mast lowered by 6 inches": (None, None, None),
    "h2m was a fraction before the repair": (None, None, None), "d2m in degC": (None, None, None), "battery low": (None, None, None), "": (None, None, None), None: (None, None, None),
}


def test_remarks(spark):
    df = spark.createDataFrame([(r, *v) for r, v in REMARKS.items()], "remark string, a string, b string, c string")
    for r in df.select("*", *(stated_in_remark(q, "remark").alias(q.field) for q in (T2M, TP, H2M))).collect():
        assert (r["t2m"], r["tp"], r["h2m"]) == (r["a"], r["b"], r["c"]), r["remark"]


DESCRIPTIONS = [
    ("temperatures in kelvin and total precipitation in metres of water.", "K", "m"), ("Kelvin throughout; rain is delivered as millimetres in this stream.", "K", "mm"),
    ("K for both temperatures, precipitation now in m.", "K", "m"), ("t2m and d2m [K], tp [m], winds [m s-1].", "K", "m"), ("degrees Celsius, rain gauge in mm (funnel rim 8 inches wide).", "C", "mm"),
    ("Fahrenheit and inches of rain.", "F", "in"), ("Loggers reset to Celsius, the tipping buckets still count inches of rain.", "C", "in"), ("temperature written as read, whatever the scale. Rain in millimetres.", None, "mm"), (None, None, None),
]


def test_descriptions(spark):
    df = spark.createDataFrame(DESCRIPTIONS, "description string, a string, b string")
    for r in df.select("*", stated_in_description(T2M, "description").alias("t"), stated_in_description(TP, "description").alias("p")).collect():
        assert (r["t"], r["p"]) == (r["a"], r["b"]), r["description"]


def test_mixture_finds_units_and_flags_doubt(spark):
    rng = np.random.default_rng(2)
    true = np.concatenate([np.full(300, 0), np.full(120, 1), np.full(80, 2)])
    k = rng.normal(299, 3, 500)
    v = np.choose(true, [k, k - 273.15, k * 9 / 5 - 459.67])
    rows = [(i, float(x), None) for i, x in enumerate(v)] + [(1000, None, "x"), (1001, -9999.0, "x"), (1002, float("nan"), "x"), (1003, 1e9, "x")]
    df = spark.createDataFrame(rows, "id int, t2m double, remark string").withColumn("t2m_unit", F.lit("old"))
    out = {r["id"]: r for r in with_units(df, T2M, "t2m", stated_in_remark(T2M, "remark")).collect()}
    assert all(out[i]["t2m_unit"] == "KCF"[t] and out[i]["t2m_by"] == "value" for i, t in enumerate(true))
    assert all(abs(out[i]["t2m_nominal"] - k[i]) < 1e-6 for i in range(500))
    assert all(out[i]["t2m_unit"] is None and out[i]["t2m_nominal"] is None for i in (1000, 1001, 1002, 1003))
    # two units a factor of ten apart and a wide spread: values between are uncertain
    wide = fit_mixture(H2M, np.array([30.0, 60.0, 90.0]), np.array([5.0, 5.0, 5.0]))
    assert abs(sum(wide.weights.values()) - 1) < 1e-9
    assert fit_mixture(H2M, np.zeros(0), np.zeros(0)).mean == pytest.approx(np.log(70.0))


def test_zero_and_stated_units(spark):
    df = spark.createDataFrame([(1, 0.0, None), (2, 0.0, "tp in mm"), (3, 4.0, "tp in mm"), (4, 0.004, None), (5, -999.0, "tp in mm")], "id int, tp double, remark string")
    out = {r["id"]: (r["tp_unit"], r["tp_by"], r["tp_nominal"]) for r in with_units(df, TP, "tp", stated_in_remark(TP, "remark"), F.lit("m")).collect()}
    assert out[1] == ("m", "source", 0.0) and out[2][0] == "mm" and out[3] == ("mm", "remark", 0.004) and out[4] == ("m", "source", 0.004) and out[5] == (None, None, None)
    assert with_units(df.limit(0), TP, "tp").collect() == []


def test_description_in_force(spark):
    feeds = spark.sql("SELECT * FROM VALUES ('a', DATE '2002-01-01', 'Celsius'), ('a', DATE '2003-01-01', 'kelvin') t(feed, valid_from, description)")
    rows = spark.sql("SELECT * FROM VALUES (1, 'a', TIMESTAMP_NTZ '2002-12-31 23:00:00'), (2, 'a', TIMESTAMP_NTZ '2003-01-01 00:00:00'), (3, 'b', TIMESTAMP_NTZ '2003-01-01 00:00:00'), (4, 'a', TIMESTAMP_NTZ '2001-01-01 00:00:00'), (5, NULL, NULL) t(id, feed, time)")
    for most in (0, 100):
        got = {r["id"]: r["t2m_source_unit"] for r in with_source_units(rows, feeds, "feed", "time", "valid_from", "description", [T2M], most).collect()}
        assert got == {1: "C", 2: "K", 3: None, 4: None, 5: None}
