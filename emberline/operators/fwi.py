"""The Canadian Fire Weather Index of every cell and day.

Three moisture codes carry over from day to day, so a cell's days are worked
off in order.  Cells are independent: a task takes a block of cells, lays
their days out as a (day, cell) array and steps through the days with all
cells of the block at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.met import MID_MONTH_DAYS, day_length_hours
from ..plans.materialize import materialize

#: Moisture codes at the start of a series.
START = (85.0, 6.0, 15.0)
#: Effective day lengths (DMC) and day-length factors (DC) by month.
MIDLAT_LE = (6.5, 7.5, 9.0, 12.8, 13.9, 13.9, 12.4, 10.9, 9.4, 8.0, 7.0, 6.0)
MIDLAT_LF = (-1.6, -1.6, -1.6, 0.9, 3.8, 5.8, 6.4, 5.0, 2.4, 0.4, -1.6, -1.6)
TROPICAL_LE, TROPICAL_LF = 9.0, 1.4
#: Rows that a block of cells aims at.
BLOCK_ROWS = 200_000
CODES = ("ffmc", "dmc", "dc", "isi", "bui", "fwi")


class Codes(NamedTuple):
    ffmc: np.ndarray
    dmc: np.ndarray
    dc: np.ndarray


def fine_fuel(f0, t, h, w, rain):
    """Fine fuel moisture code."""
    m = 147.2 * (101.0 - f0) / (59.5 + f0)
    rf = np.maximum(rain - 0.5, 1e-12)
    wet = m + 42.5 * rf * np.exp(-100.0 / np.maximum(251.0 - m, 1e-12)) * (1.0 - np.exp(-6.93 / rf))
    wet = np.where(m > 150.0, wet + 0.0015 * (m - 150.0) ** 2 * np.sqrt(rf), wet)
    m = np.where(rain > 0.5, np.minimum(wet, 250.0), m)
    tail = 0.18 * (21.1 - t) * (1.0 - np.exp(-0.115 * h))
    ed = 0.942 * h**0.679 + 11.0 * np.exp((h - 100.0) / 10.0) + tail
    ew = 0.618 * h**0.753 + 10.0 * np.exp((h - 100.0) / 10.0) + tail

    def rate(x):
        return (0.424 * (1.0 - x**1.7) + 0.0694 * np.sqrt(w) * (1.0 - x**8)) * 0.581 * np.exp(0.0365 * t)

    drying = ed + (m - ed) / 10.0 ** rate(h / 100.0)
    wetting = ew - (ew - m) / 10.0 ** rate((100.0 - h) / 100.0)
    m = np.where(m > ed, drying, np.where((m < ed) & (m <= ew), wetting, m))
    return np.clip(59.5 * (250.0 - m) / (147.2 + m), 0.0, 101.0)


def duff(p0, t, h, rain, le):
    """Duff moisture code."""
    rk = 1.894 * (np.maximum(t, -1.1) + 1.1) * (100.0 - h) * le * 1e-4
    rw = 0.92 * rain - 1.27
    logp = np.log(np.maximum(p0, 1e-12))
    b = np.where(p0 <= 33.0, 100.0 / (0.5 + 0.3 * p0), np.where(p0 <= 65.0, 14.0 - 1.3 * logp, 6.2 * logp - 17.2))
    moisture = 20.0 + 280.0 / np.exp(0.023 * p0) + 1000.0 * rw / (48.77 + b * rw)
    wet = 43.43 * (5.6348 - np.log(np.maximum(moisture - 20.0, 1e-12)))
    return np.maximum(np.maximum(np.where(rain > 1.5, wet, p0), 0.0) + rk, 1.0)


def drought(d0, t, rain, lf):
    """Drought code."""
    wet = 800.0 * np.exp(-d0 / 400.0) + 3.937 * (0.83 * rain - 1.27)
    d0 = np.where(rain > 2.8, np.maximum(0.0, 400.0 * np.log(800.0 / np.maximum(wet, 1e-12))), d0)
    v = np.where(t < -2.8, lf, 0.36 * (t + 2.8) + lf)
    return d0 + 0.5 * np.maximum(v, 0.0)


def spread(ffmc, w):
    """Initial spread index."""
    m = 147.2 * (101.0 - ffmc) / (59.5 + ffmc)
    return 19.115 * np.exp(-0.1386 * m) * (1.0 + m**5.31 / 4.93e7) * np.exp(0.05039 * w)


def buildup(p, d):
    """Buildup index."""
    low = p <= 0.4 * d
    s = np.maximum(p + 0.4 * d, 1e-300)
    return np.maximum(0.0, np.where(low, 0.8 * d * p / s, p - (1.0 - 0.8 * d / s) * (0.92 + (0.0114 * p) ** 1.7)))


def fire_weather(isi, bui):
    """Fire weather index."""
    f = np.where(bui <= 80.0, 0.626 * bui**0.809 + 2.0, 1000.0 / (25.0 + 108.64 / np.exp(0.023 * np.minimum(bui, 20_000.0))))
    bb = 0.1 * isi * f
    return np.where(bb <= 1.0, bb, np.exp(2.72 * np.maximum(0.0, 0.434 * np.log(np.maximum(bb, 1.0))) ** 0.647))


def step(state: Codes, t, h, w, rain, le, lf) -> tuple[Codes, dict[str, np.ndarray]]:
    """One day for all cells.  Where any input is missing the state stays and the outputs are NaN."""
    h = np.minimum(h, 100.0)
    ok = ~(np.isnan(t) | np.isnan(h) | np.isnan(w) | np.isnan(rain))
    t_, h_, w_, r_ = (np.where(ok, v, s) for v, s in ((t, 20.0), (h, 50.0), (w, 0.0), (rain, 0.0)))
    with np.errstate(all="ignore"):
        new = Codes(fine_fuel(state.ffmc, t_, h_, w_, r_), duff(state.dmc, t_, h_, r_, le), drought(state.dc, t_, r_, lf))
        isi, bui = spread(new.ffmc, w_), buildup(new.dmc, new.dc)
        out = dict(zip(CODES, (*new, isi, bui, fire_weather(isi, bui)), strict=True))
    kept = Codes(*(np.where(ok, n, s) for n, s in zip(new, state, strict=True)))
    return kept, {k: np.where(ok, v, np.nan) for k, v in out.items()}


def day_factors(mode: str, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Effective day lengths and factors, each 12 x cells."""
    n = len(lat)
    if mode == "tropical":
        return np.full((12, n), TROPICAL_LE), np.full((12, n), TROPICAL_LF)
    if mode == "midlat":
        return np.repeat(np.array(MIDLAT_LE)[:, None], n, 1), np.repeat(np.array(MIDLAT_LF)[:, None], n, 1)
    if mode == "latitude":
        return np.array([[max(day_length_hours(d, x), 0.0) - 3.0 for x in lat] for d in MID_MONTH_DAYS]).reshape(12, n), np.full((12, n), TROPICAL_LF)
    raise ValueError(f"{mode!r} is none of tropical, midlat, latitude")


def _run_block(mode: str, names: Sequence[str]):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cells, c = np.unique(rows["cell"].astype(str).to_numpy(), return_inverse=True)
        days, d = np.unique(rows["day"].to_numpy().astype("datetime64[D]"), return_inverse=True)
        grids = {}
        for v in ("t", "h", "w", "rain"):
            g = np.full((len(days), len(cells)), np.nan)
            g[d, c] = rows[v].to_numpy(float)
            grids[v] = g
        present = np.zeros((len(days), len(cells)), bool)
        present[d, c] = True
        lat = np.full(len(cells), 0.0)
        lat[c] = np.nan_to_num(rows["lat"].to_numpy(float))
        state = Codes(*(np.full(len(cells), s) for s in START))
        for k, n in enumerate(("s_ffmc", "s_dmc", "s_dc")):
            given = rows[n].to_numpy(float)
            known = ~np.isnan(given)
            state[k][c[known]] = given[known]
        le, lf = day_factors(mode, lat)
        months = days.astype("datetime64[M]").astype(int) % 12
        out = {k: np.empty((len(days), len(cells))) for k in CODES}
        for i in range(len(days)):
            state, day = step(state, *(grids[v][i] for v in ("t", "h", "w", "rain")), le[months[i]], lf[months[i]])
            for k in CODES:
                out[k][i] = day[k]
        found = rows[[*names, "day"]].copy()
        for k in CODES:
            v = out[k][d, c]
            found[k] = pd.Series(v, index=found.index, dtype="float64").where(~np.isnan(v), None)
        return found

    return run


def fwi_daily(
    df: DataFrame, keys: Sequence[str], day: str, t: str, h: str, w: str, rain: str,
    mode: str = "tropical", lat: str | None = None, wind_unit: str = "ms_as_is", initial_state: DataFrame | None = None,
) -> DataFrame:
    """``keys, day, ffmc, dmc, dc, isi, bui, fwi`` of each row.

    One row per key and day is expected (of several the last in the task
    counts).  Days need not be consecutive: the recurrence steps over the days
    that are there.  A row with a missing (NULL, NaN) input has NULL outputs
    and leaves the state as it was.  Relative humidity is clamped to 100.

    ``mode``: day-length tables ``tropical``, ``midlat`` or ``latitude`` (from
    the column ``lat``).  ``wind_unit``: ``kmh`` or ``ms_as_is`` pass the
    value through, as the published tables and the gridded archive use it;
    ``ms`` converts to km/h.  ``initial_state``: ``keys, ffmc, dmc, dc`` to go
    on from, such as ``final_state`` of an earlier run; others start anew.

    Cells are hashed into blocks of about ``BLOCK_ROWS`` rows (rows counted);
    a cell is one series and can't be split, its days bound it.
    """
    number = lambda c: F.col(c).cast("double")
    wind = number(w) * 3.6 if wind_unit == "ms" else number(w)
    plain = df.where(F.col(day).isNotNull()).select(
        *keys, F.col(day).cast("date").alias("day"), number(t).alias("t"), number(h).alias("h"), wind.alias("w"), number(rain).alias("rain"),
        (number(lat) if lat else F.lit(None).cast("double")).alias("lat"),
    )
    codes = ("ffmc", "dmc", "dc")
    if initial_state is None:
        plain = plain.withColumns({f"s_{k}": F.lit(None).cast("double") for k in codes})
    else:
        plain = plain.join(initial_state.select(*keys, *(F.col(k).cast("double").alias(f"s_{k}") for k in codes)), list(keys), "left")
    text = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    plain = materialize(plain, "weather")  # counted and worked off without running the input twice
    blocks = max(df.sparkSession.sparkContext.defaultParallelism, -(-plain.count() // BLOCK_ROWS))
    placed = plain.withColumns({"cell": text, "block": F.pmod(F.xxhash64(text), F.lit(blocks)).cast("int")})
    kinds = {f.name: f.dataType.simpleString() for f in plain.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", day date, " + ", ".join(f"{k} double" for k in CODES)
    return placed.groupBy("block").applyInPandas(_run_block(mode, list(keys)), schema)


def final_state(fwi: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, ffmc, dmc, dc`` after the last day with outputs: what an archive hands to a forecast."""
    last = fwi.where("fwi IS NOT NULL").groupBy(*keys).agg(F.max_by(F.struct("ffmc", "dmc", "dc"), "day").alias("s"))
    return last.select(*keys, "s.ffmc", "s.dmc", "s.dc")
