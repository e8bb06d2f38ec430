"""Trailing totals and daily grids against plain Python."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from emberline.operators.regular import daily_grid
from emberline.operators.rolling import trailing_totals

D0 = dt.date(2019, 2, 20)


def test_trailing_totals(spark):
    rng = random.Random(4)
    rows = []
    for k in ("a", "b", None):
        for d in range(60):
            for _ in range(rng.choice([0, 0, 1, 2])):
                rows.append((k, D0 + dt.timedelta(d), rng.choice([None, float("nan"), float("inf"), 1.5, 2.0, -3.25]), 9))
    rows.append(("a", None, 5.0, 1))
    df = spark.createDataFrame(rows, "key string, day date, v double, k0 int").selectExpr("*", "k0 AS d", "k0 AS v0", "k0 AS until")
    got = {(r["key"], r["day"]): r for r in trailing_totals(df, ["key"], "day", ["v"], (7, 30)).collect()}
    want = {}
    for k in ("a", "b", None):
        days = [r[1] for r in rows if r[0] == k and r[1]]
        d = min(days)
        while d <= max(days):
            for n in (7, 30):
                vs = [r[2] for r in rows if r[0] == k and r[1] and d - dt.timedelta(n) < r[1] <= d and r[2] is not None and abs(r[2]) < 1e9]
                want[k, d, n] = (sum(vs), len(vs))
            d += dt.timedelta(1)
    assert {(k, d) for k, d, _ in want} == set(got)
    for (k, d, n), (total, count) in want.items():
        r = got[k, d]
        assert abs(r[f"v_sum_{n}"] - total) < 1e-9 and r[f"v_cnt_{n}"] == count
        assert (r[f"v_avg_{n}"] is None) == (count == 0) and (not count or abs(r[f"v_avg_{n}"] - total / count) < 1e-9)
    assert trailing_totals(df.limit(0), ["key"], "day", ["v"]).collect() == []


def expected(readings, max_gap, counter):
    """Second by second shares, from the definition."""
    rs = sorted(readings)
    days = {}
    for t, _ in rs:
        days.setdefault(t.date(), [0, 0.0, "reading"])[0] += 1
    d = min(days)
    while d <= max(days):
        days.setdefault(d, [0, 0.0, "uncovered"])
        d += dt.timedelta(1)
    prev = None
    for t, v in rs:
        inc = v if not counter else 0.0 if prev is None else v if v < prev[1] else v - prev[1]
        gap = None if prev is None else (t.date() - prev[0].date()).days
        if prev is None or gap > max_gap or t == prev[0]:
            days[t.date()][1] += inc
        else:
            total = (t - prev[0]).total_seconds()
            for i in range(gap + 1):
                day = prev[0].date() + dt.timedelta(i)
                start = dt.datetime.combine(day, dt.time())
                part = (min(t, start + dt.timedelta(1)) - max(prev[0], start)).total_seconds() / total
                days[day][1] += inc * part
                if 0 < i < gap:
                    days[day][2] = "filled"
        prev = (t, v)
    return days


@pytest.mark.parametrize("counter", [True, False])
def test_daily_grid(spark, counter):
    rng = random.Random(7)
    rows = []
    for k in ("a", "b"):
        for _ in range(40):
            t = dt.datetime(2019, 1, 1) + dt.timedelta(seconds=rng.randrange(90 * 86400))
            rows.append((k, t, float(rng.choice([0, 3, 10, 50]))))
    rows += [("a", rows[3][1], 77.0), ("c", dt.datetime(2019, 5, 5, 3), 4.0)]
    bad = [("a", None, 1.0), ("b", dt.datetime(2019, 1, 5), None), ("b", dt.datetime(2018, 1, 5), float("nan"))]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], "key string, at timestamp_ntz, v double, day string").selectExpr("*", "day AS d", "day AS n", "day AS first")
    got = {(r["key"], r["day"]): r for r in daily_grid(df, ["key"], "at", "v", 4, counter).collect()}
    want = {(k, d): x for k in ("a", "b", "c") for d, x in expected([r[1:] for r in rows if r[0] == k], 4, counter).items()}
    assert set(got) == set(want)
    for key, (n, amount, status) in want.items():
        assert (got[key]["n_readings"], got[key]["status"]) == (n, status) and abs(got[key]["amount"] - amount) < 1e-6
    assert daily_grid(df.limit(0), ["key"], "at", "v", 4, counter).collect() == []
