"""The same operators over streams.

``fire_counts`` and ``without_repeats`` keep state as long as their watermark
and lose what comes later.  Where a source's delay isn't bounded, ``counts_to``
and ``firsts_to`` write what each micro-batch adds to a table and a batch run
merges it (``merged_counts``, ``merged_firsts``): no row is too late for them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fwi import CODES, START, Codes, day_factors, step


def fire_counts(events: DataFrame, time: str, keys: Sequence[str], window: str = "1 day", late: str = "14 days") -> DataFrame:
    """Detections per window and key; windows close after ``late`` and lose later rows: give it the source's longest delay, or use ``counts_to``."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def without_repeats(events: DataFrame, time: str, keys: Sequence[str], late: str = "14 days") -> DataFrame:
    """Each key once within the watermark; rows later than ``late`` are lost: give it the source's longest delay, or use ``firsts_to``."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


_LATE = {"late": "boolean", "t": "double", "h": "double", "w": "double", "rain": "double"}


def _parts_to(events: DataFrame, work: Callable[[DataFrame], DataFrame], at: str):
    def put(batch: DataFrame, k: int) -> None:
        # a batch that is run again replaces its part
        work(batch).write.mode("overwrite").parquet(f"{at}/part__={k}")

    return events.writeStream.foreachBatch(put)


def counts_to(events: DataFrame, time: str, keys: Sequence[str], at: str, window: str = "1 day"):
    """A stream writer that adds each micro-batch's counts to the table ``at``, however late its rows are.

    The caller gives it a checkpoint and starts it; table and checkpoint belong together.
    """
    return _parts_to(events, lambda b: b.groupBy(F.window(time, window).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n"), at)


def merged_counts(spark: SparkSession, at: str, keys: Sequence[str]) -> DataFrame:
    """``start, keys, n`` over all that ``counts_to`` has written so far."""
    return spark.read.parquet(at).groupBy("start", *keys).agg(F.sum("n").alias("n"))


def _firsts(df: DataFrame, time: str, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in {time, *keys, "part__"}]
    one = df.groupBy(*keys).agg(F.min(F.struct(time, *rest)).alias("one__"))
    return one.select(*keys, *(F.col(f"one__.{c}").alias(c) for c in (time, *rest)))


def firsts_to(events: DataFrame, time: str, keys: Sequence[str], at: str):
    """A stream writer that adds each micro-batch's earliest row of every key to the table ``at``; as ``counts_to``."""
    return _parts_to(events, lambda b: _firsts(b, time, keys), at)


def merged_firsts(spark: SparkSession, at: str, time: str, keys: Sequence[str]) -> DataFrame:
    """Each key once, its earliest row, over all that ``firsts_to`` has written so far."""
    return _firsts(spark.read.parquet(at), time, keys)


def _advance(mode: str, keep_late: bool):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        *codes, last = state.get if state.exists else (*START, "")
        now = Codes(*(np.array([c]) for c in codes))
        rows = pd.concat(list(batches), ignore_index=True)
        rows["day"] = pd.to_datetime(rows["day"])
        rows = rows.sort_values("day", kind="stable").drop_duplicates("day", keep="last")
        le, lf = day_factors(mode, rows["lat"].to_numpy(float)[-1:] if mode == "latitude" else np.zeros(1))
        days = rows["day"].dt.strftime("%Y-%m-%d").to_numpy()
        late = days <= last  # the state has passed them: only a batch run can work them in
        months = rows["day"].dt.month.to_numpy() - 1
        weather = rows[["t", "h", "w", "rain"]].to_numpy(float)
        got = {c: np.full(len(rows), np.nan) for c in CODES}
        for i in np.flatnonzero(~late):
            now, one = step(now, *weather[i][:, None], le[months[i]], lf[months[i]])
            for c in CODES:
                got[c][i] = one[c][0]
        if not late.all():
            last = days[~late].max()
        state.update((*(float(c[0]) for c in now), str(last)))
        out = pd.DataFrame({"cell": key[0], "day": rows["day"].dt.date.to_numpy()} | {c: pd.Series(v, dtype="object").where(~np.isnan(v), None) for c, v in got.items()})
        if keep_late:
            out = out.assign(late=late, **{c: weather[:, i] for i, c in enumerate(("t", "h", "w", "rain"))})
            yield out
        else:
            yield out[~late]

    return run


def fwi_stream(weather: DataFrame, mode: str = "tropical", keep_late: bool = False) -> DataFrame:
    """The fire-weather recurrence over a stream ``cell STRING, day DATE, t, h, w, rain``, and ``lat`` of the cell for the mode ``latitude``.

    Each cell's three codes and last day are kept as state from batch to
    batch.  Days come in order per cell from batch to batch; of a day the last
    row of a batch counts.  A day not after the cell's last one can't change
    the state any more: it is left out, or with ``keep_late`` returned with
    ``late``, its weather and no indices.  All rows then have ``late`` and their
    weather, so ``fwi_daily`` over them works the late days in.
    """
    return weather.groupBy("cell").applyInPandasWithState(
        _advance(mode, keep_late), "cell string, day date, " + ", ".join(f"{c} {kind}" for c, kind in (dict.fromkeys(CODES, "double") | (_LATE if keep_late else {})).items()), "ffmc double, dmc double, dc double, last string", "append", "NoTimeout"
    )
