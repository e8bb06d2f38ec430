"""Quantities recorded in different units, brought into common ones.

A unit comes from what is written about the very field, first in the row, then
in the description of its source; where neither says anything, from the value,
by a mixture on the log scale whose components are one distribution of the
nominal quantity, seen through the known conversions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import finite
from ..plans.materialize import materialize

#: Numbers that stand for a missing value.
MISSING = (-32768.0, -9999.0, -999.0, -99.0, 9999.0, 99999.0, 32767.0)


@dataclass(frozen=True)
class Unit:
    """``nominal = (value + shift) * scale``; ``pattern``: how texts name it (Java regular expression, lower case)."""

    name: str
    scale: float
    shift: float = 0.0
    pattern: str = ""

    def to_nominal(self, value):
        return (value + self.shift) * self.scale


@dataclass(frozen=True)
class Quantity:
    """A field, its units (the nominal one first), and what the mixture starts from.

    ``low, high``: bounds of a plausible nominal value; outside of them in
    every unit the value counts as missing.  ``centre, spread``: start of the
    fit, on the log scale.  ``bin_width``: width of the histogram's bins, on
    the log scale if ``log_bins``; it bounds what reaches the driver to
    (range / width) counts, whatever the rows.  ``missing``: numbers that
    stand for a missing value, even where they are plausible in some unit.
    """

    field: str
    units: tuple[Unit, ...]
    low: float
    high: float
    centre: float
    spread: float
    log_bins: bool = True
    bin_width: float = 0.01
    zero_is_any: bool = False
    missing: tuple[float, ...] = MISSING


_T = r"(?:\bt2m\b|\btemp\w*\b|\bsuhu\b|\btermometer\b|\bthermometer\b|\bt\b)"
_P = r"(?:\btp\b|\brain\w*|\bprecip\w*|\blluvia\b|\bhujan\b|\bgauge reading\b)"
_GAP = r"[^;,/]*?"

#: The fields, their units and how remarks name them.
T2M = Quantity(
    "t2m",
    (
        Unit("K", 1.0, 0.0, rf"kelvin|°k|\bdeg ?k\b|{_T}\.? in k\b|{_T}\.? -?[0-9.]+ ?k\b|{_T}\.?k\b|{_T} \[k\]"),
        Unit("C", 1.0, 273.15, rf"celsius|centigrad|°c|\bdeg ?c\b|{_T}\.? in c\b|{_T}\.? -?[0-9.]+ ?c\b|{_T}\.?c\b|{_T} \[c\]|grados c\b"),
        Unit("F", 5 / 9, 459.67, rf"fahrenheit|°f|\bdeg ?f\b|{_T}\.? in f\b|{_T}\.? -?[0-9.]+ ?f\b|{_T}\.?f\b|{_T} \[f\]|grados f\b"),
    ),
    low=180.0, high=345.0, centre=300.0, spread=0.02, log_bins=False, bin_width=0.1,
)
TP = Quantity(
    "tp",
    (
        Unit("m", 1.0, 0.0, rf"{_P}{_GAP}(?:\[m\]|\bin m\b|\bmetres?\b|\bmeters?\b|\bmetros?\b|[0-9] ?m\b)"),
        Unit("mm", 0.001, 0.0, rf"{_P}{_GAP}(?:\bmm\b|[0-9]mm\b|mill?imet|milímet)"),
        Unit("in", 0.0254, 0.0, rf"{_P}{_GAP}(?:\[in\]|\bin\.|[0-9] ?in\b|\binch|\binci\b|pulgada|[0-9]\")"),
    ),
    low=1e-7, high=2.0, centre=0.002, spread=1.2, zero_is_any=True,
)
H2M = Quantity(
    "h2m",
    (
        Unit("%", 1.0, 0.0, r"\b(?:rh|h2m|humidity|kelembapan|humedad) (?:in|en|dalam|\[)\W*(?:%|percent\b|persen\b)"),
        Unit("fraction", 100.0, 0.0, r"fraction|fracci|\b0\.\.1\b|share of one|pecahan|ratio not percent"),
        Unit("tenths", 0.1, 0.0, r"\bx ?10\b|by ten\b|tenths of a percent|per mille|permil|‰"),
    ),
    low=1.0, high=125.0, centre=70.0, spread=0.3,
)

#: What a remark says of the past, of another field or of a check isn't about the value.
_ASIDE = r"[^;,/]*\b(?:was|were|before|until|checked against|d2m|dew ?point)\b[^;,/]*"

#: Units as descriptions of whole sources name them: there a unit alone tells the field.
DESCRIPTION_PATTERNS = {
    "t2m": {"F": r"fahrenheit|°f|\bdegf\b", "C": r"celsius|°c|centigrad|\bdegc\b", "K": r"kelvin|\[k\]|\bk (?:for|in|throughout)\b"},
    "tp": {"in": r"inches of rain|(?:rain|precipitation)[a-z ]* (?:in|as) inches|\binches\b", "mm": r"millimet|\bmm\b|milímet", "m": r"\bmet(?:re|er)s?\b|\[m\]|\bin m\b"},
}
_SIZES = r"\([^)]*[0-9]+ (?:inch\w*|mm|m|cm)\b[^)]*\)|[0-9]+ (?:inch\w*|mm|cm) (?:wide|high|long|deep)"


def stated_in_remark(quantity: Quantity, remark: str | Column) -> Column:
    """The unit that a remark gives for the field, or NULL."""
    text = F.regexp_replace(F.lower(F.col(remark) if isinstance(remark, str) else remark), _ASIDE, " ")
    out = None
    # the nominal unit last: its words are parts of the others' in some languages
    for u in (*quantity.units[1:], quantity.units[0]):
        hit = text.rlike(u.pattern)
        out = F.when(hit, u.name) if out is None else out.when(hit, u.name)
    return out


def stated_in_description(quantity: Quantity, description: str) -> Column:
    """The unit that the description of a source gives for the field, or NULL."""
    text = F.regexp_replace(F.lower(description), _SIZES, " ")
    out = None
    for name, pattern in DESCRIPTION_PATTERNS.get(quantity.field, {}).items():
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return F.lit(None).cast("string") if out is None else out


def measured(quantity: Quantity, value: str | Column) -> Column:
    """The value where it is a measurement in some unit, else NULL."""
    v = finite(value)
    ok = F.lit(False)
    for u in quantity.units:
        n = u.to_nominal(v)
        ok = ok | n.between(quantity.low, quantity.high)
    if quantity.zero_is_any:
        ok = ok | (v == 0.0)
    return F.when(~v.isin(list(quantity.missing)) & ok, v)


@dataclass(frozen=True)
class Mixture:
    """A fitted mixture: log of the nominal value is normal; ``weights`` by unit."""

    mean: float
    sd: float
    weights: dict[str, float]


def fit_mixture(quantity: Quantity, values: np.ndarray, counts: np.ndarray, rounds: int = 60) -> Mixture:
    """Expectation maximisation over a histogram; with no values, the start."""
    mean, sd = math.log(quantity.centre), quantity.spread
    weights = np.full(len(quantity.units), 1 / len(quantity.units))
    values, counts = np.asarray(values, float), np.asarray(counts, float)
    if counts.sum() > 0:
        nominal = np.stack([u.to_nominal(values) for u in quantity.units])
        ok = (nominal >= quantity.low) & (nominal <= quantity.high)
        y = np.log(np.where(ok, nominal, 1.0))
        slope = np.log(np.array([u.scale for u in quantity.units]))[:, None] - y
        for _ in range(rounds):
            ll = np.where(ok, np.log(weights)[:, None] + slope - 0.5 * ((y - mean) / sd) ** 2 - math.log(sd), -np.inf)
            top = ll.max(axis=0)
            post = np.where(np.isfinite(top), np.exp(ll - np.where(np.isfinite(top), top, 0.0)), 0.0)
            post /= np.maximum(post.sum(axis=0), 1e-300)
            mass = post * counts
            weights = np.maximum(mass.sum(axis=1) / max(mass.sum(), 1e-300), 1e-6)
            weights /= weights.sum()
            total = max(mass.sum(), 1e-300)
            mean = float((mass * y).sum() / total)
            sd = float(np.sqrt(max((mass * (y - mean) ** 2).sum() / total, (quantity.spread / 20) ** 2)))
    return Mixture(mean, sd, dict(zip((u.name for u in quantity.units), map(float, weights), strict=True)))


def best_unit(quantity: Quantity, mixture: Mixture, value: Column) -> Column:
    """``struct(unit, posterior)`` of the most probable unit of a value; its fields are NULL where no unit is plausible.

    The value and the densities are bound by lambdas, so each is written (and
    computed) once, however large the expression around it.
    """

    def options(v: Column) -> Column:
        out = []
        for u in quantity.units:
            n = u.to_nominal(v)
            y = F.ln(n)
            d = math.log(mixture.weights[u.name]) + math.log(u.scale) - y - 0.5 * F.pow((y - mixture.mean) / mixture.sd, 2)
            out.append(F.struct(F.when(n.between(quantity.low, quantity.high), d).alias("d"), F.lit(u.name).alias("unit")))
        return F.filter(F.array(*out), lambda e: e["d"].isNotNull())

    def choose(all_: Column) -> Column:
        top = F.array_max(all_)
        total = F.aggregate(all_, F.lit(0.0), lambda s, e: s + F.exp(e["d"] - top["d"]))
        return F.struct(top["unit"].alias("unit"), F.try_divide(F.lit(1.0), total).alias("posterior"))

    return F.transform(F.transform(F.array(value), options), choose)[0]


def unit_ranges(quantity: Quantity, mixture: Mixture, grid: int = 20_000) -> list[tuple[float, str | None]]:
    """``(from, unit)``, ascending: which unit is the most probable for values from there on; None where none is plausible."""
    bounds = np.array(sorted(b / u.scale - u.shift for u in quantity.units for b in (quantity.low, quantity.high)))
    w = np.array([math.log(mixture.weights[u.name]) + math.log(u.scale) for u in quantity.units])

    def best(v: np.ndarray) -> np.ndarray:
        n = np.stack([u.to_nominal(v) for u in quantity.units])
        ok = (n >= quantity.low) & (n <= quantity.high)
        y = np.log(np.where(ok, n, 1.0))
        d = np.where(ok, w[:, None] - y - 0.5 * ((y - mixture.mean) / mixture.sd) ** 2, -np.inf)
        return np.where(ok.any(axis=0), d.argmax(axis=0), -1)

    spread = np.geomspace(max(bounds[0], 1e-12), bounds[-1], grid) if bounds[0] > 0 else np.linspace(bounds[0], bounds[-1], grid)
    at = np.unique(np.concatenate([spread, bounds, np.linspace(bounds[0], bounds[-1], grid), np.nextafter(bounds, np.inf), [np.nextafter(bounds[0], -np.inf)]]))
    names = [u.name for u in quantity.units]
    kinds = best(at)
    out = [(-math.inf, None if kinds[0] < 0 else names[kinds[0]])]
    for i in np.flatnonzero(kinds[1:] != kinds[:-1]):
        low, high = at[i], at[i + 1]
        for _ in range(100):
            mid = (low + high) / 2
            if not low < mid < high:
                break
            low, high = (mid, high) if best(np.array([mid]))[0] == kinds[i] else (low, mid)
        out.append((float(high), None if kinds[i + 1] < 0 else names[kinds[i + 1]]))
    return out


def ranged_unit(ranges: list[tuple[float, str | None]], value: Column) -> Column:
    """The ranges as one CASE, so that the unit costs a few comparisons."""
    out = F.when(value < ranges[1][0], F.lit(ranges[0][1])) if len(ranges) > 1 else F.when(value.isNotNull(), F.lit(ranges[0][1]))
    for (_, unit), (end, _) in zip(ranges[1:], ranges[2:], strict=False):
        out = out.when(value < end, F.lit(unit))
    return out.when(value.isNotNull(), F.lit(ranges[-1][1]))


@dataclass(frozen=True)
class Recorded:
    """A column of a table that holds a quantity, and the units that the row and its source state for it, if any."""

    quantity: Quantity
    value: str
    remark_unit: Column | None = None
    source_unit: Column | None = None


def histograms(staged: DataFrame, quantities: Sequence[Quantity]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Values and counts of the rows without a stated unit, by field and bin, zeros left out; one job for all fields.

    At most (plausible range / bin width) rows a field reach the driver.
    """
    bins = []
    for q in quantities:
        v = F.col(f"{q.field}__v")
        silent = F.col(f"{q.field}__r").isNull() & F.col(f"{q.field}__s").isNull() & (v > 0 if q.log_bins else v != 0)
        bins.append(F.when(silent, F.struct(F.lit(q.field).alias("field"), F.round((F.ln(v) if q.log_bins else v) / q.bin_width).cast("long").alias("b"))))
    rows = staged.select(F.explode(F.array_compact(F.array(*bins))).alias("x")).groupBy("x.field", "x.b").count().toArrow().to_pandas()
    out = {}
    for q in quantities:
        own = rows[rows["field"] == q.field]
        centre = own["b"].to_numpy(float) * q.bin_width
        out[q.field] = np.exp(centre) if q.log_bins else centre, own["count"].to_numpy(float)
    return out


def in_common_units(df: DataFrame, recorded: Sequence[Recorded], sure: float = 0.95) -> DataFrame:
    """Adds ``<field>_unit, _by, _posterior, _uncertain, _nominal`` to every row, for each recorded quantity.

    ``_by``: ``remark``, ``source``, ``value`` or NULL where the value is
    missing (then the unit and the nominal value are NULL too).  ``_posterior``
    is 1 for stated units; ``_uncertain`` where the mixture gives the best
    unit less than ``sure``.  Zero of a quantity that is zero in every unit
    gets its stated unit, else the nominal one.  The mixtures are fitted on the
    rows whose unit isn't stated, all of them, through bounded histograms.
    The texts are matched once: what they state is written to a table that the
    histograms and the result are read from.  Give only the columns that are
    needed; existing ones of these names are replaced, others are kept.
    """
    none = F.lit(None).cast("string")
    names = [f"{r.quantity.field}_{n}" for r in recorded for n in ("unit", "by", "posterior", "uncertain", "nominal")]
    kept = [c for c in df.columns if c not in names]
    stages = {}
    for r in recorded:
        f = r.quantity.field
        stages |= {f"{f}__v": measured(r.quantity, r.value), f"{f}__r": none if r.remark_unit is None else r.remark_unit, f"{f}__s": none if r.source_unit is None else r.source_unit}
    staged = materialize(df.withColumns(stages).select(*kept, *stages), "stated")
    seen = histograms(staged, [r.quantity for r in recorded])
    out = staged
    for r in recorded:
        q, f = r.quantity, r.quantity.field
        mixture = fit_mixture(q, *seen[f])
        v, said = F.col(f"{f}__v"), F.coalesce(f"{f}__r", f"{f}__s")
        zero = F.lit(q.zero_is_any) & (v == 0.0)
        unit = F.when(v.isNotNull(), F.coalesce(said, F.when(zero, q.units[0].name), ranged_unit(unit_ranges(q, mixture), v)))
        posterior = F.when(v.isNotNull(), F.when(said.isNotNull() | zero, 1.0).otherwise(best_unit(q, mixture, v)["posterior"]))
        nominal = None
        for u in q.units:
            n = u.to_nominal(v)
            nominal = F.when(F.col(f"{f}_unit") == u.name, n) if nominal is None else nominal.when(F.col(f"{f}_unit") == u.name, n)
        by = F.when(v.isNotNull(), F.when(F.col(f"{f}__r").isNotNull(), "remark").when(F.col(f"{f}__s").isNotNull(), "source").otherwise("value"))
        out = out.withColumns({f"{f}_unit": unit, f"{f}_by": by, f"{f}_posterior": posterior}).withColumns({f"{f}_uncertain": F.col(f"{f}_posterior") < sure, f"{f}_nominal": nominal})
    return out.select(*kept, *names)


def with_units(df: DataFrame, quantity: Quantity, value: str, remark_unit: Column | None = None, source_unit: Column | None = None, sure: float = 0.95) -> DataFrame:
    """``in_common_units`` for one quantity."""
    return in_common_units(df, [Recorded(quantity, value, remark_unit, source_unit)], sure)


def with_source_units(df: DataFrame, sources: DataFrame, key: str, time: str, valid_from: str, description: str, quantities: list[Quantity], most: int = 20_000) -> DataFrame:
    """Adds ``<field>_source_unit``: what the description in force at the row's time says.

    A description holds from ``valid_from`` until the source's next one.  The
    table of sources is broadcast if it has at most ``most`` rows (counted);
    otherwise Spark chooses the join by key and range.
    """
    from pyspark.sql import Window

    ordered = Window.partitionBy("key__").orderBy("from__")
    spans = sources.select(F.col(key).alias("key__"), F.col(valid_from).cast("timestamp_ntz").alias("from__"), *(stated_in_description(q, description).alias(f"{q.field}_source_unit") for q in quantities))
    spans = spans.dropDuplicates(["key__", "from__"]).withColumn("to__", F.lead("from__").over(ordered))
    if sources.count() <= most:
        spans = F.broadcast(spans)
    left = df.drop(*(f"{q.field}_source_unit" for q in quantities))
    t = F.col(time).cast("timestamp_ntz")
    on = (left[key] == F.col("key__")) & (t >= F.col("from__")) & (F.col("to__").isNull() | (t < F.col("to__")))
    return left.join(spans, on, "left").drop("key__", "from__", "to__")
