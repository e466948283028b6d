"""Scores, gates and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 2.0**-52


def ratio(part: Column, total: Column) -> Column:
    return F.when(total > 0, part / total).otherwise(F.lit(0.0))


def capped(value: Column, most: float) -> Column:
    """min(value / most, 1); with a limit of 0 any value but 0 is 1."""
    if most == 0:
        return F.when(value == 0, F.lit(0.0)).otherwise(F.lit(1.0))
    return F.least(value / most, F.lit(1.0))


def composite(parts: list[tuple[float, Column, float]]) -> Column:
    """Sum of weight * min(value / most, 1)."""
    out = F.lit(0.0)
    for weight, value, most in parts:
        out = out + F.lit(weight) * capped(value, most)
    return out


def ramp(x: Column, low: float, high: float) -> Column:
    """0 up to low, 1 from high on, linear between; limits the wrong way round, or equal, give 1 for every value."""
    if high <= low:
        return F.when(x.isNotNull(), F.lit(1.0))
    return F.when(x <= low, F.lit(0.0)).when(x >= high, F.lit(1.0)).otherwise((x - low) / (high - low))


def deficit(count: Column, total: Column) -> Column:
    """One dimension's score: 1 less findings over functions, between 0 and 1."""
    return 1 - F.least(count / F.greatest(total, F.lit(1)), F.lit(1.0))


def weighted(scores: list[Column], weights: list[float]) -> Column:
    """clamp(1 - active * (1 - sum of score * weight)), active being how many weights count, 1 at least."""
    active = max(1, sum(w > EPSILON for w in weights))
    mean = sum((s * w for s, w in zip(scores, weights, strict=True)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - active * (1 - mean)))


def diff(base: DataFrame, current: DataFrame, counters: list[str]) -> DataFrame:
    """Counter, old, new and delta, from two tables of one row each."""
    long = lambda df, v: df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, counters)), F.array(*(F.col(c).cast("double") for c in counters)))).alias("counter", v))
    both = long(base, "old").join(long(current, "new"), "counter", "full")
    return both.select("counter", "old", "new", (F.coalesce("new", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))).alias("delta"))


def over_limit(part: Column, total: Column, limit: float) -> Column:
    """Part / total > limit; false without a total."""
    return F.coalesce(F.when(total > 0, part / total > limit), F.lit(False))


def first_gate(gates: list[tuple[str, Column]]) -> Column:
    """The first gate that fails, in order; null where all pass."""
    return F.coalesce(*(F.when(c, F.lit(name)) for name, c in gates))


def calibrated(value: Column, default: float, headroom: float = 1.2) -> Column:
    """K30, over groups: the largest value with headroom, rounded up, the default at least."""
    return F.greatest(F.ceil(F.max(value) * headroom).cast("double"), F.lit(float(default)))
