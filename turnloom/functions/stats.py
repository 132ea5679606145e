"""Statistics over aggregates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Normal quantiles by confidence; other levels use 1.96. Fixed values.
Z = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576}


def z_of(confidence: float) -> float:
    return Z.get(round(confidence, 2), 1.96)


def ratio(a: Column, b: Column) -> Column:
    """a by b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def mean_interval(x: Column, confidence: float = 0.95) -> list[Column]:
    """``n, mean, std, low, high`` of the values that are not null; one value gives itself as bounds."""
    n, mean, std = F.count(x), F.avg(x), F.coalesce(F.stddev_samp(x), F.lit(0.0))
    half = z_of(confidence) * std / F.sqrt(n)
    return [n.alias("n"), mean.alias("mean"), F.when(n > 0, std).alias("std"), F.when(n > 0, mean - half).alias("low"), F.when(n > 0, mean + half).alias("high")]


def wilson(successes: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Wilson's interval of a proportion, clipped to 0..1; (0, 1) of no trials."""
    z = z_of(confidence)
    m = F.greatest(n, F.lit(1)).cast("double")
    p = successes / m
    centre = (p + z * z / (2 * m)) / (1 + z * z / m)
    margin = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - margin)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), centre + margin)).otherwise(1.0)


def standard_error(x: Column) -> Column:
    """Sample deviation by the root of n, 0 for fewer than two values."""
    return F.coalesce(F.try_divide(F.stddev_samp(x), F.sqrt(F.count(x))), F.lit(0.0))


def shares_of(n: int, parts: list[str]) -> dict[str, int]:
    """n split evenly over the parts; the first ones take what is left over."""
    base, over = divmod(max(0, n), max(1, len(parts)))
    return {p: base + (k < over) for k, p in enumerate(parts)}


def histogram_bins(n: int) -> int:
    """Bins for n values: a third of them, from 8 to 24."""
    return min(24, max(8, n // 3))


def normal_interval(p: Column, n: Column) -> tuple[Column, Column]:
    """Normal interval of a proportion at 95 %, where no Wilson bounds are given."""
    half = 1.96 * F.sqrt(p * (1 - p) / n)
    return p - half, p + half
