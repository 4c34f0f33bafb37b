"""Event windows and response features on array columns.

An epoch is one row and its samples one short array, so nothing shuffles: every
feature is a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sparkmap.functions.numeric import finite, half_even

# Gaussian consistency factor of the MAD, and the least usable scale.
MAD_FACTOR = 1.4826
MIN_SCALE = 1e-6
# Window edges in seconds around the pulse.
WINDOWS = {"pre0": -0.5, "pre1": -0.02, "early0": 0.01, "early1": 0.1, "late1": 0.5}


def window_bounds(sample_start: Column, fs: Column, edges: dict[str, float] = WINDOWS) -> dict[str, Column]:
    """Half-open sample bounds; seconds are rounded half-even."""
    return {k: sample_start + half_even(F.lit(sec) * fs) for k, sec in edges.items()}


def epoch_in_bounds(first: Column, last: Column, n_samples: Column) -> Column:
    return (first >= 0) & (last <= n_samples)


def array_mean(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(arr), F.lit(0))


def array_median(arr: Column) -> Column:
    s = F.array_sort(arr)
    n = F.size(arr)
    low = F.get(s, ((n - 1) / 2).cast("int"))
    high = F.get(s, (n / 2).cast("int"))
    return (low + high) / F.lit(2.0)


def array_lower_median(arr: Column) -> Column:
    """The lower of the two middle values."""
    return F.get(F.array_sort(arr), ((F.size(arr) - 1) / 2).cast("int"))


def drop_bad(arr: Column) -> Column:
    return F.filter(arr, finite)


def let(value: Column, body) -> Column:
    """Bind `value` once for use inside a lambda.

    A plain reference to an outer expression would be evaluated again for every
    array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def robust_center(baseline: Column) -> Column:
    return array_median(drop_bad(baseline))


def _usable(scale: Column) -> Column:
    return finite(scale) & (scale >= F.lit(MIN_SCALE))


def _population_sd(arr: Column) -> Column:
    return F.sqrt(let(array_mean(arr), lambda m: array_mean(F.transform(arr, lambda x: (x - m) * (x - m)))))


def robust_scale(baseline: Column, center: Column) -> Column:
    """1.4826 MAD, else the population sd when that is too small, else 1."""
    good = drop_bad(baseline)
    mad = F.lit(MAD_FACTOR) * let(
        center, lambda m: array_median(F.transform(good, lambda x: F.abs(x - m)))
    )
    fallback = let(_population_sd(good), lambda sd: F.when(_usable(sd), sd).otherwise(F.lit(1.0)))
    return let(mad, lambda m: F.when(_usable(m), m).otherwise(fallback))


def robust_z(arr: Column, center: Column, scale: Column) -> Column:
    return let(center, lambda m: let(scale, lambda s: F.transform(arr, lambda x: (x - m) / s)))


def rms(arr: Column) -> Column:
    return F.sqrt(array_mean(F.transform(arr, lambda x: x * x)))


def peak_abs(arr: Column) -> Column:
    return F.array_max(F.transform(arr, lambda x: F.abs(x)))


def peak_ms(arr: Column, start_ms: float, fs: float) -> Column:
    """Latency of the first sample that reaches the peak."""
    sizes = F.transform(arr, lambda x: F.abs(x))
    first = F.array_position(sizes, F.array_max(sizes)) - 1
    return F.lit(start_ms) + first * F.lit(1000.0 / fs)
