"""Numeric scalars. Missing is always NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def to_number(c: Column) -> Column:
    """Text or number to double; unreadable text and NaN become NULL."""
    return nan_to_null(c.try_cast("double"))


def finite(c: Column) -> Column:
    """TRUE for a present, finite number; never NULL."""
    c = c.cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def all_finite(*cols: Column) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & finite(c)
    return out


def parse_bool(c: Column, truthy: tuple[str, ...] = ("true", "1", "yes")) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*truthy), F.lit(False))


def log1p_clip(c: Column) -> Column:
    """Forward target transform: log(1 + x) with negatives clipped to 0."""
    return F.log1p(F.greatest(c, F.lit(0.0)))


def expm1_clip(c: Column) -> Column:
    """Inverse target transform, clipped at 0."""
    return F.greatest(F.expm1(c), F.lit(0.0))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, NULL where the denominator is 0 or missing."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def half_even(c: Column) -> Column:
    """Round to a whole number, ties to even, as BIGINT."""
    return F.bround(c, 0).cast("bigint")
