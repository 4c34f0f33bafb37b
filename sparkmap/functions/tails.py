"""Tail probabilities that Spark SQL lacks, as Arrow-batched UDFs over short result tables."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|N(0,1)| >= |z|)."""
    return z.map(lambda v: None if v is None or math.isnan(v) else math.erfc(abs(v) / math.sqrt(2.0)))


def _sum_away(n: int, p: float, k: int, step: int) -> float:
    """Binomial terms from k in the direction away from the mode, until they vanish."""
    if not 0 <= k <= n:
        return 0.0
    log_first = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    term = math.exp(log_first + k * math.log(p) + (n - k) * math.log1p(-p))
    total, odds = 0.0, p / (1.0 - p)
    while term > total * 1e-17 and 0 <= k <= n:
        total += term
        term *= (n - k) / (k + 1) * odds if step > 0 else k / (n - k + 1) / odds
        k += step
    return total


def _at_least(n: int, p: float, k: int) -> float:
    """P(X >= k) for X ~ Binomial(n, p), from the shorter tail."""
    return _sum_away(n, p, k, 1) if k > n * p else 1.0 - _sum_away(n, p, k - 1, -1)


def _solve(n: int, k: int, target: float) -> float:
    """The p at which P(X >= k) reaches the target (it grows with p): Newton steps, halving where one leaves the bracket."""
    low, high = 0.0, 1.0
    share = k / n
    p = share + math.copysign(1.96, target - 0.5) * math.sqrt(share * (1.0 - share) / n)
    log_scale = math.lgamma(n + 1) - math.lgamma(k) - math.lgamma(n - k + 1)
    while True:
        if not low < p < high:
            p = (low + high) / 2
            if p in (low, high):
                return p
        miss = _at_least(n, p, k) - target
        low, high = (low, p) if miss > 0 else (p, high)
        slope = math.exp(log_scale + (k - 1) * math.log(p) + (n - k) * math.log1p(-p))
        step = miss / slope if slope > 0 else math.inf
        if abs(step) <= 2e-15 * p:
            return p - step
        p -= step


@F.pandas_udf(StructType([StructField("low", DoubleType()), StructField("high", DoubleType())]))
def _exact_interval(hits: pd.Series, draws: pd.Series) -> pd.DataFrame:
    rows = [
        (_solve(int(n), int(k), 0.025), _solve(int(n), int(k) + 1, 0.975)) for k, n in zip(hits, draws)
    ]
    return pd.DataFrame(rows, columns=["low", "high"])


def tail_interval(hits: Column, draws: Column) -> tuple[Column, Column]:
    """Exact 95 % binomial interval of hits/draws; closed form where nothing or everything hit."""
    inner = (hits > 0) & (hits < draws)
    # rows with a closed form are sent through as 1 of 2, which costs nothing
    k, n = F.when(inner, hits).otherwise(F.lit(1)), F.when(inner, draws).otherwise(F.lit(2))
    solved = _exact_interval(k.cast("bigint"), n.cast("bigint"))
    edge = -F.expm1(F.log(F.lit(0.025)) / draws)
    low = F.when(hits == 0, 0.0).when(hits == draws, 1.0 - edge).otherwise(solved["low"])
    high = F.when(hits == draws, 1.0).when(hits == 0, edge).otherwise(solved["high"])
    return low, high


@F.pandas_udf(DoubleType())
def _half_tail(n: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([1.0 if b >= a else _sum_away(int(a), 0.5, int(b), -1) for a, b in zip(n, k)], dtype="float64")


def binomial_at_most(n: Column, k: Column) -> Column:
    """P(X <= k) for X ~ Binomial(n, 1/2) and k <= n / 2."""
    return _half_tail(n.cast("bigint"), k.cast("bigint"))
