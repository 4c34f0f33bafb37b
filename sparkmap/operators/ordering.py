"""Exact ranks and quantiles in groups of any size.

A window over a group sorts the whole group in one task, and `percentile` keeps
all its distinct values in one buffer.  Neither holds when one group has a third
of all rows.  Here every group is cut into value ranges first:

1. a sample of at most 8,192 values is taken: of one value in 1,024, the least
   hash in each of 8,192 hash classes (mergeable, map-side combined and the same
   on every rerun);
2. its values become the cut points of their group, so a group gets cuts in
   proportion to its share of the data and a small group gets none;
3. equal values are counted together, and the running count is taken inside each
   (group, range) and shifted by the size of the ranges before it.

Cut points only decide which task does the work; the result is exact for any
cuts.  Key columns must not be NULL; NULL values are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sparkmap.functions.signal import let

SAMPLE_RATE = 1024
SAMPLE_CLASSES = 8192
STRIDE = 64
#: Rows of a group whose values one task may hold as arrays; larger groups are cut into ranges.
GROUP_ROWS = 1 << 20


def _cut_points(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """At most 8,192 cut points in total, as one sorted array per sampled group."""
    h = F.xxhash64(*keys, value)
    cuts = F.col("_cuts")
    return (
        df.where(F.pmod(h, F.lit(SAMPLE_RATE)) == 0)
        .groupBy(F.pmod(F.xxhash64(h), F.lit(SAMPLE_CLASSES)).alias("_class"))
        .agg(F.min(F.struct(h.alias("_h"), *keys, value)).alias("_s"))
        .select(*[F.col(f"_s.{c}").alias(c) for c in [*keys, value]])
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(value)).alias("_cuts"))
        .withColumn("_coarse", F.filter(cuts, lambda c, i: i % STRIDE == 0))
    )


def _span(value: Column) -> Column:
    """How many cut points lie below `value`: coarse steps first, then one stride."""

    def below(arr: Column) -> Column:
        return F.size(F.filter(arr, lambda c: c < value))

    fine = let(
        below(F.col("_coarse")),
        lambda c: F.when(c == 0, F.lit(0)).otherwise(
            (c - 1) * STRIDE + below(F.slice(F.col("_cuts"), (c - 1) * STRIDE + 1, STRIDE))
        ),
    )
    # never NULL, so that the joins on it add no second evaluation as a filter
    return F.coalesce(F.when(F.col("_cuts").isNotNull(), fine), F.lit(0))


def cumulative(
    df: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str] = (), sample: DataFrame | None = None
) -> DataFrame:
    """Distinct values of each group with their counts.

    Returns keys, value, `n` (rows with this value), `before` (rows of the group
    with a smaller value) and `total` (rows of the group), and the sums of the
    `sums` columns over the rows with this value, and `total_*` over the group.
    `value` may be a struct, which orders by its fields in turn.  `sample` is a
    cheaper table with the same keys and values to take the cut points from.
    """
    keys = list(keys)
    src = df.select(*keys, value, *sums).where(F.col(value).isNotNull())
    seen = src.drop(*sums) if sample is None else sample.select(*keys, value).where(F.col(value).isNotNull())
    if not keys:
        keys = ["_all"]
        src, seen = src.withColumn("_all", F.lit(0)), seen.withColumn("_all", F.lit(0))

    counted = (
        # bounded by SAMPLE_CLASSES values in total, whatever the size of src
        src.join(F.broadcast(_cut_points(seen, keys, value)), keys, "left")
        .withColumn("_span", _span(F.col(value)))
        .groupBy(*keys, "_span", value)
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums])
    )
    up_to = W.partitionBy(*keys, "_span").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    inner = counted.withColumn("_upto", F.sum("n").over(up_to))

    # at most SAMPLE_CLASSES + 1 ranges per group
    ranges = W.partitionBy(*keys).orderBy("_span")
    offsets = (
        counted.groupBy(*keys, "_span")
        .agg(F.sum("n").alias("_size"), *[F.sum(c).alias(c) for c in sums])
        .select(
            *keys,
            "_span",
            F.coalesce(
                F.sum("_size").over(ranges.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
            ).alias("_ahead"),
            F.sum("_size").over(W.partitionBy(*keys)).alias("total"),
            *[F.sum(c).over(W.partitionBy(*keys)).alias(f"total_{c}") for c in sums],
        )
    )
    return inner.join(offsets, [*keys, "_span"]).select(
        *[k for k in keys if k != "_all"],
        value,
        "n",
        (F.col("_ahead") + F.col("_upto") - F.col("n")).alias("before"),
        "total",
        *[name for c in sums for name in (c, f"total_{c}")],
    )


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """`df` with the 1-based average rank of `value` in its group."""
    ranks = cumulative(df, keys, value).select(
        *keys, value, (F.col("before") + (F.col("n") + 1) / F.lit(2.0)).alias(out)
    )
    return df.join(ranks, [*keys, value])


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Rows with `pos` (0-based) and `total` in a total order of their group.

    The result holds the keys and the order columns, which must identify a row;
    columns to be carried along go last in `order`.
    """
    packed = df.select(*keys, F.struct(*order).alias("_o"))
    return cumulative(packed, keys, "_o").select(*keys, "_o.*", F.col("before").alias("pos"), "total")


@dataclass(frozen=True)
class Quantile:
    """One requested quantile: `lower` takes an existing value, else interpolate."""

    col: str
    p: float
    lower: bool = False


def quantiles(df: DataFrame, keys: Sequence[str], wanted: dict[str, Quantile]) -> DataFrame:
    """Exact quantiles of several columns: keys plus one column per request.

    NULL and NaN are skipped; a group without any value in any column has no row.
    """
    keys = list(keys)
    cols = sorted({q.col for q in wanted.values()})
    long = df.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("_m"), F.nanvl(F.col(c).cast("double"), F.lit(None)).alias("_v")) for i, c in enumerate(cols)])
        ).alias("_x"),
    ).select(*keys, "_x.*")
    steps = cumulative(long, [*keys, "_m"], "_v")

    def value_at(index: Column, col: str) -> Column:
        here = (F.col("_m") == cols.index(col)) & (F.col("before") <= index) & (index < F.col("before") + F.col("n"))
        return F.max(F.when(here, F.col("_v")))

    aggs = []
    for name, q in wanted.items():
        if q.lower:
            index = F.greatest(F.ceil(F.lit(q.p) * F.col("total")) - 1, F.lit(0))
            aggs.append(value_at(index, q.col).alias(name))
            continue
        at = F.lit(q.p) * (F.col("total") - 1)
        low, high = value_at(F.floor(at), q.col), value_at(F.ceil(at), q.col)
        part = F.max(F.when(F.col("_m") == cols.index(q.col), at - F.floor(at)))
        aggs.append((low + (high - low) * part).alias(name))
    return steps.groupBy(*keys).agg(*aggs)


def quantiles_of_groups(df: DataFrame, keys: Sequence[str], wanted: dict[str, Quantile]) -> DataFrame:
    """`quantiles` for a table of many groups, with one shuffle of the values and no copy of a row per column.

    The values of a group of at most GROUP_ROWS rows travel as packed arrays and
    are sorted in one task; larger groups, at most one for each GROUP_ROWS rows
    of `df`, take the ranges of `quantiles`.
    """
    keys = list(keys)
    cols = sorted({q.col for q in wanted.values()})
    named = df.select(*keys, *cols).dropna(subset=keys)
    large = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > GROUP_ROWS).select(*keys)
    # 0.0 added: -0.0 and 0.0 are one value, as in a grouping
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None)) + F.lit(0.0)
    arrays = named.join(F.broadcast(large), keys, "left_anti").groupBy(*keys).agg(
        *[F.sort_array(F.collect_list(value(c))).alias(f"_v{i}") for i, c in enumerate(cols)]
    )

    def picked(q: Quantile) -> Column:
        values = F.col(f"_v{cols.index(q.col)}")
        at = lambda index: F.get(values, index.cast("int"))
        if q.lower:
            return at(F.greatest(F.ceil(F.lit(q.p) * F.size(values)) - 1, F.lit(0)))
        place = F.lit(q.p) * (F.size(values) - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        return low + (high - low) * (place - F.floor(place))

    some = arrays.where(F.greatest(F.lit(0), *[F.size(f"_v{i}") for i in range(len(cols))]) > 0)
    found = some.select(*keys, *[picked(q).alias(name) for name, q in wanted.items()])
    return found.unionByName(quantiles(named.join(F.broadcast(large), keys, "left_semi"), keys, wanted))


def median(col: str) -> Quantile:
    return Quantile(col, 0.5)


def lower_median(col: str) -> Quantile:
    return Quantile(col, 0.5, lower=True)
