"""Robustness stress tests: other donors for the residuals, and results by distance.

Donor rules act on the slot array of one query row (at most k slots), so each is
a projection.  A donor array holds, per slot, the slot whose residual it gets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sparkmap.functions.hashing import hash_unit
from sparkmap.functions.signal import let
from sparkmap.operators.hierarchy import permute_slots, replace_residuals
from sparkmap.operators.metrics import spearman_safe

# Collision levels, distance bins and thresholds in mm, least pairs per value.
LEVELS = (0.0, 0.25, 0.5, 0.75, 1.0)
BIN_EDGES = (10.0, 20.0, 40.0, 80.0)
THRESHOLDS = (10.0, 15.0, 20.0, 30.0, 40.0)
MIN_PAIRS = 10


def permute_fraction(slots: Column, key: Column, fraction: float) -> Column:
    """A share of the slots takes the residual of a full permutation, the rest keeps its own."""
    shuffled = permute_slots(slots, key)
    mixed = F.zip_with(
        slots, shuffled,
        lambda x, d: F.when(hash_unit(key, F.lit("mix"), x["stim_site"]) < F.lit(fraction), d).otherwise(x),
    )
    return replace_residuals(slots, mixed)


def _with_index(slots: Column, *order) -> Column:
    """Slots with their index, sorted by the given functions of (slot)."""
    return F.array_sort(
        F.transform(
            slots,
            lambda x, i: F.struct(*[o(x).alias(f"o{n}") for n, o in enumerate(order)], i.alias("i"), x.alias("x")),
        )
    )


def _in_place(donors: Column) -> Column:
    """(i, donor) pairs back into slot order."""
    return F.transform(F.array_sort(donors), lambda e: e["x"])


def _swap_neighbours(ordered: Column) -> Column:
    """Neighbours in the given order give each other their residual; an odd last one keeps its own."""
    return let(
        ordered,
        lambda s: F.transform(
            s,
            lambda e, n: F.struct(
                e["i"].alias("i"),
                F.coalesce(F.get(s, n + F.when(n % 2 == 0, 1).otherwise(-1))["x"], e["x"]).alias("x"),
            ),
        ),
    )


def swap_by_distance(slots: Column) -> Column:
    donors = _swap_neighbours(_with_index(slots, lambda x: x["distance_to_stim"], lambda x: x["stim_site"]))
    return replace_residuals(slots, _in_place(donors))


def _per_label(slots: Column, label, within) -> Column:
    """Apply `within` to the slots of each label separately and put all donors in place."""
    indexed = F.transform(slots, lambda x, i: F.struct(label(x).alias("label"), i.alias("i"), x.alias("x")))
    return let(
        indexed,
        lambda s: _in_place(
            F.flatten(
                F.transform(
                    F.array_distinct(F.transform(s, lambda e: e["label"])),
                    lambda lab: within(F.filter(s, lambda e: e["label"] == lab)),
                )
            )
        ),
    )


def rotate_within_label(slots: Column, label) -> Column:
    """Each slot takes the residual of the next slot (by site) of its label; the last takes the first's."""
    def rotate(group: Column) -> Column:
        return let(
            F.array_sort(F.transform(group, lambda e: F.struct(e["x"]["stim_site"].alias("o0"), e["i"].alias("i"), e["x"].alias("x")))),
            lambda s: F.transform(
                s, lambda e, n: F.struct(e["i"].alias("i"), F.get(s, (n + 1) % F.size(s))["x"].alias("x"))
            ),
        )

    return replace_residuals(slots, _per_label(slots, label, rotate))


def swap_by_distance_in_label(slots: Column, label) -> Column:
    def swap(group: Column) -> Column:
        return _swap_neighbours(
            F.array_sort(
                F.transform(
                    group,
                    lambda e: F.struct(
                        e["x"]["distance_to_stim"].alias("o0"), e["x"]["stim_site"].alias("o1"),
                        e["i"].alias("i"), e["x"].alias("x"),
                    ),
                )
            )
        )

    return replace_residuals(slots, _per_label(slots, label, swap))


def variant_scores(rows: DataFrame, keys: Sequence[str], truth: str, variants: dict[str, str]) -> DataFrame:
    """Spearman of each prediction column against the truth: keys, variant, spearman."""
    long = rows.select(
        *keys, F.col(truth).alias("y"),
        F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.col(c).alias("p")) for n, c in variants.items()])).alias("_v"),
    ).select(*keys, "y", "_v.*")
    return spearman_safe(long, [*keys, "variant"], "y", "p")


def against(scores: DataFrame, keys: Sequence[str], base: str, sign: float = 1.0) -> DataFrame:
    """Each variant minus the base variant (sign -1: base minus variant)."""
    ref = scores.where(F.col("variant") == base).select(*keys, F.col("spearman").alias("_base"))
    return scores.join(ref, list(keys)).withColumn(
        "delta", F.lit(sign) * (F.col("spearman") - F.col("_base"))
    ).drop("_base")


def collision_curve(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Score at each permuted share minus the fully permuted one."""
    return against(scores, keys, "level_1.0")


def matched_controls(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """True correspondence minus each control."""
    return against(scores, keys, "relation", -1.0).where("variant <> 'relation'")


def distance_bin(d: Column, edges: Sequence[float] = BIN_EDGES) -> Column:
    """1-based bin of half-open intervals, NULL below the first edge."""
    out = None
    for i, (lo, hi) in enumerate(zip(edges, [*edges[1:], float("inf")]), 1):
        hit = (d >= F.lit(lo)) & (d < F.lit(hi))
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out


def _delta(df: DataFrame, keys: Sequence[str], y: str, a: str, b: str) -> DataFrame:
    """Spearman of a minus Spearman of b per group; NULL under ten pairs."""
    scores = variant_scores(df, keys, y, {"a": a, "b": b})
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"))
    wide = scores.groupBy(*keys).pivot("variant", ["a", "b"]).agg(F.max("spearman"))
    return n.join(wide, list(keys), "left").select(
        *keys, "n_pairs", F.when(F.col("n_pairs") >= MIN_PAIRS, F.col("a") - F.col("b")).alias("delta")
    )


def distance_bins(df: DataFrame, keys: Sequence[str], y: str, a: str, b: str) -> DataFrame:
    binned = df.withColumn("distance_bin", distance_bin(F.col("distance_to_stim"))).where("distance_bin IS NOT NULL")
    return _delta(binned, [*keys, "distance_bin"], y, a, b)


def distance_thresholds(df: DataFrame, keys: Sequence[str], y: str, a: str, b: str) -> DataFrame:
    """The same at or beyond each threshold; a row counts in every group it reaches."""
    reach = F.array_compact(F.array(*[F.when(F.col("distance_to_stim") >= t, F.lit(t)) for t in THRESHOLDS]))
    return _delta(df.withColumn("min_distance", F.explode(reach)), [*keys, "min_distance"], y, a, b)


def stress_patient_means(df: DataFrame, keys: Sequence[str], value: str = "delta") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(value).alias("n_values"), F.avg(value).alias("mean_value"))


def check_reproduces(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, tol: float = 1e-5) -> DataFrame:
    """Largest difference of two result tables on their common keys."""
    other = b.select(*keys, F.col(value).alias("_b"))
    return a.join(other, list(keys)).agg(
        F.count(F.lit(1)).alias("n_common"), F.max(F.abs(F.col(value) - F.col("_b"))).alias("max_difference")
    ).withColumn("passed", F.col("max_difference") <= tol)
