"""Context/query plans, splits and normalisation.

Plans stay long (one row per site and draw); lists exist only for export.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sparkmap.functions.hashing import hash_text, seed_key, stable_seed
from sparkmap.functions.numeric import half_even, log1p_clip
from sparkmap.operators.ordering import positions

# The study's design.
CONTEXT_SIZES = (1, 3, 5, 10)
REPEATS = 20
PLAN_SEED = 20260926
SPLIT_FRACTION = 0.15
MIN_TRAIN_SITES = 11
PLAN_KEYS = ["subject", "context_k", "repeat"]


def draws(sites: DataFrame, ks: Sequence[int] = CONTEXT_SIZES, repeats: int = REPEATS) -> DataFrame:
    """Every site once per (k, repeat): a fixed number of copies, made in place."""
    grid = F.array(*[F.struct(F.lit(k).alias("context_k"), F.lit(r).alias("repeat")) for k in ks for r in range(repeats)])
    return sites.select("subject", "stim_site", F.explode(grid).alias("_g")).select("subject", "stim_site", "_g.*")


def context_sites(
    sites: DataFrame, ks: Sequence[int] = CONTEXT_SIZES, repeats: int = REPEATS, seed: int = PLAN_SEED
) -> DataFrame:
    """A seeded sample of k sites per (subject, k, repeat), without replacement.

    The literal bound lets Spark keep only the first max(ks) rows of a group
    before the shuffle, so a subject with very many sites costs no more there.
    """
    order = W.partitionBy(*PLAN_KEYS).orderBy("_h", "stim_site")
    return (
        draws(sites, ks, repeats)
        .withColumn("_h", hash_text(F.lit(seed), F.col("subject"), F.col("context_k"), F.col("repeat"), F.col("stim_site")))
        .withColumn("_rn", F.row_number().over(order))
        .where(F.col("_rn") <= max(ks))
        .where(F.col("_rn") <= F.col("context_k"))
        .drop("_h", "_rn")
    )


def query_sites(sites: DataFrame, context: DataFrame, ks: Sequence[int] = CONTEXT_SIZES, repeats: int = REPEATS) -> DataFrame:
    """The sites of each draw that are not in its context."""
    return draws(sites, ks, repeats).join(context, [*PLAN_KEYS, "stim_site"], "left_anti")


def plan_lists(context: DataFrame, query: DataFrame, seed: int = PLAN_SEED) -> DataFrame:
    """Export form: one row per plan with its seed and sorted site lists."""
    listed = lambda df, name: df.groupBy(*PLAN_KEYS).agg(F.array_sort(F.collect_list("stim_site")).alias(name))
    return (
        listed(context, "context_sites")
        .join(listed(query, "query_sites"), PLAN_KEYS)
        .withColumn("seed", stable_seed(F.lit(seed), F.col("subject"), F.col("context_k"), F.col("repeat")))
        .withColumn("n_query_sites", F.size("query_sites"))
    )


def check_plan(context: DataFrame, ks: Sequence[int], repeats: int, subjects: DataFrame) -> DataFrame:
    """Per k: plan rows expected (each of `subjects` in each repeat) and found, and plans whose context is not k sites long."""
    expected = subjects.agg((F.count_distinct("subject") * repeats).alias("expected"))
    plans = context.groupBy(*PLAN_KEYS).agg(F.count(F.lit(1)).alias("n"))
    found = plans.groupBy("context_k").agg(
        F.count(F.lit(1)).alias("n_plans"), F.count_if(F.col("n") != F.col("context_k")).alias("n_bad_length")
    )
    return (
        found.where(F.col("context_k").isin(*ks))
        .crossJoin(expected)  # one row
        .withColumn("passed", (F.col("n_plans") == F.col("expected")) & (F.col("n_bad_length") == 0))
    )


def internal_split(
    sites: DataFrame, seed: int, fraction: float = SPLIT_FRACTION, min_left: int = MIN_TRAIN_SITES
) -> DataFrame:
    """Seeded site-level train/val split of each subject."""
    keyed = sites.select("subject", "stim_site", hash_text(F.lit(seed), F.col("subject"), F.col("stim_site")).alias("_h"))
    n = F.col("total")
    n_val = F.least(F.greatest(F.lit(1), half_even(F.lit(fraction) * n)), n - F.lit(min_left))
    return positions(keyed, ["subject"], ["_h", "stim_site"]).select(
        "subject", "stim_site", F.when(F.col("pos") < n_val, "val").otherwise("train").alias("split")
    )


def leave_one_out(df: DataFrame, keys: Sequence[str], cols: Sequence[str], prefix: str = "loo_") -> DataFrame:
    """Statistics of every held-out subject's training rows, as totals minus own share.

    The folds are never written out: that would be subjects x rows.  Returns
    subject, keys, `{prefix}n` and `{prefix}sum_*`, `{prefix}sq_*`.
    """
    own = df.groupBy("subject", *keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(c).alias(f"_s_{c}") for c in cols],
        *[F.sum(F.col(c) * F.col(c)).alias(f"_q_{c}") for c in cols],
    )
    names = ["_n"] + [f"_{m}_{c}" for m in "sq" for c in cols]
    total = own.groupBy(*keys).agg(*[F.sum(x).alias(f"t{x}") for x in names])
    both = own.join(total, list(keys)) if keys else own.join(F.broadcast(total), F.lit(True))  # exactly one row
    return both.select(
        "subject",
        *keys,
        (F.col("t_n") - F.col("_n")).alias(f"{prefix}n"),
        *[(F.col(f"t_s_{c}") - F.col(f"_s_{c}")).alias(f"{prefix}sum_{c}") for c in cols],
        *[(F.col(f"t_q_{c}") - F.col(f"_q_{c}")).alias(f"{prefix}sq_{c}") for c in cols],
    )


def fold_norms(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean and population sd (1 if below 1e-6) of each column over the other subjects."""
    loo = leave_one_out(df, [], cols)
    n = F.col("loo_n")
    out = loo.select("subject", n, *[F.try_divide(F.col(f"loo_{m}_{c}"), n).alias(f"{m}_{c}") for m in ("sum", "sq") for c in cols])
    sd = lambda c: F.sqrt(F.greatest(F.col(f"sq_{c}") - F.col(f"sum_{c}") * F.col(f"sum_{c}"), F.lit(0.0)))
    return out.select(
        "subject",
        F.col("loo_n").alias("n_train"),
        *[F.col(f"sum_{c}").alias(f"mean_{c}") for c in cols],
        *[F.when(sd(c) < 1e-6, 1.0).otherwise(sd(c)).alias(f"sd_{c}") for c in cols],
    )


def fit_norm(train: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """One row: feature mean and sample sd (0 or missing becomes 1), log-target mean and population sd."""
    aggs: list[Column] = []
    for c in features:
        sd = F.stddev_samp(c)
        aggs += [F.avg(c).alias(f"mean_{c}"), F.when(sd > 0, sd).otherwise(1.0).alias(f"sd_{c}")]
    for c in targets:
        y = log1p_clip(F.col(c))
        sd = F.stddev_pop(y)
        aggs += [F.avg(y).alias(f"mean_{c}"), F.when(sd < 1e-6, 1.0).otherwise(sd).alias(f"sd_{c}")]
    return train.agg(*aggs)


def apply_norm(df: DataFrame, stats: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Standardise with the one-row result of `fit_norm`."""
    joined = df.join(F.broadcast(stats), F.lit(True))  # exactly one row
    z = lambda value, c: (value - F.col(f"mean_{c}")) / F.col(f"sd_{c}")
    return joined.select(
        *[c for c in df.columns if c not in (*features, *targets)],
        *[z(F.col(c), c).alias(f"{c}_z") for c in features],
        *[z(log1p_clip(F.col(c)), c).alias(f"{c}_z") for c in targets],
    )


def fit_label_index(train: DataFrame, cols: Sequence[str], unknown: str = "UNK") -> DataFrame:
    """Sorted labels of the training rows, numbered from 1; the unknown label is 0."""
    labels = (
        train.select(F.explode(F.array(*cols)).alias("label"))
        .where(F.col("label").isNotNull() & (F.col("label") != unknown))
        .distinct()
    )
    return positions(labels, [], ["label"]).select("label", (F.col("pos") + 1).alias("label_index"))


def apply_label_index(df: DataFrame, index: DataFrame, col: str, out: str) -> DataFrame:
    idx = index.select(F.col("label").alias(col), F.col("label_index").alias(out))
    return df.join(idx, col, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def subject_ordinal(subjects: DataFrame) -> DataFrame:
    """1-based lexicographic order of the subjects."""
    return positions(subjects.select("subject").distinct(), [], ["subject"]).select(
        "subject", (F.col("pos") + 1).alias("ordinal")
    )


def with_seed_keys(draw_rows: DataFrame, ordinals: DataFrame, root: int, query: str) -> DataFrame:
    """One reproducible key per (subject, repeat, k, query)."""
    return draw_rows.join(ordinals, "subject").withColumn(
        "seed_key",
        seed_key(F.lit(root), F.col("ordinal"), F.col("repeat"), F.col("context_k"), F.col(query)),
    )
