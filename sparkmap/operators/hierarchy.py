"""Population, global, node and relation parts of a response map.

z[s,u,i] = pop[u,i] + c[s] + a[s,i] + t[s,u,i], estimated from a few context
sites of a subject for all its other sites.

A query row never meets its context rows as separate rows: the context of one
(plan, channel) is an array of at most max(k) slots, joined once, and everything
after that is a projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sparkmap.functions.hashing import hash_text
from sparkmap.functions.numeric import expm1_clip, log1p_clip
from sparkmap.functions.signal import array_lower_median, let
from sparkmap.operators.ordering import Quantile, quantiles
from sparkmap.plans.context import PLAN_KEYS, fold_norms, leave_one_out

TARGETS = ("early", "late")
CONDITIONS = ("population", "global", "node", "relation", "relation_perm")
CHANNEL = "recording_channel"
KERNEL_WIDTH = 1.0


def normalised_map(maps: DataFrame) -> DataFrame:
    """Map keys, raw targets, and log targets standardised by the other subjects' rows."""
    logs = maps.select(
        "subject", "stim_site", CHANNEL, "distance_to_stim",
        F.col("early_rms_z").alias("true_early"),
        F.col("late_rms_z").alias("true_late"),
        log1p_clip(F.col("early_rms_z")).alias("early"),
        log1p_clip(F.col("late_rms_z")).alias("late"),
    )
    norms = fold_norms(logs, TARGETS)
    return logs.join(norms, "subject").select(
        "*", *[((F.col(t) - F.col(f"mean_{t}")) / F.col(f"sd_{t}")).alias(f"z_{t}") for t in TARGETS]
    )


def population_prior(z: DataFrame) -> DataFrame:
    """Prior of each cell from the other subjects: their mean at the same (site, channel).

    If no other subject has the cell, their mean over the site; else the
    normalised zero.  Sums are map-side combined per (subject, cell), so neither
    a hot site nor a hot subject is ever gathered.
    """
    cell = leave_one_out(z, ["stim_site", CHANNEL], TARGETS, "cell_")
    site = leave_one_out(z, ["stim_site"], TARGETS, "site_")
    out = z.join(cell, ["subject", "stim_site", CHANNEL]).join(site, ["subject", "stim_site"])
    pops = []
    for t in TARGETS:
        raw = F.coalesce(
            F.try_divide(F.col(f"cell_sum_{t}"), F.col("cell_n")),
            F.try_divide(F.col(f"site_sum_{t}"), F.col("site_n")),
        )
        pops.append(F.coalesce((raw - F.col(f"mean_{t}")) / F.col(f"sd_{t}"), F.lit(0.0)).alias(f"pop_{t}"))
    return out.select(*z.columns, *pops)


def linear_prior(df: DataFrame, features: Sequence[str], targets: Sequence[str], ridge: float = 0.0, subject: str = "subject") -> DataFrame:
    """The other choice of prior: a linear model per target, for each subject fitted on all other subjects.

    Adds `pop_{target}` to `df`.  The normal equations need sums of products
    only: one array of them a subject, and a subject's own are taken off the
    total, so folds are never written out.  Features are standardised over all
    rows, which keeps the equations well conditioned and changes no prediction
    unless `ridge` (on the standardised features) is set.  Rows with a missing
    feature or target take no part in the fit; a missing feature gives no
    prediction.  The solution of least norm is taken where features repeat.
    """
    p = len(features) + 1
    ends = df.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    flat = lambda i: F.when(F.col(f"s_{i}") > 0, F.col(f"s_{i}")).otherwise(1.0)
    x = [F.lit(1.0), *[(F.col(c) - F.col(f"m_{i}")) / flat(i) for i, c in enumerate(features)]]
    rows = df.join(F.broadcast(ends), F.lit(True)).withColumn("_x", F.array(*x)).drop(*ends.columns)  # one row
    full = F.forall("_x", lambda v: v.isNotNull())
    for t in targets:
        full = full & F.col(t).isNotNull()
    at = lambda i: F.col("_x")[i]
    products = [at(i) * at(j) for i in range(p) for j in range(i + 1)] + [at(i) * F.col(t) for t in targets for i in range(p)]
    own = rows.where(full).groupBy(subject).agg(F.array(*[F.sum(c) for c in products]).alias("_own"))
    total = own.agg(F.array(*[F.sum(F.col("_own")[k]) for k in range(len(products))]).alias("_all"))
    folds = (
        df.select(subject).distinct().join(own, subject, "left").join(F.broadcast(total), F.lit(True))  # one row
        .withColumn("_sums", F.when(F.col("_own").isNull(), F.col("_all")).otherwise(F.zip_with("_all", "_own", lambda a, b: a - b)))
    )

    def solve(sums: pd.Series) -> pd.Series:
        out = []
        for v in sums:
            gram = np.zeros((p, p))
            low = np.tril_indices(p)
            gram[low] = v[: len(low[0])]
            gram = gram + gram.T - np.diag(np.diag(gram))
            gram[np.arange(1, p), np.arange(1, p)] += ridge
            sides = np.asarray(v[len(low[0]) :]).reshape(len(targets), p).T
            out.append(np.linalg.lstsq(gram, sides, rcond=1e-13)[0].T.ravel())
        return pd.Series(out)

    weights = folds.where("_sums IS NOT NULL").select(subject, F.pandas_udf(solve, "array<double>")("_sums").alias("_b"))
    fitted = rows.join(weights, subject, "left")
    for k, t in enumerate(targets):
        terms = [at(i) * F.col("_b")[k * p + i] for i in range(p)]
        fitted = fitted.withColumn(f"pop_{t}", reduce(lambda a, b: a + b, terms))
    return fitted.drop("_x", "_b")


def context_rows(prior: DataFrame, context: DataFrame) -> DataFrame:
    return context.join(prior, ["subject", "stim_site"])


def global_shift(ctx: DataFrame) -> DataFrame:
    """Lower median of z - pop over all context rows of a plan."""
    gaps = ctx.select(*PLAN_KEYS, *[(F.col(f"z_{t}") - F.col(f"pop_{t}")).alias(f"c_{t}") for t in TARGETS])
    return quantiles(gaps, PLAN_KEYS, {f"c_{t}": Quantile(f"c_{t}", 0.5, lower=True) for t in TARGETS})


def channel_slots(ctx: DataFrame) -> DataFrame:
    """Context of each (plan, channel) as an array of at most k slots, ordered by site."""
    slot = F.struct("stim_site", *[f"{p}_{t}" for p in ("z", "pop") for t in TARGETS], "distance_to_stim")
    return ctx.groupBy(*PLAN_KEYS, CHANNEL).agg(F.array_sort(F.collect_list(slot)).alias("slots"))


def node_offset(slots: DataFrame, shift: DataFrame) -> DataFrame:
    """Lower median of z - pop - c over the context sites of a channel."""
    out = slots.join(shift, PLAN_KEYS)

    def offset(t: str) -> Column:
        gaps = lambda c: F.transform("slots", lambda x: x[f"z_{t}"] - x[f"pop_{t}"] - c)
        return let(F.col(f"c_{t}"), lambda c: array_lower_median(gaps(c)))

    return out.select("*", *[offset(t).alias(f"a_{t}") for t in TARGETS])


def interaction_residual(nodes: DataFrame) -> DataFrame:
    """Slots with r = z - pop - c - a; the memory that query rows read."""

    def with_residuals(x: Column) -> Column:
        r = [
            (x[f"z_{t}"] - x[f"pop_{t}"] - F.col(f"c_{t}") - F.col(f"a_{t}")).alias(f"r_{t}") for t in TARGETS
        ]
        return F.struct(
            x["stim_site"].alias("stim_site"),
            *[x[f"pop_{t}"].alias(f"pop_{t}") for t in TARGETS],
            x["distance_to_stim"].alias("distance_to_stim"),
            *r,
        )

    return nodes.withColumn("slots", F.transform("slots", with_residuals))


def context_memory(prior: DataFrame, query: DataFrame, shift: DataFrame, memory: DataFrame) -> DataFrame:
    """Query rows with c, a and the slots of their own channel (empty when unseen)."""
    seen = memory.select(*PLAN_KEYS, CHANNEL, "slots", *[f"a_{t}" for t in TARGETS])
    out = (
        query.join(prior, ["subject", "stim_site"])
        .join(shift, PLAN_KEYS)
        .join(seen, [*PLAN_KEYS, CHANNEL], "left")
    )
    for t in TARGETS:
        out = out.withColumn(f"a_{t}", F.coalesce(f"a_{t}", F.lit(0.0)))
    # TRUE only where the channel occurs in the context of a plan with k >= 2
    return out.withColumn("has_memory", (F.col("context_k") >= 2) & F.col("slots").isNotNull())


def permute_slots(slots: Column, key: Column) -> Column:
    """Residuals moved between the slots of one row, by a seeded permutation.

    Slot n in site order takes the residual of the n-th site in hash order.
    """
    donors = F.array_sort(
        F.transform(
            slots,
            lambda x: F.struct(
                hash_text(key, x["stim_site"]).alias("h"),
                x["stim_site"].alias("site"),
                *[x[f"r_{t}"].alias(f"r_{t}") for t in TARGETS],
            ),
        )
    )
    return replace_residuals(slots, donors)


def replace_residuals(slots: Column, donors: Column) -> Column:
    """Give every slot the residuals of the donor at the same index."""
    return F.zip_with(
        slots,
        donors,
        lambda x, d: F.struct(
            x["stim_site"].alias("stim_site"),
            *[x[f"pop_{t}"].alias(f"pop_{t}") for t in TARGETS],
            x["distance_to_stim"].alias("distance_to_stim"),
            *[d[f"r_{t}"].alias(f"r_{t}") for t in TARGETS],
        ),
    )


def relation_residual(slots: Column, h: float = KERNEL_WIDTH) -> Column:
    """Kernel mean of slot residuals, shrunk by a null slot of weight 1: struct(early, late).

    Weights fall with the squared distance between the prior profiles of the
    query row (columns pop_*) and of the slot.
    """
    def weight(x: Column) -> Column:
        d2 = sum((F.col(f"pop_{t}") - x[f"pop_{t}"]) * (F.col(f"pop_{t}") - x[f"pop_{t}"]) for t in TARGETS)
        return F.exp(-d2 / F.lit(h))

    weighted = F.transform(
        slots, lambda x: F.struct(weight(x).alias("w"), *[x[f"r_{t}"].alias(f"r_{t}") for t in TARGETS])
    )
    zero = F.struct(F.lit(1.0).alias("w"), *[F.lit(0.0).alias(f"s_{t}") for t in TARGETS])
    return F.aggregate(
        weighted,
        zero,
        lambda acc, x: F.struct(
            (acc["w"] + x["w"]).alias("w"), *[(acc[f"s_{t}"] + x["w"] * x[f"r_{t}"]).alias(f"s_{t}") for t in TARGETS]
        ),
        lambda acc: F.struct(*[(acc[f"s_{t}"] / acc["w"]).alias(t) for t in TARGETS]),
    )


def row_seed(seed: int) -> Column:
    """Seed key of one query row's permutation."""
    return F.concat_ws("|", F.lit(seed), "subject", "context_k", "repeat", F.col("stim_site"))


def with_relation(rows: DataFrame, variants: dict[str, Column]) -> DataFrame:
    """Add `{name}_{target}` for each variant of the slots; 0 without usable memory."""
    for name, slots in variants.items():
        rows = rows.withColumn(f"_{name}", F.when(F.col("has_memory"), relation_residual(slots)))
    return rows.select(
        "*", *[F.coalesce(F.col(f"_{n}.{t}"), F.lit(0.0)).alias(f"{n}_{t}") for n in variants for t in TARGETS]
    ).drop(*[f"_{n}" for n in variants])


def nested_predictions(rows: DataFrame, seed: int) -> DataFrame:
    """Query rows with the five nested predictions of both targets, normalised scale."""
    rel = with_relation(
        rows, {"t": F.col("slots"), "tp": permute_slots(F.col("slots"), row_seed(seed))}
    )
    out = []
    for t in TARGETS:
        pop = F.col(f"pop_{t}")
        glob = pop + F.col(f"c_{t}")
        node = glob + F.col(f"a_{t}")
        levels = (pop, glob, node, node + F.col(f"t_{t}"), node + F.col(f"tp_{t}"))
        out += [v.alias(f"{name}_{t}") for name, v in zip(CONDITIONS, levels)]
    return rel.select(
        *PLAN_KEYS, F.col("stim_site").alias("query_site"), CHANNEL, "distance_to_stim",
        *[f"true_{t}" for t in TARGETS], *[f"{m}_{t}" for m in ("mean", "sd") for t in TARGETS], *out,
    )


def to_raw(z: Column, mean: Column, sd: Column, digits: int | None = None) -> Column:
    """Back to the raw scale; with `digits` on the log scale, so that predictions equal but for the order of a sum are ties."""
    log = z * sd + mean
    return expm1_clip(log if digits is None else F.round(log, digits))


def pair_predictions(nested: DataFrame, conditions: Sequence[str] = CONDITIONS, digits: int | None = None) -> DataFrame:
    """Long truth/prediction table on the raw scale, one row per condition; `digits` as in `to_raw`."""
    def level(c: str) -> Column:
        return F.struct(
            F.lit(c).alias("condition"),
            *[to_raw(F.col(f"{c}_{t}"), F.col(f"mean_{t}"), F.col(f"sd_{t}"), digits).alias(f"pred_{t}") for t in TARGETS],
        )

    return nested.select(
        *PLAN_KEYS, "query_site", CHANNEL, *[f"true_{t}" for t in TARGETS],
        F.explode(F.array(*[level(c) for c in conditions])).alias("_p"),
    ).select("*", "_p.*").drop("_p")


def zero_context_predictions(prior: DataFrame, digits: int | None = None) -> DataFrame:
    """k = 0: every cell is a query, one repeat, population only."""
    nested = prior.select(
        "subject", F.lit(0).alias("context_k"), F.lit(0).alias("repeat"),
        F.col("stim_site").alias("query_site"), CHANNEL,
        *[f"true_{t}" for t in TARGETS], *[f"{m}_{t}" for m in ("mean", "sd") for t in TARGETS],
        *[F.col(f"pop_{t}").alias(f"population_{t}") for t in TARGETS],
    )
    return pair_predictions(nested, ["population"], digits)


def reconstruct(prior: DataFrame, context: DataFrame, query: DataFrame) -> DataFrame:
    """Query rows with c, a and slots of residuals: the input of every relation variant."""
    ctx = context_rows(prior, context)
    shift = global_shift(ctx)
    memory = interaction_residual(node_offset(channel_slots(ctx), shift))
    return context_memory(prior, query, shift, memory)
