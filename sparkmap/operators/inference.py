"""Paired inference on per-patient deltas.

Deltas are long: cell keys, `subject`, `a`, `b`, `delta`.  A cell is one
(k, target, contrast, metric); all cells go through one job.

The seeded resamples are in `resampling`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkmap.functions.tails import binomial_at_most, normal_two_sided
from sparkmap.operators.metrics import METRICS
from sparkmap.operators.ordering import average_ranks, cumulative, median, positions, quantiles
from sparkmap.operators.resampling import _tasks, bootstrap_ci, signflip_mc

# Tolerances, and the contrasts of the nested conditions with their k.
TIE_EXTERNAL = 1e-15
TIE_DEVELOPMENT = 1e-12
CONTRASTS = {
    "global_vs_population": ("global", "population", (1, 3, 5, 10)),
    "node_vs_global": ("node", "global", (1, 3, 5, 10)),
    "relation_vs_node": ("relation", "node", (3, 5, 10)),
    "relation_vs_relation_perm": ("relation", "relation_perm", (3, 5, 10)),
}
TARGETS = ("early", "late")
LOWER_IS_BETTER = ("mae",)
# The primary cell and the six secondary ones (k, target, metric, contrast).
PRIMARY = (10, "late", "spearman", "relation_vs_relation_perm")
SECONDARY = {
    "late_k10_relation_vs_node_spearman": (10, "late", "spearman", "relation_vs_node"),
    "late_k10_relation_vs_perm_pearson": (10, "late", "pearson", "relation_vs_relation_perm"),
    "late_k10_relation_vs_perm_mae_reduction": (10, "late", "mae", "relation_vs_relation_perm"),
    "late_k5_relation_vs_perm_spearman": (5, "late", "spearman", "relation_vs_relation_perm"),
    "late_k3_relation_vs_perm_spearman": (3, "late", "spearman", "relation_vs_relation_perm"),
    "early_k10_relation_vs_perm_spearman": (10, "early", "spearman", "relation_vs_relation_perm"),
}
CELL = ["contrast", "context_k", "target", "metric"]
MAX_EXACT = 20
MAX_EXACT_RANKS = 50
MASKS = 1 << 12


def contrast_grid(spark: SparkSession, metrics: Sequence[str] = METRICS) -> DataFrame:
    """The planned cells: contrasts by k, target and metric."""
    rows = [
        (name, k, target, metric, a, b, metric in LOWER_IS_BETTER)
        for name, (a, b, ks) in CONTRASTS.items()
        for k in ks
        for target in TARGETS
        for metric in metrics
    ]
    return spark.createDataFrame(
        rows,
        "contrast string, context_k int, target string, metric string, "
        "condition_a string, condition_b string, lower_is_better boolean",
    )


def long_metrics(patients: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    return patients.select(
        "subject", "context_k", "condition", "target",
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("_m"),
    ).select("subject", "context_k", "condition", "target", "_m.*")


def paired_delta(patients: DataFrame, grid: DataFrame) -> DataFrame:
    """One row per cell and patient: both conditions' values and the gain of a over b.

    Positive is always better.  Both conditions of a cell must have the same
    patients: one without the other, or a second row of a patient, stops the
    job.  A cell without any row of one condition has NULL deltas; so has a
    patient whose value is missing, and `unpaired` lists both.
    """
    values = long_metrics(patients, [r for r in METRICS if r in patients.columns])
    both = values.join(F.broadcast(grid), ["context_k", "target", "metric"]).where(  # at most 112 planned cells
        (F.col("condition") == F.col("condition_a")) | (F.col("condition") == F.col("condition_b"))
    )

    def side(c: str) -> Column:
        here = F.col("condition") == F.col(c)
        twice = F.raise_error(F.concat(F.lit("more than one value for patient "), F.first("subject"))).cast("double")
        return F.when(F.count_if(here) > 1, twice).otherwise(F.max(F.when(here, F.col("value"))))

    there = lambda c: F.count_if(F.col("condition") == F.col(c)) > 0
    paired = both.groupBy(*CELL, "subject", "lower_is_better").agg(
        side("condition_a").alias("a"), side("condition_b").alias("b"), there("condition_a").alias("_a"), there("condition_b").alias("_b")
    )
    compared = both.groupBy(*CELL).agg((there("condition_a") & there("condition_b")).alias("_both"))
    alone = F.raise_error(F.concat(F.lit("one condition without the other for patient "), F.col("subject"))).cast("boolean")
    paired = paired.join(F.broadcast(compared), CELL).where(  # at most 112 planned cells
        F.when(F.col("_both") & (F.col("_a") != F.col("_b")), alone).otherwise(F.lit(True))
    )
    gain = F.when(F.col("lower_is_better"), F.col("b") - F.col("a")).otherwise(F.col("a") - F.col("b"))
    return paired.select(*CELL, "subject", "a", "b", gain.alias("delta"))


def unpaired(deltas: DataFrame) -> DataFrame:
    return deltas.where("a IS NULL OR b IS NULL")


def effect_summary(deltas: DataFrame, keys: Sequence[str] = CELL, tie: float = TIE_DEVELOPMENT, strict_wins: bool = False) -> DataFrame:
    """n, mean, median, sd, dz, wins/ties/losses, and the share of wins among those that are not ties.

    With `strict_wins` the tolerance only counts ties and any delta above 0 wins.
    """
    d = F.col("delta")
    bar = F.lit(0.0 if strict_wins else tie)
    sd = F.stddev_samp(d)
    base = deltas.where("delta IS NOT NULL").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_patients"),
        F.avg(d).alias("mean_delta"),
        sd.alias("sd_delta"),
        F.when(sd > 0, F.try_divide(F.avg(d), sd)).alias("dz"),
        F.count_if(d > bar).alias("wins"),
        F.count_if(F.abs(d) <= F.lit(tie)).alias("ties"),
        F.count_if(d < -bar).alias("losses"),
    )
    mid = quantiles(deltas, keys, {"median_delta": median("delta")})
    return base.join(mid, list(keys)).withColumn("win_share", F.try_divide(F.col("wins"), F.col("wins") + F.col("losses")))


def signed_ranks(deltas: DataFrame, keys: Sequence[str] = CELL, zero: float = 0.0) -> DataFrame:
    """Non-zero deltas with the average rank of their size."""
    sized = deltas.where(F.abs("delta") > F.lit(zero)).withColumn("size", F.abs("delta"))
    return average_ranks(sized, keys, "size", "rank")


def rank_biserial(deltas: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """(W+ - W-) / (W+ + W-); 0 when every delta is 0."""
    r = signed_ranks(deltas, keys, TIE_EXTERNAL).groupBy(*keys).agg(
        F.sum(F.when(F.col("delta") > 0, F.col("rank")).otherwise(-F.col("rank"))).alias("_diff"),
        F.sum("rank").alias("_all"),
    )
    cells = deltas.select(*keys).distinct()
    return cells.join(r, list(keys), "left").select(
        *keys, F.coalesce(F.try_divide(F.col("_diff"), F.col("_all")), F.lit(0.0)).alias("rank_biserial")
    )


def _rank_sums(deltas: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per cell the rank sums of both signs and the tie term, from the counts of each size; no row is ranked by itself."""
    sized = deltas.where("delta <> 0").select(*keys, F.abs("delta").alias("size"), F.when(F.col("delta") > 0, 1).otherwise(0).alias("up"))
    n, rank = F.col("n").cast("double"), F.col("before") + (F.col("n") + 1) / F.lit(2.0)
    return cumulative(sized, keys, "size", ["up"]).groupBy(*keys).agg(
        F.sum("n").alias("n_nonzero"),
        F.sum(F.col("up") * rank).alias("w_plus"),
        F.sum((F.col("n") - F.col("up")) * rank).alias("w_minus"),
        F.sum(n * n * n - n).alias("tie_term"),
    )


def wilcoxon(deltas: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Signed rank W, tie-corrected z (no continuity correction) and two-sided normal p; p is 1 if all deltas are 0."""
    sums = _rank_sums(deltas, keys)
    n = F.col("n_nonzero").cast("double")
    w = F.least("w_plus", "w_minus")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("tie_term") / 48
    z = F.when(var > 0, (w - n * (n + 1) / 4) / F.sqrt(var))
    cells = deltas.where("delta IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_deltas"))
    found = sums.select(*keys, "n_nonzero", w.alias("w"), z.alias("z"), (F.col("tie_term") > 0).alias("ties"))
    return (
        cells.join(found, list(keys), "left")
        .withColumns({"n_nonzero": F.coalesce("n_nonzero", F.lit(0)), "ties": F.coalesce("ties", F.lit(False))})
        .withColumn("p_wilcoxon", F.when(F.col("n_nonzero") == 0, F.lit(1.0)).otherwise(normal_two_sided("z")))
    )


def _ways(ranks: Column) -> Column:
    """How many sign patterns give each sum of positive ranks, for an array of whole ranks: one step per rank."""
    start = F.array(F.lit(1.0))

    def step(ways: Column, rank: Column) -> Column:
        longer = F.concat(ways, F.array_repeat(F.lit(0.0), rank))
        shifted = F.concat(F.array_repeat(F.lit(0.0), rank), ways)
        return F.zip_with(longer, shifted, lambda x, y: x + y)

    return F.aggregate(ranks, start, step)


def wilcoxon_exact(deltas: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Exact two-sided signed-rank p of every cell with at most 50 non-zero deltas, ties included.

    Average ranks are doubled to whole numbers; the sums' frequencies follow by recurrence.
    """
    ranks = signed_ranks(deltas, keys)
    small = ranks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= MAX_EXACT_RANKS).select(*keys)
    whole = (F.col("rank") * 2).cast("int")
    cells = ranks.join(small, list(keys)).groupBy(*keys).agg(
        F.collect_list(whole).alias("_r"),
        F.sum(F.when(F.col("delta") > 0, whole).otherwise(0)).alias("_plus"),
        F.sum(whole).alias("_all"),
    )
    low = F.least(F.col("_plus"), F.col("_all") - F.col("_plus"))
    tail = F.aggregate(F.slice(_ways(F.col("_r")), 1, (low + 1).cast("int")), F.lit(0.0), lambda s, x: s + x)
    n = F.size("_r")
    found = cells.select(
        *keys, n.alias("n_nonzero"), F.least(F.lit(1.0), 2.0 * tail / F.pow(F.lit(2.0), n)).alias("p_wilcoxon")
    )
    some = ranks.select(*keys).distinct()
    none = deltas.where("delta IS NOT NULL").select(*keys).distinct().join(some, list(keys), "left_anti")
    return found.unionByName(none.withColumns({"n_nonzero": F.lit(0), "p_wilcoxon": F.lit(1.0)}))


def wilcoxon_auto(deltas: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Signed rank W with the exact p where there are at most 50 deltas, none zero and none tied, else the normal one.

    Without ties the ranks are 1 to n, so the exact p follows from n and W alone.
    """
    plain = (F.col("n_deltas") <= MAX_EXACT_RANKS) & (F.col("n_deltas") == F.col("n_nonzero")) & ~F.col("ties")
    n = F.col("n_nonzero").cast("int")
    counts = F.slice(_ways(F.sequence(F.lit(1), n)), 1, F.col("w").cast("int") + 1)
    tail = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    exact = F.least(F.lit(1.0), 2.0 * tail / F.pow(F.lit(2.0), n))
    return (
        wilcoxon(deltas, keys).withColumn("is_exact", plain)
        .withColumn("p_wilcoxon", F.when(F.col("is_exact"), exact).otherwise(F.col("p_wilcoxon")))
        .drop("n_deltas", "ties")
    )


def signflip_exact(deltas: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """All 2^n signs of the deltas that are not zero; p is 1 where there are none.

    Cells above 20 such deltas are left to Monte Carlo, as planned.  A cell's
    patterns are dealt out in stretches of 4,096.
    """
    nonzero = deltas.where(F.abs("delta") > F.lit(TIE_EXTERNAL))
    small = nonzero.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= MAX_EXACT).select(*keys)
    cells = nonzero.join(small, list(keys)).groupBy(*keys).agg(F.array_sort(F.collect_list("delta")).alias("_v"))
    total = F.pow(F.lit(2), F.size("_v")).cast("bigint")
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("i"))  # (sum, bit position)

    def flip(acc: Column, x: Column) -> Column:
        on = F.getbit("_mask", acc["i"]) == 1
        return F.struct((acc["s"] + F.when(on, x).otherwise(-x)).alias("s"), (acc["i"] + 1).alias("i"))

    masks = (
        cells.withColumn("_total", total)
        .withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_total") - 1, F.lit(MASKS).cast("bigint"))))
        .repartition(_tasks(cells), *keys, "_from")
        .withColumn("_mask", F.explode(F.sequence("_from", F.least(F.col("_from") + MASKS, F.col("_total")) - 1)))
    )
    observed = F.abs(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x))
    mean = lambda s: s / F.size("_v")
    extreme = mean(F.abs(F.aggregate("_v", start, flip, lambda acc: acc["s"]))) >= mean(observed) - F.lit(TIE_EXTERNAL)
    found = masks.groupBy(*keys).agg(
        F.max(F.size("_v")).alias("n_nonzero"), F.count_if(extreme).alias("n_extreme"), F.count(F.lit(1)).alias("n_total")
    )
    some = nonzero.select(*keys).distinct()
    none = deltas.where("delta IS NOT NULL").select(*keys).distinct().join(some, list(keys), "left_anti")
    one = F.lit(1).cast("bigint")
    both = found.unionByName(none.withColumns({"n_nonzero": F.lit(0), "n_extreme": one, "n_total": one}))
    return both.withColumn("p_exact", F.col("n_extreme") / F.col("n_total"))


def sign_test(deltas: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Exact two-sided binomial test at 1/2 on the non-zero deltas."""
    counts = deltas.groupBy(*keys).agg(
        F.count_if(F.col("delta") > 0).alias("wins"), F.count_if(F.col("delta") < 0).alias("losses")
    ).withColumn("n", F.col("wins") + F.col("losses"))
    # from the larger of the two tails' ends outwards; terms fall off, so the sum needs few of them whatever n is
    p = F.when(F.col("n") == 0, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), 2.0 * binomial_at_most(F.col("n"), F.least("wins", "losses")))
    )
    return counts.withColumn("p_sign", p)


def holm(df: DataFrame, p: str, out: str, family: Sequence[str] = (), id_cols: Sequence[str] = ()) -> DataFrame:
    """Step-down adjusted p inside each family; a missing p stays missing and is not counted.

    adjusted = min(1, running max of (m - r + 1) p over ascending p).  The
    running max needs the values in order; ranges of one family are taken in
    parallel and joined by the maxima of the ranges before them.
    """
    from pyspark.sql import Window as W

    family, ids = list(family), list(id_cols)
    ranked = positions(df.where(F.col(p).isNotNull()), family, [p, *ids]).withColumn(
        "_step", (F.col("total") - F.col("pos")) * F.col(p)
    )
    chunk = F.floor(F.col("pos") / F.lit(65_536))
    ranked = ranked.withColumn("_chunk", chunk)
    inside = W.partitionBy(*family, "_chunk").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = (
        ranked.groupBy(*family, "_chunk").agg(F.max("_step").alias("_m"))
        .withColumn("_before", F.max("_m").over(
            W.partitionBy(*family).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)))
        .drop("_m")
    )
    adjusted = ranked.withColumn("_run", F.max("_step").over(inside)).join(before, [*family, "_chunk"]).select(
        *family, *ids, F.least(F.lit(1.0), F.greatest("_run", F.coalesce("_before", F.lit(0.0)))).alias(out)
    )
    return df.join(adjusted, [*family, *ids], "left")


def relative_improvement(deltas: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Mean of (b - a) / max(|b|, 1e-12) in percent, for lower-is-better metrics only."""
    share = (F.col("b") - F.col("a")) / F.greatest(F.abs("b"), F.lit(1e-12)) * 100.0
    return deltas.where(F.col("metric").isin(*LOWER_IS_BETTER)).groupBy(*keys).agg(
        F.avg(share).alias("relative_improvement_pct")
    )


def contrast_summary(deltas: DataFrame, grid: DataFrame, bootstrap_draws: int, mc_draws: int, seed: int) -> DataFrame:
    """Effects, intervals and tests of every cell of `grid`: exact sign flip where the cell allows, else Monte Carlo.

    `delta_definition` names the conditions in the order of the difference.
    """
    keys = CELL
    out = effect_summary(deltas, keys)
    for part in (
        bootstrap_ci(deltas, bootstrap_draws, seed, keys),
        rank_biserial(deltas, keys),
        wilcoxon_auto(deltas, keys).select(*keys, "w", "z", "p_wilcoxon"),
        sign_test(deltas, keys).select(*keys, "p_sign"),
        signflip_mc(deltas, mc_draws, seed + 1, keys).select(*keys, "p_mc"),
        signflip_exact(deltas, keys).select(*keys, "p_exact"),
        relative_improvement(deltas, keys),
    ):
        out = out.join(part, keys, "left")
    first, second = (F.when(F.col("lower_is_better"), F.col(a)).otherwise(F.col(b)) for a, b in (("condition_b", "condition_a"), ("condition_a", "condition_b")))
    named = grid.withColumn("delta_definition", F.concat(first, F.lit(" - "), second)).drop("lower_is_better")
    return out.join(F.broadcast(named), keys, "left").withColumn("p_signflip", F.coalesce("p_exact", "p_mc"))  # at most 112 planned cells


def endpoint_flags(summary: DataFrame, p: str) -> DataFrame:
    """Mark the primary and secondary cells and adjust p in two families."""
    def is_cell(spec: tuple) -> Column:
        k, target, metric, contrast = spec
        return (
            (F.col("context_k") == k) & (F.col("target") == target)
            & (F.col("metric") == metric) & (F.col("contrast") == contrast)
        )

    secondary = F.lit(False)
    for spec in SECONDARY.values():
        secondary = secondary | is_cell(spec)
    flagged = summary.withColumn("is_primary", is_cell(PRIMARY)).withColumn("is_secondary", secondary)
    flagged = flagged.withColumn("_p2", F.when(F.col("is_secondary"), F.col(p)))
    out = holm(flagged, p, "holm_all", [], CELL)
    return holm(out, "_p2", "holm_secondary", [], CELL).drop("_p2")


def correspondence_trajectory(summary: DataFrame) -> DataFrame:
    return summary.where("contrast = 'relation_vs_relation_perm'").orderBy("target", "metric", "context_k")


def endpoint_name() -> Column:
    """Name of the endpoint a cell stands for, NULL for all other cells."""
    name = F
    for endpoint, (k, target, metric, contrast) in ({"primary": PRIMARY} | SECONDARY).items():
        name = name.when(
            (F.col("context_k") == k) & (F.col("target") == target)
            & (F.col("metric") == metric) & (F.col("contrast") == contrast),
            endpoint,
        )
    return name


def endpoint_mc(deltas: DataFrame, draws: int, secondary_draws: int, seed: int, secondary_seed: int) -> DataFrame:
    """Monte-Carlo sign flips of named endpoints, the secondary ones with draws of their own."""
    primary = signflip_mc(deltas.where("endpoint = 'primary'"), draws, seed, ["endpoint"])
    return primary.unionByName(signflip_mc(deltas.where("endpoint <> 'primary'"), secondary_draws, secondary_seed, ["endpoint"]))


def endpoint_table(deltas: DataFrame, mc: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The primary and six secondary endpoints with p, interval and Holm-adjusted p (secondary family).

    `mc` gives the Monte-Carlo results of named endpoints, as `endpoint_mc` does.
    """
    chosen = deltas.withColumn("endpoint", endpoint_name()).where("endpoint IS NOT NULL")
    keys = ["endpoint"]
    effects = effect_summary(chosen, keys, TIE_EXTERNAL, strict_wins=True)
    out = effects.join(mc(chosen), keys).join(sign_test(chosen, keys).select("endpoint", "p_sign"), keys)
    out = out.withColumn("_p2", F.when(F.col("endpoint") != "primary", F.col("p_mc")))
    out = holm(out, "_p2", "holm_adjusted_p", [], keys).drop("_p2")
    return out.withColumn("supported", support_rule(F.col("mean_delta"), F.col("p_mc")))


def support_rule(mean: Column, p: Column, alpha: float = 0.05) -> Column:
    return (mean > 0) & (p < alpha)
