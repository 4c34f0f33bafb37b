"""Map-fidelity metrics per group, and their averages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sparkmap.functions.numeric import all_finite, half_even
from sparkmap.operators.ordering import cumulative, positions
from sparkmap.operators.quality import one_per_key

MIN_PAIRS = 3
MIN_SD = 1e-12
METRICS = ("pearson", "spearman", "mae", "top10_recall")
REPEATS = 20  # fixed value: repeats of each plan
REPEAT_KEYS = ["subject", "context_k", "repeat", "condition", "target"]


def pearson_safe(y: str, p: str) -> Column:
    """Aggregate: Pearson r, NULL under three pairs or for a constant side."""
    finite = all_finite(F.col(y), F.col(p))  # only pairs with both sides count, on both sides
    y, p = F.when(finite, F.col(y)), F.when(finite, F.col(p))
    sy, sp = F.stddev_pop(y), F.stddev_pop(p)
    ok = (F.count(y) >= MIN_PAIRS) & (sy >= MIN_SD) & (sp >= MIN_SD)
    return F.when(ok, F.try_divide(F.covar_pop(y, p), sy * sp))


def mae(y: str, p: str) -> Column:
    return F.avg(F.abs(F.col(y) - F.col(p)))


def _centred_rank() -> Column:
    """Average rank minus the group's mean rank, on the columns of `cumulative`."""
    return F.col("before") + (F.col("n") - F.col("total")) / F.lit(2.0)


def _with_truth_rank(df: DataFrame, steps: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    ranks = steps.select(*keys, y, _centred_rank().alias("_d"))
    return df.join(ranks, [*keys, y]).withColumn("_q", F.col("_d") * F.col("_d"))


def _rank_correlation(steps: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Spearman r from predicted values with the sums of their truth ranks (`_d`, `_q`).

    Rows with one predicted value share its rank, so their truth ranks are only
    summed: the predicted rank is never joined back to the rows.
    """
    c, n = _centred_rank(), F.max("total")
    sxy, sxx = F.sum(c * F.col("_d")), F.sum(F.col("n") * c * c)
    syy = F.max("total__q") - F.max("total__d") * F.max("total__d") / n
    ok = (n >= MIN_PAIRS) & (F.sqrt(sxx / n) >= MIN_SD) & (F.sqrt(F.greatest(syy, F.lit(0.0)) / n) >= MIN_SD)
    return steps.groupBy(*keys).agg(
        F.when(ok, F.try_divide(sxy, F.sqrt(sxx) * F.sqrt(F.greatest(syy, F.lit(0.0))))).alias(out)
    )


def spearman_safe(df: DataFrame, keys: Sequence[str], y: str, p: str, out: str = "spearman") -> DataFrame:
    """Pearson r of the average ranks, per group of any size."""
    keys = list(keys)
    pairs = df.select(*keys, F.col(y).alias("_y"), F.col(p).alias("_p")).where(all_finite(F.col("_y"), F.col("_p")))
    rows = _with_truth_rank(pairs, cumulative(pairs, keys, "_y"), keys, "_y")
    varies = pairs.groupBy(*keys).agg(_varies("_y", "_p").alias("_varies"))
    rho = _rank_correlation(cumulative(rows, keys, "_p", ["_d", "_q"], pairs), keys, out)
    if not keys:
        return rho.join(F.broadcast(varies), F.lit(True)).select(F.when(F.col("_varies"), F.col(out)).alias(out))  # one row each
    return rho.join(varies, keys).select(*keys, F.when(F.col("_varies"), F.col(out)).alias(out))


def _varies(y: str, p: str) -> Column:
    """Aggregate: whether neither side is constant, by its values."""
    return (F.stddev_pop(y) >= MIN_SD) & (F.stddev_pop(p) >= MIN_SD)


def _top_values(steps: DataFrame, keys: Sequence[str], v: str, frac: float) -> DataFrame:
    """Values that reach the top: how many rows have them (`n`), how many of these fit (`_room`), and the top's size (`_k`)."""
    k = F.greatest(F.lit(1), half_even(F.lit(frac) * F.col("total")))
    above = F.col("total") - F.col("before") - F.col("n")
    return steps.select(*keys, v, "n", k.alias("_k"), (k - above).alias("_room")).where("_room > 0")


def _top_share(
    df: DataFrame, picked: DataFrame, steps: DataFrame, keys: Sequence[str], v: str, tie: Sequence[str], frac: float, out: str
) -> DataFrame:
    """Share of the top of `df` that lies in `picked`, a part of it.

    Only the picked rows meet the top values; of all rows, only those of the one
    value that straddles the border are put in order.
    """
    keys, tie = list(keys), list(tie)
    values = _top_values(steps, keys, v, frac)
    inside = picked.join(values.where("n <= _room"), [*keys, v]).select(*keys)
    border = df.select(*keys, v, *tie).join(values.where("n > _room"), [*keys, v])
    reached = positions(border, keys, [*tie, "_room"]).where("pos < _room").select(*keys, *tie)
    hits = inside.unionByName(reached.join(picked.select(*keys, *tie), [*keys, *tie], "left_semi").select(*keys))
    size = values.groupBy(*keys).agg(F.max("_k").alias("_k"))
    found = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("_hits"))
    return size.join(found, keys, "left").select(*keys, (F.coalesce("_hits", F.lit(0)) / F.col("_k")).alias(out))


def _top(
    df: DataFrame, steps: DataFrame, keys: Sequence[str], v: str, tie: Sequence[str], frac: float
) -> DataFrame:
    """Keys of the max(1, share) largest rows of each group; ties go by key. `_k` is their number.

    `steps` is `cumulative(df, keys, v)`.  Only values that reach the top are
    joined back, and only the rows of the one value that straddles the border
    are put in order.
    """
    keys, tie = list(keys), list(tie)
    values = _top_values(steps, keys, v, frac)
    rows = df.select(*keys, v, *tie).join(values, [*keys, v])
    inside = rows.where("n <= _room").select(*keys, *tie, "_k")
    border = positions(rows.where("n > _room"), keys, [*tie, "_k", "_room"]).where("pos < _room")
    return inside.unionByName(border.select(*keys, *tie, "_k"))


def top_recall(
    df: DataFrame, keys: Sequence[str], y: str, p: str, tie: Sequence[str], frac: float = 0.1, out: str = "top10_recall"
) -> DataFrame:
    """Overlap of the largest share by truth and by prediction."""
    keys, tie = list(keys), list(tie)
    truth = _top(df, cumulative(df, keys, y), keys, y, tie, frac)
    guess = _top(df, cumulative(df, keys, p), keys, p, tie, frac)
    hits = truth.drop("_k").join(guess.drop("_k"), [*keys, *tie]).groupBy(*keys).agg(F.count(F.lit(1)).alias("_hits"))
    size = truth.groupBy(*keys).agg(F.max("_k").alias("_k"))
    return size.join(hits, keys, "left").select(
        *keys, F.try_divide(F.coalesce("_hits", F.lit(0)).cast("double"), F.col("_k").cast("double")).alias(out)
    )


def by_target(pairs: DataFrame) -> DataFrame:
    """Wide early/late columns to one row per target."""
    return pairs.select(
        *[c for c in pairs.columns if c.split("_")[-1] not in ("early", "late")],
        F.explode(
            F.array(*[
                F.struct(F.lit(t).alias("target"), F.col(f"true_{t}").alias("y"), F.col(f"pred_{t}").alias("p"))
                for t in ("early", "late")
            ])
        ).alias("_t"),
    ).select("*", "_t.*").drop("_t")


def repeat_metrics(pairs: DataFrame, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """All metrics per (subject, k, repeat, condition, target).

    `pairs` is read several times, so hand in a written table.  Conditions share
    their truth, so truth is ranked once and not once per condition.  The ranked
    predictions serve two metrics; pass `session.materialize` as `cut` to write
    them once instead of ranking twice.
    """
    long = by_target(pairs)
    base = long.groupBy(*REPEAT_KEYS).agg(
        F.count(F.lit(1)).alias("n_pairs"), pearson_safe("y", "p").alias("pearson"), mae("y", "p").alias("mae"), _varies("y", "p").alias("_varies"),
    )
    plan = [k for k in REPEAT_KEYS if k != "condition"]
    cell = ["query_site", "recording_channel"]
    truth = long.groupBy(*plan, *cell).agg(F.max("y").alias("y"))
    true_steps = cumulative(truth, plan, "y")
    rows = _with_truth_rank(long, true_steps, plan, "y")
    pred_steps = cut(cumulative(rows, REPEAT_KEYS, "p", ["_d", "_q"], long))
    rho = _rank_correlation(pred_steps, REPEAT_KEYS, "spearman")

    top_truth = _top(truth, true_steps, plan, "y", cell, 0.1)
    in_truth = long.select(*REPEAT_KEYS, *cell, "p").join(top_truth.drop("_k"), [*plan, *cell], "left_semi")
    hits = _top_share(long, in_truth, pred_steps, REPEAT_KEYS, "p", cell, 0.1, "_recall")
    return (
        base.join(rho, REPEAT_KEYS)
        .join(hits, REPEAT_KEYS, "left")
        .withColumns({"top10_recall": F.coalesce("_recall", F.lit(0.0)), "spearman": F.when(F.col("_varies"), F.col("spearman"))})
        .drop("_recall", "_varies")
    )


def patient_metrics(repeats: DataFrame, metrics: Sequence[str] = METRICS, expected: int | None = REPEATS) -> DataFrame:
    """Mean over repeats; repeats without a value are skipped but still counted.

    A cell with other than `expected` repeats, each once, stops the job (None: any number).
    """
    means = repeats.groupBy("subject", "context_k", "condition", "target").agg(
        F.count_distinct("repeat").alias("n_repeats"),
        F.count(F.lit(1)).alias("_rows"),
        *[F.avg(m).alias(m) for m in metrics],
        F.avg("n_pairs").alias("mean_pairs_per_repeat"),
    )
    if expected is not None:
        stop = F.raise_error(F.concat(F.col("_rows").cast("string"), F.lit(f" rows where {expected} repeats are expected for patient "), F.col("subject")))
        right = (F.col("n_repeats") == expected) & (F.col("_rows") == expected)
        means = means.where(F.when(right, F.lit(True)).otherwise(stop.cast("boolean")))
    return means.drop("_rows")


def _single(value: str, what: str) -> Column:
    """Aggregate: the one value of a cell; a second row stops the job."""
    stop = F.raise_error(F.lit(f"more than one row for a {what}")).cast("double")
    return F.when(F.count(F.lit(1)) > 1, stop).otherwise(F.max(value))


def _by_condition(patients: DataFrame, metric: str, conditions: Sequence[str]) -> DataFrame:
    """One column per condition, each from exactly one row."""
    cells = patients.where(F.col("condition").isin(*conditions)).groupBy("subject", "context_k", "target", "condition").agg(
        _single(metric, "patient and condition").alias("_v")
    )
    return cells.groupBy("subject", "context_k", "target").agg(
        *[F.max(F.when(F.col("condition") == c, F.col("_v"))).alias(c) for c in conditions]
    )


def group_metrics(patients: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    return patients.groupBy("context_k", "condition", "target").agg(
        F.count(F.lit(1)).alias("n_patients"),
        *[a for m in metrics for a in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_sd"))],
    )


# Each level and the one it is compared with.
GAINS = {
    "global_gain": ("global", "population"),
    "node_gain": ("node", "global"),
    "relation_gain": ("relation", "node"),
    "correspondence_gain": ("relation", "relation_perm"),
}


def nested_gains(patients: DataFrame, metric: str, lower_is_better: bool = False) -> DataFrame:
    """Gain of each level over the one below, per patient, k and target."""
    from sparkmap.operators.hierarchy import CONDITIONS

    wide = _by_condition(patients, metric, CONDITIONS)
    sign = -1.0 if lower_is_better else 1.0
    return wide.select(
        "subject", "context_k", "target",
        *[(F.lit(sign) * (F.col(a) - F.col(b))).alias(name) for name, (a, b) in GAINS.items()],
    )


def _huber(y: str, mu: str) -> Column:
    err = F.col(y) - F.col(mu)
    return F.when(F.abs(err) <= 1.0, 0.5 * err * err).otherwise(F.abs(err) - 0.5)


def score_terms(df: DataFrame, keys: Sequence[str], pairs_per_row: int = 4, seed: int = 7) -> DataFrame:
    """Grouped evaluation scores of predictions: Gaussian NLL, Huber, 1 - r, pairwise rank loss.

    `df`: keys, row_id, y, mu, log_var; a second row of a row_id stops the job.
    The rank loss compares each row with `pairs_per_row` partners drawn by hash;
    it never forms all pairs.
    """
    from sparkmap.functions.hashing import hash_long

    keys = list(keys)
    df = one_per_key(df.select(*keys, "row_id", "y", "mu", "log_var"), [*keys, "row_id"], "row")
    err = F.col("y") - F.col("mu")
    nll = 0.5 * (F.col("log_var") + err * err * F.exp(-F.col("log_var")))
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(nll).alias("gaussian_nll"),
        F.avg(_huber("y", "mu")).alias("huber"),
        (F.lit(1.0) - pearson_safe("y", "mu")).alias("one_minus_r"),
    )
    ranked = positions(df.select(*keys, "row_id", "y", "mu"), keys, ["row_id", "y", "mu"])
    asked = ranked.withColumn("_j", F.explode(F.sequence(F.lit(1), F.lit(pairs_per_row)))).withColumn(
        "_partner", F.pmod(hash_long(F.lit(seed), F.col("row_id"), F.col("_j")), F.col("total"))
    )
    other = ranked.select(*keys, F.col("pos").alias("_partner"), F.col("y").alias("y2"), F.col("mu").alias("mu2"))
    met = asked.join(other, [*keys, "_partner"]).where("y <> y2")
    margin = F.signum(F.col("y") - F.col("y2")) * (F.col("mu") - F.col("mu2"))
    loss = met.groupBy(*keys).agg(F.avg(F.log1p(F.exp(-margin))).alias("rank_loss"))
    return base.join(loss, keys, "left")


def control_hinge(df: DataFrame, keys: Sequence[str], margin: float = 0.0) -> DataFrame:
    """How far the true correspondence fails to beat its permuted control, per group.

    `df`: keys, row_id, y, mu (true correspondence), control.  Both Huber scores
    are taken over the same rows in one aggregate, those with all three values;
    the hinge is what of margin + huber - huber_control is above 0.  A second row
    of a row_id stops the job.
    """
    keys = list(keys)
    rows = one_per_key(df.select(*keys, "row_id", "y", "mu", "control"), [*keys, "row_id"], "row")
    paired = rows.where(all_finite(F.col("y"), F.col("mu"), F.col("control")))
    scores = paired.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(_huber("y", "mu")).alias("huber"), F.avg(_huber("y", "control")).alias("huber_control")
    )
    return scores.withColumn("control_hinge", F.greatest(F.lit(margin) + F.col("huber") - F.col("huber_control"), F.lit(0.0)))
