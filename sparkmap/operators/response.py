"""From samples and trials to response maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sparkmap.functions import signal
from sparkmap.functions.numeric import all_finite
from sparkmap.functions.text import casefold_key
from sparkmap.operators.ordering import Quantile, median, quantiles, quantiles_of_groups
from sparkmap.operators.quality import one_per_key

MAP_KEYS = ["subject", "stim_site", "recording_channel"]


def cut_epochs(
    events: DataFrame, samples: DataFrame, keys: Sequence[str], bucket: int, lo: str = "lo", hi: str = "hi"
) -> DataFrame:
    """Samples inside [lo, hi) of each event of the same recording.

    Both sides carry the key and a time bucket.  An event is repeated for the
    buckets its window touches, so each sample meets only nearby events, and a
    recording with a third of all samples is spread over its buckets.
    """
    ev = events.withColumn(
        "_bucket",
        F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor((F.col(hi) - 1) / bucket))),
    )
    sm = samples.withColumn("_bucket", F.floor(F.col("sample_idx") / bucket))
    return (
        ev.join(sm, [*keys, "_bucket"])
        .where((F.col("sample_idx") >= F.col(lo)) & (F.col("sample_idx") < F.col(hi)))
        .drop("_bucket")
    )


def epoch_features(epochs: DataFrame, late_start_ms: float, early_start_ms: float, fs: float) -> DataFrame:
    """Robustly standardised RMS and peak features of `baseline`, `early`, `late` arrays."""
    center, scale = F.col("baseline_center"), F.col("baseline_scale")
    return (
        epochs.withColumn("baseline_center", signal.robust_center(F.col("baseline")))
        .withColumn("baseline_scale", signal.robust_scale(F.col("baseline"), center))
        .withColumn("_e", signal.robust_z(F.col("early"), center, scale))
        .withColumn("_l", signal.robust_z(F.col("late"), center, scale))
        .withColumn("early_rms_z", signal.rms(F.col("_e")))
        .withColumn("late_rms_z", signal.rms(F.col("_l")))
        .withColumn("early_peak_abs_z", signal.peak_abs(F.col("_e")))
        .withColumn("late_peak_abs_z", signal.peak_abs(F.col("_l")))
        .withColumn("early_peak_ms", signal.peak_ms(F.col("_e"), early_start_ms, fs))
        .withColumn("late_peak_ms", signal.peak_ms(F.col("_l"), late_start_ms, fs))
        .drop("_e", "_l")
    )


def exclude_contacts(df: DataFrame) -> DataFrame:
    """Drop rows recorded on one of the two stimulating contacts."""
    ch = casefold_key(F.col("recording_channel"))
    return df.where(
        (ch != casefold_key(F.col("contact_a"))) & (ch != casefold_key(F.col("contact_b")))
    )


def match_channels(inventory: DataFrame, header: DataFrame, coords: Sequence[str]) -> DataFrame:
    """Inventory rows found in the recording header (case-insensitive) with finite coordinates.

    Ambiguous header names (two spellings of one key) are an error in the data
    and stop the job; `duplicate_header_keys` lists them.
    """
    key = casefold_key(F.col("name"))
    head = one_per_key(header.withColumn("_key", key).withColumnRenamed("name", "header_name"), ["_key"], "header name")
    inv = inventory.where(all_finite(*[F.col(c) for c in coords])).withColumn("_key", key)
    return inv.join(head, "_key").drop("_key")


def duplicate_header_keys(header: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return (
        header.groupBy(*keys, casefold_key(F.col("name")).alias("key"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )


def trials_to_map(
    trials: DataFrame,
    keys: Sequence[str] = MAP_KEYS,
    medians: dict[str, str] | None = None,
    iqrs: dict[str, str] | None = None,
    maxima: dict[str, str] | None = None,
) -> DataFrame:
    """Aggregate trials to one row per key.

    n_trials counts distinct events, n_runs distinct runs.  Medians and quartiles
    are exact for cells of any size.  `medians`, `iqrs` and `maxima` map output
    names to input columns; the defaults give the external map, and a
    development map adds `split` to the keys, peaks to the medians and the
    near-field flag to the maxima.
    """
    medians = medians or {
        "distance_to_stim": "distance_to_stim",
        "early_rms_z": "early_rms_z",
        "late_rms_z": "late_rms_z",
    }
    iqrs = {"early_rms_iqr": "early_rms_z", "late_rms_iqr": "late_rms_z"} if iqrs is None else iqrs
    wanted = {name: median(col) for name, col in medians.items()}
    for name, col in iqrs.items():
        wanted |= {f"_{name}_hi": Quantile(col, 0.75), f"_{name}_lo": Quantile(col, 0.25)}
    spread = quantiles_of_groups(trials, keys, wanted)
    for name in iqrs:
        spread = spread.withColumn(name, F.col(f"_{name}_hi") - F.col(f"_{name}_lo"))
        spread = spread.drop(f"_{name}_hi", f"_{name}_lo")
    counts = trials.groupBy(*keys).agg(
        F.count_distinct("event_uid").alias("n_trials"),
        F.count_distinct("run_base").alias("n_runs"),
        *[F.max(c).alias(n) for n, c in (maxima or {}).items()],
    )
    return counts.join(spread, list(keys), "left")


def events_allowlist(events: DataFrame, allow: DataFrame, key: Sequence[str]) -> DataFrame:
    return events.join(allow.select(*key), list(key), "left_semi")


EVENT_KEYS = ("subject", "stim_site", "run_base", "event_uid")


def extraction_audit(expected: DataFrame, trials: DataFrame) -> DataFrame:
    """Events of the frozen list against those with a response: in all, per subject, per site and per run.

    Both sides have subject, stim_site, run_base and event_uid.  One pass over
    both gives each event's two flags, one over the events all levels:
    `level`, the level's keys (else NULL), n_expected, n_observed (of the list),
    n_missing and n_unexpected events.
    """
    flag = lambda df, e, o: df.select(*EVENT_KEYS, F.lit(e).alias("e"), F.lit(o).alias("o"))
    events = flag(expected, 1, 0).unionByName(flag(trials, 0, 1)).groupBy(*EVENT_KEYS).agg(F.max("e").alias("e"), F.max("o").alias("o"))
    keys = [F.col(c) for c in EVENT_KEYS[:3]]
    subject, site, run = keys
    counted = events.groupingSets([[], [subject], [subject, site], [run]], *keys).agg(
        F.grouping_id().alias("_g"),
        F.sum("e").alias("n_expected"),
        F.sum(F.col("e") * F.col("o")).alias("n_observed"),
        F.sum(F.col("e") * (1 - F.col("o"))).alias("n_missing"),
        F.sum((1 - F.col("e")) * F.col("o")).alias("n_unexpected"),
    )
    level = F.when(F.col("_g") == 7, "all").when(F.col("_g") == 3, "subject").when(F.col("_g") == 1, "site").otherwise("run")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return counted.select(level.alias("level"), *EVENT_KEYS[:3], *[zero(c) for c in ("n_expected", "n_observed", "n_missing", "n_unexpected")])


def extraction_qc(expected: DataFrame, trials: DataFrame, maps: DataFrame, low_trials: int = 5) -> DataFrame:
    """One row: the frozen list against what came out, low-trial cells, and the spread of trials and responses.

    A site is missing if it has expected events and no map entry.
    """
    audit = extraction_audit(expected, trials)
    count = lambda where: F.count_if(F.expr(where))
    whole = lambda c: F.max(F.when(F.col("level") == "all", F.col(c)))
    events = audit.agg(
        count("level = 'subject' AND n_expected > 0").alias("n_subjects_expected"),
        count("level = 'run' AND n_expected > 0").alias("n_runs_expected"),
        count("level = 'run' AND n_observed + n_unexpected > 0").alias("n_runs_seen"),
        whole("n_expected").alias("n_events_expected"),
        whole("n_observed").alias("n_events"),
        whole("n_missing").alias("n_events_missing"),
        whole("n_unexpected").alias("n_events_unexpected"),
    )
    sizes = trials.agg(F.count(F.lit(1)).alias("n_trial_rows"))
    listed = expected.select("subject", "stim_site").distinct().withColumn("_e", F.lit(1))
    per_site = maps.groupBy("subject", "stim_site").agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if(F.col("n_trials") < low_trials).alias("_low"),
        F.min("n_trials").alias("_min"), F.max("n_trials").alias("_max"),
    ).join(listed, ["subject", "stim_site"], "full")
    mapped = F.col("_rows").isNotNull()
    per_subject = per_site.groupBy("subject").agg(
        F.count_if(mapped).alias("n_sites"), F.count_if(F.col("_e").isNotNull()).alias("_listed"),
        F.count_if(mapped & F.col("_e").isNotNull()).alias("_both"), *[F.sum(c).alias(c) for c in ("_rows", "_low")],
        F.min("_min").alias("_min"), F.max("_max").alias("_max"),
    )
    seen = F.when(F.col("n_sites") > 0, F.col("n_sites"))
    cells = per_subject.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("n_map_rows"),
        F.count(seen).alias("n_subjects"),
        F.sum("_listed").alias("n_sites_expected"),
        F.sum("n_sites").alias("n_sites"),
        (F.sum("_listed") - F.sum("_both")).alias("n_sites_missing"),
        F.min(seen).alias("min_subject_sites"),
        F.max(seen).alias("max_subject_sites"),
        F.coalesce(F.sum("_low"), F.lit(0)).alias("n_low_trial_rows"),
        F.min("_min").alias("min_trials"),
        F.max("_max").alias("max_trials"),
    )
    middle = quantiles(per_subject.select(seen.cast("double").alias("s")), [], {"median_subject_sites": median("s")})
    spread = quantiles(
        maps.select(F.col("n_trials").cast("double").alias("n_trials"), "early_rms_z", "late_rms_z"),
        [],
        {"median_trials": median("n_trials")}
        | {f"{t}_{n}": Quantile(f"{t}_rms_z", q) for t in ("early", "late") for n, q in (("p01", 0.01), ("p50", 0.5), ("p99", 0.99))},
    )
    ends = maps.agg(F.min("late_rms_z").alias("late_min"), F.max("late_rms_z").alias("late_max"))
    out = events
    for one in (sizes, cells, middle, spread, ends):  # tables of exactly one row
        out = out.join(F.broadcast(one), F.lit(True))
    complete = F.when(F.col("n_sites_missing") == 0, "EXTRACTION_COMPLETE").otherwise("EXTRACTION_COMPLETE_WITH_MECHANICAL_MISSINGNESS")
    return out.withColumn("status", complete)


def missing_keys(expected: DataFrame, observed: DataFrame, key: Sequence[str]) -> DataFrame:
    return expected.select(*key).distinct().join(observed.select(*key), list(key), "left_anti")


def counts_with_zero(cohort: DataFrame, df: DataFrame, group: str, item: str, out: str) -> DataFrame:
    """Distinct items per member of the cohort, 0 for members without rows."""
    n = df.groupBy(group).agg(F.count_distinct(item).alias(out))
    return cohort.select(group).join(n, group, "left").withColumn(out, F.coalesce(out, F.lit(0)))

