"""Event windows, response features, maps and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkmap.catalog.registry import cte, query
from sparkmap.catalog.roles import (
    contact_points, epochs, maps, pulse_samples, pulses, table, trial_table, trials,
)
from sparkmap.functions import signal
from sparkmap.operators import quality, response

_FS = 250.0


@query("window_bounds", "event_id pre0:i pre1:i early0:i early1:i late1:i", "", """
  SELECT event_id, s + CAST(round_even(-0.5 * fs, 0) AS BIGINT) AS pre0, s + CAST(round_even(-0.02 * fs, 0) AS BIGINT) AS pre1,
    s + CAST(round_even(0.01 * fs, 0) AS BIGINT) AS early0, s + CAST(round_even(0.1 * fs, 0) AS BIGINT) AS early1,
    s + CAST(round_even(0.5 * fs, 0) AS BIGINT) AS late1
  FROM (SELECT event_id, event_id * 7 AS s, CASE WHEN event_id % 2 = 0 THEN 2048.0::DOUBLE ELSE 250.0::DOUBLE END AS fs FROM events)""")
def _(spark, sf):
    fs = F.when(F.col("event_id") % 2 == 0, F.lit(2048.0)).otherwise(F.lit(250.0))
    b = signal.window_bounds(F.col("event_id") * 7, fs)
    return table(spark, sf, "events", "event_id").select("event_id", *[c.alias(n) for n, c in b.items()])


@query("epoch_in_bounds", "user_id n_kept:i n_dropped:i", "", """
  SELECT user_id, count(*) FILTER (WHERE ok) AS n_kept, count(*) FILTER (WHERE NOT ok) AS n_dropped FROM (
    SELECT user_id, event_id * 7 - 500 >= 0 AND event_id * 7 + 500 <= 30000 AS ok FROM events) GROUP BY user_id""")
def _(spark, sf):
    s = F.col("event_id") * 7
    ok = signal.epoch_in_bounds(s - 500, s + 500, F.lit(30000))
    return table(spark, sf, "events", "event_id", "user_id").groupBy("user_id").agg(
        F.count_if(ok).alias("n_kept"), F.count_if(~ok).alias("n_dropped")
    )


def _cut(spark, sf):
    return response.cut_epochs(pulses(spark, sf), pulse_samples(spark, sf), ["user_id"], bucket=86_400)


@query("cut_epochs", "user_id event_id n_before:i n_after:i mean_after:d", "pulses pulse_samples", """
  SELECT p.user_id, event_id, count(*) FILTER (WHERE sample_idx < mid) AS n_before,
    count(*) FILTER (WHERE sample_idx >= mid) AS n_after, avg(value) FILTER (WHERE sample_idx >= mid) AS mean_after
  FROM pulses p JOIN pulse_samples s ON p.user_id = s.user_id AND sample_idx >= lo AND sample_idx < hi GROUP BY 1, 2""")
def _(spark, sf):
    after = F.col("sample_idx") >= F.col("mid")
    return _cut(spark, sf).groupBy("user_id", "event_id").agg(
        F.count_if(~after).alias("n_before"), F.count_if(after).alias("n_after"),
        F.avg(F.when(after, F.col("value"))).alias("mean_after"),
    )


@query("robust_scale", "vec_id center:d scale:d", "robust", "SELECT vec_id, center, scale FROM robust")
def _(spark, sf):
    b = F.col("baseline")
    return epochs(spark, sf).select(
        "vec_id", signal.robust_center(b).alias("center"), signal.robust_scale(b, signal.robust_center(b)).alias("scale")
    )


@query("robust_z", "vec_id i:i z:d", "zsamples", "SELECT vec_id, i - 29 AS i, z FROM zsamples WHERE win = 'early'")
def _(spark, sf):
    b = F.col("baseline")
    c = signal.robust_center(b)
    z = signal.robust_z(F.col("early"), c, signal.robust_scale(b, c))
    return epochs(spark, sf).select("vec_id", F.posexplode(z).alias("i", "z"))


def _features(spark, sf):
    return response.epoch_features(epochs(spark, sf), late_start_ms=100.0, early_start_ms=10.0, fs=_FS)


@query("rms", "vec_id early_rms_z:d late_rms_z:d", "zsamples", """
  SELECT vec_id, sqrt(avg(z * z) FILTER (WHERE win = 'early')) AS early_rms_z,
    sqrt(avg(z * z) FILTER (WHERE win = 'late')) AS late_rms_z FROM zsamples GROUP BY vec_id""")
def _(spark, sf):
    return _features(spark, sf)


@query("peak", "vec_id early_peak_abs_z:d early_peak_ms:d late_peak_abs_z:d late_peak_ms:d", "zsamples", """
  SELECT vec_id, max(abs(z)) FILTER (WHERE win = 'early') AS early_peak_abs_z,
    10 + (arg_min(i, (-abs(z), i)) FILTER (WHERE win = 'early') - 29) * 4.0 AS early_peak_ms,
    max(abs(z)) FILTER (WHERE win = 'late') AS late_peak_abs_z,
    100 + (arg_min(i, (-abs(z), i)) FILTER (WHERE win = 'late') - 41) * 4.0 AS late_peak_ms
  FROM zsamples GROUP BY vec_id""")
def _(spark, sf):
    return _features(spark, sf)


def _with_contacts(spark, sf):
    n = F.col("site_no")
    return trials(spark, sf).withColumn("contact_a", F.concat(F.lit("CH"), (1 + n % 7).cast("string"))).withColumn(
        "contact_b", F.concat(F.lit("ch"), (1 + n % 5).cast("string"))
    )


@query("exclude_contacts", "subject stim_site n:i", "trials", """
  SELECT subject, stim_site, count(*) AS n FROM trials
  WHERE recording_channel <> 'ch' || (1 + site_no % 7) AND recording_channel <> 'ch' || (1 + site_no % 5) GROUP BY 1, 2""")
def _(spark, sf):
    kept = response.exclude_contacts(_with_contacts(spark, sf))
    return kept.groupBy("subject", "stim_site").agg(F.count(F.lit(1)).alias("n"))


@query("match_channels", "subject name header_name", "contact_points", """
  SELECT subject, name, ' ' || lower(name) AS header_name FROM contact_points WHERE y > -20 AND x < 20""")
def _(spark, sf):
    """The header spells contacts below a plane in another way; far-right ones have lost their coordinate."""
    c = contact_points(spark, sf)
    inventory = c.withColumn("x", F.when(F.col("x") < 20, F.col("x"))).select("subject", "name", "x", "y", "z")
    header = c.select(F.concat(F.when(F.col("y") > -20, " ").otherwise("?"), F.lower("name")).alias("name"))
    return response.match_channels(inventory, header, ["x", "y", "z"])


@query("trials_to_map", "subject stim_site recording_channel n_trials:i n_runs:i distance_to_stim:d early_rms_z:d9 late_rms_z:d9 early_rms_iqr:d9 late_rms_iqr:d9",
       "map", "FROM map")
def _(spark, sf):
    return trials_map(spark, sf)


def trials_map(spark, sf):
    return response.trials_to_map(trial_table(spark, sf))


@query("trials_to_map_development", "subject split stim_site recording_channel n_trials:i late_peak:d9 near_field:i", "trials", """
  SELECT subject, CASE WHEN protocol < '3' THEN 'a' ELSE 'b' END AS split, stim_site, recording_channel,
    count(DISTINCT event_uid) AS n_trials, median(late_rms_z) AS late_peak, max(CAST(distance_to_stim <= 20 AS INT)) AS near_field
  FROM trials GROUP BY ALL""")
def _(spark, sf):
    t = trial_table(spark, sf).withColumn("split", F.when(F.col("protocol") < "3", "a").otherwise("b")).withColumn(
        "near", (F.col("distance_to_stim") <= 20).cast("int")
    )
    return response.trials_to_map(
        t, ["subject", "split", "stim_site", "recording_channel"],
        medians={"late_peak": "late_rms_z"}, iqrs={}, maxima={"near_field": "near"},
    )


@query("events_allowlist", "subject n:i", "trials", """
  SELECT subject, count(*) AS n FROM trials WHERE event_uid IN (
    SELECT o_orderkey || ':1' FROM orders WHERE o_orderstatus = 'F') GROUP BY subject""")
def _(spark, sf):
    allow = table(spark, sf, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus = 'F'").select(
        F.concat(F.col("o_orderkey").cast("string"), F.lit(":1")).alias("event_uid")
    )
    kept = response.events_allowlist(trials(spark, sf), allow, ["event_uid"])
    return kept.groupBy("subject").agg(F.count(F.lit(1)).alias("n"))


# the frozen list holds every trial's event; events of a weak response, and one subject's site, have none that is valid
_VALID = "early_rms_z > 2 AND NOT (subject = 'sub-03' AND site_no % 10 = 3)"
cte("valid_trials", "trials", f"SELECT * FROM trials WHERE {_VALID}")
cte("valid_map", "valid_trials", """
  SELECT subject, stim_site, recording_channel, count(DISTINCT event_uid) AS n_trials, median(early_rms_z) AS early_rms_z, median(late_rms_z) AS late_rms_z
  FROM valid_trials GROUP BY ALL""")
_KEYS4 = "subject, stim_site, run_base, event_uid"
cte("event_flags", "trials valid_trials", f"""
  SELECT {_KEYS4}, max(e) AS e, max(o) AS o FROM (SELECT {_KEYS4}, 1 AS e, 0 AS o FROM trials UNION ALL SELECT {_KEYS4}, 0, 1 FROM valid_trials) GROUP BY ALL""")


def valid_trials(spark, sf):
    return trial_table(spark, sf).where(_VALID)


@query("extraction_audit", "level subject stim_site run_base n_expected:i n_observed:i n_missing:i n_unexpected:i", "event_flags", """
  SELECT CASE GROUPING_ID(subject, stim_site, run_base) WHEN 7 THEN 'all' WHEN 3 THEN 'subject' WHEN 1 THEN 'site' ELSE 'run' END AS level,
    subject, stim_site, run_base, sum(e) AS n_expected, sum(e * o) AS n_observed, sum(e * (1 - o)) AS n_missing, sum((1 - e) * o) AS n_unexpected
  FROM event_flags GROUP BY GROUPING SETS ((), (subject), (subject, stim_site), (run_base))""")
def _(spark, sf):
    return response.extraction_audit(trial_table(spark, sf), valid_trials(spark, sf))


@query("extraction_qc", "status n_subjects_expected:i n_subjects:i n_runs_expected:i n_runs_seen:i n_events_expected:i n_events:i n_events_missing:i n_events_unexpected:i "
       "n_trial_rows:i n_map_rows:i n_sites_expected:i n_sites:i n_sites_missing:i min_subject_sites:i median_subject_sites:d max_subject_sites:i n_low_trial_rows:i min_trials:i max_trials:i "
       "median_trials:d early_p01:d9 early_p50:d9 early_p99:d9 late_min:d9 late_p01:d9 late_p50:d9 late_p99:d9 late_max:d9",
       "trials valid_trials valid_map event_flags", """
  SELECT *, CASE WHEN n_sites_missing = 0 THEN 'EXTRACTION_COMPLETE' ELSE 'EXTRACTION_COMPLETE_WITH_MECHANICAL_MISSINGNESS' END AS status FROM
    (SELECT count(*) AS n_trial_rows, count(DISTINCT run_base) AS n_runs_seen FROM valid_trials),
    (SELECT count(DISTINCT subject) AS n_subjects_expected, count(DISTINCT run_base) AS n_runs_expected, sum(e) AS n_events_expected, sum(e * o) AS n_events,
      sum(e * (1 - o)) AS n_events_missing, sum((1 - e) * o) AS n_events_unexpected FROM event_flags),
    (SELECT count(*) AS n_map_rows, count(DISTINCT subject) AS n_subjects, count(DISTINCT (subject, stim_site)) AS n_sites, count(*) FILTER (WHERE n_trials < 5) AS n_low_trial_rows,
      min(n_trials) AS min_trials, max(n_trials) AS max_trials, median(n_trials) AS median_trials, min(late_rms_z) AS late_min,
      quantile_cont(early_rms_z, 0.01) AS early_p01, median(early_rms_z) AS early_p50, quantile_cont(early_rms_z, 0.99) AS early_p99,
      quantile_cont(late_rms_z, 0.01) AS late_p01, median(late_rms_z) AS late_p50, quantile_cont(late_rms_z, 0.99) AS late_p99,
      max(late_rms_z) AS late_max FROM valid_map),
    (SELECT min(n) AS min_subject_sites, median(n) AS median_subject_sites, max(n) AS max_subject_sites FROM (SELECT count(DISTINCT stim_site) AS n FROM valid_map GROUP BY subject)),
    (SELECT count(*) AS n_sites_expected, count(*) FILTER (WHERE (subject, stim_site) NOT IN (SELECT (subject, stim_site) FROM valid_map)) AS n_sites_missing
      FROM (SELECT DISTINCT subject, stim_site FROM trials))""")
def _(spark, sf):
    """The whole frozen list against its valid trials and their map."""
    t = valid_trials(spark, sf)
    return response.extraction_qc(trial_table(spark, sf), t, response.trials_to_map(t, iqrs={}))


@query("missing_keys", "subject stim_site recording_channel", "trials", """
  SELECT DISTINCT subject, stim_site, recording_channel FROM trials
  EXCEPT SELECT subject, stim_site, recording_channel FROM trials WHERE protocol = '1-URGENT'""")
def _(spark, sf):
    t = trials(spark, sf)
    return response.missing_keys(t, t.where("protocol = '1-URGENT'"), response.MAP_KEYS)


@query("counts_with_zero", "subject n_sites:i", "", """
  SELECT c_name AS subject, count(DISTINCT o_orderpriority) AS n_sites
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_name""")
def _(spark, sf):
    cohort = table(spark, sf, "customer", "c_custkey", "c_name").withColumnRenamed("c_name", "subject")
    o = table(spark, sf, "orders", "o_custkey", "o_orderpriority", "o_orderstatus").where("o_orderstatus = 'F'")
    rows = o.join(cohort, o.o_custkey == cohort.c_custkey).select("subject", "o_orderpriority")
    return response.counts_with_zero(cohort, rows, "subject", "o_orderpriority", "n_sites")


@query("drop_counters", "n_rows:i early_window:i no_sample:i weak:i", "pulses pulse_samples", """
  SELECT count(*) AS n_rows, count(*) FILTER (WHERE sample_idx < mid) AS early_window, 0 AS no_sample,
    count(*) FILTER (WHERE value < 5) AS weak
  FROM pulses p JOIN pulse_samples s ON p.user_id = s.user_id AND sample_idx >= lo AND sample_idx < hi""")
def _(spark, sf):
    return quality.drop_counters(
        _cut(spark, sf),
        {
            "early_window": F.col("sample_idx") < F.col("mid"),
            "no_sample": F.col("value").isNull(),
            "weak": F.col("value") < 5,
        },
    )
