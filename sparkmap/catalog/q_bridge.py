"""Label bridge and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkmap.catalog.q_clean import stem_sql
from sparkmap.catalog.q_geometry import site_pairs
from sparkmap.catalog.registry import cte, query
from sparkmap.catalog.roles import contact_bridge, part_labels, site_points, target_vocabulary, trial_table
from sparkmap.functions import text
from sparkmap.operators import bridge

cte("vocabulary", "part_labels", """
  SELECT label_column, token, count(*) AS n FROM (
    SELECT 'roi_text' AS label_column, roi_text AS token FROM part_labels UNION ALL SELECT 'roi_numeric', roi_numeric FROM part_labels)
  WHERE token <> 'unknown' GROUP BY ALL""")


def _vocabulary(spark, sf):
    return bridge.vocabulary(part_labels(spark, sf), ["roi_text", "roi_numeric"])


@query("vocabulary", "label_column token n:i", "vocabulary", "FROM vocabulary")
def _(spark, sf):
    return _vocabulary(spark, sf)


cte("vocab_overlap", "vocabulary target_vocab", """
  SELECT label_column, sum(n * hit) / sum(n) AS weighted_share, avg(hit) AS plain_share FROM (
    SELECT *, CAST(token IN (SELECT token FROM target_vocab) AS INT) AS hit FROM vocabulary) GROUP BY label_column""")


@query("vocab_overlap", "label_column weighted_share:d plain_share:d", "vocab_overlap", "FROM vocab_overlap")
def _(spark, sf):
    return bridge.vocab_overlap(_vocabulary(spark, sf), target_vocabulary(spark, sf))


@query("better_representation", "text_share:d numeric_share:d chosen", "vocab_overlap", """
  SELECT t.w AS text_share, m.w AS numeric_share, CASE WHEN m.w > t.w THEN 'roi_numeric' ELSE 'roi_text' END AS chosen
  FROM (SELECT weighted_share AS w FROM vocab_overlap WHERE label_column = 'roi_text') t,
    (SELECT weighted_share AS w FROM vocab_overlap WHERE label_column = 'roi_numeric') m""")
def _(spark, sf):
    overlap = bridge.vocab_overlap(_vocabulary(spark, sf), target_vocabulary(spark, sf))
    return bridge.better_representation(overlap, "roi_text", "roi_numeric")


_L = "|".join(f"(?:{p})" for p in text.LEFT_MARKS)
_R = "|".join(f"(?:{p})" for p in text.RIGHT_MARKS)


def _hemi(col: str) -> str:
    return f"CASE WHEN regexp_matches(lower({col}), '{_L}') THEN 'L' WHEN regexp_matches(lower({col}), '{_R}') THEN 'R' END"


cte("target_keys", "target_vocab", f"""
  SELECT token, {_hemi('token')} AS hemi, {stem_sql('token')} AS stem FROM target_vocab""")


@query("candidates", "hemi stem n:i tokens", "target_keys", """
  SELECT hemi, stem, count(*) AS n, string_agg(token, '|' ORDER BY token) AS tokens FROM target_keys GROUP BY hemi, stem""")
def _(spark, sf):
    c = bridge.candidates(target_vocabulary(spark, sf), ["hemi", "stem"])
    return c.select("hemi", "stem", F.size("candidates").alias("n"), F.array_join("candidates", "|").alias("tokens"))


def bridge_sql(source: str, hemi: str) -> str:
    return f"""
  SELECT s.*, exact, coalesce(n_strict, 0) AS n_strict, coalesce(strict_candidates, '') AS strict_candidates,
    coalesce(n_stem, 0) AS n_stem, coalesce(stem_candidates, '') AS stem_candidates, CASE WHEN n_strict = 1 THEN strict_candidates END AS target
  FROM (SELECT *, {hemi} AS hemi, {stem_sql('token')} AS stem FROM {source}) s
  LEFT JOIN (SELECT token, token AS exact FROM target_vocab) e ON s.token = e.token
  LEFT JOIN (SELECT hemi, stem, count(*) AS n_strict, string_agg(token, '|' ORDER BY token) AS strict_candidates FROM target_keys GROUP BY 1, 2) k
    ON k.hemi IS NOT DISTINCT FROM s.hemi AND k.stem = s.stem
  LEFT JOIN (SELECT stem, count(*) AS n_stem, string_agg(token, '|' ORDER BY token) AS stem_candidates FROM target_keys GROUP BY 1) m ON m.stem = s.stem"""


cte("roi_tokens", "vocabulary", "SELECT token, n FROM vocabulary WHERE label_column = 'roi_text'")
cte("plain_bridge", "roi_tokens target_vocab target_keys", bridge_sql("roi_tokens", _hemi("token")))
_BRIDGE_COLS = "n:i hemi stem exact n_strict:i strict_candidates n_stem:i stem_candidates target"


def _plain(spark, sf):
    src = _vocabulary(spark, sf).where("label_column = 'roi_text'").select("token", "n")
    return bridge.bridge_candidates(src, target_vocabulary(spark, sf))


@query("bridge_candidates", f"token {_BRIDGE_COLS}", "plain_bridge", "FROM plain_bridge")
def _(spark, sf):
    return _plain(spark, sf)


cte("roi_rows", "part_labels", """
  SELECT roi_text AS token, CASE WHEN hemi_text = 'left' THEN 'L' ELSE 'R' END AS metadata_hemi, count(*) AS n
  FROM part_labels WHERE roi_text <> 'unknown' GROUP BY 1, 2""")
cte("augmented_bridge", "roi_rows target_vocab target_keys",
    bridge_sql("roi_rows", f"coalesce({_hemi('token')}, metadata_hemi)"))


def _augmented(spark, sf):
    rows = (
        part_labels(spark, sf)
        .where(text.valid_text(F.col("roi_text"), text.MISSING_LABEL))
        .groupBy(F.col("roi_text").alias("token"), text.hemi_from_meta(F.col("hemi_text")).alias("metadata_hemi"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return bridge.bridge_candidates(rows, target_vocabulary(spark, sf), F.col("metadata_hemi"))


@query("bridge_augmented", f"token metadata_hemi {_BRIDGE_COLS}", "augmented_bridge", "FROM augmented_bridge")
def _(spark, sf):
    return _augmented(spark, sf)


@query("bridge_coverage", "kind n_tokens:i weighted_share:d unique_share:d", "plain_bridge augmented_bridge", """
  SELECT 'plain' AS kind, count(*) AS n_tokens, sum(n * CAST(target IS NOT NULL AS INT)) / sum(n) AS weighted_share,
    avg(CAST(target IS NOT NULL AS INT)) AS unique_share FROM plain_bridge
  UNION ALL SELECT 'augmented', count(*), sum(n * CAST(target IS NOT NULL AS INT)) / sum(n), avg(CAST(target IS NOT NULL AS INT)) FROM augmented_bridge""")
def _(spark, sf):
    plain = bridge.bridge_coverage(_plain(spark, sf)).withColumn("kind", F.lit("plain"))
    return plain.unionByName(bridge.bridge_coverage(_augmented(spark, sf)).withColumn("kind", F.lit("augmented")))


cte("frozen", "augmented_bridge", """
  SELECT token, metadata_hemi, n, coalesce(target, 'UNK') AS frozen_token,
    CASE WHEN target IS NULL THEN 'unseen_or_ambiguous_to_UNK' ELSE 'unique_hemi_stem_match' END AS bridge_status FROM augmented_bridge""")


@query("freeze_bridge", "token metadata_hemi n:i frozen_token bridge_status", "frozen", "FROM frozen")
def _(spark, sf):
    return bridge.freeze_bridge(_augmented(spark, sf))


cte("frozen_rows", "part_labels frozen", """
  SELECT p.subject, p.contact, p.roi_text, CASE WHEN hemi_text = 'left' THEN 'L' ELSE 'R' END AS metadata_hemi,
    coalesce(frozen_token, 'UNK') AS frozen_token, coalesce(bridge_status, 'unseen_or_ambiguous_to_UNK') AS bridge_status
  FROM part_labels p LEFT JOIN frozen f ON p.roi_text = f.token AND CASE WHEN hemi_text = 'left' THEN 'L' ELSE 'R' END = f.metadata_hemi""")


def _frozen_rows(spark, sf):
    frozen = bridge.freeze_bridge(_augmented(spark, sf)).select(
        F.col("token").alias("roi_text"), "metadata_hemi", "frozen_token", "bridge_status"
    )
    rows = part_labels(spark, sf).withColumn("metadata_hemi", text.hemi_from_meta(F.col("hemi_text")))
    return (
        rows.join(frozen, ["roi_text", "metadata_hemi"], "left")
        .withColumn("frozen_token", F.coalesce("frozen_token", F.lit(bridge.UNKNOWN)))
        .withColumn("bridge_status", F.coalesce("bridge_status", F.lit("unseen_or_ambiguous_to_UNK")))
    )


@query("crosswalk", "roi_text metadata_hemi frozen_token bridge_status n_electrodes:i n_subjects:i", "frozen_rows", """
  SELECT roi_text, metadata_hemi, frozen_token, bridge_status, count(*) AS n_electrodes, count(DISTINCT subject) AS n_subjects
  FROM frozen_rows GROUP BY ALL""")
def _(spark, sf):
    return bridge.crosswalk(_frozen_rows(spark, sf))


@query("coverage_by_subject", "subject n:i known:i share:d", "frozen_rows", """
  SELECT subject, count(*) AS n, count(*) FILTER (WHERE frozen_token <> 'UNK') AS known, avg(CAST(frozen_token <> 'UNK' AS INT)) AS share
  FROM frozen_rows GROUP BY subject""")
def _(spark, sf):
    return bridge.coverage_by(_frozen_rows(spark, sf), F.col("frozen_token") != bridge.UNKNOWN, ["subject"])


cte("contact_sets", "trials site_points", """
  SELECT DISTINCT subject, recording_channel AS contact, 'recording' AS contact_set FROM trials
  UNION SELECT subject, contact_a, 'stimulation' FROM site_points UNION SELECT subject, contact_b, 'stimulation' FROM site_points
  UNION SELECT subject, recording_channel, 'union' FROM trials UNION SELECT subject, contact_a, 'union' FROM site_points
  UNION SELECT subject, contact_b, 'union' FROM site_points""")
cte("operational", "contact_sets contact_bridge", """
  SELECT s.subject, contact_set, count(*) AS n_contacts, count(b.contact) AS n_found,
    count(*) FILTER (WHERE roi_text <> 'n/a') AS n_labelled, count(*) FILTER (WHERE frozen_token <> 'UNK') AS n_known
  FROM contact_sets s LEFT JOIN contact_bridge b ON s.subject = b.subject AND s.contact = b.contact GROUP BY 1, 2""")


def _operational(spark, sf):
    recording = trial_table(spark, sf).select("subject", F.col("recording_channel").alias("contact"))
    return bridge.operational_coverage(recording, site_points(spark, sf), contact_bridge(spark, sf))


@query("operational_coverage", "subject contact_set n_contacts:i n_found:i n_labelled:i n_known:i", "operational", "FROM operational")
def _(spark, sf):
    return _operational(spark, sf)


cte("labelled_pairs", "site_pairs contact_bridge", """
  SELECT p.subject, coalesce(a.frozen_token <> 'UNK', FALSE) AND coalesce(b.frozen_token <> 'UNK', FALSE) AS stim_known,
    coalesce(a.frozen_token <> 'UNK', FALSE) AND coalesce(b.frozen_token <> 'UNK', FALSE) AND coalesce(r.frozen_token <> 'UNK', FALSE) AS all_known
  FROM site_pairs p
  LEFT JOIN contact_bridge a ON p.subject = a.subject AND p.contact_a = a.contact
  LEFT JOIN contact_bridge b ON p.subject = b.subject AND p.contact_b = b.contact
  LEFT JOIN contact_bridge r ON p.subject = r.subject AND p.recording_channel = r.contact""")
cte("pair_coverage", "labelled_pairs", """
  SELECT subject, count(*) AS n_pairs, count(*) FILTER (WHERE stim_known) AS n_stim_known, count(*) FILTER (WHERE all_known) AS n_all_known
  FROM labelled_pairs GROUP BY subject""")


def _pair_coverage(spark, sf):
    return bridge.pair_coverage(bridge.pair_labels(site_pairs(spark, sf), contact_bridge(spark, sf)), ["subject"])


@query("pair_coverage", "subject n_pairs:i n_stim_known:i n_all_known:i", "pair_coverage", "FROM pair_coverage")
def _(spark, sf):
    return _pair_coverage(spark, sf)


@query("coverage_summary", "n_subjects:i recording_share:d stimulation_share:d pair_share:d", "operational pair_coverage", """
  SELECT (SELECT count(DISTINCT subject) FROM operational) AS n_subjects,
    (SELECT sum(n_known) / sum(n_contacts) FROM operational WHERE contact_set = 'recording') AS recording_share,
    (SELECT sum(n_known) / sum(n_contacts) FROM operational WHERE contact_set = 'stimulation') AS stimulation_share,
    (SELECT sum(n_all_known) / sum(n_pairs) FROM pair_coverage) AS pair_share""")
def _(spark, sf):
    return bridge.coverage_summary(_operational(spark, sf), _pair_coverage(spark, sf))
