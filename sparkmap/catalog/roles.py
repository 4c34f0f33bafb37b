"""The given tables in the roles of the study's tables, in Spark and in SQL.

trials     lineitem x orders x customer x part: subject = nation, site = brand,
           channel = line number, event = order line, run = ship month,
           protocol = order priority
signals    embeddings: 64 samples per row; coordinates are its first elements
pulses     events: `error` rows are pulses, all others samples of the same user
labels     part: product names, decorated as anatomical labels
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkmap.catalog.registry import cte
from sparkmap.functions.text import canonical_pair
from sparkmap.operators.geometry import site_geometry
from sparkmap.operators.response import trials_to_map
from sparkmap.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


_STAGES: dict[tuple, DataFrame] = {}


def stage(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """An intermediate that many queries read: written once per session, then read back."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGES:
        _STAGES[key] = materialize(build(), name)
    return _STAGES[key]


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(
        spark, sf_dir, "lineitem",
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate",
    )
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand")
    # orders meet their customers first, so that the order lines move once an order and once a part
    placed = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "o_orderpriority", "c_nationkey")
    joined = li.join(placed, li.l_orderkey == placed.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    n = F.regexp_extract("p_brand", r"#(\d+)", 1).cast("int")
    return joined.select(
        F.concat(F.lit("sub-"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("subject"),
        F.col("p_brand").alias("stim_site"),
        F.concat(F.lit("ch"), F.col("l_linenumber").cast("string")).alias("recording_channel"),
        F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("event_uid"),
        F.date_format("l_shipdate", "yyyy-MM").alias("run_base"),
        F.col("o_orderpriority").alias("protocol"),
        (F.lit(10) + (17 * n + 23 * F.col("l_linenumber")) % 90).cast("double").alias("distance_to_stim"),
        F.col("l_quantity").alias("early_rms_z"),
        (F.col("l_extendedprice") / 1000).alias("late_rms_z"),
        F.col("l_quantity").alias("qty"),
        F.col("l_discount").alias("disc"),
        F.col("l_tax").alias("tax"),
        n.alias("site_no"),
        F.col("l_linenumber").alias("channel_no"),
    )


cte("trials", "", """
  SELECT 'sub-' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS subject, p_brand AS stim_site,
    'ch' || l_linenumber AS recording_channel, l_orderkey || ':' || l_linenumber AS event_uid,
    strftime(l_shipdate, '%Y-%m') AS run_base, o_orderpriority AS protocol,
    CAST(10 + (17 * CAST(regexp_extract(p_brand, '#([0-9]+)', 1) AS INT) + 23 * l_linenumber) % 90 AS DOUBLE) AS distance_to_stim,
    l_quantity AS early_rms_z, l_extendedprice / 1000 AS late_rms_z,
    l_quantity AS qty, l_discount AS disc, l_tax AS tax,
    CAST(regexp_extract(p_brand, '#([0-9]+)', 1) AS INT) AS site_no, l_linenumber AS channel_no
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey""")


def trial_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trials written once, for jobs that scan them several times: one three-way join instead of many."""
    return stage(spark, sf_dir, "trials", lambda: trials(spark, sf_dir))


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "map", lambda: trials_to_map(trial_table(spark, sf_dir)))


cte("map", "trials", """
  SELECT subject, stim_site, recording_channel, count(DISTINCT event_uid) AS n_trials,
    count(DISTINCT run_base) AS n_runs, median(distance_to_stim) AS distance_to_stim,
    median(early_rms_z) AS early_rms_z, median(late_rms_z) AS late_rms_z,
    quantile_cont(early_rms_z, 0.75) - quantile_cont(early_rms_z, 0.25) AS early_rms_iqr,
    quantile_cont(late_rms_z, 0.75) - quantile_cont(late_rms_z, 0.25) AS late_rms_iqr
  FROM trials GROUP BY subject, stim_site, recording_channel""")


def _centroid(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.round(F.avg("qty") * 10, 6).alias("x"),
        F.round(F.avg("disc") * 10000, 6).alias("y"),
        F.round(F.avg("tax") * 10000, 6).alias("z"),
    )


def channel_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, recording_channel, x, y, z: averages over the channel's trials."""
    return _centroid(trial_table(spark, sf_dir), "subject", "recording_channel")


def site_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, stim_site, its two contacts and their geometry."""
    c = _centroid(trial_table(spark, sf_dir), "subject", "stim_site", "site_no")
    n = F.col("site_no")
    ends = c.select(
        "subject", "stim_site",
        F.concat(F.lit("ch"), (1 + n % 7).cast("string")).alias("contact_a"),
        F.concat(F.lit("B"), n.cast("string")).alias("contact_b"),
        *[F.col(a).alias(f"a_{a}") for a in "xyz"],
        (F.col("x") + n % 5).alias("b_x"), (F.col("y") + 2).alias("b_y"), (F.col("z") - n % 3).alias("b_z"),
    )
    return site_geometry(ends)


cte("channel_points", "trials", """
  SELECT subject, recording_channel, round(avg(qty) * 10, 6) AS x, round(avg(disc) * 10000, 6) AS y,
    round(avg(tax) * 10000, 6) AS z FROM trials GROUP BY subject, recording_channel""")
cte("site_ends", "trials", """
  SELECT subject, stim_site, 'ch' || (1 + site_no % 7) AS contact_a, 'B' || site_no AS contact_b,
    round(avg(qty) * 10, 6) AS a_x, round(avg(disc) * 10000, 6) AS a_y, round(avg(tax) * 10000, 6) AS a_z,
    round(avg(qty) * 10, 6) + site_no % 5 AS b_x, round(avg(disc) * 10000, 6) + 2 AS b_y,
    round(avg(tax) * 10000, 6) - site_no % 3 AS b_z
  FROM trials GROUP BY subject, stim_site, site_no""")
cte("site_len", "site_ends", """
  SELECT *, (a_x + b_x) / 2 AS mid_x, (a_y + b_y) / 2 AS mid_y, (a_z + b_z) / 2 AS mid_z,
    sqrt((b_x - a_x) * (b_x - a_x) + (b_y - a_y) * (b_y - a_y) + (b_z - a_z) * (b_z - a_z)) AS pair_length
  FROM site_ends""")
cte("site_points", "site_len", """
  SELECT *, (b_x - a_x) / pair_length AS axis_x, (b_y - a_y) / pair_length AS axis_y, (b_z - a_z) / pair_length AS axis_z,
    ((b_x - a_x) / pair_length) * ((b_x - a_x) / pair_length) AS axis_xx,
    ((b_y - a_y) / pair_length) * ((b_y - a_y) / pair_length) AS axis_yy,
    ((b_z - a_z) / pair_length) * ((b_z - a_z) / pair_length) AS axis_zz,
    ((b_x - a_x) / pair_length) * ((b_y - a_y) / pair_length) AS axis_xy,
    ((b_x - a_x) / pair_length) * ((b_z - a_z) / pair_length) AS axis_xz,
    ((b_y - a_y) / pair_length) * ((b_z - a_z) / pair_length) AS axis_yz
  FROM site_len""")


def contact_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding rows as contacts: subject = label, coordinates in mm, some missing."""
    e = table(spark, sf_dir, "embeddings")
    mm = [(F.get("embedding", F.lit(i)).cast("double") * 100).alias(a) for i, a in enumerate("xyz")]
    return e.select(
        F.concat(F.lit("sub-"), F.lpad(F.col("label").cast("string"), 2, "0")).alias("subject"),
        F.concat(F.lit("E"), F.col("vec_id").cast("string")).alias("name"), "vec_id", *mm,
        F.when(F.col("vec_id") % 3 == 0, "L").when(F.col("vec_id") % 3 == 1, "R").alias("hemi"),
    )


cte("contact_points", "", """
  SELECT 'sub-' || lpad(CAST(label AS VARCHAR), 2, '0') AS subject, 'E' || vec_id AS name, vec_id,
    CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y, CAST(embedding[3] AS DOUBLE) * 100 AS z,
    CASE WHEN vec_id % 3 = 0 THEN 'L' WHEN vec_id % 3 = 1 THEN 'R' END AS hemi
  FROM embeddings""")


def contact_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact vec_id with contact vec_id + 1 as a_x..b_z."""
    c = contact_points(spark, sf_dir)
    a = c.select("subject", "vec_id", F.col("name").alias("contact_a"), *[F.col(x).alias(f"a_{x}") for x in "xyz"])
    b = c.select((F.col("vec_id") - 1).alias("vec_id"), F.col("name").alias("contact_b"), *[F.col(x).alias(f"b_{x}") for x in "xyz"])
    return a.join(b, "vec_id")


cte("contact_pairs", "contact_points", """
  SELECT a.subject, a.vec_id, a.name AS contact_a, b.name AS contact_b, a.x AS a_x, a.y AS a_y, a.z AS a_z,
    b.x AS b_x, b.y AS b_y, b.z AS b_z
  FROM contact_points a JOIN contact_points b ON b.vec_id = a.vec_id + 1""")


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding rows as epochs: 24 baseline, 12 early and 24 late samples."""
    e = table(spark, sf_dir, "embeddings")
    d = F.col("embedding").cast("array<double>")
    return e.select(
        "vec_id", "label", F.slice(d, 1, 24).alias("baseline"), F.slice(d, 29, 12).alias("early"),
        F.slice(d, 41, 24).alias("late"),
    )


cte("samples", "", """
  SELECT vec_id, label, unnest(range(1, 65)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings""")
cte("robust1", "samples", """
  SELECT vec_id, median(v) AS center, stddev_pop(v) AS sd FROM samples WHERE i <= 24 GROUP BY vec_id""")
cte("robust", "samples robust1", """
  SELECT s.vec_id, center, CASE WHEN 1.4826 * median(abs(v - center)) >= 1e-6 THEN 1.4826 * median(abs(v - center))
    WHEN sd >= 1e-6 THEN sd ELSE 1.0 END AS scale
  FROM samples s JOIN robust1 r ON s.vec_id = r.vec_id WHERE i <= 24 GROUP BY s.vec_id, center, sd""")
cte("zsamples", "samples robust", """
  SELECT s.vec_id, label, i, (v - center) / scale AS z, CASE WHEN i BETWEEN 29 AND 40 THEN 'early' WHEN i >= 41 THEN 'late' END AS win
  FROM samples s JOIN robust r ON s.vec_id = r.vec_id""")


def pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events with a window from six hours before to a day after, in seconds."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type").where("event_type = 'error'")
    s = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return e.select("user_id", "event_id", (s - 6 * 3600).alias("lo"), s.alias("mid"), (s + 24 * 3600).alias("hi"))


def pulse_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "ts", "user_id", "event_type", "value").where("event_type <> 'error'")
    return e.select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("sample_idx"), "value")


cte("pulses", "", """
  SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) - 6 * 3600 AS lo, CAST(floor(epoch(ts)) AS BIGINT) AS mid,
    CAST(floor(epoch(ts)) AS BIGINT) + 24 * 3600 AS hi
  FROM events WHERE event_type = 'error'""")
cte("pulse_samples", "", """
  SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS sample_idx, value FROM events WHERE event_type <> 'error'""")


def part_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as electrodes with decorated label texts and a metadata hemisphere."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    snake = F.replace("p_name", F.lit(" "), F.lit("_"))
    m = F.col("p_size") % 5
    text = (
        F.when(m == 0, F.concat(F.lit("lh_"), snake))
        .when(m == 1, F.concat(F.lit("ctx-rh-"), snake))
        .when(m == 2, snake)
        .when(m == 3, F.concat(F.lit("Left "), F.col("p_name")))
        .otherwise("unknown")
    )
    return p.select(
        F.col("p_brand").alias("subject"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("contact"),
        text.alias("roi_text"), F.when(F.col("p_size") % 2 == 0, "left").otherwise("Right").alias("hemi_text"),
        F.col("p_type").alias("roi_numeric"),
    )


def target_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary to map onto: both hemispheres of most names, some spelled twice."""
    names = table(spark, sf_dir, "part", "p_name").distinct()
    snake = F.replace("p_name", F.lit(" "), F.lit("_"))
    plain = names.where(F.length("p_name") % 4 != 0)
    return (
        plain.select(F.explode(F.array(F.concat(F.lit("lh_"), snake), F.concat(F.lit("rh_"), snake))).alias("token"))
        .union(names.where(F.length("p_name") % 5 == 0).select(F.concat(F.lit("Left-"), snake).alias("token")))
        .union(names.where(F.length("p_name") % 3 == 0).select(F.concat(F.lit("ctx-rh-"), snake).alias("token")))
        .distinct()
    )


cte("part_labels", "", """
  SELECT p_brand AS subject, 'P' || p_partkey AS contact,
    CASE p_size % 5 WHEN 0 THEN 'lh_' || replace(p_name, ' ', '_') WHEN 1 THEN 'ctx-rh-' || replace(p_name, ' ', '_')
      WHEN 2 THEN replace(p_name, ' ', '_') WHEN 3 THEN 'Left ' || p_name ELSE 'unknown' END AS roi_text,
    CASE WHEN p_size % 2 = 0 THEN 'left' ELSE 'Right' END AS hemi_text, p_type AS roi_numeric
  FROM part""")
cte("target_vocab", "", """
  SELECT 'lh_' || replace(p_name, ' ', '_') AS token FROM part WHERE length(p_name) % 4 <> 0
  UNION SELECT 'rh_' || replace(p_name, ' ', '_') FROM part WHERE length(p_name) % 4 <> 0
  UNION SELECT 'Left-' || replace(p_name, ' ', '_') FROM part WHERE length(p_name) % 5 = 0
  UNION SELECT 'ctx-rh-' || replace(p_name, ' ', '_') FROM part WHERE length(p_name) % 3 = 0""")


def contact_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, contact, roi_text, frozen_token of the trials' contacts; some have neither text nor token."""
    t = trial_table(spark, sf_dir)
    contacts = (
        t.select("subject", F.col("recording_channel").alias("contact"), F.col("channel_no").alias("no"))
        .union(t.select("subject", F.concat(F.lit("B"), F.col("site_no").cast("string")), "site_no"))
        .distinct()
    )
    s = F.substring("subject", 5, 2).cast("int")
    listed = (s + F.col("no")) % 7 != 0
    roi = F.concat(F.lit("roi"), (F.col("no") % 4).cast("string"))
    return contacts.select(
        "subject", "contact",
        F.when(listed, F.when(F.col("no") % 5 == 0, "n/a").otherwise(roi)).alias("roi_text"),
        F.when(listed, F.when(F.col("no") % 3 == 0, "UNK").otherwise(roi)).alias("frozen_token"),
    )


cte("contact_bridge", "trials", """
  SELECT subject, contact, CASE WHEN (CAST(substr(subject, 5, 2) AS INT) + no) % 7 = 0 THEN NULL WHEN no % 5 = 0 THEN 'n/a' ELSE 'roi' || (no % 4) END AS roi_text,
    CASE WHEN (CAST(substr(subject, 5, 2) AS INT) + no) % 7 = 0 THEN NULL WHEN no % 3 = 0 THEN 'UNK' ELSE 'roi' || (no % 4) END AS frozen_token
  FROM (SELECT DISTINCT subject, recording_channel AS contact, channel_no AS no FROM trials
        UNION SELECT DISTINCT subject, 'B' || site_no, site_no FROM trials)""")


def pair_label(site):
    """Unordered label pair of a site of the trials role."""
    n = F.regexp_extract(site, r"#(\d+)", 1).cast("int")
    return canonical_pair(F.concat(F.lit("T"), (n % 3).cast("string")), F.concat(F.lit("U"), (n % 2).cast("string")))
