"""Metadata profiling, eligibility, gates, files and incremental ingest."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkmap.catalog.q_clean import parsed_pairs
from sparkmap.catalog.q_geometry import site_pairs
from sparkmap.catalog.registry import cte, query
from sparkmap.catalog.roles import contact_points, maps, pulse_samples, pulses, stage, table, trial_table, trials
from sparkmap.functions import signal
from sparkmap.operators import eligibility, quality, response
from sparkmap.session import shared_folder
from sparkmap.sources import files, tables
from sparkmap.streaming import runs


@query("restrict_if_present", "l_orderkey n:i qty:d", "", """
  SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS qty FROM (
    SELECT *, max(CAST(l_returnflag = 'R' AS INT)) OVER (PARTITION BY l_orderkey) AS has FROM lineitem)
  WHERE has = 0 OR l_returnflag = 'R' GROUP BY l_orderkey""")
def _(spark, sf):
    li = table(spark, sf, "lineitem", "l_orderkey", "l_returnflag", "l_quantity")
    kept = eligibility.restrict_if_present(li, ["l_orderkey"], F.col("l_returnflag") == "R")
    return kept.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


cte("site_counts", "trials", "SELECT subject, stim_site, count(*) AS n_pulses FROM trials GROUP BY ALL")


@query("site_counts", "subject stim_site n_pulses:i", "site_counts", "FROM site_counts")
def _(spark, sf):
    return eligibility.site_counts(trials(spark, sf))


@query("sites_over_thresholds", "subject n_sites:i n_sites_ge5:i n_sites_ge100:i", "site_counts", """
  SELECT subject, count(*) AS n_sites, count(*) FILTER (WHERE n_pulses >= 5) AS n_sites_ge5,
    count(*) FILTER (WHERE n_pulses >= 100) AS n_sites_ge100 FROM site_counts GROUP BY subject""")
def _(spark, sf):
    return eligibility.sites_over(eligibility.site_counts(trials(spark, sf)), (5, 100))


cte("dominant", "trials", """
  SELECT subject, protocol, n FROM (
    SELECT *, row_number() OVER (PARTITION BY subject ORDER BY n DESC, protocol) AS rn
    FROM (SELECT subject, protocol, count(*) AS n FROM trials GROUP BY ALL)) WHERE rn = 1""")


@query("dominant_value", "subject protocol n:i", "dominant", "FROM dominant")
def _(spark, sf):
    return eligibility.dominant_value(trials(spark, sf), ["subject"], "protocol")


@query("first_per_key", "o_custkey o_orderkey o_totalprice", "", """
  SELECT o_custkey, o_orderkey, o_totalprice FROM (
    SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def _(spark, sf):
    o = table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return quality.first_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("last_per_key", "o_custkey o_orderkey", "", """
  SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey""")
def _(spark, sf):
    o = table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderdate")
    return quality.first_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], last=True)


def _channels(spark, sf):
    """Contacts as channels with a status and a type, both missing at times."""
    v = F.col("vec_id")
    once = contact_points(spark, sf).select(
        "subject", "name", "vec_id",
        F.when(v % 7 == 0, " bad\t").when(v % 7 == 1, "Good").when(v % 7 == 2, F.lit(None)).when(v % 7 == 3, "noisy").otherwise("good").alias("status"),
        F.when(v % 4 == 0, "ecog").when(v % 4 == 1, " SEEG").when(v % 4 == 2, F.lit(None)).otherwise("EKG").alias("type"),
        F.lit(0).alias("row_order"),
    )
    # every third channel occurs in a second run file with other values; the first row counts
    again = once.where(v % 3 == 0).withColumns({"status": F.lit("good"), "type": F.lit("SEEG"), "row_order": F.lit(1)})
    return once.union(again)


def _electrodes(spark, sf):
    c = contact_points(spark, sf)
    return c.withColumn("x", F.when(F.col("vec_id") % 5 != 0, F.col("x")))


cte("channels", "contact_points", """
  SELECT subject, name, vec_id, CASE vec_id % 7 WHEN 0 THEN 'bad' WHEN 1 THEN 'Good' WHEN 2 THEN NULL WHEN 3 THEN 'noisy' ELSE 'good' END AS status,
    CASE vec_id % 4 WHEN 0 THEN 'ecog' WHEN 1 THEN ' SEEG' WHEN 2 THEN NULL ELSE 'EKG' END AS type FROM contact_points""")
cte("electrodes", "contact_points", """
  SELECT subject, name, vec_id, CASE WHEN vec_id % 5 <> 0 THEN x END AS x, y, z FROM contact_points""")


@query("channel_inventory", "subject name status type", "channels electrodes", """
  SELECT subject, name, lower(coalesce(status, 'good')) AS status, upper(trim(type)) AS type FROM channels
  WHERE lower(coalesce(status, 'good')) <> 'bad' AND upper(trim(type)) IN ('ECOG', 'SEEG')
    AND name IN (SELECT name FROM electrodes WHERE x IS NOT NULL)""")
def _(spark, sf):
    return eligibility.channel_inventory(_channels(spark, sf), _electrodes(spark, sf), ["subject", "name"])


cte("channel_profile", "channels", """
  SELECT subject, CAST(sum(n) AS BIGINT) AS n_channels, CAST(sum(n_good) AS BIGINT) AS n_good,
    '{' || string_agg('"' || type || '":' || n, ',' ORDER BY type) || '}' AS type_counts
  FROM (SELECT subject, coalesce(type, 'UNKNOWN') AS type, count(*) AS n,
      count(*) FILTER (WHERE lower(coalesce(status, 'good')) <> 'bad') AS n_good FROM channels GROUP BY 1, 2) GROUP BY subject""")


def _channel_profile(spark, sf):
    return eligibility.channel_profile(_channels(spark, sf).withColumn("type", F.coalesce("type", F.lit("UNKNOWN"))), ["subject"])


@query("channel_profile", "subject n_channels:i n_good:i type_counts", "channel_profile", "FROM channel_profile")
def _(spark, sf):
    return _channel_profile(spark, sf)


cte("coordinate_coverage", "channels electrodes", """
  SELECT * FROM (SELECT subject, count(*) AS n_electrodes, count(x) AS n_with_xyz FROM electrodes GROUP BY subject)
  JOIN (SELECT c.subject, avg(CAST(e.x IS NOT NULL AS INT)) AS good_located_share FROM channels c
    JOIN electrodes e ON c.name = e.name WHERE lower(coalesce(status, 'good')) <> 'bad' GROUP BY c.subject) USING (subject)""")


@query("coordinate_coverage", "subject n_electrodes:i n_with_xyz:i good_located_share:d", "coordinate_coverage", "FROM coordinate_coverage")
def _(spark, sf):
    return eligibility.coordinate_coverage(_electrodes(spark, sf), _channels(spark, sf), ["subject", "name"], "subject")


@query("run_inventory", "run_base n_rows:i n_stim_rows:i n_sites:i has_site_column", "trials", """
  SELECT run_base, count(*) AS n_rows, count(*) FILTER (WHERE protocol < '3') AS n_stim_rows,
    CASE WHEN run_base < '1997' THEN count(DISTINCT stim_site) FILTER (WHERE protocol < '3') ELSE 0 END AS n_sites, run_base < '1997' AS has_site_column
  FROM trials GROUP BY run_base""")
def _(spark, sf):
    """Runs from 1997 on come from files without the site column."""
    t = trials(spark, sf)
    files = t.where("run_base < '1997'").unionByName(t.where("run_base >= '1997'").drop("stim_site"), allowMissingColumns=True)
    return eligibility.run_inventory(files, "run_base", F.col("protocol") < "3", "stim_site")


cte("numeric_profile", "trials", """
  SELECT subject, median(qty) AS qty_median, min(qty) AS qty_min, max(qty) AS qty_max,
    median(disc) AS disc_median, min(disc) AS disc_min, max(disc) AS disc_max FROM trials GROUP BY subject""")
_PROFILE = "qty_median:d qty_min:d qty_max:d disc_median:d disc_min:d disc_max:d"


@query("numeric_profile", f"subject {_PROFILE}", "numeric_profile", "FROM numeric_profile")
def _(spark, sf):
    return eligibility.numeric_profile(trial_table(spark, sf), ["subject"], ["qty", "disc"])


@query("declared_values", "source n_files:i langs long_share:d exact_share:d", "", """
  SELECT source, count(*) AS n_files, string_agg(DISTINCT lang, '|' ORDER BY lang) AS langs,
    avg(CAST(n_chars > 1000 AS INT)) AS long_share, avg(CAST(length(text) = n_chars AS INT)) AS exact_share
  FROM documents GROUP BY source""")
def _(spark, sf):
    d = table(spark, sf, "documents", "source", "lang", "n_chars", "text")
    return eligibility.declared_values(
        d, ["source"], {"langs": "lang"},
        {"long_share": F.col("n_chars") > 1000, "exact_share": F.length("text") == F.col("n_chars")},
    )


# electrode files in three layouts by subject, some places missing or no numbers
cte("electrode_rows", "contact_points", """
  SELECT subject, name, vec_id, CAST(substr(subject, 5) AS INT) % 3 AS layout, vec_id % 6 <> 0 AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AS located FROM contact_points""")


def _electrode_files(spark, sf):
    """Written once: one folder a subject, headers that differ by layout."""
    path = f"{shared_folder(spark)}/interface-{uuid.uuid4().hex}"
    c = contact_points(spark, sf)
    layout = F.substring("subject", 5, 9).cast("int") % 3
    z = F.when(F.col("vec_id") % 6 != 0, F.col("z").cast("string")).otherwise("n/a")
    c = c.withColumns({"folder": F.col("subject"), "layout": layout, "z": z})
    variants = (["name", "x", "y", "z"], ["NAME", "X", "Y", "Z", "MNI_X", "MNI_Y", "MNI_Z"], ["name", "Destrieux_label", "z", "y", "x", "ROI"])
    extra = {"MNI_X": F.col("x"), "MNI_Y": F.col("y"), "MNI_Z": F.col("z"), "Destrieux_label": F.lit("G_front"), "ROI": F.lit(None).cast("string")}
    for i, header in enumerate(variants):
        cols = [extra[h].alias(h) if h in extra else F.col(h.lower()).alias(h) for h in header]
        c.where(F.col("layout") == i).select("folder", *cols).write.partitionBy("folder").csv(f"{path}/layout{i}", sep="\t", header=True)
    return [f"{path}/layout{i}/*" for i in range(3)]


def electrode_cells(spark, sf):
    def build():
        cells = tables.read_cells(spark, _electrode_files(spark, sf), ["sub"])
        return cells.withColumn("subject", F.concat(F.lit("sub-"), "sub")).drop("sub")

    return stage(spark, sf, "electrode_cells", build)


@query("column_evidence", "subject column_name n_rows:i n_present:i numeric_share:d", "contact_points", """
  SELECT subject, column_name, count(*) AS n_rows, count(*) FILTER (WHERE present) AS n_present, avg(CAST(number AS INT)) FILTER (WHERE present) AS numeric_share FROM (
    SELECT subject, lower(h) AS column_name, CASE WHEN h IN ('z', 'mni_z') THEN vec_id % 6 <> 0 ELSE h <> 'roi' END AS present, h NOT IN ('name', 'destrieux_label') AS number
    FROM contact_points, (SELECT unnest(['name', 'x', 'y', 'z', 'mni_x', 'mni_y', 'mni_z', 'destrieux_label', 'roi']) AS h)
    WHERE h IN ('name', 'x', 'y', 'z') OR (CAST(substr(subject, 5) AS INT) % 3 = 1 AND starts_with(h, 'mni')) OR (CAST(substr(subject, 5) AS INT) % 3 = 2 AND h IN ('destrieux_label', 'roi'))) GROUP BY ALL""")
def _(spark, sf):
    e = tables.column_evidence(electrode_cells(spark, sf))
    subject = F.concat(F.lit("sub-"), F.regexp_extract("file", "folder=sub-([0-9]+)", 1))
    present = F.coalesce(F.col("numeric_share") * F.col("n_present"), F.lit(0.0))
    return e.groupBy(subject.alias("subject"), "column_name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_present").alias("n_present"), F.try_divide(F.sum(present), F.sum("n_present")).alias("numeric_share")
    )


cte("site_labels", "pair_texts pair_one pair_two pair_three", """
  SELECT subject, count(*) AS n_sites, count(contact_a) AS n_parsed FROM (
    SELECT t.subject, t.label, p.contact_a FROM (SELECT DISTINCT subject, label FROM pair_texts) t
    LEFT JOIN (FROM pair_one UNION ALL FROM pair_two UNION ALL FROM pair_three) p ON t.subject = p.subject AND t.label = p.label) GROUP BY subject""")


@query("interface_audit", "subject n_electrodes:i n_xyz:i coordinate_systems coordinate_units direct_mni_system explicit_mni_columns candidate_mni_triplets direct_mni_columns "
       "fsaverage_system unit_mm atlas_columns n_unique_stim_sites:i n_stim_sites_pair_parsed:i stim_pair_match_fraction:d sampling_frequencies power_line_frequencies reference_electrodes manufacturers",
       "electrode_rows site_labels", """
  SELECT subject, count(*) AS n_electrodes, count(*) FILTER (WHERE located) AS n_xyz, CASE layout WHEN 0 THEN 'MNI152NLin6Asym' WHEN 1 THEN 'Other|fsaverage' ELSE 'UNKNOWN' END AS coordinate_systems,
    CASE layout WHEN 0 THEN 'mm' WHEN 1 THEN 'm|mm' ELSE 'UNKNOWN' END AS coordinate_units, layout = 0 AS direct_mni_system,
    CASE WHEN layout = 1 THEN 'MNI_X|MNI_Y|MNI_Z' ELSE '' END AS explicit_mni_columns, CASE WHEN layout = 1 THEN 'MNI_X|MNI_Y|MNI_Z' ELSE '' END AS candidate_mni_triplets,
    layout = 1 AS direct_mni_columns, layout = 1 AS fsaverage_system, layout <> 1 AS unit_mm, CASE WHEN layout = 2 THEN 'Destrieux_label|ROI' ELSE '' END AS atlas_columns,
    max(n_sites) AS n_unique_stim_sites, max(n_parsed) AS n_stim_sites_pair_parsed, max(n_parsed) / max(n_sites) AS stim_pair_match_fraction,
    CASE WHEN layout = 0 THEN '1024|512' ELSE '2048' END AS sampling_frequencies, '50' AS power_line_frequencies, CASE WHEN layout = 2 THEN '' ELSE 'mastoid' END AS reference_electrodes, 'A|B' AS manufacturers
  FROM electrode_rows JOIN site_labels USING (subject) GROUP BY subject, layout""")
def _(spark, sf):
    """Three layouts of electrode files, with their coordinate documents and recordings."""
    subjects = contact_points(spark, sf).select("subject", (F.substring("subject", 5, 9).cast("int") % 3).alias("layout")).distinct()
    row = lambda *v: F.struct(*[F.lit(x).cast("string").alias(n) for n, x in zip(("system", "units"), v)])
    documents = F.when(F.col("layout") == 0, F.array(row("MNI152NLin6Asym", "mm"))).when(
        F.col("layout") == 1, F.array(row("fsaverage", "m"), row("Other", "mm"))).otherwise(F.array(row(None, None)))
    systems = subjects.select("subject", F.explode(documents).alias("d")).select("subject", "d.*")
    heard = subjects.withColumn("manufacturer", F.explode(F.array(F.lit("B"), F.lit("A")))).select(
        "subject", "manufacturer", F.when(F.col("layout") == 0, F.when(F.col("manufacturer") == "A", 512).otherwise(1024)).otherwise(2048).alias("sampling"),
        F.lit(50).alias("line"), F.when(F.col("layout") != 2, "mastoid").alias("reference"),
    )
    return eligibility.interface_audit(electrode_cells(spark, sf), systems, heard, parsed_pairs(spark, sf))


@query("schema_counts", "column_name n_files:i", "", """
  SELECT column_name, count(*) AS n_files FROM (
    SELECT unnest(string_split(p_name, ' ')) AS column_name FROM part) GROUP BY column_name""")
def _(spark, sf):
    p = table(spark, sf, "part", "p_name").select(F.split("p_name", " ").alias("cols"))
    return eligibility.schema_counts(p, "cols")


cte("site_eligibility", "trials dominant site_pairs", """
  SELECT subject, stim_site, n_pulses, coalesce(n_channels, 0) AS n_channels, n_pulses >= 5 AND coalesce(n_channels, 0) >= 5 AS site_usable
  FROM (SELECT subject, stim_site, count(*) AS n_pulses FROM trials JOIN dominant USING (subject, protocol) GROUP BY ALL)
  LEFT JOIN (SELECT subject, stim_site, count(DISTINCT recording_channel) AS n_channels FROM site_pairs GROUP BY ALL)
  USING (subject, stim_site)""")


def _sites(spark, sf):
    return eligibility.site_eligibility(trial_table(spark, sf), site_pairs(spark, sf), min_channels=5)


@query("site_eligibility", "subject stim_site n_pulses:i n_channels:i site_usable", "site_eligibility", "FROM site_eligibility")
def _(spark, sf):
    return _sites(spark, sf)


cte("subject_eligibility", "site_eligibility", """
  SELECT subject, count(*) AS n_sites, count(*) FILTER (WHERE site_usable) AS n_usable_sites,
    min(n_channels) FILTER (WHERE site_usable) AS min_channels, median(n_channels) FILTER (WHERE site_usable) AS median_channels,
    count(*) FILTER (WHERE site_usable) >= 11 AS eligible FROM site_eligibility GROUP BY subject""")


@query("subject_eligibility", "subject n_sites:i n_usable_sites:i min_channels:i median_channels:d eligible",
       "subject_eligibility", "FROM subject_eligibility")
def _(spark, sf):
    return eligibility.subject_eligibility(_sites(spark, sf))


@query("cohort", "subject", "subject_eligibility", "SELECT subject FROM subject_eligibility WHERE eligible ORDER BY subject")
def _(spark, sf):
    return eligibility.cohort(eligibility.subject_eligibility(_sites(spark, sf)))


cte("subject_inventory", "trials", """
  SELECT subject, count(*) AS n_rows, count(DISTINCT stim_site) AS n_sites, count(DISTINCT recording_channel) AS n_channels
  FROM trials GROUP BY subject""")


@query("subject_inventory", "subject n_rows:i n_sites:i n_channels:i", "subject_inventory", "FROM subject_inventory")
def _(spark, sf):
    return eligibility.subject_inventory(trials(spark, sf))


@query("subject_profile", f"subject n_rows:i n_sites:i n_channels:i {_PROFILE} protocol n_dominant:i n_electrodes:i n_with_xyz:i good_located_share:d",
       "subject_inventory numeric_profile dominant coordinate_coverage", """
  SELECT * FROM subject_inventory FULL JOIN numeric_profile USING (subject)
  FULL JOIN (SELECT subject, protocol, n AS n_dominant FROM dominant) USING (subject) FULL JOIN coordinate_coverage USING (subject)""")
def _(spark, sf):
    t = trial_table(spark, sf)
    return eligibility.subject_profile(
        [
            eligibility.subject_inventory(t),
            eligibility.numeric_profile(t, ["subject"], ["qty", "disc"]),
            eligibility.dominant_value(t, ["subject"], "protocol", "n_dominant"),
            eligibility.coordinate_coverage(_electrodes(spark, sf), _channels(spark, sf), ["subject", "name"], "subject"),
        ]
    )


@query("coordinate_inventory", "subject coordinate_systems n_electrodes:i n_with_xyz:i good_located_share:d",
       "coordinate_coverage contact_points", """
  SELECT * FROM (SELECT subject, string_agg(DISTINCT CASE WHEN vec_id % 11 = 0 THEN 'MNI305' ELSE 'MNI152' END, '|'
    ORDER BY CASE WHEN vec_id % 11 = 0 THEN 'MNI305' ELSE 'MNI152' END) AS coordinate_systems FROM contact_points GROUP BY subject)
  FULL JOIN coordinate_coverage USING (subject)""")
def _(spark, sf):
    declared = contact_points(spark, sf).select(
        "subject", F.when(F.col("vec_id") % 11 == 0, "MNI305").otherwise("MNI152").alias("system")
    )
    return eligibility.coordinate_inventory(
        declared, _electrodes(spark, sf), _channels(spark, sf), ["subject", "name"], "system", "subject"
    )


# ---- gates ----------------------------------------------------------------------------------------------


@query("expect_unique", "l_orderkey l_linenumber n:i", "", """
  SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def _(spark, sf):
    return quality.expect_unique(table(spark, sf, "lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("expect_one_value", "run_base lowest highest", "trials", """
  SELECT run_base, min(subject) AS lowest, max(subject) AS highest FROM trials GROUP BY run_base HAVING min(subject) <> max(subject)""")
def _(spark, sf):
    return quality.expect_one_value(trials(spark, sf), ["run_base"], "subject")


@query("expect_max", "max_error:d passed", "", """
  SELECT max(abs(l_tax - 0.04)) AS max_error, max(abs(l_tax - 0.04)) <= 0.05 AS passed FROM lineitem""")
def _(spark, sf):
    return quality.expect_max(table(spark, sf, "lineitem", "l_tax"), F.abs(F.col("l_tax") - 0.04), 0.05)


@query("expect_count", "n:i passed", "", """
  SELECT count(*) AS n, count(*) = (SELECT 10 * count(*) FROM customer) AS passed FROM orders""")
def _(spark, sf):
    """Ten orders to a customer."""
    ten_each = table(spark, sf, "customer", "c_custkey").agg((F.count(F.lit(1)) * 10).alias("n"))
    return quality.expect_count(table(spark, sf, "orders", "o_orderkey"), ten_each)


@query("expect_group_count", "l_orderkey n:i", "", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) <> 4")
def _(spark, sf):
    return quality.expect_group_count(table(spark, sf, "lineitem", "l_orderkey"), ["l_orderkey"], 4)


@query("same_keys", "key only_in", "", """
  SELECT o_custkey AS key, 'a' AS only_in FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1
  UNION ALL SELECT o_custkey, 'b' FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""")
def _(spark, sf):
    o = table(spark, sf, "orders", "o_custkey", "o_orderstatus").withColumnRenamed("o_custkey", "key")
    return quality.same_keys(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), ["key"])


@query("overlap_keys", "key", "", """
  SELECT o_custkey AS key FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def _(spark, sf):
    o = table(spark, sf, "orders", "o_custkey", "o_orderstatus").withColumnRenamed("o_custkey", "key")
    return quality.overlap_keys(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), ["key"])


@query("match_counts", "subject stim_site actual:i stored:i matches", "trials", """
  SELECT coalesce(a.subject, b.subject) AS subject, coalesce(a.stim_site, b.stim_site) AS stim_site, a.n AS actual, b.n AS stored,
    a.n IS NOT DISTINCT FROM b.n AS matches
  FROM (SELECT subject, stim_site, count(*) AS n FROM trials GROUP BY ALL) a
  FULL JOIN (SELECT subject, stim_site, count(DISTINCT event_uid) AS n FROM trials GROUP BY ALL) b
    ON a.subject = b.subject AND a.stim_site = b.stim_site""")
def _(spark, sf):
    t = trials(spark, sf).groupBy("subject", "stim_site")
    return quality.match_counts(
        t.agg(F.count(F.lit(1)).alias("n")), t.agg(F.count_distinct("event_uid").alias("n")), ["subject", "stim_site"]
    )


@query("check_deterministic", "p_name p_type n_values:i", "", """
  SELECT p_name, nullif(p_type, 'ECONOMY') AS p_type, count(DISTINCT nullif(p_brand, 'Brand#1'))
    + max(CAST(nullif(p_brand, 'Brand#1') IS NULL AS INT)) AS n_values FROM part GROUP BY 1, 2
  HAVING count(DISTINCT nullif(p_brand, 'Brand#1')) + max(CAST(nullif(p_brand, 'Brand#1') IS NULL AS INT)) > 1""")
def _(spark, sf):
    p = table(spark, sf, "part", "p_name", "p_type", "p_brand")
    p = p.withColumn("p_type", F.nullif("p_type", F.lit("ECONOMY"))).withColumn("p_brand", F.nullif("p_brand", F.lit("Brand#1")))
    return quality.check_deterministic(p, ["p_name", "p_type"], "p_brand")


@query("compare_tables", "c_custkey field", "", """
  WITH a AS (SELECT * REPLACE (CASE WHEN c_acctbal > -900 THEN c_custkey ELSE -c_custkey END AS c_custkey) FROM customer),
    b AS (SELECT CASE WHEN c_acctbal < 9500 THEN c_custkey ELSE -c_custkey END AS c_custkey, c_name, c_nationkey, CASE c_mktsegment WHEN 'BUILDING' THEN c_acctbal * (1 + 1e-9) WHEN 'MACHINERY'
      THEN c_acctbal * (1 + 1e-14) ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_mktsegment END AS c_mktsegment
      FROM customer)
  SELECT c_custkey, '(missing)' AS field FROM a WHERE c_custkey NOT IN (SELECT c_custkey FROM b)
  UNION ALL SELECT c_custkey, '(extra)' FROM b WHERE c_custkey NOT IN (SELECT c_custkey FROM a)
  UNION ALL SELECT a.c_custkey, 'c_acctbal' FROM a JOIN b USING (c_custkey)
    WHERE abs(a.c_acctbal - b.c_acctbal) > 1e-12 * greatest(abs(a.c_acctbal), abs(b.c_acctbal))
  UNION ALL SELECT a.c_custkey, 'c_mktsegment' FROM a JOIN b USING (c_custkey) WHERE a.c_mktsegment IS DISTINCT FROM b.c_mktsegment""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    seg, bal = F.col("c_mktsegment"), F.col("c_acctbal")
    # some keys differ on either side: they are missing here and extra there
    key = lambda same: F.when(same, F.col("c_custkey")).otherwise(-F.col("c_custkey"))
    b = c.withColumn("c_custkey", key(bal < 9500)).withColumn(
        "c_acctbal",
        F.when(seg == "BUILDING", bal * (1 + 1e-9)).when(seg == "MACHINERY", bal * (1 + 1e-14)).otherwise(bal),
    ).withColumn("c_mktsegment", F.when(F.col("c_nationkey") != 3, seg))
    return quality.compare_tables(c.withColumn("c_custkey", key(bal > -900)), b, ["c_custkey"])


_PRINTED = "l_linenumber l_linestatus l_orderkey l_partkey l_returnflag l_suppkey".split()


@query("table_fingerprint", "n_rows:i xor_hash:i sum_hash", "", f"""
  SELECT count(*) AS n_rows, bit_xor(h) AS xor_hash, CAST(sum(h) AS VARCHAR) AS sum_hash FROM (
    SELECT CAST('0x' || substr(md5(concat_ws('|', {", ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in _PRINTED)})), 1, 15) AS BIGINT) AS h
    FROM (SELECT {", ".join(f"CAST({'CASE WHEN l_linenumber <> 3 THEN l_returnflag END' if c == 'l_returnflag' else c} AS VARCHAR) AS {c}" for c in _PRINTED)} FROM lineitem))""")
def _(spark, sf):
    t = table(spark, sf, "lineitem", *_PRINTED)
    return quality.table_fingerprint(t.withColumn("l_returnflag", F.when(F.col("l_linenumber") != 3, F.col("l_returnflag"))))


# ---- files ----------------------------------------------------------------------------------------------

# The pages stand for files: the address is the path, the text is the content.


@query("file_inventory", "file_name path length:i sha256 git_blob", "", """
  SELECT string_split(url, '/')[-1] AS file_name, url AS path, octet_length(encode(html)) AS length, sha256(html) AS sha256,
    sha1(encode('blob ' || octet_length(encode(html))) || '\\x00'::BLOB || encode(html)) AS git_blob FROM pages""")
def _(spark, sf):
    p = table(spark, sf, "pages", F.col("url").alias("path"), F.col("html").cast("binary").alias("content"))
    return files.inventory(p)


@query("guard_sources", "path", "", """
  SELECT url AS path FROM pages WHERE NOT (ends_with(lower(url), '.eeg') OR ends_with(lower(url), '.vhdr') OR contains(lower(url), '/derivatives/'))""")
def _(spark, sf):
    """No page has a forbidden address, so all pass; that one which has stops the job is tested on fixtures."""
    return files.guard_sources(table(spark, sf, "pages", F.col("url").alias("path")), [".eeg", ".vhdr"], ["derivatives"])


@query("candidate_paths", "path file_name suffix is_derivative", "", r"""
  SELECT url AS path, lower(string_split(url, '/')[-1]) AS file_name,
    regexp_extract(lower(string_split(url, '/')[-1]), '(\.[a-z0-9]+(?:\.gz)?)$', 1) AS suffix, contains(lower(url), '/derivatives/') AS is_derivative
  FROM pages WHERE regexp_matches(lower(string_split(url, '/')[-1]), '1|7')""")
def _(spark, sf):
    return files.candidate_paths(table(spark, sf, "pages", F.col("url").alias("path")), ["1", "7"])


@query("manifest_diff", "path status", "", """
  SELECT coalesce(a.path, e.path) AS path, CASE WHEN a.path IS NULL THEN 'missing' WHEN e.path IS NULL THEN 'extra' ELSE 'changed' END AS status
  FROM (SELECT page_id || ' ' || url || CASE WHEN length(html) > 1000 THEN '' ELSE '~' END AS path, md5(html) AS h FROM pages) a
  FULL JOIN (SELECT page_id || ' ' || url || CASE WHEN length(html) < 8000 THEN '' ELSE '?' END AS path, md5(trim(html)) AS h FROM pages) e
    ON a.path = e.path WHERE a.h IS DISTINCT FROM e.h""")
def _(spark, sf):
    p = table(spark, sf, "pages", "page_id", "url", "html").withColumn("path", F.concat_ws(" ", F.col("page_id").cast("string"), "url"))
    path = lambda same, mark: F.concat("path", F.when(same, "").otherwise(mark))
    actual = p.withColumns({"path": path(F.length("html") > 1000, "~"), "sha256": F.md5("html")})
    stored = p.withColumns({"path": path(F.length("html") < 8000, "?"), "sha256": F.md5(F.trim("html"))})
    return files.manifest_diff(actual, stored)


@query("progress_report", "run_base status", "trials", """
  SELECT run_base, CASE WHEN max(CAST(protocol >= '2' AS INT)) = 0 THEN 'unexpected'
    WHEN max(CAST(subject < 'sub-05' AND protocol < '2' AND qty > 49 AS INT)) = 1 THEN 'completed'
    WHEN max(CAST(subject > 'sub-20' AND qty > 48 AND tax > 0.07 AS INT)) = 1 THEN 'ready' ELSE 'waiting' END AS status
  FROM trials WHERE protocol >= '2' OR (subject < 'sub-05' AND protocol < '2' AND qty > 49) OR (subject > 'sub-20' AND qty > 48 AND tax > 0.07)
  GROUP BY run_base""")
def _(spark, sf):
    t = trials(spark, sf)
    return runs.progress_report(
        t.where("protocol >= '2'"),
        t.where("subject < 'sub-05' AND protocol < '2' AND qty > 49"),
        t.where("subject > 'sub-20' AND qty > 48 AND tax > 0.07"),
    )


@query("pending_runs", "run_base n:i", "trials", """
  SELECT run_base, count(*) AS n FROM trials WHERE run_base NOT IN (
    SELECT run_base FROM trials WHERE subject < 'sub-05' AND qty > 49) GROUP BY run_base""")
def _(spark, sf):
    t = trials(spark, sf)
    left = runs.pending_runs(t, t.where("subject < 'sub-05' AND qty > 49"))
    return left.groupBy("run_base").agg(F.count(F.lit(1)).alias("n"))


cte("pulse_pieces", "pulses pulse_samples", """
  SELECT p.user_id, event_id, sample_idx, value, sample_idx < mid AS before FROM pulses p JOIN pulse_samples s
  ON p.user_id = s.user_id AND sample_idx >= lo AND sample_idx < hi""")
cte("pulse_center", "pulse_pieces", """
  SELECT user_id, event_id, median(value) FILTER (WHERE before) AS center, count(*) FILTER (WHERE before) AS n_before FROM pulse_pieces GROUP BY ALL""")


def pulse_trials(pieces):
    """Trials of the kept samples: the level before the pulse, and the root mean square about it afterwards."""
    inside = F.collect_list(F.struct("sample_idx", F.col("value").cast("double").alias("value"), (F.col("sample_idx") < F.col("mid")).alias("before")))
    windows = pieces.groupBy("run_base", "event_id").agg(F.array_sort(inside).alias("w"))  # a window's samples
    side = lambda before: F.transform(F.filter("w", lambda x: x["before"] == before), lambda x: x["value"])
    center = F.when(F.size("first") > 0, signal.robust_center(F.col("first")))
    return (
        windows.withColumns({"first": side(True), "rest": side(False)})
        .withColumn("center", center)
        .select(
            "run_base", "event_id", F.size("first").alias("n_before"), F.size("rest").alias("n_after"), "center",
            F.when(F.size("rest") > 0, signal.rms(F.transform("rest", lambda x: x - F.col("center")))).alias("late_rms"),
        )
    )


@query("ingest_runs_incremental", "run_base event_id:i n_before:i n_after:i center:d late_rms:d", "pulse_pieces pulse_center", """
  SELECT CAST(user_id AS VARCHAR) AS run_base, event_id, max(n_before) AS n_before, count(*) FILTER (WHERE NOT before) AS n_after, max(center) AS center,
    sqrt(avg((value - center) * (value - center)) FILTER (WHERE NOT before)) AS late_rms FROM pulse_pieces JOIN pulse_center USING (user_id, event_id) GROUP BY ALL""")
def _(spark, sf):
    """Samples as a stream of files dealt at random, so windows cross file borders; trials of each run once its last sample is there."""
    samples = pulse_samples(spark, sf).withColumnRenamed("user_id", "run_base")
    source = stage(spark, sf, "samples_source", lambda: samples.repartition(6, F.xxhash64("run_base", "sample_idx", "value")))
    events = pulses(spark, sf).withColumn("run_base", F.col("user_id").cast("string")).drop("user_id")
    expected = source.groupBy(F.col("run_base").cast("string").alias("run_base")).agg(F.count(F.lit(1)).alias("n_rows"))
    folder = _fresh(spark, "ingest")
    cut = lambda batch: response.cut_epochs(events, batch, ["run_base"], 24 * 3600).select("run_base", "event_id", "mid", "sample_idx", "value")
    runs.ingest_samples(spark, source.inputFiles()[0].rsplit("/", 1)[0], source.schema, expected, cut, pulse_trials, folder, max_files=2)
    columns = pulse_trials(cut(source.limit(0).withColumn("run_base", F.col("run_base").cast("string")))).schema
    return runs.finalise(spark, expected, columns, folder, f"{folder}/final")


# ---- sources and sinks: written in one format, read back through the reader ------------------------------


def _fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("read_csv", "o_orderkey o_totalprice:d o_orderstatus", "", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def _(spark, sf):
    """Sorted gzip CSV export, read back with an explicit schema."""
    path = _fresh(spark, "csv")
    o = table(spark, sf, "orders", "o_orderkey", "o_totalprice", "o_orderstatus")
    tables.write_sorted_csv_gz(o, path, ["o_orderkey"])
    return tables.read_csv(spark, path, "o_orderkey bigint, o_totalprice double, o_orderstatus string")


@query("read_tsv", "s_suppkey:i s_name absent", "", "SELECT s_suppkey, s_name, CAST(NULL AS VARCHAR) AS absent FROM supplier")
def _(spark, sf):
    path = _fresh(spark, "tsv")
    table(spark, sf, "supplier").write.csv(path, sep="\t", header=True)
    return tables.read_tsv(spark, path, ["s_suppkey", "s_name", "absent"])


@query("read_json_docs", "n_name n_regionkey:i", "", "SELECT n_name, n_regionkey FROM nation")
def _(spark, sf):
    path = _fresh(spark, "json")
    # a document per row: one file per key
    table(spark, sf, "nation").withColumn("doc", F.col("n_nationkey")).write.partitionBy("doc").json(path)
    return tables.read_json_docs(spark, path, "n_name string, n_regionkey int")


@query("read_tree", "sub ses n:i", "trials", """
  SELECT substr(subject, 5) AS sub, CASE WHEN protocol < '3' THEN 'a' ELSE 'b' END AS ses, count(*) AS n FROM trials GROUP BY 1, 2""")
def _(spark, sf):
    """One folder per subject and session, read back with the keys taken from the path."""
    path = _fresh(spark, "tree")
    t = trials(spark, sf).select(
        "event_uid", "qty", F.concat(F.lit("sub-"), F.substring("subject", 5, 9)).alias("folder"),
        F.when(F.col("protocol") < "3", "ses-a").otherwise("ses-b").alias("session"),
    )
    for ses in ("ses-a", "ses-b"):  # the two layouts
        part = t.where(F.col("session") == ses).drop("session")
        if ses == "ses-b":
            part = part.drop("qty")
        part.write.partitionBy("folder").csv(f"{path}/{ses}", sep="\t", header=True)
    tree = tables.read_tree(spark, [f"{path}/ses-a/*", f"{path}/ses-b/*"], wanted=["event_uid", "qty"])
    return tree.groupBy("sub", "ses").agg(F.count("event_uid").alias("n"))


@query("write_manifest", "n_rows:i subjects:i first_site", "trials",
       "SELECT count(*) AS n_rows, count(DISTINCT subject) AS subjects, min(stim_site) AS first_site FROM trials")
def _(spark, sf):
    """One-row nested summary as a JSON document, read back."""
    path = _fresh(spark, "manifest")
    t = trials(spark, sf).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.struct(F.count_distinct("subject").alias("subjects"), F.min("stim_site").alias("first_site")).alias("inventory"),
    )
    tables.write_manifest(t, path)
    doc = tables.read_json_docs(spark, path, "n_rows bigint, inventory struct<subjects: bigint, first_site: string>")
    return doc.select("n_rows", "inventory.*")


@query("write_table", "subject n:i", "map", "SELECT subject, count(*) AS n FROM map GROUP BY subject")
def _(spark, sf):
    path = _fresh(spark, "table")
    tables.write_table(maps(spark, sf), path, ["subject"])
    return spark.read.parquet(path).groupBy("subject").agg(F.count(F.lit(1)).alias("n"))


@query("pick_column", "subject n:i", "", "SELECT p_brand AS subject, count(*) AS n FROM part GROUP BY 1")
def _(spark, sf):
    p = quality.forbid_columns(quality.expect_columns(table(spark, sf, "part"), ["p_brand"]), ["outcome"])
    return p.withColumnRenamed(tables.pick_column(p, ["subject", "P_BRAND"], strict=True), "subject").groupBy("subject").agg(
        F.count(F.lit(1)).alias("n")
    )
