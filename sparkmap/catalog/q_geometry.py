"""Geometry of contacts, sites and pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkmap.catalog.registry import cte, query
from sparkmap.catalog.roles import (
    channel_points, contact_bridge, contact_pairs, contact_points, maps, site_points, trials,
)
from sparkmap.functions import space
from sparkmap.operators import geometry

_AFFINE = ", ".join(
    f"{r[0]} * x + {r[1]} * y + {r[2]} * z + {r[3]} AS m{a}" for r, a in zip(space.SURFACE_TO_MNI, "xyz")
)


@query("affine3", "name mx:d my:d mz:d", "contact_points", f"SELECT name, {_AFFINE} FROM contact_points")
def _(spark, sf):
    p = space.affine3(space.point())
    return contact_points(spark, sf).select("name", *[c.alias(f"m{a}") for c, a in zip(p, "xyz")])


@query("midpoint", "vec_id mid_x:d mid_y:d mid_z:d", "contact_pairs", """
  SELECT vec_id, (a_x + b_x) / 2 AS mid_x, (a_y + b_y) / 2 AS mid_y, (a_z + b_z) / 2 AS mid_z FROM contact_pairs""")
def _(spark, sf):
    m = space.midpoint(space.point("a_"), space.point("b_"))
    return contact_pairs(spark, sf).select("vec_id", *[c.alias(f"mid_{a}") for c, a in zip(m, "xyz")])


cte("pair_axis", "contact_pairs", """
  SELECT *, (b_x - a_x) / nullif(len, 0) AS ux, (b_y - a_y) / nullif(len, 0) AS uy, (b_z - a_z) / nullif(len, 0) AS uz
  FROM (SELECT *, sqrt((b_x - a_x) ** 2 + (b_y - a_y) ** 2 + (b_z - a_z) ** 2) AS len FROM contact_pairs)""")


@query("unit_vector", "vec_id len:d ux:d uy:d uz:d", "pair_axis", "SELECT vec_id, len, ux, uy, uz FROM pair_axis")
def _(spark, sf):
    a, b = space.point("a_"), space.point("b_")
    u = space.unit_vector(a, b)
    return contact_pairs(spark, sf).select(
        "vec_id", space.norm(space.minus(b, a)).alias("len"), *[c.alias(f"u{x}") for c, x in zip(u, "xyz")]
    )


@query("axis_tensor", "vec_id xx:d yy:d zz:d xy:d xz:d yz:d", "pair_axis", """
  SELECT vec_id, ux * ux AS xx, uy * uy AS yy, uz * uz AS zz, ux * uy AS xy, ux * uz AS xz, uy * uz AS yz FROM pair_axis""")
def _(spark, sf):
    t = space.axis_tensor(space.unit_vector(space.point("a_"), space.point("b_")))
    return contact_pairs(spark, sf).select("vec_id", *[c.alias(n) for n, c in t.items()])


@query("displacement", "vec_id dx:d dy:d dz:d distance:d log_distance:d", "pair_axis", """
  SELECT vec_id, b_x - a_x AS dx, b_y - a_y AS dy, b_z - a_z AS dz, len AS distance, ln(1 + len) AS log_distance FROM pair_axis""")
def _(spark, sf):
    d = space.displacement(space.point("a_"), space.point("b_"))
    return contact_pairs(spark, sf).select("vec_id", *[c.alias(n) for n, c in d.items()])


@query("near_field", "subject n_gt:i n_ge:i n_near:i n:i", "trials", """
  SELECT subject, count(*) FILTER (WHERE distance_to_stim > 10) AS n_gt, count(*) FILTER (WHERE distance_to_stim >= 10) AS n_ge,
    count(*) FILTER (WHERE distance_to_stim <= 10) AS n_near, count(*) AS n FROM trials GROUP BY subject""")
def _(spark, sf):
    d = F.col("distance_to_stim")
    return trials(spark, sf).groupBy("subject").agg(
        F.count_if(space.near_field(d, rule="gt")).alias("n_gt"),
        F.count_if(space.near_field(d, rule="ge")).alias("n_ge"),
        F.count_if(space.near_field(d, rule="flag_le")).alias("n_near"),
        F.count(F.lit(1)).alias("n"),
    )


cte("site_pairs", "site_points channel_points", """
  SELECT s.*, c.recording_channel, c.x, c.y, c.z,
    sqrt((c.x - mid_x) ** 2 + (c.y - mid_y) ** 2 + (c.z - mid_z) ** 2) AS distance_to_stim
  FROM site_points s JOIN channel_points c ON s.subject = c.subject
  WHERE recording_channel <> contact_a AND recording_channel <> contact_b
    AND sqrt((c.x - mid_x) ** 2 + (c.y - mid_y) ** 2 + (c.z - mid_z) ** 2) >= 10""")


def site_pairs(spark, sf):
    return geometry.site_channel_pairs(site_points(spark, sf), channel_points(spark, sf))


@query("site_channel_pairs", "subject stim_site recording_channel distance_to_stim:d", "site_pairs",
       "SELECT subject, stim_site, recording_channel, distance_to_stim FROM site_pairs")
def _(spark, sf):
    return site_pairs(spark, sf)


# contacts with holes in their coordinates
def _holes(spark, sf):
    c = contact_points(spark, sf)
    return c.withColumn("x", F.when(F.col("vec_id") % 4 != 0, F.col("x"))).withColumn(
        "z", F.when(F.col("vec_id") % 6 != 0, F.col("z"))
    )


cte("holes", "contact_points", """
  SELECT subject, name, vec_id, hemi, CASE WHEN vec_id % 4 <> 0 THEN x END AS x, y, CASE WHEN vec_id % 6 <> 0 THEN z END AS z
  FROM contact_points""")


@query("availability_flags", "name has_xyz has_yz", "holes", """
  SELECT name, x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AS has_xyz, y IS NOT NULL AND z IS NOT NULL AS has_yz FROM holes""")
def _(spark, sf):
    return geometry.availability_flags(_holes(spark, sf), {"has_xyz": ["x", "y", "z"], "has_yz": ["y", "z"]})


_AGREE = """count(CASE WHEN hemi IS NOT NULL AND x IS NOT NULL THEN 1 END) AS n_sided,
  avg(CASE WHEN x IS NULL OR hemi IS NULL THEN NULL WHEN hemi = 'L' THEN CAST(x < 0 AS INT) ELSE CAST(x > 0 AS INT) END) AS agreement"""


@query("hemi_sign_agreement", "subject n_sided:i agreement:d", "holes", f"""
  SELECT subject, {_AGREE} FROM holes GROUP BY subject UNION ALL SELECT 'all', {_AGREE} FROM holes""")
def _(spark, sf):
    h = _holes(spark, sf)
    overall = geometry.hemi_sign_agreement(h, []).withColumn("subject", F.lit("all"))
    return geometry.hemi_sign_agreement(h, ["subject"]).unionByName(overall)


cte("stored_geometry", "pair_axis", """
  SELECT *, round((a_x + b_x) / 2, 1) AS mid_x, round((a_y + b_y) / 2, 2) AS mid_y, round((a_z + b_z) / 2, 2) AS mid_z,
    round(len, 2) AS pair_length FROM pair_axis""")


@query("check_geometry", "max_midpoint_error:d max_length_error:d passed", "stored_geometry", """
  SELECT *, max_midpoint_error <= 0.1 AND max_length_error <= 0.1 AS passed FROM (
    SELECT max(greatest(abs((a_x + b_x) / 2 - mid_x), abs((a_y + b_y) / 2 - mid_y), abs((a_z + b_z) / 2 - mid_z))) AS max_midpoint_error,
      max(abs(len - pair_length)) AS max_length_error FROM stored_geometry)""")
def _(spark, sf):
    a, b = space.point("a_"), space.point("b_")
    m = space.midpoint(a, b)
    stored = contact_pairs(spark, sf).select(
        "*", F.round(m[0], 1).alias("mid_x"), F.round(m[1], 2).alias("mid_y"), F.round(m[2], 2).alias("mid_z"),
        F.round(space.norm(space.minus(b, a)), 2).alias("pair_length"),
    )
    return geometry.check_geometry(stored).withColumn("passed", F.expr("max_midpoint_error <= 0.1 AND max_length_error <= 0.1"))


def _map_holes(spark, sf):
    """Channels and sites, of which channels 3 and sites 9 of every subject have lost their coordinates."""
    kept = lambda cols, where: {c: F.when(F.expr(where), F.col(c)) for c in cols}
    return (
        channel_points(spark, sf).withColumns(kept(space.AXES, "recording_channel <> 'ch3'")),
        site_points(spark, sf).withColumns(kept([f"mid_{a}" for a in space.AXES], "stim_site <> 'Brand#9'")),
    )


def harmonised(spark, sf):
    return geometry.harmonize_map(maps(spark, sf), *_map_holes(spark, sf))


cte("harmonised", "map channel_points site_points", """
  SELECT m.*, c.x AS rec_x, c.y AS rec_y, c.z AS rec_z, s.* EXCLUDE (subject, stim_site),
    c.x - mid_x AS dx, c.y - mid_y AS dy, c.z - mid_z AS dz,
    sqrt((c.x - mid_x) ** 2 + (c.y - mid_y) ** 2 + (c.z - mid_z) ** 2) AS distance,
    ln(1 + sqrt((c.x - mid_x) ** 2 + (c.y - mid_y) ** 2 + (c.z - mid_z) ** 2)) AS log_distance,
    c.x IS NOT NULL AS has_recording, mid_x IS NOT NULL AS has_site, c.x IS NOT NULL AND mid_x IS NOT NULL AS has_pair
  FROM map m
  LEFT JOIN (FROM channel_points WHERE recording_channel <> 'ch3') c
    ON m.subject = c.subject AND m.recording_channel = c.recording_channel
  LEFT JOIN (FROM site_points WHERE stim_site <> 'Brand#9') s ON m.subject = s.subject AND m.stim_site = s.stim_site""")


@query("harmonize_map", "subject stim_site recording_channel late_rms_z:d9 dx:d dy:d dz:d distance:d has_recording has_site has_pair",
       "harmonised", "FROM harmonised")
def _(spark, sf):
    return harmonised(spark, sf)


_FEATURE_COLS = " ".join(f"{c}:d" for c in geometry.FEATURES)


def feature_rows(spark, sf):
    bridge = contact_bridge(spark, sf).select("subject", "contact", F.col("frozen_token").alias("token"))
    return geometry.build_features(maps(spark, sf), *_map_holes(spark, sf), bridge)


cte("feature_rows", "harmonised contact_bridge", """
  SELECT h.*, coalesce(a.frozen_token, 'UNK') AS stim_a_roi, coalesce(b.frozen_token, 'UNK') AS stim_b_roi,
    coalesce(r.frozen_token, 'UNK') AS recording_roi
  FROM harmonised h
  LEFT JOIN contact_bridge a ON h.subject = a.subject AND h.contact_a = a.contact
  LEFT JOIN contact_bridge b ON h.subject = b.subject AND h.contact_b = b.contact
  LEFT JOIN contact_bridge r ON h.subject = r.subject AND h.recording_channel = r.contact
  WHERE has_pair""")


@query("build_features", f"subject stim_site recording_channel n_trials:i early_rms_z:d9 late_rms_z:d9 {_FEATURE_COLS} stim_a_roi stim_b_roi recording_roi",
       "feature_rows", "FROM feature_rows")
def _(spark, sf):
    return feature_rows(spark, sf)


@query("geometry_coverage", "subject n_pairs:i pair_share:d n_sites:i site_share:d n_channels:i channel_share:d", "harmonised", """
  SELECT * FROM (SELECT subject, count(*) AS n_pairs, avg(CAST(has_pair AS INT)) AS pair_share FROM harmonised GROUP BY subject)
  JOIN (SELECT subject, count(*) AS n_sites, avg(h) AS site_share FROM (
    SELECT subject, stim_site, max(CAST(has_site AS INT)) AS h FROM harmonised GROUP BY ALL) GROUP BY subject) USING (subject)
  JOIN (SELECT subject, count(*) AS n_channels, avg(h) AS channel_share FROM (
    SELECT subject, recording_channel, max(CAST(has_recording AS INT)) AS h FROM harmonised GROUP BY ALL) GROUP BY subject) USING (subject)""")
def _(spark, sf):
    return geometry.geometry_coverage(harmonised(spark, sf), ["subject"])


@query("known_fraction", "label_column known_share:d", "feature_rows", """
  SELECT 'stim_a_roi' AS label_column, avg(CAST(stim_a_roi <> 'UNK' AS INT)) AS known_share FROM feature_rows
  UNION ALL SELECT 'stim_b_roi', avg(CAST(stim_b_roi <> 'UNK' AS INT)) FROM feature_rows
  UNION ALL SELECT 'recording_roi', avg(CAST(recording_roi <> 'UNK' AS INT)) FROM feature_rows""")
def _(spark, sf):
    from sparkmap.operators.bridge import known_fraction

    return known_fraction(feature_rows(spark, sf), ["stim_a_roi", "stim_b_roi", "recording_roi"])
