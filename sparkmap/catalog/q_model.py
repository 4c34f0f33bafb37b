"""Plans, hierarchical reconstruction and map metrics on the trials map."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkmap.catalog.q_geometry import feature_rows
from sparkmap.catalog.registry import cte, query
from sparkmap.catalog.roles import channel_points, maps, site_points, stage, trial_table, trials
from sparkmap.functions.hashing import stable_seed
from sparkmap.operators import hierarchy as H, metrics as K
from sparkmap.plans import context as P
from sparkmap.session import materialize

SEED = P.PLAN_SEED
PLAN = "subject, context_k, repeat"
_T = ("early", "late")
_CELLS = ["subject", "stim_site", "recording_channel"]


def each(template: str, sep: str = ", ") -> str:
    """The template once per target, with @ as the target."""
    return sep.join(template.replace("@", t) for t in _T)


# ---- plans ----------------------------------------------------------------------------------------------

cte("sites", "map", "SELECT DISTINCT subject, stim_site FROM map")
cte("draws", "sites", """
  SELECT subject, stim_site, context_k, repeat FROM sites, (SELECT unnest([1, 3, 5, 10]) AS context_k), (SELECT unnest(range(20)) AS repeat)""")
cte("ranked_draws", "draws", f"""
  SELECT *, row_number() OVER (PARTITION BY {PLAN}
    ORDER BY md5(concat_ws('|', {SEED}, subject, context_k, repeat, stim_site)), stim_site) AS rn FROM draws""")
cte("ctx", "ranked_draws", f"SELECT {PLAN}, stim_site FROM ranked_draws WHERE rn <= context_k")
cte("qry", "ranked_draws", f"SELECT {PLAN}, stim_site FROM ranked_draws WHERE rn > context_k")


def sites(spark, sf):
    return maps(spark, sf).select("subject", "stim_site").distinct()


def context(spark, sf):
    return stage(spark, sf, "context", lambda: P.context_sites(sites(spark, sf)))


def query_rows(spark, sf):
    return P.query_sites(sites(spark, sf), context(spark, sf))


@query("context_plan", "subject context_k:i repeat:i seed:i context_text query_text n_query_sites:i", "ctx qry", f"""
  SELECT *, ('0x' || substr(sha256(concat_ws('|', {SEED}, subject, context_k, repeat)), 1, 8))::BIGINT AS seed FROM
    (SELECT {PLAN}, string_agg(stim_site, '|' ORDER BY stim_site) AS context_text FROM ctx GROUP BY ALL)
    JOIN (SELECT {PLAN}, string_agg(stim_site, '|' ORDER BY stim_site) AS query_text, count(*) AS n_query_sites FROM qry GROUP BY ALL)
    USING ({PLAN})""")
def _(spark, sf):
    lists = P.plan_lists(context(spark, sf), query_rows(spark, sf))
    return lists.withColumn("context_text", F.array_join("context_sites", "|")).withColumn(
        "query_text", F.array_join("query_sites", "|")
    )


@query("query_complement", "subject context_k:i repeat:i stim_site", "qry", "FROM qry")
def _(spark, sf):
    return query_rows(spark, sf)


@query("check_plan", "context_k:i expected:i n_plans:i n_bad_length:i passed", "ctx sites", f"""
  SELECT context_k, count(*) AS n_plans, count(*) FILTER (WHERE n <> context_k) AS n_bad_length,
    (SELECT 20 * count(DISTINCT subject) FROM sites) AS expected, count(*) = (SELECT 20 * count(DISTINCT subject) FROM sites) AND count(*) FILTER (WHERE n <> context_k) = 0 AS passed
  FROM (SELECT {PLAN}, count(*) AS n FROM ctx GROUP BY ALL) GROUP BY context_k""")
def _(spark, sf):
    return P.check_plan(context(spark, sf), P.CONTEXT_SIZES, P.REPEATS, sites(spark, sf))


cte("split", "sites", f"""
  SELECT subject, stim_site, CASE WHEN pos < least(greatest(1, CAST(round_even(0.15 * n, 0) AS BIGINT)), n - 11) THEN 'val' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY md5(concat_ws('|', {SEED}, subject, stim_site)), stim_site) - 1 AS pos,
    count(*) OVER (PARTITION BY subject) AS n FROM sites)""")


@query("internal_split", "subject stim_site split", "split", "FROM split")
def _(spark, sf):
    return P.internal_split(sites(spark, sf), SEED)


cte("logs", "map", """
  SELECT subject, stim_site, recording_channel, distance_to_stim, early_rms_z AS true_early, late_rms_z AS true_late,
    ln(1 + greatest(early_rms_z, 0)) AS early, ln(1 + greatest(late_rms_z, 0)) AS late FROM map""")
cte("norms0", "logs", """
  SELECT s.subject, count(*) AS n_train, avg(o.early) AS mean_early, avg(o.late) AS mean_late,
    stddev_pop(o.early) AS sd0_early, stddev_pop(o.late) AS sd0_late
  FROM (SELECT DISTINCT subject FROM logs) s JOIN logs o ON o.subject <> s.subject GROUP BY s.subject""")
cte("norms", "norms0", f"""
  SELECT subject, n_train, mean_early, mean_late, {each("CASE WHEN sd0_@ < 1e-6 THEN 1.0 ELSE sd0_@ END AS sd_@")} FROM norms0""")


def _logs(spark, sf):
    m = maps(spark, sf)
    return m.select("subject", "stim_site", F.log1p("early_rms_z").alias("early"), F.log1p("late_rms_z").alias("late"))


@query("leave_one_subject_out", "subject stim_site n_train:i mean_early:d mean_late:d", "logs", """
  SELECT s.subject, s.stim_site, count(*) AS n_train, avg(o.early) AS mean_early, avg(o.late) AS mean_late
  FROM (SELECT DISTINCT subject, stim_site FROM logs) s JOIN logs o ON o.subject <> s.subject AND o.stim_site = s.stim_site GROUP BY 1, 2""")
def _(spark, sf):
    loo = P.leave_one_out(_logs(spark, sf), ["stim_site"], _T)
    n = F.col("loo_n")
    return loo.where(n > 0).select(
        "subject", "stim_site", n.alias("n_train"), *[(F.col(f"loo_sum_{t}") / n).alias(f"mean_{t}") for t in _T]
    )


@query("fold_norms", "subject n_train:i mean_early:d mean_late:d sd_early:d sd_late:d", "norms", "FROM norms")
def _(spark, sf):
    return P.fold_norms(_logs(spark, sf), _T)


_FEATS, _TARGS = ["distance_to_stim", "n_trials"], ["early_rms_z", "late_rms_z"]
cte("fit", "map split", """
  SELECT avg(distance_to_stim) AS mean_distance_to_stim, stddev_samp(distance_to_stim) AS sd_distance_to_stim,
    avg(n_trials) AS mean_n_trials, stddev_samp(n_trials) AS sd_n_trials,
    avg(ln(1 + early_rms_z)) AS mean_early_rms_z, stddev_pop(ln(1 + early_rms_z)) AS sd_early_rms_z,
    avg(ln(1 + late_rms_z)) AS mean_late_rms_z, stddev_pop(ln(1 + late_rms_z)) AS sd_late_rms_z
  FROM map JOIN split USING (subject, stim_site) WHERE split = 'train'""")
_FIT = " ".join(f"{s}_{c}:d" for c in _FEATS + _TARGS for s in ("mean", "sd"))


def _fit(spark, sf):
    train = P.internal_split(sites(spark, sf), SEED).where("split = 'train'")
    return P.fit_norm(maps(spark, sf).join(train, ["subject", "stim_site"], "left_semi"), _FEATS, _TARGS)


@query("fit_norm", _FIT, "fit", "FROM fit")
def _(spark, sf):
    return _fit(spark, sf)


@query("apply_norm", "subject stim_site recording_channel distance_to_stim_z:d n_trials_z:d early_rms_z_z:d late_rms_z_z:d", "map fit", """
  SELECT subject, stim_site, recording_channel, (distance_to_stim - mean_distance_to_stim) / sd_distance_to_stim AS distance_to_stim_z,
    (n_trials - mean_n_trials) / sd_n_trials AS n_trials_z, (ln(1 + early_rms_z) - mean_early_rms_z) / sd_early_rms_z AS early_rms_z_z,
    (ln(1 + late_rms_z) - mean_late_rms_z) / sd_late_rms_z AS late_rms_z_z FROM map, fit""")
def _(spark, sf):
    return P.apply_norm(maps(spark, sf), _fit(spark, sf), _FEATS, _TARGS)


cte("label_index", "feature_rows split", """
  SELECT label, row_number() OVER (ORDER BY label) AS label_index FROM (
    SELECT DISTINCT unnest([stim_a_roi, stim_b_roi, recording_roi]) AS label FROM feature_rows JOIN split USING (subject, stim_site)
    WHERE split = 'train') WHERE label <> 'UNK'""")


def _label_index(spark, sf):
    # training sites only: other sites can bring unseen labels
    train = P.internal_split(sites(spark, sf), SEED).where("split = 'train'")
    rows = feature_rows(spark, sf).join(train, ["subject", "stim_site"], "left_semi")
    return P.fit_label_index(rows, ["stim_a_roi", "stim_b_roi", "recording_roi"])


@query("fit_label_index", "label label_index:i", "label_index", "FROM label_index")
def _(spark, sf):
    return _label_index(spark, sf)


@query("apply_label_index", "subject idx:i n:i", "feature_rows label_index", """
  SELECT subject, coalesce(label_index, 0) AS idx, count(*) AS n FROM feature_rows LEFT JOIN label_index ON recording_roi = label GROUP BY 1, 2""")
def _(spark, sf):
    rows = P.apply_label_index(feature_rows(spark, sf), _label_index(spark, sf), "recording_roi", "idx")
    return rows.groupBy("subject", "idx").agg(F.count(F.lit(1)).alias("n"))


@query("subject_ordinal", "subject ordinal:i", "sites", """
  SELECT subject, row_number() OVER (ORDER BY subject) AS ordinal FROM (SELECT DISTINCT subject FROM sites)""")
def _(spark, sf):
    return P.subject_ordinal(sites(spark, sf))


@query("seed_key", "subject context_k:i repeat:i stim_site seed_key draw:i", "qry", f"""
  SELECT *, ('0x' || substr(sha256(seed_key), 1, 8))::BIGINT AS draw FROM (
    SELECT q.*, concat_ws('|', {SEED}, ordinal, repeat, context_k, stim_site) AS seed_key FROM qry q
    JOIN (SELECT subject, row_number() OVER (ORDER BY subject) AS ordinal FROM (SELECT DISTINCT subject FROM qry)) USING (subject))""")
def _(spark, sf):
    q = query_rows(spark, sf)
    return P.with_seed_keys(q, P.subject_ordinal(sites(spark, sf)), SEED, "stim_site").withColumn(
        "draw", stable_seed(F.col("seed_key"))
    )


# ---- reconstruction -------------------------------------------------------------------------------------

cte("z", "logs norms", f"""
  SELECT l.*, {each("mean_@, sd_@")}, {each("(@ - mean_@) / sd_@ AS z_@")} FROM logs l JOIN norms n ON l.subject = n.subject""")
cte("prior", "z sites", f"""
  SELECT z.*, {each("coalesce((coalesce(c.pop_@, s.pop_@) - mean_@) / sd_@, 0) AS pop_@")}
  FROM z
  LEFT JOIN (SELECT a.subject, a.stim_site, a.recording_channel, {each("avg(o.@) AS pop_@")} FROM logs a JOIN logs o
    ON o.stim_site = a.stim_site AND o.recording_channel = a.recording_channel AND o.subject <> a.subject GROUP BY 1, 2, 3) c
    ON z.subject = c.subject AND z.stim_site = c.stim_site AND z.recording_channel = c.recording_channel
  LEFT JOIN (SELECT a.subject, a.stim_site, {each("avg(o.@) AS pop_@")} FROM sites a JOIN logs o
    ON o.stim_site = a.stim_site AND o.subject <> a.subject GROUP BY 1, 2) s
    ON z.subject = s.subject AND z.stim_site = s.stim_site""")
cte("ctx_rows", "ctx prior", "SELECT * FROM ctx JOIN prior USING (subject, stim_site)")
cte("shift", "ctx_rows", f"""
  SELECT {PLAN}, {each("quantile_disc(z_@ - pop_@, 0.5) AS c_@")} FROM ctx_rows GROUP BY ALL""")
cte("node", "ctx_rows shift", f"""
  SELECT {PLAN}, recording_channel, {each("quantile_disc(z_@ - pop_@ - c_@, 0.5) AS a_@")}
  FROM ctx_rows JOIN shift USING ({PLAN}) GROUP BY ALL""")
cte("resid", "ctx_rows shift node", f"""
  SELECT {PLAN}, recording_channel, stim_site, distance_to_stim, {each("pop_@")}, {each("z_@ - pop_@ - c_@ - a_@ AS r_@")}
  FROM ctx_rows JOIN shift USING ({PLAN}) JOIN node USING ({PLAN}, recording_channel)""")
cte("qrows", "qry prior shift node", f"""
  SELECT q.*, p.* EXCLUDE (subject, stim_site), {each("c_@")}, {each("coalesce(a_@, 0) AS a_@")}
  FROM qry q JOIN prior p ON q.subject = p.subject AND q.stim_site = p.stim_site
  JOIN shift s ON q.subject = s.subject AND q.context_k = s.context_k AND q.repeat = s.repeat
  LEFT JOIN node n ON q.subject = n.subject AND q.context_k = n.context_k AND q.repeat = n.repeat
    AND p.recording_channel = n.recording_channel""")
# one row per query row and slot, with the permuted donor's residual
cte("slots", "qrows resid", f"""
  SELECT q.subject, q.context_k, q.repeat, q.stim_site, q.recording_channel, m.stim_site AS slot_site, m.distance_to_stim AS slot_distance,
    exp(-((q.pop_early - m.pop_early) ** 2 + (q.pop_late - m.pop_late) ** 2)) AS w, {each("m.r_@ AS r_@")},
    row_number() OVER (PARTITION BY q.subject, q.context_k, q.repeat, q.stim_site, q.recording_channel ORDER BY m.stim_site) AS pos,
    row_number() OVER (PARTITION BY q.subject, q.context_k, q.repeat, q.stim_site, q.recording_channel
      ORDER BY md5(concat_ws('|', {SEED}, q.subject, q.context_k, q.repeat, q.stim_site, m.stim_site)), m.stim_site) AS hash_pos
  FROM qrows q JOIN resid m ON q.subject = m.subject AND q.context_k = m.context_k AND q.repeat = m.repeat
    AND q.recording_channel = m.recording_channel WHERE q.context_k >= 2""")
_ROW = f"{PLAN}, stim_site, recording_channel"
cte("relation", "slots", f"""
  SELECT {_ROW}, count(*) AS n_slots, {each("sum(s.w * s.r_@) / (1 + sum(s.w)) AS t_@")}, {each("sum(s.w * d.r_@) / (1 + sum(s.w)) AS tp_@")}
  FROM slots s JOIN (SELECT {_ROW}, hash_pos AS pos, {each("r_@")} FROM slots) d USING ({_ROW}, pos) GROUP BY ALL""")
_LEVELS = {
    "population": "pop_@",
    "global": "pop_@ + c_@",
    "node": "pop_@ + c_@ + a_@",
    "relation": "pop_@ + c_@ + a_@ + coalesce(t_@, 0)",
    "relation_perm": "pop_@ + c_@ + a_@ + coalesce(tp_@, 0)",
}
cte("nested", "qrows relation", f"""
  SELECT {PLAN}, stim_site AS query_site, recording_channel, distance_to_stim, {each("true_@, mean_@, sd_@")},
    coalesce(t_early, 0) AS t_early, coalesce(t_late, 0) AS t_late, coalesce(tp_early, 0) AS tp_early, coalesce(tp_late, 0) AS tp_late,
    coalesce(n_slots, 0) AS n_slots, {", ".join(each(f"{e} AS {n}_@") for n, e in _LEVELS.items())}
  FROM qrows LEFT JOIN relation USING ({_ROW})""")
_RAW = "greatest(exp(round({c}_@ * sd_@ + mean_@, 9)) - 1, 0) AS pred_@"
cte("pairs", "nested", " UNION ALL ".join(
    f"SELECT {PLAN}, query_site, recording_channel, '{c}' AS condition, true_early, true_late, {each(_RAW.format(c=c))} FROM nested"
    for c in _LEVELS
))


def prior(spark, sf):
    return stage(spark, sf, "prior", lambda: H.population_prior(H.normalised_map(maps(spark, sf))))


def rows(spark, sf):
    return stage(
        spark, sf, "rows", lambda: H.reconstruct(prior(spark, sf), context(spark, sf), query_rows(spark, sf))
    )


def nested(spark, sf):
    return H.nested_predictions(rows(spark, sf), SEED)


def pairs(spark, sf):
    return stage(spark, sf, "pairs", lambda: H.pair_predictions(nested(spark, sf), digits=9))


def _ctx(spark, sf):
    return H.context_rows(prior(spark, sf), context(spark, sf))


@query("population_prior", "subject stim_site recording_channel z_early:d z_late:d pop_early:d pop_late:d", "prior", "FROM prior")
def _(spark, sf):
    return H.population_prior(H.normalised_map(maps(spark, sf)))


# sixteen features of a cell: places of the channel and the site, the site's axis, and the distance in three shapes
_FEATURES = {
    "cx": "c.x", "cy": "c.y", "cz": "c.z", "mx": "mid_x", "my": "mid_y", "mz": "mid_z", "len": "pair_length",
    "axx": "axis_xx", "ayy": "axis_yy", "axy": "axis_xy", "axz": "axis_xz", "ayz": "axis_yz",
    "d": "distance_to_stim", "d2": "distance_to_stim * distance_to_stim", "ld": "ln(1 + distance_to_stim)", "xx": "c.x * mid_x",
}
_P = len(_FEATURES) + 1
cte("features16", "map channel_points site_points", f"""
  SELECT m.subject, m.stim_site, m.recording_channel, {each("ln(1 + @_rms_z) AS @")}, {", ".join(f"{e} AS {n}" for n, e in _FEATURES.items())}
  FROM map m JOIN channel_points c ON c.subject = m.subject AND c.recording_channel = m.recording_channel
  JOIN site_points s ON s.subject = m.subject AND s.stim_site = m.stim_site""")
cte("design", "features16", f"""
  SELECT subject, stim_site, recording_channel, [1.0::DOUBLE, {", ".join(f"({n} - avg({n}) OVER ()) / CASE WHEN stddev_pop({n}) OVER () > 0 THEN stddev_pop({n}) OVER () ELSE 1 END" for n in _FEATURES)}] AS x,
    {", ".join(_T)} FROM features16""")
cte("normal", "design", f"""
  SELECT subject, list(v ORDER BY j) AS r, i FROM (
    SELECT DISTINCT subject, i, j, sum(v) OVER (PARTITION BY i, j) - sum(v) OVER (PARTITION BY subject, i, j) AS v FROM (
      SELECT subject, i, j, sum(x[i] * z[j]) AS v FROM (SELECT subject, x, list_concat(x, [{", ".join(_T)}]) AS z FROM design), range(1, {_P + 1}) a(i), range(1, {_P + 3}) b(j)
      GROUP BY ALL)) GROUP BY subject, i""")
# Gauss-Jordan, one pivot a step; the matrix is positive definite
cte("weights16", "normal", f"""
  WITH RECURSIVE g AS (SELECT subject, 0 AS k, list(r ORDER BY i) AS m FROM normal GROUP BY subject
    UNION ALL SELECT subject, k + 1, list_transform(range(1, {_P + 1}), lambda i: CASE WHEN i = k + 1 THEN list_transform(m[k + 1], lambda v: v / m[k + 1][k + 1])
      ELSE list_transform(range(1, {_P + 3}), lambda j: m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM g WHERE k < {_P})
  SELECT subject, list_transform(m, lambda r: r[{_P + 1}]) AS b_early, list_transform(m, lambda r: r[{_P + 2}]) AS b_late FROM g WHERE k = {_P}""")


@query("linear_prior", "subject stim_site recording_channel pop_early:d pop_late:d", "design weights16", f"""
  SELECT subject, stim_site, recording_channel, {each("list_inner_product(x, b_@) AS pop_@")} FROM design JOIN weights16 USING (subject)""")
def _(spark, sf):
    m = maps(spark, sf).select(
        *_CELLS, "distance_to_stim", F.log1p("early_rms_z").alias("early"), F.log1p("late_rms_z").alias("late")
    )
    placed = m.join(channel_points(spark, sf).alias("c"), ["subject", "recording_channel"]).join(site_points(spark, sf), ["subject", "stim_site"])
    rows = placed.select(*_CELLS, *_T, *[F.expr(e).alias(n) for n, e in _FEATURES.items()])
    return H.linear_prior(rows, list(_FEATURES), _T)


@query("global_shift", "subject context_k:i repeat:i c_early:d c_late:d", "shift", "FROM shift")
def _(spark, sf):
    return H.global_shift(_ctx(spark, sf))


@query("node_offset", "subject context_k:i repeat:i recording_channel a_early:d a_late:d", "node", "FROM node")
def _(spark, sf):
    ctx = _ctx(spark, sf)
    return H.node_offset(H.channel_slots(ctx), H.global_shift(ctx))


@query("interaction_residual", "subject context_k:i repeat:i recording_channel stim_site r_early:d r_late:d", "resid", "FROM resid")
def _(spark, sf):
    ctx = _ctx(spark, sf)
    memory = H.interaction_residual(H.node_offset(H.channel_slots(ctx), H.global_shift(ctx)))
    return memory.select(*P.PLAN_KEYS, "recording_channel", F.inline("slots"))


_BY_SITE = f"{PLAN}, query_site"


@query("context_memory", "subject context_k:i repeat:i query_site n_rows:i n_slots:i", "nested", f"""
  SELECT {_BY_SITE}, count(*) AS n_rows, sum(n_slots) AS n_slots FROM nested GROUP BY ALL""")
def _(spark, sf):
    r = H.reconstruct(prior(spark, sf), context(spark, sf), query_rows(spark, sf))
    return r.groupBy(*P.PLAN_KEYS, F.col("stim_site").alias("query_site")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.when(F.col("has_memory"), F.size("slots")).otherwise(0)).alias("n_slots")
    )


def _mean_variants(spark, sf, name, slots):
    rel = H.with_relation(rows(spark, sf), {name: slots})
    return rel.groupBy(*P.PLAN_KEYS, F.col("stim_site").alias("query_site")).agg(
        *[F.avg(f"{name}_{t}").alias(f"{name}_{t}") for t in _T]
    )


@query("relation_residual", "subject context_k:i repeat:i query_site t_early:d t_late:d", "nested", f"""
  SELECT {_BY_SITE}, {each("avg(t_@) AS t_@")} FROM nested GROUP BY ALL""")
def _(spark, sf):
    return _mean_variants(spark, sf, "t", F.col("slots"))


@query("permute_within", "subject context_k:i repeat:i query_site tp_early:d tp_late:d", "nested", f"""
  SELECT {_BY_SITE}, {each("avg(tp_@) AS tp_@")} FROM nested GROUP BY ALL""")
def _(spark, sf):
    return _mean_variants(spark, sf, "tp", H.permute_slots(F.col("slots"), H.row_seed(SEED)))


_NESTED_COLS = " ".join(f"{c}_{t}:d" for c in _LEVELS for t in _T)


@query("nested_predictions", f"subject context_k:i repeat:i query_site {_NESTED_COLS}", "nested", f"""
  SELECT {_BY_SITE}, {", ".join(each(f"avg({c}_@) AS {c}_@") for c in _LEVELS)} FROM nested GROUP BY ALL""")
def _(spark, sf):
    return nested(spark, sf).groupBy(*P.PLAN_KEYS, "query_site").agg(
        *[F.avg(f"{c}_{t}").alias(f"{c}_{t}") for c in _LEVELS for t in _T]
    )


@query("pair_predictions", "subject context_k:i repeat:i condition n:i true_early:d9 true_late:d9 pred_early:d pred_late:d", "pairs prior", f"""
  SELECT {PLAN}, condition, count(*) AS n, {each("max(true_@) AS true_@")}, {each("avg(pred_@) AS pred_@")} FROM (
    FROM pairs UNION ALL SELECT subject, 0, 0, stim_site, recording_channel, 'population', true_early, true_late,
      {each("greatest(exp(round(pop_@ * sd_@ + mean_@, 9)) - 1, 0)")} FROM prior) GROUP BY ALL""")
def _(spark, sf):
    both = H.pair_predictions(nested(spark, sf), digits=9).unionByName(H.zero_context_predictions(prior(spark, sf), 9))
    return both.groupBy(*P.PLAN_KEYS, "condition").agg(
        F.count(F.lit(1)).alias("n"), *[F.max(f"true_{t}").alias(f"true_{t}") for t in _T],
        *[F.avg(f"pred_{t}").alias(f"pred_{t}") for t in _T],
    )


cte("scored", "nested", f"""
  SELECT subject, context_k, repeat, query_site || '/' || recording_channel AS row_id, (ln(1 + true_late) - mean_late) / sd_late AS y,
    node_late AS mu, 0.1 * population_late - 0.5 AS log_var FROM nested""")
cte("scored_pos", "scored", f"""
  SELECT *, row_number() OVER (PARTITION BY {PLAN} ORDER BY row_id) - 1 AS pos, count(*) OVER (PARTITION BY {PLAN}) AS total FROM scored""")


@query("score_terms", "subject context_k:i repeat:i n:i gaussian_nll:d huber:d one_minus_r:d rank_loss:d", "scored_pos", f"""
  SELECT * FROM (SELECT {PLAN}, count(*) AS n, avg(0.5 * (log_var + (y - mu) ** 2 * exp(-log_var))) AS gaussian_nll,
      avg(CASE WHEN abs(y - mu) <= 1 THEN 0.5 * (y - mu) ** 2 ELSE abs(y - mu) - 0.5 END) AS huber,
      CASE WHEN count(*) >= 3 AND stddev_pop(y) >= 1e-12 AND stddev_pop(mu) >= 1e-12 THEN 1 - covar_pop(y, mu) / (stddev_pop(y) * stddev_pop(mu)) END AS one_minus_r
      FROM scored_pos GROUP BY {PLAN})
  LEFT JOIN (SELECT {PLAN}, avg(ln(1 + exp(-sign(a.y - b.y) * (a.mu - b.mu)))) AS rank_loss
    FROM (SELECT s.*, ('0x' || substr(md5(concat_ws('|', 7, row_id, j)), 1, 8))::BIGINT % total AS partner
      FROM scored_pos s, (SELECT unnest(range(1, 5)) AS j)) a
    JOIN (SELECT {PLAN}, pos AS partner, y, mu FROM scored_pos) b USING ({PLAN}, partner) WHERE a.y <> b.y GROUP BY {PLAN}) USING ({PLAN})""")
def _(spark, sf):
    n = nested(spark, sf).select(
        *P.PLAN_KEYS, F.concat_ws("/", "query_site", "recording_channel").alias("row_id"),
        ((F.log1p("true_late") - F.col("mean_late")) / F.col("sd_late")).alias("y"), F.col("node_late").alias("mu"),
        (F.lit(0.1) * F.col("population_late") - 0.5).alias("log_var"),
    )
    return K.score_terms(n, P.PLAN_KEYS)


# ---- metrics --------------------------------------------------------------------------------------------


@query("pearson_safe", "subject r:d constant:d", "trials", """
  SELECT subject, covar_pop(qty, late_rms_z) / (stddev_pop(qty) * stddev_pop(late_rms_z)) AS r, NULL AS constant
  FROM trials WHERE recording_channel NOT IN ('ch3', 'ch5') GROUP BY subject""")
def _(spark, sf):
    """Where one side of a pair is missing or not a number, the pair does not count."""
    gap = lambda ch, c, v: F.when(F.col("recording_channel") == ch, F.lit(v)).otherwise(F.col(c))
    t = trials(spark, sf).select(
        "subject", F.lit(1.0).alias("one"), gap("ch3", "qty", None).alias("qty"), gap("ch5", "late_rms_z", float("nan")).alias("late_rms_z")
    )
    return t.groupBy("subject").agg(K.pearson_safe("qty", "late_rms_z").alias("r"), K.pearson_safe("qty", "one").alias("constant"))


@query("mae", "subject mae:d", "trials", "SELECT subject, avg(abs(qty - late_rms_z)) AS mae FROM trials GROUP BY subject")
def _(spark, sf):
    return trials(spark, sf).groupBy("subject").agg(K.mae("qty", "late_rms_z").alias("mae"))


@query("spearman_safe", "subject spearman:d", "trials", """
  SELECT subject, covar_pop(ry, rp) / (stddev_pop(ry) * stddev_pop(rp)) AS spearman FROM (
    SELECT subject, rank() OVER (PARTITION BY subject ORDER BY qty) + (count(*) OVER (PARTITION BY subject, qty) - 1) / 2.0 AS ry,
      rank() OVER (PARTITION BY subject ORDER BY late_rms_z) + (count(*) OVER (PARTITION BY subject, late_rms_z) - 1) / 2.0 AS rp
    FROM trials) GROUP BY subject""")
def _(spark, sf):
    return K.spearman_safe(trial_table(spark, sf), ["subject"], "qty", "late_rms_z")


@query("top_recall", "subject top10_recall:d", "map", """
  SELECT subject, count(*) FILTER (WHERE ry <= k AND rp <= k) / max(k) AS top10_recall FROM (
    SELECT *, greatest(1, CAST(round_even(0.1 * count(*) OVER (PARTITION BY subject), 0) AS BIGINT)) AS k,
      row_number() OVER (PARTITION BY subject ORDER BY -late_rms_z, stim_site, recording_channel) AS ry,
      row_number() OVER (PARTITION BY subject ORDER BY -early_rms_z, stim_site, recording_channel) AS rp FROM map) GROUP BY subject""")
def _(spark, sf):
    return K.top_recall(maps(spark, sf), ["subject"], "late_rms_z", "early_rms_z", ["stim_site", "recording_channel"])


RKEYS = "subject, context_k, repeat, condition, target"
cte("long_pairs", "pairs", " UNION ALL ".join(
    f"SELECT {PLAN}, condition, '{t}' AS target, query_site, recording_channel, true_{t} AS y, pred_{t} AS p FROM pairs" for t in _T
))
cte("ranked_pairs", "long_pairs", f"""
  SELECT *, rank() OVER (PARTITION BY {RKEYS} ORDER BY y) + (count(*) OVER (PARTITION BY {RKEYS}, y) - 1) / 2.0 AS ry,
    rank() OVER (PARTITION BY {RKEYS} ORDER BY p) + (count(*) OVER (PARTITION BY {RKEYS}, p) - 1) / 2.0 AS rp,
    row_number() OVER (PARTITION BY {RKEYS} ORDER BY -y, query_site, recording_channel) AS ty,
    row_number() OVER (PARTITION BY {RKEYS} ORDER BY -p, query_site, recording_channel) AS tp,
    greatest(1, CAST(round_even(0.1 * count(*) OVER (PARTITION BY {RKEYS}), 0) AS BIGINT)) AS k FROM long_pairs""")


def _r_sql(y: str, p: str) -> str:
    ok = f"count(*) >= 3 AND stddev_pop({y}) >= 1e-12 AND stddev_pop({p}) >= 1e-12"
    return f"CASE WHEN {ok} THEN covar_pop({y}, {p}) / (stddev_pop({y}) * stddev_pop({p})) END"


cte("repeats", "ranked_pairs", f"""
  SELECT {RKEYS}, count(*) AS n_pairs, round({_r_sql('y', 'p')}, 12) AS pearson, CASE WHEN stddev_pop(y) >= 1e-12 AND stddev_pop(p) >= 1e-12 THEN round({_r_sql('ry', 'rp')}, 12) END AS spearman,
    round(avg(abs(y - p)), 12) AS mae, count(*) FILTER (WHERE ty <= k AND tp <= k) / max(k) AS top10_recall
  FROM ranked_pairs GROUP BY ALL""")
cte("patients", "repeats", """
  SELECT subject, context_k, condition, target, count(DISTINCT repeat) AS n_repeats, avg(pearson) AS pearson, avg(spearman) AS spearman,
    avg(mae) AS mae, avg(top10_recall) AS top10_recall, avg(n_pairs) AS mean_pairs_per_repeat FROM repeats GROUP BY ALL""")


def repeats(spark, sf):
    """Repeat metrics, twelve digits: what differs beyond is summation order, not signal."""
    def build():
        r = K.repeat_metrics(pairs(spark, sf), materialize)
        for m in ("pearson", "spearman", "mae"):
            r = r.withColumn(m, F.round(m, 12))
        return r

    return stage(spark, sf, "repeats", build)


def patients(spark, sf):
    return K.patient_metrics(repeats(spark, sf))


@query("repeat_metrics", "subject context_k:i repeat:i condition target n_pairs:i pearson:d spearman:d mae:d top10_recall:d", "repeats", "FROM repeats")
def _(spark, sf):
    return repeats(spark, sf)


@query("patient_metrics", "subject context_k:i condition target n_repeats:i pearson:d spearman:d mae:d top10_recall:d mean_pairs_per_repeat:d",
       "patients", "FROM patients")
def _(spark, sf):
    return patients(spark, sf)


_GM = ", ".join(f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_sd" for m in K.METRICS)


@query("group_metrics", "context_k:i condition target n_patients:i " + " ".join(f"{m}_mean:d {m}_sd:d" for m in K.METRICS), "patients", f"""
  SELECT context_k, condition, target, count(*) AS n_patients, {_GM} FROM patients GROUP BY ALL""")
def _(spark, sf):
    return K.group_metrics(patients(spark, sf))


def _gains_sql(metric: str, sign: str) -> str:
    side = lambda c: f"max({metric}) FILTER (WHERE condition = '{c}')"
    cols = ", ".join(f"{sign} * ({side(a)} - {side(b)}) AS {n}" for n, (a, b) in K.GAINS.items())
    return f"SELECT subject, context_k, target, '{metric}' AS metric, {cols} FROM patients GROUP BY subject, context_k, target"


@query("nested_gains", "subject context_k:i target metric " + " ".join(f"{g}:d" for g in K.GAINS), "patients",
       _gains_sql("spearman", "1.0") + " UNION ALL " + _gains_sql("mae", "-1.0"))
def _(spark, sf):
    p = patients(spark, sf)
    return K.nested_gains(p, "spearman").withColumn("metric", F.lit("spearman")).unionByName(
        K.nested_gains(p, "mae", lower_is_better=True).withColumn("metric", F.lit("mae"))
    )


_MARGIN = 0.02


def _huber_sql(mu: str) -> str:
    return f"avg(CASE WHEN abs(y - {mu}) <= 1 THEN 0.5 * (y - {mu}) ** 2 ELSE abs(y - {mu}) - 0.5 END)"


@query("control_hinge", "subject context_k:i repeat:i n:i huber:d huber_control:d control_hinge:d", "nested", f"""
  SELECT *, greatest({_MARGIN} + huber - huber_control, 0) AS control_hinge FROM (
    SELECT {PLAN}, count(*) AS n, {_huber_sql("relation_late")} AS huber, {_huber_sql("relation_perm_late")} AS huber_control
    FROM (SELECT *, (ln(1 + true_late) - mean_late) / sd_late AS y FROM nested) GROUP BY {PLAN})""")
def _(spark, sf):
    n = nested(spark, sf).select(
        *P.PLAN_KEYS, F.concat_ws("/", "query_site", "recording_channel").alias("row_id"),
        ((F.log1p("true_late") - F.col("mean_late")) / F.col("sd_late")).alias("y"),
        F.col("relation_late").alias("mu"), F.col("relation_perm_late").alias("control"),
    )
    return K.control_hinge(n, P.PLAN_KEYS, _MARGIN)
