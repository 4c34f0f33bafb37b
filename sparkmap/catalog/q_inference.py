"""Paired inference and stress tests on the reconstructed maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkmap.catalog.q_model import SEED, patients, rows
from sparkmap.catalog.registry import cte, query
from sparkmap.catalog.roles import pair_label, stage, table
from sparkmap.operators import hierarchy as H, inference as L, stress as M
from sparkmap.operators.metrics import METRICS

# two sizes of one code path: the plain names and, with `_full`, the study's own numbers of draws
DRAWS = {"": 20_000, "_full": 200_000}
ENDPOINT_DRAWS = {"": (200_000, 40_000), "_full": (10_000_000, 2_000_000)}
ENDPOINT_SEEDS = (20260927, 20261000)
ENDPOINT_BOOT_SEED = 20260928
CELL = ", ".join(L.CELL)
_CELL_COLS = "contrast context_k:i target metric"

_GRID = ", ".join(
    f"('{name}', {k}, '{t}', '{m}', '{a}', '{b}', {str(m in L.LOWER_IS_BETTER).upper()})"
    for name, (a, b, ks) in L.CONTRASTS.items() for k in ks for t in L.TARGETS for m in METRICS
)
cte("grid", "", f"SELECT * FROM (VALUES {_GRID}) g(contrast, context_k, target, metric, condition_a, condition_b, lower_is_better)")
cte("long_metrics", "patients", """
  UNPIVOT (SELECT subject, context_k, condition, target, pearson, spearman, mae, top10_recall FROM patients)
  ON pearson, spearman, mae, top10_recall INTO NAME metric VALUE v""")
cte("deltas", "grid long_metrics", """
  SELECT contrast, g.context_k, g.target, g.metric, a.subject, a.v AS a, b.v AS b,
    round(CASE WHEN lower_is_better THEN b.v - a.v ELSE a.v - b.v END, 10) AS delta
  FROM grid g JOIN long_metrics a ON a.context_k = g.context_k AND a.target = g.target AND a.metric = g.metric AND a.condition = condition_a
  JOIN long_metrics b ON b.context_k = g.context_k AND b.target = g.target AND b.metric = g.metric AND b.condition = condition_b
    AND a.subject = b.subject""")


def deltas(spark, sf):
    """Deltas to ten digits: what differs beyond is summation order, and must not decide wins or ties."""
    return stage(
        spark, sf, "deltas",
        lambda: L.paired_delta(patients(spark, sf), L.contrast_grid(spark)).withColumn("delta", F.round("delta", 10)),
    )


def region_deltas(spark, sf):
    """The same deltas in small cells: subjects of one region."""
    n = table(spark, sf, "nation", "n_nationkey", "n_regionkey").select(
        F.concat(F.lit("sub-"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("subject"),
        F.col("n_regionkey").alias("region"),
    )
    return deltas(spark, sf).join(n, "subject")


cte("region_deltas", "deltas", """
  SELECT d.*, n_regionkey AS region FROM deltas d JOIN nation ON subject = 'sub-' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0')""")
REGION_CELL = [*L.CELL, "region"]


@query("contrast_grid", "target metric n_subjects:i n_cells:i", "deltas", """
  SELECT target, metric, count(DISTINCT subject) AS n_subjects, count(DISTINCT (contrast, context_k)) AS n_cells FROM deltas GROUP BY ALL""")
def _(spark, sf):
    d = L.long_metrics(patients(spark, sf)).select("subject", "target", "metric", "context_k").distinct()
    return L.contrast_grid(spark).join(d, ["target", "metric", "context_k"]).groupBy("target", "metric").agg(
        F.count_distinct("subject").alias("n_subjects"), F.count_distinct("contrast", "context_k").alias("n_cells")
    )


@query("paired_delta", f"{_CELL_COLS} subject a:d b:d delta:d", "deltas", "FROM deltas")
def _(spark, sf):
    return L.paired_delta(patients(spark, sf), L.contrast_grid(spark)).withColumn("delta", F.round("delta", 10))


cte("effects", "deltas", f"""
  SELECT {CELL}, count(*) AS n_patients, avg(delta) AS mean_delta, stddev_samp(delta) AS sd_delta, median(delta) AS median_delta,
    CASE WHEN stddev_samp(delta) > 0 THEN avg(delta) / stddev_samp(delta) END AS dz, count(*) FILTER (WHERE delta > 1e-12) AS wins,
    count(*) FILTER (WHERE abs(delta) <= 1e-12) AS ties, count(*) FILTER (WHERE delta < -1e-12) AS losses,
    count(*) FILTER (WHERE delta > 1e-12) / nullif(count(*) FILTER (WHERE abs(delta) > 1e-12), 0) AS win_share FROM deltas GROUP BY ALL""")
_EFFECT = "n_patients:i mean_delta:d median_delta:d sd_delta:d dz:d wins:i ties:i losses:i win_share:d"


@query("effect_summary", f"{_CELL_COLS} {_EFFECT}", "effects", "FROM effects")
def _(spark, sf):
    return L.effect_summary(deltas(spark, sf))




def boot_sql(source: str, keys: str, draws: int, seed: int) -> str:
    """Every resample as the counts of its ranks; a cell's mean is a product with its sorted deltas."""
    return f"""
  WITH cells AS (SELECT {keys}, list(delta ORDER BY delta, subject) AS v, count(*) AS n FROM {source} WHERE delta IS NOT NULL GROUP BY {keys}),
  heads AS (SELECT d, flatten(list([CAST(u & 4294967295 AS BIGINT), CAST(u >> 32 AS BIGINT), CAST(l & 4294967295 AS BIGINT), CAST(l >> 32 AS BIGINT)] ORDER BY j)) AS h
    FROM (SELECT d, j, md5_number_upper(concat_ws('|', {seed}, d, j)) AS u, md5_number_lower(concat_ws('|', {seed}, d, j)) AS l
      FROM range({draws}) a(d), range((SELECT (max(n) + 3) // 4 FROM cells)) b(j)) GROUP BY d),
  ranks AS (SELECT n, list_sort(list_transform(h[1:n], lambda x: x % n)) AS r FROM heads, (SELECT DISTINCT n FROM cells)),
  picked AS (SELECT n, r[(n - 1) // 2 + 1] AS low, r[n // 2 + 1] AS high,
    list_transform(range(n), lambda k: CAST(len(list_filter(r, lambda x: x = k)) AS DOUBLE)) AS times FROM ranks),
  vals AS (SELECT {keys}, list_inner_product(times, v) / n AS mean, (v[low + 1] + v[high + 1]) / 2 AS middle FROM picked JOIN cells USING (n))
  SELECT {keys}, quantile_cont(mean, 0.025) AS ci_low, quantile_cont(mean, 0.975) AS ci_high,
    quantile_cont(middle, 0.025) AS median_low, quantile_cont(middle, 0.975) AS median_high FROM vals GROUP BY {keys}"""


for _s, _n in DRAWS.items():
    cte(f"boot{_s}", "deltas", boot_sql("deltas", CELL, _n, SEED))


@query("bootstrap_ci", f"{_CELL_COLS} ci_low:d ci_high:d", "boot", "FROM boot")
def _(spark, sf):
    return L.bootstrap_ci(deltas(spark, sf), DRAWS[""], SEED, L.CELL)


@query("bootstrap_ci_median", f"{_CELL_COLS} ci_low:d ci_high:d", "boot",
       f"SELECT {CELL}, median_low AS ci_low, median_high AS ci_high FROM boot")
def _(spark, sf):
    found = L.bootstrap_ci(deltas(spark, sf), DRAWS[""], SEED, L.CELL)
    return found.select(*L.CELL, F.col("median_low").alias("ci_low"), F.col("median_high").alias("ci_high"))


def _cell_sql(spec: tuple) -> str:
    k, t, m, c = spec
    return f"(context_k = {k} AND target = '{t}' AND metric = '{m}' AND contrast = '{c}')"


_NAMED = "CASE " + " ".join(f"WHEN {_cell_sql(s)} THEN '{n}'" for n, s in ({"primary": L.PRIMARY} | L.SECONDARY).items()) + " END"
cte("named_deltas", "deltas", f"SELECT *, {_NAMED} AS endpoint FROM deltas WHERE {_NAMED} IS NOT NULL")
cte("primary_deltas", "named_deltas", "SELECT * FROM named_deltas WHERE endpoint = 'primary'")
cte("secondary_deltas", "named_deltas", "SELECT * FROM named_deltas WHERE endpoint <> 'primary'")


def endpoint_deltas(spark, sf):
    return deltas(spark, sf).withColumn("endpoint", L.endpoint_name()).where("endpoint IS NOT NULL")


@query("bootstrap_ci_full", "endpoint ci_low:d ci_high:d", "named_deltas", boot_sql("named_deltas", "endpoint", DRAWS["_full"], ENDPOINT_BOOT_SEED))
def _(spark, sf):
    """200,000 seeded resamples of the primary and secondary endpoints."""
    return L.bootstrap_ci(endpoint_deltas(spark, sf), DRAWS["_full"], ENDPOINT_BOOT_SEED, ["endpoint"])


def mc_sql(source: str, keys: str, draws: int, seed: int) -> str:
    """Signs as one list a draw over all patients; a cell without some of them has zeros there."""
    return f"""
  WITH patients AS (SELECT DISTINCT subject FROM {source}),
  words AS (SELECT w, list(md5_number_upper(concat_ws('|', {seed}, w, subject)) ORDER BY subject) AS u,
    list(md5_number_lower(concat_ws('|', {seed}, w, subject)) ORDER BY subject) AS l FROM patients, range(({draws} + 127) // 128) t(w) GROUP BY w),
  signs AS (SELECT list_transform(CASE WHEN b < 64 THEN u ELSE l END, lambda x: CASE WHEN (x >> (b % 64)) & 1 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END) AS s
    FROM words, range(128) r(b) WHERE w * 128 + b < {draws}),
  cells AS (SELECT {keys}, list(coalesce(delta, 0) ORDER BY subject) AS v, count(delta) AS n,
    abs(sum(delta)) / count(delta) - 1e-15 - sum(abs(delta)) * pow(2, -52) AS bar
    FROM (SELECT DISTINCT {keys} FROM {source} WHERE delta IS NOT NULL) CROSS JOIN patients LEFT JOIN {source} USING ({keys}, subject) GROUP BY {keys})
  SELECT *, {draws} AS n_draws, (n_extreme + 1) / {draws + 1}.0 AS p_mc
  FROM (SELECT {keys}, count(*) FILTER (WHERE abs(list_inner_product(s, v)) / n >= bar) AS n_extreme FROM signs, cells GROUP BY {keys})"""


cte("signflip", "deltas", mc_sql("deltas", CELL, DRAWS[""], SEED))


@query("signflip_mc", f"{_CELL_COLS} n_extreme:i n_draws:i p_mc:d", "signflip", "FROM signflip")
def _(spark, sf):
    return L.signflip_mc(deltas(spark, sf), DRAWS[""], SEED, L.CELL)


_D = DRAWS[""]


@query("signflip_mc_interval", f"{_CELL_COLS} closed_low:d closed_high:d", "signflip", f"""
  SELECT {CELL}, CASE WHEN n_extreme = 0 THEN 0 WHEN n_extreme = {_D} THEN exp(ln(0.025) / {_D}) END AS closed_low,
    CASE WHEN n_extreme = 0 THEN 1 - exp(ln(0.025) / {_D}) WHEN n_extreme = {_D} THEN 1 END AS closed_high FROM signflip""")
def _(spark, sf):
    """The tail interval where a closed form exists; the general one has no SQL form."""
    r = L.signflip_mc(deltas(spark, sf), _D, SEED, L.CELL)
    edge = (F.col("n_extreme") == 0) | (F.col("n_extreme") == _D)
    return r.select(*L.CELL, F.when(edge, F.col("mc_ci_low")).alias("closed_low"), F.when(edge, F.col("mc_ci_high")).alias("closed_high"))


for _s, (_a, _b) in ENDPOINT_DRAWS.items():
    cte(f"named_mc{_s}", "primary_deltas secondary_deltas", f"""
  FROM ({mc_sql("primary_deltas", "endpoint", _a, ENDPOINT_SEEDS[0])}) UNION ALL FROM ({mc_sql("secondary_deltas", "endpoint", _b, ENDPOINT_SEEDS[1])})""")


def endpoint_mc(suffix):
    return lambda d: L.endpoint_mc(d, *ENDPOINT_DRAWS[suffix], *ENDPOINT_SEEDS)


@query("signflip_mc_full", "endpoint n_extreme:i n_draws:i p_mc:d9", "named_mc_full", "FROM named_mc_full")
def _(spark, sf):
    """Ten million seeded sign flips of the primary endpoint, two million of each secondary one."""
    return endpoint_mc("_full")(endpoint_deltas(spark, sf))


_RCELL = f"{CELL}, region"
cte("signflip_exact", "region_deltas", f"""
  WITH n AS (SELECT *, row_number() OVER (PARTITION BY {_RCELL} ORDER BY delta) - 1 AS i, count(*) OVER (PARTITION BY {_RCELL}) AS n
    FROM region_deltas WHERE abs(delta) > 1e-15)
  SELECT {_RCELL}, coalesce(n_nonzero, 0) AS n_nonzero, coalesce(n_extreme, 1) AS n_extreme, coalesce(n_total, 1) AS n_total,
    coalesce(n_extreme / n_total, 1) AS p_exact FROM (SELECT DISTINCT {_RCELL} FROM region_deltas) LEFT JOIN (
  SELECT {_RCELL}, max(n) AS n_nonzero, count(*) FILTER (WHERE s / n >= observed / n - 1e-15) AS n_extreme, count(*) AS n_total
  FROM (SELECT {_RCELL}, mask, max(n) AS n, abs(sum(CASE WHEN (mask >> i) & 1 = 1 THEN delta ELSE -delta END ORDER BY i)) AS s, abs(sum(delta ORDER BY i)) AS observed
    FROM n, (SELECT unnest(range(32)) AS mask) WHERE mask < (1 << n) GROUP BY {_RCELL}, mask) GROUP BY {_RCELL}) USING ({_RCELL})""")


@query("signflip_exact", f"{_CELL_COLS} region:i n_nonzero:i n_extreme:i n_total:i p_exact:d", "signflip_exact", "FROM signflip_exact")
def _(spark, sf):
    return L.signflip_exact(region_deltas(spark, sf), REGION_CELL)


cte("sign_test", "deltas", f"""
  SELECT {CELL}, wins, losses, n, CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(least(wins, losses) + 1),
    lambda i: exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - CASE WHEN i = n THEN 0 ELSE lgamma(n - i + 1) END - n * ln(2))))) END AS p_sign
  FROM (SELECT {CELL}, count(*) FILTER (WHERE delta > 0) AS wins, count(*) FILTER (WHERE delta < 0) AS losses,
    count(*) FILTER (WHERE delta <> 0) AS n FROM deltas GROUP BY ALL)""")


@query("sign_test", f"{_CELL_COLS} wins:i losses:i n:i p_sign:d", "sign_test", "FROM sign_test")
def _(spark, sf):
    return L.sign_test(deltas(spark, sf))


cte("signed", "deltas", f"""
  SELECT *, rank() OVER (PARTITION BY {CELL} ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY {CELL}, abs(delta)) - 1) / 2.0 AS r,
    count(*) OVER (PARTITION BY {CELL}, abs(delta)) AS t FROM deltas WHERE delta <> 0""")
cte("wilcoxon", "deltas signed", f"""
  SELECT {CELL}, coalesce(n, 0) AS n_nonzero, w, CASE WHEN n * (n + 1) * (2 * n + 1) / 24 - tie / 48 > 0
    THEN (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48) END AS z
  FROM (SELECT DISTINCT {CELL} FROM deltas) LEFT JOIN (SELECT {CELL}, CAST(count(*) AS DOUBLE) AS n, least(coalesce(sum(r) FILTER (WHERE delta > 0), 0), coalesce(sum(r) FILTER (WHERE delta < 0), 0)) AS w,
    sum(CAST(t * t - 1 AS DOUBLE)) AS tie FROM signed GROUP BY ALL) USING ({CELL})""")


@query("wilcoxon", f"{_CELL_COLS} n_nonzero:i w:d z:d", "wilcoxon", "FROM wilcoxon")
def _(spark, sf):
    return L.wilcoxon(deltas(spark, sf))


cte("rank_sums", "", """
  WITH RECURSIVE dp(n, f) AS (SELECT 0, [1.0::DOUBLE] UNION ALL SELECT n + 1, list_transform(range(0, (n + 1) * (n + 2) // 2 + 1),
    lambda s: coalesce(f[s + 1], 0) + CASE WHEN s > n THEN coalesce(f[s - n], 0) ELSE 0 END) FROM dp WHERE n < 50) SELECT * FROM dp""")
cte("wilcoxon_plain", "deltas wilcoxon rank_sums", f"""
  SELECT {CELL}, is_exact, CASE WHEN is_exact THEN least(1.0, 2 * list_sum(f[1:CAST(w AS INT) + 1]) / pow(2, n)) END AS p_exact
  FROM (SELECT {CELL}, count(*) AS n, count(*) <= 50 AND count(DISTINCT abs(delta)) = count(*) AND count(*) FILTER (WHERE delta = 0) = 0 AS is_exact
    FROM deltas GROUP BY ALL) JOIN wilcoxon USING ({CELL}) LEFT JOIN rank_sums r USING (n)""")


@query("wilcoxon_p", f"{_CELL_COLS} is_exact p_exact:d9", "wilcoxon_plain", "FROM wilcoxon_plain")
def _(spark, sf):
    """The automatic rule; the normal tail of cells with ties or zeros has no SQL form and is tested on fixtures."""
    return L.wilcoxon_auto(deltas(spark, sf)).withColumn("p_exact", F.when(F.col("is_exact"), F.col("p_wilcoxon")))


@query("wilcoxon_exact", f"{_CELL_COLS} region:i n_nonzero:i p_wilcoxon:d", "region_deltas", f"""
  WITH n AS (SELECT *, rank() OVER (PARTITION BY {_RCELL} ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY {_RCELL}, abs(delta)) - 1) / 2.0 AS r,
      row_number() OVER (PARTITION BY {_RCELL} ORDER BY abs(delta), subject) - 1 AS i, count(*) OVER (PARTITION BY {_RCELL}) AS n
      FROM region_deltas WHERE delta <> 0)
  SELECT {_RCELL}, coalesce(n_nonzero, 0) AS n_nonzero, coalesce(p, 1) AS p_wilcoxon FROM (SELECT DISTINCT {_RCELL} FROM region_deltas) LEFT JOIN (
  SELECT {_RCELL}, max(n) AS n_nonzero, least(1, count(*) FILTER (WHERE s >= observed) / count(*)) AS p
  FROM (SELECT {_RCELL}, mask, max(n) AS n, abs(sum(CASE WHEN (mask >> i) & 1 = 1 THEN r ELSE -r END)) AS s,
      abs(sum(CASE WHEN delta > 0 THEN r ELSE -r END)) AS observed
    FROM n, (SELECT unnest(range(32)) AS mask) WHERE mask < (1 << n) GROUP BY {_RCELL}, mask) GROUP BY {_RCELL}) USING ({_RCELL})""")
def _(spark, sf):
    return L.wilcoxon_exact(region_deltas(spark, sf), REGION_CELL)


cte("rank_biserial", "deltas signed", f"""
  SELECT {CELL}, coalesce(rb, 0) AS rank_biserial FROM (SELECT DISTINCT {CELL} FROM deltas)
  LEFT JOIN (SELECT {CELL}, sum(CASE WHEN delta > 0 THEN r ELSE -r END) / sum(r) AS rb FROM signed GROUP BY ALL) USING ({CELL})""")


@query("rank_biserial", f"{_CELL_COLS} rank_biserial:d", "rank_biserial", "FROM rank_biserial")
def _(spark, sf):
    return L.rank_biserial(deltas(spark, sf))


def holm_sql(source: str, p: str, family: str, ids: str, out: str) -> str:
    part = f"PARTITION BY {family}" if family else ""
    keys = f"{family}, {ids}" if family else ids
    return f"""
  SELECT s.*, {out} FROM {source} s LEFT JOIN (
    SELECT {keys}, least(1.0, max((m - r + 1) * {p}) OVER ({part} ORDER BY r)) AS {out} FROM (
      SELECT *, row_number() OVER ({part} ORDER BY {p}, {ids}) AS r, count(*) OVER ({part}) AS m FROM {source} WHERE {p} IS NOT NULL)) h USING ({keys})"""


@query("holm", f"{_CELL_COLS} p_sign:d holm:d", "sign_test", holm_sql("sign_test", "p_sign", "target, metric", "contrast, context_k", "holm"))
def _(spark, sf):
    return L.holm(L.sign_test(deltas(spark, sf)), "p_sign", "holm", ["target", "metric"], ["contrast", "context_k"])


cte("improvement", "deltas", f"""
  SELECT {CELL}, avg((b - a) / greatest(abs(b), 1e-12) * 100) AS relative_improvement_pct FROM deltas WHERE metric = 'mae' GROUP BY ALL""")


@query("relative_improvement", f"{_CELL_COLS} relative_improvement_pct:d", "improvement", "FROM improvement")
def _(spark, sf):
    return L.relative_improvement(deltas(spark, sf))


for _s, _n in DRAWS.items():
    cte(f"signflip2{_s}", "deltas", mc_sql("deltas", CELL, _n, SEED + 1))
# all sign patterns of at most 20 non-zero deltas, by doubling; the first sum is the observed one
cte("exact_p", "deltas", f"""
  WITH RECURSIVE small AS (SELECT {CELL}, list(delta ORDER BY delta) AS v, count(*) AS n FROM deltas WHERE abs(delta) > 1e-15 GROUP BY {CELL} HAVING count(*) <= 20),
  flips AS (SELECT *, 0 AS i, [CAST(0 AS DOUBLE)] AS s FROM small UNION ALL
    SELECT {CELL}, v, n, i + 1, list_concat(list_transform(s, lambda x: x + v[i + 1]), list_transform(s, lambda x: x - v[i + 1])) FROM flips WHERE i < n)
  SELECT {CELL}, len(list_filter(s, lambda x: abs(x) / n >= abs(s[1]) / n - 1e-15)) / len(s) AS p_exact FROM flips WHERE i = n
  UNION ALL SELECT {CELL}, 1.0 FROM deltas WHERE delta IS NOT NULL GROUP BY {CELL} HAVING count(*) FILTER (WHERE abs(delta) > 1e-15) = 0""")
# the normal tail by Simpson's rule
cte("wilcoxon_p", "wilcoxon wilcoxon_plain", f"""
  SELECT {CELL}, CASE WHEN n_nonzero = 0 THEN 1.0 WHEN is_exact THEN p_exact ELSE 1 - sqrt(2 / pi()) * abs(z) / 1200 * list_sum(list_transform(range(401),
    lambda i: CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(i * z / 400, 2) / 2))) END AS p_wilcoxon
  FROM wilcoxon JOIN wilcoxon_plain USING ({CELL})""")
for _s in DRAWS:
    cte(f"summary{_s}", f"effects grid boot{_s} rank_biserial wilcoxon wilcoxon_p sign_test signflip2{_s} exact_p improvement", f"""
  SELECT e.*, ci_low, ci_high, median_low, median_high, rank_biserial, w, z, p_wilcoxon, p_sign, coalesce(p_exact, p_mc) AS p_signflip, relative_improvement_pct,
    condition_a, condition_b, CASE WHEN lower_is_better THEN condition_b || ' - ' || condition_a ELSE condition_a || ' - ' || condition_b END AS delta_definition
  FROM effects e JOIN grid USING ({CELL}) LEFT JOIN boot{_s} USING ({CELL}) LEFT JOIN rank_biserial USING ({CELL})
  LEFT JOIN (SELECT {CELL}, w, z FROM wilcoxon) USING ({CELL}) LEFT JOIN wilcoxon_p USING ({CELL}) LEFT JOIN (SELECT {CELL}, p_sign FROM sign_test) USING ({CELL})
  LEFT JOIN (SELECT {CELL}, p_mc FROM signflip2{_s}) USING ({CELL}) LEFT JOIN exact_p USING ({CELL}) LEFT JOIN improvement USING ({CELL})""")


def summary(spark, sf, suffix=""):
    n = DRAWS[suffix]
    return stage(spark, sf, f"summary{suffix}", lambda: L.contrast_summary(deltas(spark, sf), L.contrast_grid(spark), n, n, SEED))


def endpoints(spark, sf, suffix=""):
    return stage(spark, sf, f"endpoints{suffix}", lambda: L.endpoint_table(deltas(spark, sf), endpoint_mc(suffix)))


_SUMMARY = (
    f"{_CELL_COLS} condition_a condition_b delta_definition {_EFFECT} ci_low:d ci_high:d median_low:d median_high:d "
    "rank_biserial:d w:d z:d p_wilcoxon:d p_sign:d p_signflip:d relative_improvement_pct:d"
)


def _tables(suffix: str) -> None:
    """The tables and verdicts that rest on resamples, at one size of draws."""
    cte(f"flagged{suffix}", f"summary{suffix}", f"""
  SELECT {CELL}, p_signflip, {_cell_sql(L.PRIMARY)} AS is_primary, {" OR ".join(_cell_sql(s) for s in L.SECONDARY.values())} AS is_secondary,
    CASE WHEN {" OR ".join(_cell_sql(s) for s in L.SECONDARY.values())} THEN p_signflip END AS p2 FROM summary{suffix}""")
    cte(f"flagged_all{suffix}", f"flagged{suffix}", holm_sql(f"flagged{suffix}", "p_signflip", "", CELL, "holm_all"))
    cte(f"endpoints{suffix}", f"named_deltas named_mc{suffix}", f"""
  SELECT *, CASE WHEN endpoint <> 'primary' THEN p_mc END AS p2, mean_delta > 0 AND p_mc < 0.05 AS supported FROM (
    SELECT endpoint, count(*) AS n_patients, avg(delta) AS mean_delta, median(delta) AS median_delta, count(*) FILTER (WHERE delta > 0) AS wins,
      count(*) FILTER (WHERE abs(delta) <= 1e-15) AS ties, count(*) FILTER (WHERE delta < 0) AS losses FROM named_deltas GROUP BY endpoint)
  JOIN named_mc{suffix} USING (endpoint)""")

    @query(f"contrast_summary{suffix}", _SUMMARY, f"summary{suffix}", f"FROM summary{suffix}")
    def _(spark, sf):
        """All contrasts; p_signflip is exact where a cell has at most 20 non-zero deltas."""
        return summary(spark, sf, suffix)

    @query(f"endpoint_flags{suffix}", f"{_CELL_COLS} p_signflip:d is_primary is_secondary holm_all:d holm_secondary:d", f"flagged_all{suffix}",
           holm_sql(f"flagged_all{suffix}", "p2", "", CELL, "holm_secondary"))
    def _(spark, sf):
        return L.endpoint_flags(summary(spark, sf, suffix), "p_signflip")

    @query(f"correspondence_trajectory{suffix}", f"{_CELL_COLS} mean_delta:d ci_low:d ci_high:d", f"summary{suffix}", f"""
  SELECT * FROM summary{suffix} WHERE contrast = 'relation_vs_relation_perm' ORDER BY target, metric, context_k""")
    def _(spark, sf):
        return L.correspondence_trajectory(summary(spark, sf, suffix))

    @query(f"endpoint_table{suffix}", "endpoint n_patients:i mean_delta:d median_delta:d wins:i ties:i losses:i n_draws:i p_mc:d9 holm_adjusted_p:d9 supported",
           f"endpoints{suffix}", holm_sql(f"endpoints{suffix}", "p2", "", "endpoint", "holm_adjusted_p"))
    def _(spark, sf):
        return endpoints(spark, sf, suffix)

    @query(f"support_rule{suffix}", "endpoint supported", f"endpoints{suffix}", f"SELECT endpoint, supported FROM endpoints{suffix}")
    def _(spark, sf):
        return endpoints(spark, sf, suffix)


for _s in DRAWS:
    _tables(_s)


# ---- stress tests: late target at the largest context ---------------------------------------------------


def late_rows(spark, sf):
    return rows(spark, sf).where("context_k = 10")


def _variants(spark, sf, variants: dict):
    """Query rows with one prediction column per variant, nine digits so that ties stay ties."""
    rel = H.with_relation(late_rows(spark, sf), variants)
    base = F.col("pop_late") + F.col("c_late") + F.col("a_late")
    return rel.select(
        "subject", "repeat", "stim_site", "recording_channel", "distance_to_stim", "true_late",
        *[F.round(base + F.col(f"{v}_late"), 9).alias(v) for v in variants],
    )


_KEYS = ["subject", "repeat"]


def _levels(spark, sf):
    key = H.row_seed(SEED)
    names = {f"level_{f}": f"l{i}" for i, f in enumerate(M.LEVELS)}
    cols = {f"l{i}": M.permute_fraction(F.col("slots"), key, f) for i, f in enumerate(M.LEVELS)}
    written = stage(spark, sf, "levels", lambda: _variants(spark, sf, cols))
    return stage(spark, sf, "level_scores", lambda: M.variant_scores(written, _KEYS, "true_late", names))


def _controls(spark, sf):
    slots = F.col("slots")
    label = lambda x: pair_label(x["stim_site"])
    cols = {
        "relation": slots,
        "permuted": H.permute_slots(slots, H.row_seed(SEED)),
        "distance_swap": M.swap_by_distance(slots),
        "label_rotation": M.rotate_within_label(slots, label),
        "distance_swap_in_label": M.swap_by_distance_in_label(slots, label),
    }
    return _variants(spark, sf, cols)


def control_rows(spark, sf):
    return stage(spark, sf, "controls", lambda: _controls(spark, sf))


CONTROLS = ("relation", "permuted", "distance_swap", "label_rotation", "distance_swap_in_label")
_Q = "subject, repeat, stim_site, recording_channel"
_N = "CAST(regexp_extract(slot_site, '#([0-9]+)', 1) AS INT)"
cte("late_slots", "slots", f"""
  SELECT *, 'T' || ({_N} % 3) || '--U' || ({_N} % 2) AS label,
    row_number() OVER (PARTITION BY {_Q} ORDER BY slot_distance, slot_site) AS dpos,
    count(*) OVER (PARTITION BY {_Q}) AS n,
    row_number() OVER (PARTITION BY {_Q}, 'T' || ({_N} % 3) || '--U' || ({_N} % 2) ORDER BY slot_site) AS lpos,
    row_number() OVER (PARTITION BY {_Q}, 'T' || ({_N} % 3) || '--U' || ({_N} % 2) ORDER BY slot_distance, slot_site) AS ldpos,
    count(*) OVER (PARTITION BY {_Q}, 'T' || ({_N} % 3) || '--U' || ({_N} % 2)) AS ln,
    ('0x' || substr(md5(concat_ws('|', {SEED}, subject, context_k, repeat, stim_site, 'mix', slot_site)), 1, 8))::BIGINT / 4294967296.0 AS mix
  FROM slots WHERE context_k = 10""")
_SWAP = "CASE WHEN {p} % 2 = 1 THEN CASE WHEN {p} < {n} THEN {p} + 1 ELSE {p} END ELSE {p} - 1 END"
cte("donated", "late_slots", f"""
  SELECT s.*, p.r_late AS r_perm, d.r_late AS r_swap, l.r_late AS r_rot, m.r_late AS r_lswap
  FROM (SELECT *, {_SWAP.format(p="dpos", n="n")} AS dd, lpos % ln + 1 AS ld, {_SWAP.format(p="ldpos", n="ln")} AS ldd FROM late_slots) s
  JOIN (SELECT {_Q}, hash_pos AS pos, r_late FROM late_slots) p USING ({_Q}, pos)
  JOIN (SELECT {_Q}, dpos AS dd, r_late FROM late_slots) d USING ({_Q}, dd)
  JOIN (SELECT {_Q}, label, lpos AS ld, r_late FROM late_slots) l USING ({_Q}, label, ld)
  JOIN (SELECT {_Q}, label, ldpos AS ldd, r_late FROM late_slots) m USING ({_Q}, label, ldd)""")
_T = "sum(w * {r}) / (1 + sum(w))"
_MIX = ", ".join(f"{_T.format(r=f'CASE WHEN mix < {f} THEN r_perm ELSE r_late END')} AS l{i}" for i, f in enumerate(M.LEVELS))
cte("stress_t", "donated", f"""
  SELECT {_Q}, {_T.format(r="r_late")} AS relation, {_T.format(r="r_perm")} AS permuted, {_T.format(r="r_swap")} AS distance_swap,
    {_T.format(r="r_rot")} AS label_rotation, {_T.format(r="r_lswap")} AS distance_swap_in_label, {_MIX} FROM donated GROUP BY ALL""")
_ALL = [*CONTROLS, *[f"l{i}" for i in range(len(M.LEVELS))]]
cte("stress_rows", "qrows stress_t", f"""
  SELECT {_Q}, distance_to_stim, true_late, {", ".join(f"round(pop_late + c_late + a_late + coalesce({v}, 0), 9) AS {v}" for v in _ALL)}
  FROM (FROM qrows WHERE context_k = 10) LEFT JOIN stress_t USING ({_Q})""")


def _spearman_sql(source: str, keys: str, y: str, p: str) -> str:
    rank = lambda v: f"rank() OVER (PARTITION BY {keys} ORDER BY {v}) + (count(*) OVER (PARTITION BY {keys}, {v}) - 1) / 2.0"
    return f"""SELECT {keys}, CASE WHEN count(*) >= 3 AND stddev_pop({y}) >= 1e-12 AND stddev_pop({p}) >= 1e-12
    THEN covar_pop(ry, rp) / (stddev_pop(ry) * stddev_pop(rp)) END AS spearman
  FROM (SELECT {keys}, {y}, {p}, {rank(y)} AS ry, {rank(p)} AS rp FROM {source}) GROUP BY {keys}"""


_KEYTXT = "subject, repeat"
cte("level_scores", "stress_rows", " UNION ALL ".join(
    f"SELECT *, 'level_{f}' AS variant FROM ({_spearman_sql('stress_rows', _KEYTXT, 'true_late', f'l{i}')})" for i, f in enumerate(M.LEVELS)
))
cte("control_scores", "stress_rows", " UNION ALL ".join(
    f"SELECT *, '{c}' AS variant FROM ({_spearman_sql('stress_rows', _KEYTXT, 'true_late', c)})" for c in CONTROLS
))
cte("collision_curve", "level_scores", """
  SELECT subject, repeat, variant, spearman, spearman - max(spearman) FILTER (WHERE variant = 'level_1.0') OVER (PARTITION BY subject, repeat) AS delta
  FROM level_scores""")
cte("matched_controls", "control_scores", """
  SELECT * FROM (SELECT subject, repeat, variant, spearman,
    max(spearman) FILTER (WHERE variant = 'relation') OVER (PARTITION BY subject, repeat) - spearman AS delta FROM control_scores)
  WHERE variant <> 'relation'""")


def curve(spark, sf):
    return stage(spark, sf, "curve", lambda: M.collision_curve(_levels(spark, sf), _KEYS))


def controls(spark, sf):
    def build():
        scores = M.variant_scores(control_rows(spark, sf), _KEYS, "true_late", {c: c for c in CONTROLS})
        return M.matched_controls(scores, _KEYS)

    return stage(spark, sf, "matched", build)


@query("permute_fraction", "subject repeat:i variant spearman:d", "level_scores", "FROM level_scores")
def _(spark, sf):
    return _levels(spark, sf)


@query("collision_curve", "subject repeat:i variant spearman:d delta:d", "collision_curve", "FROM collision_curve")
def _(spark, sf):
    return curve(spark, sf)


_PAIRCOLS = "subject repeat:i stim_site recording_channel"


@query("swap_by_distance", f"{_PAIRCOLS} distance_swap:d", "stress_rows", "FROM stress_rows")
def _(spark, sf):
    return control_rows(spark, sf)


@query("rotate_within_label", f"{_PAIRCOLS} label_rotation:d", "stress_rows", "FROM stress_rows")
def _(spark, sf):
    return control_rows(spark, sf)


@query("swap_by_distance_in_label", f"{_PAIRCOLS} distance_swap_in_label:d", "stress_rows", "FROM stress_rows")
def _(spark, sf):
    return control_rows(spark, sf)


@query("matched_controls", "subject repeat:i variant spearman:d delta:d", "matched_controls", "FROM matched_controls")
def _(spark, sf):
    return controls(spark, sf)


def _delta_sql(source: str, key: str) -> str:
    keys = f"{_KEYTXT}, {key}"
    return f"""SELECT {keys}, n_pairs, CASE WHEN n_pairs >= 10 THEN a.spearman - b.spearman END AS delta
  FROM (SELECT {keys}, count(*) AS n_pairs FROM {source} GROUP BY ALL)
  JOIN ({_spearman_sql(source, keys, 'true_late', 'relation')}) a USING ({keys})
  JOIN ({_spearman_sql(source, keys, 'true_late', 'permuted')}) b USING ({keys})"""


cte("binned", "stress_rows", """
  SELECT *, CASE WHEN distance_to_stim < 20 THEN 1 WHEN distance_to_stim < 40 THEN 2 WHEN distance_to_stim < 80 THEN 3 ELSE 4 END AS distance_bin
  FROM stress_rows WHERE distance_to_stim >= 10""")
cte("reached", "stress_rows", """
  SELECT * FROM stress_rows, (SELECT unnest([10.0, 15.0, 20.0, 30.0, 40.0]::DOUBLE[]) AS min_distance) WHERE distance_to_stim >= min_distance""")


@query("distance_bins", "subject repeat:i distance_bin:i n_pairs:i delta:d", "binned", _delta_sql("binned", "distance_bin"))
def _(spark, sf):
    return M.distance_bins(control_rows(spark, sf), _KEYS, "true_late", "relation", "permuted")


@query("distance_thresholds", "subject repeat:i min_distance:d n_pairs:i delta:d", "reached", _delta_sql("reached", "min_distance"))
def _(spark, sf):
    return M.distance_thresholds(control_rows(spark, sf), _KEYS, "true_late", "relation", "permuted")


@query("stress_patient_means", "subject variant n_values:i mean_value:d", "collision_curve matched_controls", """
  SELECT subject, variant, count(delta) AS n_values, avg(delta) AS mean_value FROM (FROM collision_curve UNION ALL FROM matched_controls) GROUP BY ALL""")
def _(spark, sf):
    return M.stress_patient_means(curve(spark, sf).unionByName(controls(spark, sf)), ["subject", "variant"])


@query("check_reproduces", "n_common:i max_difference:d passed", "matched_controls deltas", f"""
  SELECT count(*) AS n_common, max(abs(mean_value - delta)) AS max_difference, max(abs(mean_value - delta)) <= 1e-5 AS passed FROM (
    SELECT subject, avg(delta) AS mean_value FROM matched_controls WHERE variant = 'permuted' GROUP BY subject)
  JOIN (SELECT subject, delta FROM deltas WHERE {_cell_sql(L.PRIMARY)}) USING (subject)""")
def _(spark, sf):
    """The stress run must give the primary deltas again."""
    again = M.stress_patient_means(controls(spark, sf).where("variant = 'permuted'"), ["subject"])
    primary = deltas(spark, sf).where(_cell_sql(L.PRIMARY)).select("subject", F.col("delta").alias("mean_value"))
    return M.check_reproduces(again, primary, ["subject"], "mean_value")
