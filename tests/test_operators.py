"""Operators on small hand-made tables."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkmap.operators import bridge, eligibility, geometry, hierarchy, inference as L, metrics, quality, response, stress
from sparkmap.plans import context as P
from tests.published_deltas import DELTAS

ONE = ["cell"]


def cell_deltas(spark, values):
    return spark.createDataFrame([("c", f"s{i:04d}", float(v)) for i, v in enumerate(values)], "cell string, subject string, delta double")


# ---- inference ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("values, p", [([1, 2, 3], 0.25), ([1, 2, 3, 0], 0.25), ([1, 2, -1, 4], 0.375), ([0, 0, 0], 1.0)])
def test_signflip_exact(spark, values, p):
    assert L.signflip_exact(cell_deltas(spark, values), ONE).first()["p_exact"] == p


@pytest.mark.parametrize("values, p", [([1] * 4 + [-1], 0.375), ([1] * 71 + [-1] * 3, 7.157428404298838e-18), ([0, 0], 1.0)])
def test_sign_test(spark, values, p):
    assert L.sign_test(cell_deltas(spark, values), ONE).first()["p_sign"] == pytest.approx(p, rel=1e-12)


@pytest.mark.parametrize("values, rb", [([1, 2, -3], 0.0), ([1, -1, 2], 0.5), ([0, 0], 0.0)])
def test_rank_biserial(spark, values, rb):
    assert L.rank_biserial(cell_deltas(spark, values), ONE).first()["rank_biserial"] == rb


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "id string, p double")
    got = {r["id"]: r["h"] for r in L.holm(df, "p", "h", [], ["id"]).collect()}
    assert got == {"a": pytest.approx(0.03), "b": pytest.approx(0.06), "c": pytest.approx(0.06), "d": None}


def test_wilcoxon_of_zeros(spark):
    r = L.wilcoxon(cell_deltas(spark, [0, 0, 0]), ONE).first()
    assert r["n_nonzero"] == 0 and r["p_wilcoxon"] == 1.0


def test_wilcoxon_exact(spark):
    # W = 0 of 5: two of 32 sign patterns are as extreme
    assert L.wilcoxon_exact(cell_deltas(spark, [1, 2, 3, 4, 5]), ONE).first()["p_wilcoxon"] == 2 / 32
    # ties: ranks 1.5 1.5 3.5 3.5, W- = 1.5; sums of at most 1.5 in 3 of 16 patterns
    assert L.wilcoxon_exact(cell_deltas(spark, [1, -1, 2, 2]), ONE).first()["p_wilcoxon"] == 6 / 16
    assert L.wilcoxon_exact(cell_deltas(spark, [0, 0]), ONE).first()["p_wilcoxon"] == 1.0
    auto = L.wilcoxon_auto(cell_deltas(spark, [float(x) for x in range(1, 22)]), ONE).first()
    assert auto["is_exact"] and auto["p_wilcoxon"] == pytest.approx(2 / 2**21)
    assert not L.wilcoxon_auto(cell_deltas(spark, [1, 1, 2]), ONE).first()["is_exact"]


def test_win_share_leaves_ties_out(spark):
    assert L.effect_summary(cell_deltas(spark, [1, 1, -1, 0]), ONE).first()["win_share"] == pytest.approx(2 / 3)
    assert L.effect_summary(cell_deltas(spark, [0, 0]), ONE).first()["win_share"] is None


def test_published_inference(spark):
    d = cell_deltas(spark, DELTAS)
    e = L.effect_summary(d, ONE, L.TIE_EXTERNAL, strict_wins=True).first()
    assert e["mean_delta"] == pytest.approx(0.03732822177853643, rel=1e-13)
    assert e["median_delta"] == pytest.approx(0.030232770117554916, rel=1e-13)
    assert (e["wins"], e["ties"], e["losses"]) == (71, 0, 3)
    assert L.sign_test(d, ONE).first()["p_sign"] == pytest.approx(7.157428404298838e-18, rel=1e-12)
    w = L.wilcoxon(d, ONE).first()
    assert w["w"] == 24 and w["p_wilcoxon"] == pytest.approx(2.0499718078655237e-13, rel=1e-9)
    mc = L.signflip_mc(d, 2_000_000, 20260927, ONE).first()
    assert mc["n_extreme"] == 0 and mc["p_mc"] == pytest.approx(4.99999750000125e-07)
    assert mc["mc_ci_high"] == pytest.approx(1.8444380260790605e-06)
    ci = L.bootstrap_ci(d, 200_000, 20260928, ONE).first()
    assert ci["ci_low"] == pytest.approx(0.031326, abs=1e-4) and ci["ci_high"] == pytest.approx(0.043599, abs=1e-4)


def test_monte_carlo_forms_agree_with_enumeration(spark):
    values = [0.5, -0.2, 0.9, 0.3, -0.6, 0.8, 0.1, 0.4]
    d = cell_deltas(spark, values)
    exact = L.signflip_exact(d, ONE).first()["p_exact"]
    signs = np.array(list(itertools.product((1, -1), repeat=8)))
    assert exact == np.mean(np.abs(signs @ values) >= abs(sum(values)) - 1e-12)
    r = L.signflip_mc(d, 200_000, 5, ONE).first()
    assert r["mc_ci_low"] - 2e-3 <= exact <= r["mc_ci_high"] + 2e-3


def test_blocks_do_not_depend_on_parallelism(spark):
    d = cell_deltas(spark, DELTAS)
    runs = []
    for n in (1, 7):
        spread = d.repartition(n)
        runs.append((L.bootstrap_ci(spread, 20_000, 1, ONE).first(), L.signflip_mc(spread.withColumn("delta", F.col("delta") - 0.03), 100_000, 1, ONE).first()))
    assert runs[0] == runs[1]


def test_contrast_grid(spark):
    assert L.contrast_grid(spark).count() == 112


# ---- metrics --------------------------------------------------------------------------------------------


def test_metrics_safe(spark):
    rows = [("a", y, p) for y, p in zip([1, 2, 2, 3], [1, 3, 2, 4])] + [("b", 1, p) for p in (1, 2, 3)] + [("c", 1, 2), ("c", 2, 1)]
    df = spark.createDataFrame([(g, float(y), float(p)) for g, y, p in rows], "g string, y double, p double")
    rho = {r["g"]: r["spearman"] for r in metrics.spearman_safe(df, ["g"], "y", "p").collect()}
    assert rho == {"a": pytest.approx(0.948683298), "b": None, "c": None}
    r = {r["g"]: r["r"] for r in df.groupBy("g").agg(metrics.pearson_safe("y", "p").alias("r")).collect()}
    assert r["b"] is None and r["c"] is None and r["a"] == pytest.approx(np.corrcoef([1, 2, 2, 3], [1, 3, 2, 4])[0, 1])


def test_top_recall_with_ties(spark):
    # 20 rows: k = 2; four rows share the largest truth, so the keys a and b are in
    df = spark.createDataFrame([("g", k, 5.0 if k in "abcd" else 1.0, 9.0 if k in "bz" else 0.0) for k in "abcdefghijklmnopqrsz"[:20]], "g string, k string, y double, p double")
    assert df.count() == 20
    assert metrics.top_recall(df, ["g"], "y", "p", ["k"]).first()["top10_recall"] == 0.5


def test_repeat_metrics_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s, k, r in itertools.product(["s1", "s2"], [3], [0, 1]):
        n = 400 if s == "s1" else 12  # a hot subject
        y = rng.integers(0, 20, (2, n)).astype(float)
        for cond in ("node", "relation"):
            p = np.round(y + rng.normal(size=(2, n)) * 5)
            rows += [(s, k, r, cond, f"q{i // 5:03d}", f"c{i % 5}", *map(float, (y[0, i], y[1, i], p[0, i], p[1, i]))) for i in range(n)]
    cols = ["subject", "context_k", "repeat", "condition", "query_site", "recording_channel", "true_early", "true_late", "pred_early", "pred_late"]
    pdf = pd.DataFrame(rows, columns=cols)
    got = metrics.repeat_metrics(spark.createDataFrame(pdf)).toPandas().set_index(metrics.REPEAT_KEYS).sort_index()
    assert len(got) == 16
    for (s, k, r, c, t), m in got.iterrows():
        g = pdf[(pdf.subject == s) & (pdf.repeat == r) & (pdf.condition == c)].sort_values(["query_site", "recording_channel"])
        y, p = g[f"true_{t}"], g[f"pred_{t}"]
        assert m.n_pairs == len(g) and m.mae == pytest.approx((y - p).abs().mean())
        assert m.pearson == pytest.approx(y.corr(p)) and m.spearman == pytest.approx(y.rank().corr(p.rank()))
        top = max(1, round(0.1 * len(g)))
        a, b = (set(np.argsort(-v.to_numpy(), kind="stable")[:top]) for v in (y, p))
        assert m.top10_recall == pytest.approx(len(a & b) / top)


# ---- plans ----------------------------------------------------------------------------------------------


def test_context_plan_properties(spark):
    sites = spark.createDataFrame([("s1", f"A{i:02d}") for i in range(12)] + [("s2", f"B{i:03d}") for i in range(300)], "subject string, stim_site string")
    ctx = P.context_sites(sites, (3, 10), 4).toPandas()
    again = P.context_sites(sites.repartition(7), (3, 10), 4).toPandas()
    key = ["subject", "context_k", "repeat", "stim_site"]
    assert set(map(tuple, ctx[key].values)) == set(map(tuple, again[key].values))
    q = P.query_sites(sites, spark.createDataFrame(ctx), (3, 10), 4).toPandas()
    for (s, k, r), g in ctx.groupby(key[:3]):
        rest = set(q[(q.subject == s) & (q.context_k == k) & (q["repeat"] == r)].stim_site)
        assert len(g) == k and not rest & set(g.stim_site) and len(rest) + k == (12 if s == "s1" else 300)


def test_context_window_is_limited_before_the_shuffle(spark):
    sites = spark.createDataFrame([("s1", "A")], "subject string, stim_site string")
    plan = P.context_sites(sites)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("n, n_val", [(19, 3), (30, 4), (57, 9), (70, 10), (12, 1)])
def test_internal_split(spark, n, n_val):
    sites = spark.createDataFrame([("s", f"x{i}") for i in range(n)], "subject string, stim_site string")
    assert P.internal_split(sites, 1).where("split = 'val'").count() == n_val


# ---- hierarchy and stress -------------------------------------------------------------------------------


def slots(spark, sites, distances, r):
    s = F.array(*[
        F.struct(
            F.lit(a).alias("stim_site"), F.lit(0.0).alias("pop_early"), F.lit(0.0).alias("pop_late"),
            F.lit(float(d)).alias("distance_to_stim"), F.lit(float(x)).alias("r_early"), F.lit(float(x)).alias("r_late"),
        )
        for a, d, x in zip(sites, distances, r)
    ])
    return spark.range(1).select(s.alias("slots"), F.lit("seed").alias("key"))


def donors(df, col):
    return [int(x["r_late"]) for x in df.select(col.alias("d")).first()["d"]]


def test_donor_rules(spark):
    df = slots(spark, "abc", [5, 1, 3], [0, 1, 2])
    assert donors(df, stress.swap_by_distance(F.col("slots"))) == [0, 2, 1]
    label = lambda x: F.when(x["stim_site"] == "c", "b").otherwise("a")
    df = slots(spark, "abcd", [4, 3, 2, 1], [0, 1, 2, 3])
    assert donors(df, stress.rotate_within_label(F.col("slots"), label)) == [1, 3, 2, 0]
    assert donors(df, stress.swap_by_distance_in_label(F.col("slots"), label)) == [0, 3, 2, 1]


def test_permutation_moves_and_keeps_values(spark):
    df = slots(spark, "abcdefgh", range(8), range(8))
    full = donors(df, hierarchy.permute_slots(F.col("slots"), F.col("key")))
    assert sorted(full) == list(range(8)) and full != list(range(8))
    assert donors(df, stress.permute_fraction(F.col("slots"), F.col("key"), 0.0)) == list(range(8))
    assert donors(df, stress.permute_fraction(F.col("slots"), F.col("key"), 1.0)) == full
    assert donors(slots(spark, "a", [1], [7]), hierarchy.permute_slots(F.col("slots"), F.col("key"))) == [7]


def test_distance_bins(spark):
    got = spark.range(1).select(*[stress.distance_bin(F.lit(float(d))) for d in (9.9, 10, 20, 79.9, 80)]).first()
    assert tuple(got) == (None, 1, 2, 3, 4)


def test_relation_is_zero_with_one_context_site(spark):
    rng = np.random.default_rng(0)
    maps = spark.createDataFrame(
        [(f"s{s}", f"x{u:02d}", f"c{i}", float(rng.gamma(2)), float(rng.gamma(3)), 10.0 + u) for s in range(3) for u in range(12) for i in range(3)],
        "subject string, stim_site string, recording_channel string, early_rms_z double, late_rms_z double, distance_to_stim double",
    )
    prior = hierarchy.population_prior(hierarchy.normalised_map(maps))
    sites = maps.select("subject", "stim_site").distinct()
    ctx = P.context_sites(sites, (1, 3), 2)
    rows = hierarchy.reconstruct(prior, ctx, P.query_sites(sites, ctx, (1, 3), 2))
    nested = hierarchy.nested_predictions(rows, 1).toPandas()
    one = nested[nested.context_k == 1]
    assert len(one) == 3 * 2 * 11 * 3 and (one.relation_late == one.node_late).all()
    three = nested[nested.context_k == 3]
    assert (three.relation_late != three.node_late).any()
    pairs = hierarchy.pair_predictions(hierarchy.nested_predictions(rows, 1))
    assert pairs.count() == 5 * len(nested) and pairs.where("pred_late < 0 OR pred_late IS NULL").count() == 0


def test_linear_prior_leaves_the_subject_out(spark):
    """Against least squares on the other subjects; a subject's own rows do not move its prior."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 16)) * np.geomspace(1, 300, 16) + 50
    y = x @ rng.normal(size=16) + rng.normal(size=90)
    subject = [f"s{i % 5}" for i in range(90)]
    names = [f"f{i}" for i in range(16)]

    def prior(y, x=x):
        rows = [(i, s, float(v), *map(float, r)) for i, (s, v, r) in enumerate(zip(subject, y, x))]
        df = spark.createDataFrame(rows, "i int, subject string, early double, " + ", ".join(f"{n} double" for n in names))
        return hierarchy.linear_prior(df, names, ["early"]).orderBy("i").toPandas()["pop_early"].to_numpy()

    got = prior(y)
    design = np.column_stack([np.ones(90), x])
    for s in set(subject):
        mine = np.array(subject) == s
        beta = np.linalg.lstsq(design[~mine], y[~mine], rcond=None)[0]
        assert got[mine] == pytest.approx(design[mine] @ beta, rel=1e-7)
    moved = np.where(np.array(subject) == "s2", y * 3 + 7, y)
    again = prior(moved)
    mine = np.array(subject) == "s2"
    assert again[mine] == pytest.approx(got[mine], rel=1e-9) and not np.allclose(again[~mine], got[~mine])


# ---- responses, bridge, eligibility, quality ------------------------------------------------------------


def test_trials_to_map(spark):
    rows = [("s", "A-B", "c", f"e{i}", f"r{i % 2}", 12.0, float(v), float(v * 10)) for i, v in enumerate([1, 2, 3, 4, 9])]
    df = spark.createDataFrame(rows, "subject string, stim_site string, recording_channel string, event_uid string, run_base string, distance_to_stim double, early_rms_z double, late_rms_z double")
    m = response.trials_to_map(df).first()
    assert (m["n_trials"], m["n_runs"], m["early_rms_z"], m["early_rms_iqr"], m["late_rms_iqr"]) == (5, 2, 3.0, 2.0, 20.0)


def test_cut_epochs_crosses_buckets(spark):
    ev = spark.createDataFrame([("r", 1, 95, 206)], "run string, event int, lo bigint, hi bigint")
    sm = spark.range(0, 400).select(F.lit("r").alias("run"), F.col("id").alias("sample_idx"), F.col("id").alias("value"))
    got = [r["sample_idx"] for r in response.cut_epochs(ev, sm, ["run"], 100).collect()]
    assert sorted(got) == list(range(95, 206))


def test_duplicate_header_keys(spark):
    h = spark.createDataFrame([("A1",), (" a1",), ("B",)], "name string")
    assert [tuple(r) for r in response.duplicate_header_keys(h).collect()] == [("a1", 2)]


@pytest.mark.parametrize(
    "label, want",
    [
        ("A1-A2", ("A1", "A2")), ("a1-B1", ("A1", "B1")), ("A1-A2-B1", (None, None)), ("A1A2", (None, None)),
        ("stim(A2)(b1)", ("A2", "B1")), ("B1 - A1", ("B1", "A1")), ("x", (None, None)),
    ],
)
def test_parse_pair(spark, label, want):
    names = spark.createDataFrame([("A1",), ("A2",), ("B1",)], "name string")
    got = bridge.parse_pair(spark.createDataFrame([(label,)], "label string"), names).first()
    assert (got["contact_a"], got["contact_b"]) == want


def test_parse_pair_in_long_labels(spark):
    """Rows grow with the label, not with its square; names of several tokens, signs and letter cases."""
    names = spark.createDataFrame([("A1",), ("A 1-x",), ("'b2",), ("B2",), ("Zz9",)], "name string")
    filler = ".".join(f"k{i}" for i in range(5_000))
    rows = [(f"{filler}(zZ9){filler}/b2",), (f"{filler}.a1-X.{filler}",), ("q('b2)(a1)",), ("",), (None,)]
    got = {r.label: (r.contact_a, r.contact_b) for r in bridge.parse_pair(spark.createDataFrame(rows, "label string"), names).collect()}
    assert got[rows[0][0]] == ("Zz9", "B2")
    assert got[rows[1][0]] == ("A1-x", "A1")  # both are found in it
    tokens = spark.createDataFrame([(rows[0][0].lower(),)], "t string").select(bridge._tokens(F.col("t")).alias("t"))
    pieces = bridge._stretches(F.col("t"), F.create_map(F.lit("k1"), F.array(F.lit(1), F.lit(3)), F.lit("zz9"), F.array(F.lit(1))))
    assert sorted(tokens.select(pieces.alias("p")).first()["p"]) == ["k1", "k1.k2", "zz9"]


def test_check_deterministic(spark):
    df = spark.createDataFrame([(None, "L", "UNK"), (None, "L", "x"), ("a", "L", "x"), ("a", "L", "x")], "t string, h string, v string")
    bad = quality.check_deterministic(df, ["t", "h"], "v").collect()
    assert len(bad) == 1 and bad[0]["t"] is None


def test_dominant_value_ties_by_text(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "a"), ("h", "z"), ("h", "z"), ("h", "a")], "g string, k string")
    assert {tuple(r) for r in eligibility.dominant_value(df, ["g"], "k").collect()} == {("g", "a", 1), ("h", "z", 2)}


def test_restrict_if_present(spark):
    df = spark.createDataFrame([("f", "SPES"), ("f", "x"), ("g", "x"), ("g", None)], "f string, t string")
    assert eligibility.restrict_if_present(df, ["f"], F.col("t") == "SPES").count() == 3


def test_salted_pairs_are_complete(spark):
    left = spark.range(50).select(F.lit("s").alias("subject"), F.col("id").alias("a"))
    right = spark.range(30).select(F.lit("s").alias("subject"), F.col("id").alias("b"))
    got = geometry.salted_pairs(left, right, "subject")
    assert got.count() == 1500 and got.distinct().count() == 1500


@pytest.mark.parametrize("tile", [7, 4096])
def test_pairs_of_a_heavy_subject(spark, tile):
    """One subject holds half of all rows on both sides; the others are joined as they are."""
    subject = F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 19))
    left = spark.range(120).select(subject.alias("subject"), F.col("id").alias("a"))
    right = spark.range(80).select(subject.alias("subject"), F.col("id").alias("b"))
    got = geometry.salted_pairs(left, right, "subject", tile)
    want = left.join(right, "subject")
    assert got.columns == ["subject", "a", "b"] and got.count() == want.count() and got.exceptAll(want).count() == 0
    none = geometry.salted_pairs(left.where("a < 0"), right, "subject", tile)
    assert none.count() == 0


# ---- comparison: every leaf mutated one at a time must show ----------------------------------------------

BASE = {"k": 1, "x": 2.5, "n": 7, "t": "a", "b": True}
SCHEMA = "k int, x double, n bigint, t string, b boolean"


def frame(spark, *rows):
    return spark.createDataFrame([tuple(r[c] for c in BASE) for r in rows], SCHEMA)


@pytest.mark.parametrize(
    "change, field",
    [
        ({"x": 2.5000001}, "x"), ({"x": float("nan")}, "x"), ({"x": None}, "x"), ({"n": 8}, "n"), ({"t": "b"}, "t"),
        ({"t": None}, "t"), ({"b": False}, "b"), ({"k": 2}, "(missing)"),
    ],
)
def test_compare_tables_sees_each_change(spark, change, field):
    diff = quality.compare_tables(frame(spark, BASE), frame(spark, BASE | change), ["k"]).collect()
    assert field in {r["field"] for r in diff}


def test_compare_tables(spark):
    a = frame(spark, BASE)
    same = quality.compare_tables(a, frame(spark, BASE | {"x": 2.5 * (1 + 1e-14)}), ["k"])
    assert same.count() == 0
    nan = frame(spark, BASE | {"x": float("nan")})
    assert quality.compare_tables(nan, nan, ["k"]).count() == 1
    assert quality.compare_tables(frame(spark, BASE | {"x": 1e-30}), frame(spark, BASE | {"x": 2e-30}), ["k"]).count() == 1
    assert {r["field"] for r in quality.compare_tables(a, frame(spark, BASE, BASE), ["k"]).collect()} == {"(duplicate)"}
    with pytest.raises(ValueError):
        quality.compare_tables(a, a.withColumn("n", F.col("b")), ["k"])


def test_gates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert [tuple(r) for r in quality.expect_unique(df, ["k"]).collect()] == [(1, 2)]
    assert quality.expect_one_value(df, ["k"], "v").count() == 1
    assert quality.first_per_key(df, ["k"], ["v"], last=True).where("k = 1").first()["v"] == "b"
    quality.require_empty(df.where("k > 9"), "none").count()
    with pytest.raises(Exception, match="duplicates"):
        quality.require_empty(quality.expect_unique(df, ["k"]), "duplicates").collect()
    with pytest.raises(ValueError):
        quality.expect_columns(df, ["z"])
    with pytest.raises(ValueError):
        quality.forbid_columns(df.withColumn("Outcome_x", F.lit(1)), ["outcome"])
    assert quality.table_fingerprint(df).first() == quality.table_fingerprint(df.repartition(3)).first()
    assert math.isclose(quality.expect_max(df, F.col("k"), 2).first()["max_error"], 2)


# ---- gates ----------------------------------------------------------------------------------------------


def test_unequal_patients_stop_the_job(spark):
    schema = "subject string, context_k int, condition string, target string, pearson double, spearman double, mae double, top10_recall double"
    rows = [(p, 10, c, "late", 0.1, 0.2, 0.3, 0.4) for p in "pq" for c in ("relation", "node")]
    whole = L.paired_delta(spark.createDataFrame(rows, schema), L.contrast_grid(spark))
    assert whole.where("delta = 0").count() == 8
    with pytest.raises(Exception, match="one condition without the other for patient q"):
        L.paired_delta(spark.createDataFrame(rows[:-1], schema), L.contrast_grid(spark)).collect()
    missing = [*rows[:-1], ("q", 10, "node", "late", None, 0.2, 0.3, 0.4)]  # a row without a value is no missing patient
    assert L.unpaired(L.paired_delta(spark.createDataFrame(missing, schema), L.contrast_grid(spark))).where("metric = 'pearson' AND subject = 'q' AND contrast = 'relation_vs_node'").count() == 1


def test_repeats_are_counted(spark):
    schema = "subject string, context_k int, repeat int, condition string, target string, n_pairs int, pearson double, spearman double, mae double, top10_recall double"
    rows = [("p", 3, r, "node", "late", 10, 0.5, None, 0.1, 0.2) for r in range(20)]
    means = metrics.patient_metrics(spark.createDataFrame(rows, schema)).first()
    assert means.n_repeats == 20 and means.pearson == 0.5 and means.spearman is None
    for bad in (rows[:-1], [*rows, rows[0]], [*rows[:-1], rows[0]]):
        with pytest.raises(Exception, match="20 repeats are expected for patient p"):
            metrics.patient_metrics(spark.createDataFrame(bad, schema)).collect()
    assert metrics.patient_metrics(spark.createDataFrame(rows[:3], schema), expected=None).first().n_repeats == 3


def test_gains_take_single_rows(spark):
    rows = [("p", 3, "late", c, float(i)) for i, c in enumerate(hierarchy.CONDITIONS)]
    schema = "subject string, context_k int, target string, condition string, mae double"
    gains = metrics.nested_gains(spark.createDataFrame(rows, schema), "mae", lower_is_better=True).first()
    assert (gains.global_gain, gains.correspondence_gain) == (-1.0, 1.0)
    with pytest.raises(Exception, match="more than one row"):
        metrics.nested_gains(spark.createDataFrame([*rows, rows[2]], schema), "mae").collect()


def test_control_hinge(spark):
    rng = np.random.default_rng(2)
    y, mu, control = rng.normal(size=(3, 40)) * 2
    rows = [(f"g{i % 2}", i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(y, mu, control))] + [("g0", 99, 1.0, None, 1.0)]
    schema = "g string, row_id int, y double, mu double, control double"
    huber = lambda e: np.where(np.abs(e) <= 1, e * e / 2, np.abs(e) - 0.5).mean()
    got = {r.g: r for r in metrics.control_hinge(spark.createDataFrame(rows, schema), ["g"], 0.3).collect()}
    for k in (0, 1):
        a, b = huber((y - mu)[k::2]), huber((y - control)[k::2])
        assert tuple(got[f"g{k}"])[1:] == pytest.approx((20, a, b, max(0.3 + a - b, 0)))
    with pytest.raises(Exception, match="more than one row"):
        metrics.control_hinge(spark.createDataFrame([*rows, rows[0]], schema), ["g"]).collect()
    with pytest.raises(Exception, match="more than one row"):
        metrics.score_terms(spark.createDataFrame([*rows, rows[0]], schema).withColumn("log_var", F.lit(0.0)), ["g"]).collect()


def test_constant_by_value(spark):
    """Values that differ by less than the least deviation are constant, though their ranks are not."""
    rows = [("a", 1.0 + i * 1e-14, float(i)) for i in range(5)] + [("b", float(i), float(i * i)) for i in range(5)]
    got = {r.g: r.spearman for r in metrics.spearman_safe(spark.createDataFrame(rows, "g string, y double, p double"), ["g"], "y", "p").collect()}
    assert got["a"] is None and got["b"] == pytest.approx(1.0)


def test_runs_without_the_site_column(spark):
    a = spark.createDataFrame([("r1", "s", "A-B"), ("r1", "x", None)], "run string, kind string, site string")
    b = spark.createDataFrame([("r2", "s")], "run string, kind string")
    both = a.unionByName(b, allowMissingColumns=True)
    got = {tuple(r) for r in eligibility.run_inventory(both, "run", F.col("kind") == "s", "site").collect()}
    assert got == {("r1", 2, 1, 1, True), ("r2", 1, 1, 0, False)}
    assert tuple(eligibility.run_inventory(b, "run", F.col("kind") == "s", "site").first()) == ("r2", 1, 1, 0, False)


def test_first_channel_needs_an_order(spark):
    df = spark.createDataFrame([("a", "bad", 2), ("a", "good", 1)], "name string, status string, row_order int")
    assert eligibility.first_channel(df, ["name"]).first().status == "good"
    with pytest.raises(ValueError, match="row_order"):
        eligibility.first_channel(df.drop("row_order"), ["name"])


def test_a_second_row_stops_the_job(spark):
    once = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 3.0), (None, 1, 4.0), (None, 1, 5.0)], "k string, j int, v double")
    assert quality.one_per_key(once, ["k", "j"], "row").where("k IS NOT NULL").count() == 2
    twice = once.union(spark.createDataFrame([("a", 1, 9.0)], "k string, j int, v double"))
    with pytest.raises(Exception, match="more than one row for a 1"):
        quality.one_per_key(twice, ["k", "j"], "row").collect()


def test_a_doubled_patient_stops_the_job(spark):
    rows = [("p", 10, c, "late", 0.1, 0.2, 0.3, 0.4) for c in ("relation", "node", "relation")]
    df = spark.createDataFrame(rows, "subject string, context_k int, condition string, target string, pearson double, spearman double, mae double, top10_recall double")
    with pytest.raises(Exception, match="more than one value for patient p"):
        L.paired_delta(df, L.contrast_grid(spark)).collect()
    assert L.paired_delta(df.dropDuplicates(), L.contrast_grid(spark)).where("a IS NOT NULL AND b IS NOT NULL").count() == 4


def test_fingerprint_tells_nulls_apart(spark):
    one = spark.createDataFrame([(None, "x"), ("a", "b:c")], "p string, q string")
    other = spark.createDataFrame([("x", None), ("a", "b:c")], "p string, q string")
    assert quality.table_fingerprint(one).first() != quality.table_fingerprint(other).first()


def test_missing_floats_do_not_agree(spark):
    a = spark.createDataFrame([(1, None), (2, 0.5)], "k int, v double")
    assert [tuple(r) for r in quality.compare_tables(a, a, ["k"]).collect()] == [(1, "v")]
