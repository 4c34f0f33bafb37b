"""Hand-computed results of the scalar functions."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from sparkmap.functions import hashing, numeric, signal, space, tails, text


def one(spark, *cols, row="SELECT 1 AS x"):
    return spark.sql(row).select(*cols).first()


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


@pytest.mark.parametrize(
    "values, center, scale", [((1, 2, 3, 4, 100), 3, 1.4826), ((0, 0, 0, 0, 10), 0, 4.0), ((5, 5, 5), 5, 1.0)]
)
def test_robust_scale(spark, values, center, scale):
    c = signal.robust_center(arr(*values))
    got = one(spark, c, signal.robust_scale(arr(*values), c))
    assert got[0] == center and got[1] == pytest.approx(scale, rel=1e-12)


def test_robust_scale_skips_bad_samples(spark):
    bad = F.array(F.lit(1.0), F.lit(2.0), F.lit(None).cast("double"), F.lit(float("nan")), F.lit(3.0), F.lit(4.0), F.lit(100.0))
    c = signal.robust_center(bad)
    assert tuple(one(spark, c, signal.robust_scale(bad, c))) == (3.0, 1.4826)


@pytest.mark.parametrize(
    "s0, fs, want", [(10000, 2048.0, (8976, 9959, 10020, 10205, 11024)), (10000, 250.0, (9875, 9995, 10002, 10025, 10125))]
)
def test_window_bounds(spark, s0, fs, want):
    assert tuple(one(spark, *signal.window_bounds(F.lit(s0), F.lit(fs)).values())) == want


def test_signal_features(spark):
    got = one(
        spark, signal.rms(arr(3, 4)), signal.array_median(arr(4, 1, 3, 2)), signal.array_lower_median(arr(4, 1, 3, 2)),
        signal.peak_abs(arr(1, -5, 5)), signal.peak_ms(arr(1, -5, 5), 10.0, 250.0),
    )
    assert tuple(got) == (3.5355339059327378, 2.5, 2.0, 5.0, 14.0)


def test_space(spark):
    p = lambda *v: tuple(F.lit(float(x)) for x in v)
    assert [round(x, 4) for x in one(spark, *space.affine3(p(10, 20, 30)))] == [10.3141, 21.6416, 30.781]
    u = space.unit_vector(p(0, 0, 0), p(3, 4, 0))
    assert tuple(one(spark, *u)) == pytest.approx((0.6, 0.8, 0.0))
    assert tuple(one(spark, *space.axis_tensor(u).values())) == pytest.approx((0.36, 0.64, 0, 0.48, 0, 0))
    assert tuple(one(spark, *space.unit_vector(p(1, 1, 1), p(1, 1, 1)))) == (None, None, None)
    d = F.lit(10.0)
    assert tuple(one(spark, *[space.near_field(d, 10.0, r) for r in ("gt", "ge", "flag_le")])) == (False, True, True)


@pytest.mark.parametrize(
    "label, stem, hemi",
    [
        ("ctx_lh_G_front_middle", "gfrontmiddle", "L"),
        ("lh_G_front_middle", "gfrontmiddle", "L"),
        ("G_front_middle", "gfrontmiddle", None),
        ("S_central-rh", "scentral", "R"),
        ("Left-Hippocampus", "hippocampus", "L"),
        ("left_hippocampus", "lefthippocampus", "L"),
        ("unknown", None, None),
    ],
)
def test_labels(spark, label, stem, hemi):
    c = F.lit(label)
    assert tuple(one(spark, text.canonical_stem(c), text.hemi_from_label(c))) == (stem, hemi)


def test_text(spark):
    raw = ["sub-7", "Sub012", "7", "7.0", "sub-123", "abc", "sub_07", "sub-007", "\tsub7\n"]
    got = one(spark, *[text.norm_subject(F.lit(r)) for r in raw])
    assert list(got) == ["sub-07", "sub-012", "sub-07", "sub-07", "sub-123", "abc", "sub-07", "sub-007", "sub-07"]
    got = one(
        spark, text.norm_name(F.lit("\t A 1 ")), text.norm_site(F.lit("A1_ A2")), text.ascii_fold(F.lit("Ünïcôdé é")),
        text.canonical_pair(F.lit("b"), F.lit("a")), text.valid_text(F.lit("<NA>"), text.MISSING_TABLE),
        text.valid_text(F.lit(None).cast("string")),
    )
    assert tuple(got) == ("A1", "A1-A2", "Unicode e", "a--b", False, False)


def test_numbers(spark):
    inf = F.lit(float("inf"))
    got = one(
        spark, numeric.to_number(F.lit("nan")), numeric.to_number(F.lit(" 2.5 ")), numeric.finite(inf),
        numeric.finite(F.lit(None).cast("double")), numeric.safe_ratio(F.lit(1), F.lit(0)), numeric.half_even(F.lit(2.5)),
        numeric.log1p_clip(F.lit(-3.0)), numeric.expm1_clip(F.lit(-3.0)), numeric.parse_bool(F.lit("YES")),
    )
    assert tuple(got) == (None, 2.5, False, False, None, 2, 0.0, 0.0, True)


def test_stable_seed(spark):
    assert one(spark, hashing.stable_seed(F.lit(20260926), F.lit("S1"), F.lit(10), F.lit(0)))[0] == 2746964621


@pytest.mark.parametrize(
    "hits, draws, low, high",
    [
        (0, 10_000_000, 0.0, 3.688878773722438e-07),
        (0, 2_000_000, 0.0, 1.8444380260790605e-06),
        (3, 10, 0.0667395111777345, 0.6524528500599973),
        (10, 10, 0.6915028921812392, 1.0),
    ],
)
def test_tail_interval(spark, hits, draws, low, high):
    got = one(spark, *tails.tail_interval(F.lit(hits), F.lit(draws)))
    assert tuple(got) == pytest.approx((low, high), rel=1e-9)


def test_fold_compatibility_forms(spark):
    assert tuple(one(spark, text.ascii_fold(F.lit("Ａ²ẛ"))))[0] == "A2s"


def test_ascii_fold_of_several_characters(spark):
    texts = ["ﬁn", "½", "한글", "ﷺ", "ǆé", "plain", "Ünïcôdé", "", None, "①⅓x", "\u0301a"]
    want = [t if t is None else "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)) for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(2)
    assert [r.f for r in df.select("i", text.ascii_fold(F.col("t")).alias("f")).orderBy("i").collect()] == want


def test_white_space_around_metadata(spark):
    df = spark.createDataFrame([("\tL ", "\u00a0RIGHT\n", " \tlh_Amygdala\n")], "a string, b string, c string")
    got = df.select(text.hemi_from_meta(F.col("a")), text.hemi_from_meta(F.col("b")), text.canonical_stem(F.col("c"))).first()
    assert tuple(got) == ("L", "R", "amygdala")


def test_ascii_fold_looks_for_forms_beyond_ascii_only(spark):
    """Every character folds as NFKD without marks; ASCII texts, and ASCII characters of others, skip the long classes."""
    chars = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x11000), *range(0x1F100, 0x1F250))]
    rows = [(i, "".join(chars[i : i + 64])) for i in range(0, len(chars), 64)] + [(-1, None), (-2, ""), (-3, "plain text"), (-4, "éﬁ½ a")]
    df = spark.createDataFrame(rows, "id long, t string").withColumn("f", text.ascii_fold(F.col("t")))
    split = spark.createDataFrame([(c,) for c in chars], "t string")
    held = {r["t"] for r in split.where(F.col("t").rlike(text._SEVERAL)).collect()}
    fold = lambda t: "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x))
    assert held == {c for c in chars if len(fold(c)) > 1}
    got = {r["id"]: r["f"] for r in df.collect()}
    assert (got[-1], got[-2], got[-3], got[-4]) == (None, "", "plain text", "efi1⁄2 a")
    assert text._SEVERAL.startswith(r"[\x{80}-\x{10FFFF}&&") and "octet_length" in df._jdf.queryExecution().optimizedPlan().toString()
