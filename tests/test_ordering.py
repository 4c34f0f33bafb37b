"""Ranks and quantiles against numpy, with a hot group, heavy ties and many cut points."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkmap.operators import ordering as O


@pytest.fixture(scope="module", params=[1, 1024])
def rate(request):
    """Sample every value (all groups are cut) or one in 1,024."""
    old = O.SAMPLE_RATE
    O.SAMPLE_RATE = request.param
    yield request.param
    O.SAMPLE_RATE = old


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(1)
    hot = pd.DataFrame({"g": "hot", "v": rng.normal(size=3000)})
    hot.loc[:1000, "v"] = 0.25  # one value holds a third of the hot group
    rest = pd.DataFrame({"g": [f"g{i % 40}" for i in range(2000)], "v": rng.integers(0, 30, 2000).astype(float)})
    df = pd.concat([hot, rest], ignore_index=True)
    df["id"] = range(len(df))
    return df


def test_average_ranks(spark, frame, rate):
    got = O.average_ranks(spark.createDataFrame(frame), ["g"], "v", "r").toPandas().sort_values("id")
    assert len(got) == len(frame)
    assert np.array_equal(got["r"], frame.groupby("g")["v"].rank(method="average"))


def test_positions(spark, frame, rate):
    got = O.positions(spark.createDataFrame(frame), ["g"], [(-F.col("v")).alias("neg"), "id"]).toPandas()
    want = frame.sort_values(["g", "v", "id"], ascending=[True, False, True])
    want["pos"] = want.groupby("g").cumcount()
    both = got.merge(want, on=["g", "id"])
    assert len(both) == len(frame) and (both["pos_x"] == both["pos_y"]).all()
    assert set(got["total"]) == set(frame["g"].value_counts())


def test_positions_without_keys(spark, frame, rate):
    got = O.positions(spark.createDataFrame(frame), [], ["v", "id"]).toPandas().sort_values("pos")
    assert list(got["pos"]) == list(range(len(frame)))
    assert list(got["id"]) == list(frame.sort_values(["v", "id"])["id"])


def test_quantiles(spark, frame, rate):
    df = spark.createDataFrame(frame).withColumn("w", F.when(F.col("id") % 7 != 0, F.col("v") * 2))
    got = O.quantiles(
        df, ["g"], {"m": O.median("v"), "q": O.Quantile("v", 0.75), "low": O.lower_median("v"), "w": O.median("w")}
    ).toPandas().set_index("g")
    by = frame.groupby("g")["v"]
    assert np.allclose(got["m"], by.median()[got.index], rtol=0, atol=1e-12)
    assert np.allclose(got["q"], by.quantile(0.75)[got.index], rtol=0, atol=1e-12)
    lower = by.apply(lambda x: np.sort(x.to_numpy())[(len(x) - 1) // 2])
    assert np.array_equal(got["low"], lower[got.index])
    w = (frame[frame["id"] % 7 != 0].groupby("g")["v"].median() * 2)[got.index]
    assert np.allclose(got["w"], w, rtol=0, atol=1e-12)


def test_medians_of_four(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "v double")
    assert tuple(O.quantiles(df, [], {"m": O.median("v"), "l": O.lower_median("v")}).first()) == (2.5, 2.0)


def test_hot_group_is_cut_into_ranges(spark, rate):
    df = spark.range(200_000).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    cuts = O._cut_points(df, ["g"], "v").first()["_cuts"]
    assert 100 < len(cuts) <= O.SAMPLE_CLASSES and cuts == sorted(cuts)
    spans = df.crossJoin(F.broadcast(O._cut_points(df, ["g"], "v").drop("g"))).groupBy(O._span(F.col("v")).alias("s")).count()
    top = spans.agg(F.max("count"), F.count("*")).first()
    assert top[0] < 200_000 / 20 and top[1] > 100


@pytest.mark.parametrize("most", [0, 50, 1 << 20])
def test_quantiles_of_groups(spark, frame, monkeypatch, most):
    """Groups sorted whole, by ranges, and some of each: the same values, whatever the limit."""
    monkeypatch.setattr(O, "GROUP_ROWS", most)
    df = spark.createDataFrame(frame).withColumn("w", F.when(F.col("id") % 7 != 0, F.col("v") * 2)).withColumn("nan", F.when(F.col("g") == "hot", F.lit(float("nan"))))
    df = df.unionByName(df.limit(5).withColumn("g", F.lit(None).cast("string"))).unionByName(df.limit(3).withColumns({"g": F.lit("none"), **{c: F.lit(None).cast("double") for c in "vw"}}))
    wanted = {"m": O.median("v"), "q": O.Quantile("v", 0.75), "low": O.lower_median("v"), "w": O.median("w"), "nan": O.median("nan"), "low_nan": O.lower_median("nan")}
    got = O.quantiles_of_groups(df, ["g"], wanted).toPandas().sort_values("g", ignore_index=True)
    want = O.quantiles(df, ["g"], wanted).toPandas().sort_values("g", ignore_index=True)
    pd.testing.assert_frame_equal(got[want.columns], want, check_exact=True)
    assert list(got["g"]) == sorted(frame["g"].unique())


def test_map_moves_no_copy_of_a_row_per_column(spark, frame):
    """The values of small groups travel once, as arrays: rows are multiplied only on the way of the large groups."""
    from sparkmap.operators.response import trials_to_map

    f = F.col("id").cast("string")
    df = spark.createDataFrame(frame).select(F.col("g").alias("subject"), f.alias("event_uid"), f.alias("run_base"), *[F.col("v").alias(c) for c in ("distance_to_stim", "early_rms_z", "late_rms_z")])
    m = trials_to_map(df, ["subject"])
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and plan.count("LeftAnti") == 1
    by = frame.groupby("g")["v"]
    got = m.toPandas().set_index("subject")
    assert np.allclose(got["late_rms_iqr"], (by.quantile(0.75) - by.quantile(0.25))[got.index], rtol=0, atol=1e-12)
    assert (got["n_trials"] == by.size()[got.index]).all()
