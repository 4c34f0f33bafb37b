"""Whitening against a direct eigendecomposition with exact sums."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmap.llm import q_whitening, whitening

SCHEMA = "vec_id long, embedding array<float>"


def brute(vectors, top=8):
    """x, n, sums, deviations, eigenvalues and components of the vectors that count."""
    dims = [len(v) for v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    dim = max(set(dims), key=lambda d: (dims.count(d), d))
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors if v and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    n, sums = len(x), [sum(r[j] for r in x) for j in range(dim)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    a = np.array([[n * c - s for c, s in zip(r, sums)] for r in x], float) / n
    e, w = np.linalg.eigh(a.T @ a / n)
    return n, deviation, a, e[::-1], w[:, ::-1].T


def made(n, dim, seed, rank=None):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, rank or dim)) * np.geomspace(1, 0.05, rank or dim)
    return (base @ rng.normal(size=(rank or dim, dim)) / math.sqrt(dim) + rng.normal(size=dim)).astype(np.float32).tolist()


def check(got, vectors, ids):
    n, deviation, a, e, w = brute(vectors)
    got = got.sort_values(["vec_id", "component"], ignore_index=True)
    many = got.component.max()
    assert len(got) == n * many and (got.n == n).all()
    first = got[got.component == 1]
    assert first.deviation.tolist() == [d for _, d in sorted(zip(ids, deviation))]
    order = np.argsort(ids, kind="stable")
    for c in range(many):
        rows = got[got.component == c + 1]
        want = (a @ w[c] / math.sqrt(e[c]))[order]
        have = rows.whitened.to_numpy()
        sign = 1 if have @ want > 0 else -1
        assert np.allclose(have * sign, want, rtol=0, atol=1e-6)
        assert np.allclose(rows.explained, e[c] / e.sum(), rtol=1e-9)
    y = got.whitened.to_numpy().reshape(-1, many)
    error = np.abs((y - y.mean(0)).T @ (y - y.mean(0)) / n - np.eye(many)).max()
    assert np.allclose(got.identity_error, error, atol=1e-12) and error < 1e-9


@pytest.mark.parametrize("dim", [1, 3, 12, 70])
def test_query(spark, tmp_path, dim):
    vectors = made(400, dim, dim)
    rows = list(enumerate(vectors))
    bad = [None, [], [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), [None] + [0.0] * (dim - 1), [0.5] * (dim + 1)]
    rows += [(1000 + i, v) for i, v in enumerate(bad)]
    rows += [(2000 + i, vectors[0]) for i in range(200)]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = q_whitening.query(spark, str(tmp_path)).toPandas()
    kept = [(i, v) for i, v in rows if i < 1000 or i >= 2000]
    check(got, [v for _, v in kept], [i for i, _ in kept])
    assert got.component.max() == min(dim, 8)


def test_fewer_directions_than_dimensions(spark, tmp_path):
    """Whole multiples of a few directions and constant dimensions: only the directions have components."""
    rng = np.random.default_rng(2)
    k = rng.integers(-20, 20, (300, 3)) / 8
    vectors = np.column_stack([k, k[:, 0] + k[:, 1], np.full(300, 0.25), k[:, 2] * 2]).astype(float).tolist()
    spark.createDataFrame(list(enumerate(vectors)), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = q_whitening.query(spark, str(tmp_path)).toPandas()
    assert got.component.max() == 3
    check(got, vectors, list(range(300)))


def test_ill_conditioned(spark):
    """Directions that differ by five orders of magnitude, far from the origin."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(500, 6)) * np.geomspace(1000, 0.01, 6) + 5000
    model = whitening.fit(spark.createDataFrame([(v.tolist(),) for v in vectors], "embedding array<double>").repartition(4))
    x = np.floor(vectors * 1024) + 100_000
    a = x - x.mean(0)
    s = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(model.values, s * s / 500, rtol=1e-7)


def test_solve():
    rng = np.random.default_rng(4)
    r, a = np.triu(rng.normal(size=(75, 75))) + 9 * np.eye(75), rng.normal(size=(20, 75))
    assert np.allclose(whitening.solve(a, r) @ r, a)


def test_deviations():
    sums = [10**7, 3]
    n = 7
    x = np.array([[100_000, 5], [2**33, 7], [-(2**40), 2], [2**28, 0]], np.int64)
    want = [sum((n * int(a) - s) ** 2 for a, s in zip(r, sums)) for r in x]
    assert whitening.deviations(x, n, sums) == [v if v < 2**63 else None for v in want]
    assert sum(v >= 2**63 for v in want) == 2


def test_defined_cases(spark):
    rows = [(i, [float(i % 3), float(i % 2)], "a", 1.0) for i in range(30)] + [(None, [1.0, 1.0], None, None), (None, None, None, None), (4, [1.0, 1.0], "a", 1.0)]
    df = spark.createDataFrame(rows, "id long, v array<double>, w__ string, n double")
    out, model = whitening.whiten(df, "v")
    assert out.columns == ["id", "v", "w__", "n", "deviation", "whitened"] and out.count() == 32 and model.n == 32
    with pytest.raises(ValueError, match="whitened"):
        whitening.whiten(df.withColumn("Whitened", F.lit(1)), "v")
    none, model = whitening.whiten(df.where("id < 0"), "v")
    assert model is None and none.count() == 0 and none.columns == out.columns
    alike, model = whitening.whiten(df.withColumn("v", F.array(F.lit(1.5), F.lit(2.0))), "v")
    assert len(model.values) == 0 and alike.where("size(whitened) > 0").count() == 0
    assert whitening.identity_error(alike, 0) is None


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = q_whitening.query(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
