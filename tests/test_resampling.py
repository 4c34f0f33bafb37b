"""Resamples against their rule written out, for whole cells and for cells dealt out in chunks."""

from hashlib import md5

import numpy as np
import pytest

from sparkmap.catalog import load, q_inference as Q
from sparkmap.functions.tails import _at_least, _solve
from sparkmap.operators import inference as L, resampling as R

SCHEMA = "cell string, subject string, delta double"


def cells(seed=0):
    rng = np.random.default_rng(seed)
    out = {}
    for name, n in (("a", 7), ("b", 7), ("c", 12), ("d", 1), ("e", 30)):
        out[name] = sorted((f"p{i:02d}", float(v)) for i, v in zip(rng.permutation(40)[:n], np.round(rng.normal(0.1, 1, n), 3)))
    out["same"] = [(f"p{i:02d}", 0.5) for i in range(9)]
    out["zero"] = [(f"p{i:02d}", 0.0) for i in range(4)]
    return out


def frame(spark, data):
    rows = [(c, s, v) for c, pairs in data.items() for s, v in pairs] + [("a", "missing", None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def sign(seed, draw, subject):
    digest = md5(f"{seed}|{draw // 128}|{subject}".encode()).digest()
    bit = draw % 128
    return -1.0 if digest[bit // 8] >> (bit % 8) & 1 else 1.0


def hits(pairs, draws, seed):
    observed = abs(sum(v for _, v in pairs)) / len(pairs)
    means = [abs(sum(sign(seed, d, s) * v for s, v in pairs)) / len(pairs) for d in range(draws)]
    return sum(m >= observed - 1e-12 for m in means)


def resamples(pairs, draws, seed):
    values = sorted(v for _, v in pairs)
    n = len(values)
    for d in range(draws):
        picked = []
        for j in range(n):
            digest = md5(f"{seed}|{d}|{j // 4}".encode()).digest()
            picked.append(values[int.from_bytes(digest[4 * (j % 4) : 4 * (j % 4) + 4], "little") % n])
        yield np.mean(picked), np.median(picked)


@pytest.mark.parametrize("chunk", [1 << 16, 4])
def test_rules(spark, monkeypatch, chunk):
    monkeypatch.setattr(R, "CHUNK", chunk)
    monkeypatch.setattr(R, "VECTOR", 128)
    monkeypatch.setattr(R, "NUMBERS", 500)
    data, draws = cells(), 400
    df = frame(spark, data)
    got = {r.cell: r for r in R.signflip_mc(df, draws, 9, ["cell"]).collect()}
    assert {c: r.n_extreme for c, r in got.items()} == {c: hits(pairs, draws, 9) for c, pairs in data.items()}
    assert got["zero"].p_mc == 1.0 and got["d"].n_extreme == draws
    boot = {r.cell: tuple(r)[1:] for r in R.bootstrap_ci(df, draws, 9, ["cell"]).collect()}
    for c, pairs in data.items():
        mean, middle = zip(*resamples(pairs, draws, 9))
        want = [*np.quantile(mean, (0.025, 0.975)), *np.quantile(middle, (0.025, 0.975))]
        assert boot[c] == pytest.approx(want, abs=1e-12), c


def test_cells_share_a_task_or_not(spark, monkeypatch):
    df = frame(spark, cells(1))
    whole = {r.cell: r for r in R.bootstrap_ci(df, 300, 2, ["cell"]).collect()}
    flips = {r.cell: r for r in R.signflip_mc(df, 300, 2, ["cell"]).collect()}
    monkeypatch.setattr(R, "BUNDLE", 10)
    assert {r.cell: r for r in R.signflip_mc(df, 300, 2, ["cell"]).collect()} == flips
    again = {r.cell: tuple(r)[1:] for r in R.bootstrap_ci(df, 300, 2, ["cell"]).collect()}
    assert again == {c: pytest.approx(tuple(r)[1:], abs=1e-12) for c, r in whole.items()}


def test_no_cells(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert R.signflip_mc(none, 100, 1, ["cell"]).count() == 0 and R.bootstrap_ci(none, 100, 1, ["cell"]).count() == 0


@pytest.mark.parametrize("n,k", [(1, 1), (10, 3), (500, 1), (500, 499), (200_000, 95_000), (10_000_000, 2), (10_000_000, 98_070)])
def test_tail_interval(n, k):
    for target in (0.025, 0.975):
        p = _solve(n, k, target)
        assert 0 < p < 1 and _at_least(n, p, k) == pytest.approx(target, rel=1e-9)


def test_contrast_summary(spark):
    """Every field of one cell: the exact sign flip where it is small, names in the order of the difference."""
    rng = np.random.default_rng(3)
    rows = []
    for contrast, metric, n in (("relation_vs_node", "mae", 12), ("relation_vs_node", "pearson", 25)):
        for i in range(n):
            a, b = rng.normal(1, 0.2, 2).tolist()
            rows.append((contrast, 10, "late", metric, f"s{i:02d}", a, b, b - a if metric == "mae" else a - b))
    d = spark.createDataFrame(rows, "contrast string, context_k int, target string, metric string, subject string, a double, b double, delta double")
    got = {r.metric: r for r in L.contrast_summary(d, L.contrast_grid(spark), 500, 500, 4).collect()}
    mae, pearson = got["mae"], got["pearson"]
    assert (mae.delta_definition, mae.condition_a, mae.condition_b) == ("node - relation", "relation", "node")
    assert pearson.delta_definition == "relation - node"
    v = np.array([r[7] for r in rows if r[3] == "mae"])
    masks = 1 - 2 * ((np.arange(1 << 12)[:, None] >> np.arange(12)) & 1)
    assert mae.p_signflip == mae.p_exact == pytest.approx(np.mean(np.abs(masks @ v) >= abs(v.sum()) - 1e-12))
    assert pearson.p_exact is None and pearson.p_signflip == pearson.p_mc
    assert mae.median_low <= mae.median_delta <= mae.median_high and 0 < mae.p_wilcoxon <= 1


def test_full_tables_take_the_studys_draws():
    assert Q.DRAWS["_full"] == 200_000 and Q.ENDPOINT_DRAWS["_full"] == (10_000_000, 2_000_000)
    oracles = load()[1]
    for name in ("contrast_summary", "endpoint_flags", "correspondence_trajectory", "endpoint_table", "support_rule"):
        assert name in oracles and f"{name}_full" in oracles
