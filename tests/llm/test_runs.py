"""Periodic runs against every period tried at every place."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkmap.llm import q_runs, runs


def brute(words):
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            piece = words[i : j + q]
            if len(piece) >= max(24, 3 * q) and not any(piece[r:] == piece[:-r] for r in range(1, q)):
                out.append((i, j + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(rng, n, kinds, longest):
    words = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 4)):
        p, a = rng.randint(1, longest), rng.randrange(n)
        for i in range(a + p, min(n, a + rng.randint(p, 5 * p))):
            words[i] = words[i - p]
    return words


def test_correlation_is_exact():
    rng = np.random.default_rng(1)
    for size in (16, 32, 64, 512):
        x, y = rng.integers(0, 65537, (3, size // 2)), rng.integers(0, 65537, (3, size))
        want = [[int(x[r] @ y[r, s : s + size // 2]) % 65537 for s in range(size // 2)] for r in range(3)]
        assert runs.correlate(x.astype(float), y.astype(float)).tolist() == want


@pytest.mark.parametrize("kinds", [1, 2, 3, 50, 1000])
def test_runs(kinds):
    rng = random.Random(kinds)
    for _ in range(120):
        words = planted(rng, rng.randint(1, 300), kinds, 70)
        assert runs.find(np.array(words, np.int64)) == brute(words)


def test_blocks_sought_by_their_first_words(monkeypatch):
    monkeypatch.setattr(runs, "LONGEST_BLOCK", 16)
    rng = random.Random(3)
    found = 0
    for _ in range(60):
        words = planted(rng, rng.randint(300, 900), 400, 250)
        want = brute(words)
        found += sum(q > 32 for _, _, q in want)
        assert runs.find(np.array(words, np.int64)) == want
    assert found > 5


def test_word_numbers_beyond_the_modulus():
    words = [i % 100 * 65537 for i in range(400)]  # all alike modulo 65537
    assert runs.find(np.array(words, np.int64)) == [(0, 400, 100)]


def test_long_sequences():
    for words, want in (([0] * 300_000, [(0, 300_000, 1)]), ([i % 30_000 for i in range(200_000)], [(0, 200_000, 30_000)])):
        assert runs.find(np.array(words, np.int64)) == want


def digests(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, e, q in found for i in range(s + q, e)}
    best = min(found, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (
        doc_id, len(found), *top, sha(b"".join(b"%d,%d,%d\n" % (s, e - s, q) for s, e, q in found)),
        sha(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def cases():
    rng = random.Random(8)
    rows = []
    for i in range(220):
        text = " ".join(f"w{x}" for x in planted(rng, rng.randint(1, 250), rng.choice([1, 2, 3, 400]), 60))
        rows.append((i, text.replace(" ", rng.choice([" ", "\n", " \t "]))))
    rows += [(260, None), (261, ""), (262, " \n\x0b"), (None, "a " * 30), (None, None), (263, "ab " * 30 + "x " + "ab " * 30), (5, rows[5][1]), (5, rows[5][1])]
    rows += [(270 + i, "same words in a row " * 20) for i in range(60)]
    return rows


def test_query(spark, tmp_path):
    rows = cases()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: tuple((x is None, x) for x in r)
    got = q_runs.query(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=key) == sorted((digests(*r) for r in rows), key=key)
    assert sum(r.n_runs > 0 for r in got) > 60 and sum(r.n_runs > 1 for r in got) > 5


def test_detect(spark, docs, corpus, no_docs):
    got = runs.detect(docs)
    assert got.count() == len(corpus) and got.columns == [*docs.columns, "runs", "collapsed"]
    assert got.where(F.col("text").isNull() & ((F.size("runs") > 0) | (F.col("collapsed") != ""))).count() == 0
    assert runs.detect(no_docs).count() == 0
    clashing = docs.withColumns({"runs": F.lit(1), "collapsed": F.lit("x"), "found__": F.lit(2)})
    with pytest.raises(ValueError, match="runs"):
        runs.detect(clashing)
    assert runs.detect(clashing, runs="r", rest="c").where("found__ = 2 AND runs = 1").count() == len(corpus)


def test_a_text_of_five_megabytes():
    text = b" ".join(b"w%d" % (i % 90_000) for i in range(700_000))
    (row,) = runs._detected(pd.Series([text])).itertuples(index=False)
    assert (row.start, row.length, row.period) == ([0], [700_000], [90_000]) and len(row.rest.split()) == 90_000
