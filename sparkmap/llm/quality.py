"""Quality rules with an isolation forest over their statistics.

The rules' statistics of each whole text are counted first.  An isolation
forest (Liu, Ting, Zhou 2008) is then grown on a bounded sample of the labelled
documents that pass the base rules: each tree splits a small draw of them at
random values of random features until its rows stand alone.  A document whose
paths are short on average is an anomaly.  The labels of the sample calibrate
the forest: the statistics it may split on are taken up one by one while they
raise the balanced accuracy, since a rare statistic need not be a bad one (clean
pages repeat lines), and the threshold on the score is the one with the best
balanced accuracy.  Everything else, statistics and scores, covers all documents.

The features are shares, not counts, so that a long clean document looks like a
short one.

Defined cases: a null or empty text has only zeros, fails the base rules and is
not kept; without labels of both kinds no document is an anomaly; labels that
repeat a doc_id count with their least quality; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sparkmap.llm.common import SYMBOLS, hash_share
from sparkmap.session import materialize

BLANKS = b" \t\n\r\x0b\x0c"
SAMPLE_ROWS = 10_000
TREES = 200
DRAW = 64
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_marks long"
MARKS = b".,;:!?"


def _repeat_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that is found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    seen = np.zeros(len(words), bool)
    at = np.flatnonzero([often[w] > 1 for w in windows])
    for i in range(3):
        seen[at + i] = True
    return int(seen.sum())


def _stats(text: bytes | None) -> tuple[int, ...]:
    if not text:
        return (0,) * 8
    words, lines = text.split(), [line for line in text.split(b"\n") if line.translate(None, BLANKS)]
    count = lambda chars: len(text) - len(text.translate(None, chars))
    raw = np.frombuffer(text, np.uint8)
    points = int(((raw & 0xC0) != 0x80).sum())
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    return (
        len(words), points - count(BLANKS), count(SYMBOLS.encode()), len(lines) - len(set(lines)),
        _repeat_words(words), len(lines), upper, count(MARKS),
    )


NAMES = [x.split()[0] for x in STATS.split(", ")]


def _stats_of(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_stats(t) for t in text], columns=NAMES, dtype="int64")


def statistics(text: Column) -> Column:
    """The rules' statistics as a struct; all zero for a null text."""
    return F.pandas_udf(_stats_of, STATS)(text.cast("binary"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def features(s: pd.DataFrame) -> np.ndarray:
    at_least_one = lambda c: np.maximum(s[c].to_numpy(float), 1.0)
    words, chars, lines = at_least_one("n_words"), at_least_one("word_chars"), at_least_one("n_lines")
    return np.stack(
        [s["n_symbols"] / chars, s["n_dup_lines"] / lines, s["n_repeat_words"] / words, chars / words / 10, s["n_upper"] / chars, s["n_marks"] / words],
        axis=1,
    )


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 2.0)
    return np.where(n > 2, 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


class Forest:
    """Trees in arrays: feature (-1: leaf), cut, left, right, and a leaf's depth with the mean path of its rows."""

    def __init__(self, x: np.ndarray, columns: list[int], trees: int = TREES, draw: int = DRAW, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.columns, x = columns, x[:, columns]
        self.draw = min(draw, len(x))
        self.trees = [self._grow(x[rng.choice(len(x), self.draw, replace=False)], rng) for _ in range(trees)]

    @staticmethod
    def _grow(x: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        nodes: list[list] = []
        deepest = int(np.ceil(np.log2(max(len(x), 2)))) + 2
        todo = [(x, 0, -1, 0)]
        while todo:
            rows, depth, above, side = todo.pop()
            if above >= 0:
                nodes[above][2 + side] = len(nodes)
            low, high = rows.min(0), rows.max(0)
            wide = np.flatnonzero(high > low)
            if depth >= deepest or len(rows) < 2 or not len(wide):
                nodes.append([-1, 0.0, 0, 0, depth + float(_mean_path(len(rows)))])
                continue
            f = rng.choice(wide)
            cut = rng.uniform(low[f], high[f])
            nodes.append([f, cut, 0, 0, 0.0])
            here = len(nodes) - 1
            todo += [(rows[rows[:, f] < cut], depth + 1, here, 0), (rows[rows[:, f] >= cut], depth + 1, here, 1)]
        f, cut, left, right, path = zip(*nodes)
        return np.array(f), np.array(cut), np.array(left), np.array(right), np.array(path)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path / expected path): near 1 for anomalies."""
        x, total = x[:, self.columns], np.zeros(len(x))
        for f, cut, left, right, path in self.trees:
            at = np.zeros(len(x), int)
            open_ = np.flatnonzero(f[at] >= 0)
            while len(open_):
                node = at[open_]
                at[open_] = np.where(x[open_, f[node]] < cut[node], left[node], right[node])
                open_ = open_[f[at[open_]] >= 0]
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / float(max(_mean_path(self.draw), 1e-9)))


def calibrate(scores: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """The threshold between two neighbouring scores with the best balanced accuracy (above it is an
    anomaly), and twice that accuracy."""
    if good.all() or not good.any():
        return np.inf, 1.0
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    kept = np.cumsum(g) / g.sum() + 1 - np.cumsum(~g) / (~g).sum()
    kept[:-1][s[1:] == s[:-1]] = -1  # no threshold inside a tie
    best = int(np.argmax(kept))
    threshold = float(s[best]) if best + 1 == len(s) else float((s[best] + s[best + 1]) / 2)
    return threshold, float(kept[best])


def choose(x: np.ndarray, good: np.ndarray) -> list[int]:
    """Columns that separate the labels, taken up one by one as long as each adds to the accuracy."""
    chosen: list[int] = []
    reached = 1.0
    while len(chosen) < x.shape[1]:
        gain = {}
        for c in set(range(x.shape[1])) - set(chosen):
            gain[c] = calibrate(Forest(x, [*chosen, c], trees=TREES // 4).scores(x), good)[1]
        best = max(gain, key=lambda c: (gain[c], -c))
        if gain[best] < reached + 1e-3:
            break
        reached = gain[best]
        chosen.append(best)
    return chosen


def fit(stats: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[Forest, float] | None:
    """Forest and threshold from about `rows` labelled documents that pass the base rules, drawn by hash."""
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    passed = stats.where(~base_failed()).join(marked, "doc_id").select("quality", *NAMES, hash_share(F.col("doc_id")).alias("at"))
    n = passed.count()
    if n < 2:
        return None
    sample = passed.where(F.col("at") < min(1.0, rows / n)).toPandas().sort_values("at", ignore_index=True)
    x = features(sample)
    good = sample["quality"].to_numpy() == 1
    forest = Forest(x, choose(x, good) or list(range(x.shape[1])))
    return forest, calibrate(forest.scores(x), good)[0]


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, anomaly (score), kept: one row per row of `docs`."""
    stats = materialize(docs.select("doc_id", statistics(F.col("text")).alias("s")).select("doc_id", "s.*"), "statistics")
    model = fit(stats, labels)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(model[0].scores(features(b)) if model else np.zeros(len(b)))

    anomaly = F.pandas_udf(score, "double")(F.struct(*NAMES)) if model else F.lit(0.0)
    out = stats.withColumn("base_failed", base_failed()).withColumn("anomaly", anomaly)
    threshold = model[1] if model else float("inf")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= F.lit(threshold)))
