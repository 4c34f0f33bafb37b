"""Toxicity by a weighted finite-state grammar over clauses.

Words are tagged with a class (insult, threat, target, negation, reported
speech, other).  Three small transducers read the tags of a clause and rewrite
them: behind a negation an insult or threat becomes a negated one, in reported
speech a reported one, near a target an aimed one.  They are composed once into
one transducer; the weight of each matched word is multiplied by the factor of
the tag that comes out.  A document's score is a logistic function of the sums
over its clauses, not of isolated words.

What is learnt: insult words and stems (word beginnings) with their weights, as
log-odds over a bounded sample of labelled documents, and, on the other half of
the sample, the logistic function.  Threats, targets, negations and verbs of
speech are short fixed lists.

Defined cases: a null or empty text scores like any text without a match; without
labels of both kinds the score is the share of toxic labels (0 without labels);
labels that repeat a doc_id count with their greatest value.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sparkmap.llm.common import hash_share
from sparkmap.session import materialize

SAMPLE_PER_CLASS = 6000
STEMS = (3, 4, 5, 6, 7)
LEAST_WEIGHT = 1.8
#: Dunning's log-likelihood ratio: keeps entries out that are rare by chance.
LEAST_EVIDENCE = 30.0

# Closed word classes of the languages at hand.
TARGETS = "you your yours yourself u du dich dir dein deine ihr euch tu toi vous ton ta votre tú ti usted ustedes vosotros".split()
NEGATIONS = "not no never nobody isn't aren't wasn't don't nicht kein keine nie pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say wrote called claimed quoted reported sagte schrieb meinte dit écrit affirme dijo escribió afirma".split()
THREATS = "kill hurt destroy beat shoot stab töten umbringen schlagen tuer frapper détruire matar golpear destruir".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Tags that come out: insults and threats carry their setting as bits.
NEGATED, REPORTED, AIMED = 1, 2, 4
FACTORS = {NEGATED: 0.25, REPORTED: 0.4, AIMED: 1.5}
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]")
CLAUSE_END = frozenset(".!?;:\n")


class Transducer:
    """Deterministic: step[state][tag] = (next state, bits that come out for an insult or threat)."""

    def __init__(self, opens: int, scope: int, bit: int):
        """Behind a tag `opens`, the next `scope` words carry `bit`."""
        self.step = []
        for left in range(scope + 1):
            row = [(max(0, left - 1), bit if left else 0)] * 6
            row[opens] = (scope, 0)
            self.step.append(row)


def compose(parts: list[Transducer]) -> list[list[tuple[int, int]]]:
    """One table for running all parts side by side on the same tags."""
    states = list(product(*[range(len(p.step)) for p in parts]))
    number = {s: i for i, s in enumerate(states)}
    table = []
    for s in states:
        row = []
        for tag in range(6):
            moves = [p.step[x][tag] for p, x in zip(parts, s)]
            row.append((number[tuple(m[0] for m in moves)], sum(m[1] for m in moves)))
        table.append(row)
    return table


GRAMMAR = compose([Transducer(NEGATION, 3, NEGATED), Transducer(REPORT, 12, REPORTED), Transducer(TARGET, 6, AIMED)])


def _forms(word: str) -> list[str]:
    """A word and its stems (with a hyphen behind them)."""
    return [word] + [word[:k] + "-" for k in STEMS if len(word) > k]


def entries(text: str) -> set[str]:
    """Words and stems of a text; those that occur again also with a 2 in front."""
    n = Counter(f for w in WORD.findall(text) if len(w) > 1 for f in _forms(w.lower()))
    return set(n) | {"2" + f for f, k in n.items() if k > 1}


class Lexicon:
    """Weights of entries; a form in it counts with the weight for one occurrence or, if greater, for two."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.forms = {f.removeprefix("2") for f in weights}
        self.fixed = {w: t for t, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in ws}
        self.memo: dict[str, tuple[int, tuple[str, ...]]] = {}

    def tag(self, word: str) -> tuple[int, tuple[str, ...]]:
        """Class of a word and the lexicon's forms of it."""
        found = self.memo.get(word)
        if found is None:
            w = word.lower()
            forms = tuple(f for f in _forms(w) if f in self.forms)
            found = (INSULT if forms else self.fixed.get(w, OTHER), forms)
            if len(self.memo) < 500_000:
                self.memo[word] = found
        return found

    def measure(self, text: str | None) -> tuple[float, ...]:
        """Matched weight, best clause, matched words, and matched words per 100 words (whole text)."""
        total = best = clause = hits = 0.0
        words = WORD.findall(text or "")
        tags = [self.tag(w) for w in words]
        if not any(t == INSULT or t == THREAT for t, _ in tags):
            return 0.0, 0.0, 0.0, 0.0
        seen = Counter(f for _, forms in tags for f in forms)
        get = self.weights.get
        worth = {f: max(get(f, 0.0), get("2" + f, 0.0) if n > 1 else 0.0) for f, n in seen.items()}
        state = 0
        for word, (tag, forms) in zip(words, tags):
            if word in CLAUSE_END:
                best, clause, state = max(best, clause), 0.0, 0
                continue
            state, bits = GRAMMAR[state][tag]
            if tag in (INSULT, THREAT):
                weight = max([worth[f] for f in forms], default=1.0)
                for bit, factor in FACTORS.items():
                    if bits & bit:
                        weight *= factor
                clause += weight
                total += weight
                hits += weight > 0
        return total, max(best, clause), hits, 100 * hits / len(words)


def _design(m: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(m)), np.log1p(m[:, 0]), np.log1p(m[:, 1]), np.log1p(m[:, 2]), np.log1p(m[:, 3])])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton steps with a small ridge, which keeps separable samples finite."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


class Model:
    def __init__(self, lexicon: Lexicon, coefficients: np.ndarray):
        self.lexicon, self.coefficients = lexicon, coefficients

    def scores(self, texts) -> np.ndarray:
        m = np.array([self.lexicon.measure(t) for t in texts], float).reshape(-1, 4)
        return 1 / (1 + np.exp(-np.clip(_design(m) @ self.coefficients, -30, 30)))


def may_learn(fold: int = 3, out: int = 1) -> Column:
    """Documents outside the held-out fold."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold != out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model from the labelled ones of `docs`, about `per_class` rows a class, drawn by hash."""
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        edge = 30.0 if sizes.get(1) else -30.0
        return Model(Lexicon({}), np.array([edge, 0, 0, 0, 0]))
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / sizes[1])).otherwise(min(1.0, per_class / sizes[0]))
    drawn = materialize(
        marked.where(hash_share(F.col("doc_id"), F.lit("toxic")) < share).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))),
        "drawn",
    )
    n_half = {(r["half"], r["toxic"]): r["n"] for r in drawn.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    # ids and labels alone, about 2 * per_class rows; the count is checked before they are broadcast
    few = sum(n_half.values()) <= 4 * per_class
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn) if few else drawn, "doc_id")

    @F.pandas_udf("array<string>")
    def found(text: pd.Series) -> pd.Series:
        return pd.Series([sorted(entries(t)) if t else [] for t in text])

    first = sample.where("half = 0").select("toxic", F.explode(found("text")).alias("entry"))
    n_bad, n_good = n_half.get((0, 1), 0), n_half.get((0, 0), 0)
    odds = lambda n, of: F.log((n + 0.5) / (of + 1.0))

    def surprise(name: str, of: int) -> Column:
        n, expected = F.col(name), (F.col("bad") + F.col("good")) * (of / max(n_bad + n_good, 1))
        return F.when(n > 0, n * F.log(n / F.greatest(expected, F.lit(1e-9)))).otherwise(0.0)

    table = (
        first.groupBy("entry").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
        .withColumn("weight", odds(F.col("bad"), n_bad) - odds(F.col("good"), n_good))
        .withColumn("evidence", 2 * (surprise("bad", n_bad) + surprise("good", n_good)))
        .where((F.col("weight") >= LEAST_WEIGHT) & (F.col("evidence") >= LEAST_EVIDENCE))
    )  # as many as the bounded sample holds
    lexicon = Lexicon({r["entry"]: r["weight"] for r in table.select("entry", "weight").collect()})

    @F.pandas_udf("array<double>")
    def measured(text: pd.Series) -> pd.Series:
        return pd.Series([list(lexicon.measure(t)) for t in text])

    # rows that repeat a drawn id are drawn with it, so the number of rows is bounded as well
    second = sample.where("half = 1").select("toxic", measured("text").alias("m"), F.xxhash64("text").alias("h")).orderBy("h").limit(4 * per_class).toPandas()
    if second["toxic"].nunique() < 2:
        return Model(lexicon, np.array([math.log(1e-3), 1.0, 1.0, 1.0, 0.0]))
    x = _design(np.array(second["m"].tolist()))
    y = second["toxic"].to_numpy(float)
    order = np.lexsort(np.column_stack([x, y]).T)
    return Model(lexicon, _logistic(x[order], y[order]))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """`docs` with the probability of label 1."""

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores(texts))

    return docs.withColumn(name, F.pandas_udf(scored, "double")("text"))
