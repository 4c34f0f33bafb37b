"""Quality rules, language identification, toxicity."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkmap.llm import language, quality, toxicity


def brute_stats(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    windows = list(zip(words, words[1:], words[2:]))
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return (
        len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)), len(inside),
    )


@pytest.mark.parametrize("text", [None, "", "a", "a b c a b c x", "l\nl\n \n\nl m", "é # ü ** <x>\x1f", "one word two\x0bthree", "a a a a"])
def test_statistics(text):
    assert quality._stats(text.encode() if text is not None else None)[:5] == brute_stats(text)


def test_forest_finds_the_odd_ones():
    rng = np.random.default_rng(0)
    x = np.concatenate([np.column_stack([np.zeros(500), rng.random(500) * 0.2]), np.column_stack([rng.uniform(0.1, 0.4, 20), rng.random(20) * 0.2])])
    good = np.arange(520) < 500
    forest = quality.Forest(x, quality.choose(x, good))
    threshold, accuracy = quality.calibrate(forest.scores(x), good)
    assert forest.columns == [0] and accuracy == 2.0
    assert ((forest.scores(x) <= threshold) == good).all()


def test_judge(spark, docs, corpus, no_docs):
    labels = spark.createDataFrame([(i, int(i % 7 != 0)) for i in range(160)] + [(1, None), (None, 0), (3, 0)], "doc_id long, quality int")
    got = quality.judge(docs, labels).toPandas()
    assert len(got) == len(corpus)
    want = {(r[0], *brute_stats(r[1])) for r in corpus if r[0] is not None}
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert set(got[got.doc_id.notna()][names].astype(int).itertuples(index=False, name=None)) == want
    assert (got.base_failed == ((got.n_words < 50) | (100 * got.n_repeat_words > 50 * got.n_words))).all()
    assert not got.kept[got.base_failed].any()
    none = spark.createDataFrame([], "doc_id long, quality int")
    unlabelled = quality.judge(docs, none).toPandas()
    assert (unlabelled.kept == ~unlabelled.base_failed).all()
    assert quality.judge(no_docs, labels).count() == 0


def test_language(docs, corpus, no_docs):
    model = language.fit(docs.where(language.may_learn()))
    got = language.identify(docs, model).toPandas()
    assert len(got) == len(corpus)
    letters = got.text.fillna("").str.contains(r"[^\W\d_]")
    assert (got.lang_pred[~letters] == "und").all() and (got.score[~letters] == 0).all()
    long = got[letters & (got.text.str.len() > 40) & got.lang.notna()]
    assert (long.lang_pred == long.lang).mean() > 0.97
    assert got.score.between(0, 1).all()
    assert language.fit(no_docs) is None
    assert set(language.identify(docs, None).toPandas().lang_pred) == {"und"}
    assert language.identify(no_docs, model).count() == 0


def test_letters():
    assert [language.has_letter(t) for t in (None, "", "12 ½²①Ⅷ _", "½x", "漢", "é", "ª")] == [False, False, False, True, True, True, True]
    model = language.Model(["de", "en"], np.zeros((language.BUCKETS, 2), np.float32), np.zeros(2))
    assert model.predict("½ ² ① Ⅷ") == ("und", 0.0) and model.predict("½ a")[0] == "de"


def test_language_sample_is_held_once():
    """The drawn rows are read in place, batch by batch, a row without features among them."""
    at, n = [[3, 5], [], [7]], [[0.25, 0.75], [], [1.0]]
    schema = pa.schema([("at", pa.list_(pa.int32())), ("n", pa.list_(pa.float32()))])
    one = pa.record_batch([pa.array(at, schema[0].type), pa.array(n, schema[1].type)], schema=schema)
    sample = pa.Table.from_batches([one, one.slice(0, 0), one.slice(1, 2)])
    got = language._rows(sample)
    assert [(a.tolist(), b.tolist()) for a, b in got] == list(zip(at + at[1:], n + n[1:]))
    assert np.shares_memory(got[0][0], one["at"].values.to_numpy()) and got[0][1].dtype == np.float32


def test_language_held_out(docs, corpus):
    """Documents of the held-out fold are told by a model that never saw them."""
    model = language.fit(docs.where(language.may_learn()))
    held = language.identify(docs.where(~language.may_learn()), model).where("lang IS NOT NULL AND length(text) > 40").toPandas()
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.97


def test_one_id_on_a_third_of_all_rows(spark, docs):
    many = docs.withColumn("doc_id", F.when(F.xxhash64("text", "doc_id") % 3 == 0, 7).otherwise(F.col("doc_id")))
    copies = many.unionByName(spark.range(300).select(F.lit(7).cast("long").alias("doc_id"), F.lit("der the und and haus house").alias("text"), F.lit("de").alias("lang"), *[F.lit(None).cast("string").alias(c) for c in docs.columns[3:]]))
    model = language.fit(copies, per_language=50)
    got = language.identify(docs.where("length(text) > 200 AND lang IS NOT NULL"), model).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.9


def test_grams_are_whole_text():
    assert len(language._grams("abcde")) == 5 + 4 + 3
    assert len(language._grams("ab")) == 3
    at, n = language._counts("ab" * 3000)
    assert n.sum() == 6000 + 5999 + 5998


def test_language_weights_are_sparse(docs):
    model = language.fit(docs)
    assert 0 < (model.table != 0).mean() < 0.2 and model.temperature > 0


def test_composed_grammar():
    lexicon = toxicity.Lexicon({"fool": 2.0})
    score = lambda t: lexicon.measure(t)[0]
    assert score("what a fool") == 2.0
    assert score("you fool") == 3.0
    assert score("not a fool") == 0.5
    assert score("she said you are no fool") == pytest.approx(2 * 0.4 * 1.5 * 0.25)
    assert score("she said so. what a fool") == 2.0  # the clause ends
    assert score("clean words only") == 0.0 and score(None) == 0.0 and score("") == 0.0
    assert lexicon.measure("they will kill you")[2] == 1


def test_toxicity(spark, no_docs):
    rng = random.Random(2)
    base = "one two three four five six seven eight nine ten".split()
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(base) for _ in range(rng.randint(5, 60))]
        bad = i % 3 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), "vilen" + rng.choice("abc"))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(bad)))
    rows += [(900, None, None), (901, "", None), (None, "vilena vilenb vilenc", None), (902, "vilena " * 30_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    marks = spark.createDataFrame(labels + [(0, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs.where(toxicity.may_learn()), marks.where(toxicity.may_learn()))
    got = toxicity.score(docs, model).toPandas().set_index("doc_id")
    truth = np.array([y for _, y in labels])
    assert ((got.score.loc[range(900)] >= 0.7) == (truth == 1)).mean() > 0.99
    assert got.score[900] == got.score[901] < 0.5 < got.score[902]
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    assert toxicity.score(no_docs, model).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, marks.where(F.lit(False)))).toPandas().score.max() < 0.5
