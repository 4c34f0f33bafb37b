import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, size string, epochs string, fp string, row__ string"
WORDS = {"en": "the of and there with house water street light morning".split(), "de": "der und nicht haus wasser straße licht morgen über".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "en"]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Rows with nulls in every column, empty, blank and very long texts, copies, repeated rows and clashing names."""
    rng = random.Random(4)
    rows = []
    for i in range(160):
        lang = rng.choice(["en", "de"])
        rows.append((i, prose(rng, lang, rng.randint(1, 150)), lang, rng.choice(["a", "b", "c", "b"]), "x", "y", "z", "w"))
    copy = rows[3][1]
    for i in range(160, 240):  # a third of all rows are copies of one text, in one source
        rows.append((i, copy, "en", "b", "x", "y", "z", "w"))
    rows += [
        (240, None, "en", "a", None, None, None, None), (241, "", "en", None, None, None, None, None),
        (242, " \n\t ", None, "a", None, None, None, None), (243, "123 456 !!", None, None, None, None, None, None),
        (None, "a text without a number", None, None, None, None, None, None), (None, None, None, None, None, None, None, None),
        (244, prose(rng, "en", 20_000), "en", "c", None, None, None, None), (5, rows[5][1], rows[5][2], rows[5][3], "x", "y", "z", "w"),
        (5, rows[5][1], rows[5][2], rows[5][3], "x", "y", "z", "w"),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
