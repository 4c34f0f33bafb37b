"""op13: periodic runs of the whole of `documents`, a tenth of them with a repeating tail."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkmap.llm.common import table
from sparkmap.llm.runs import detect

NAME = "op13_periodic_runs"


def _tail(doc_id: object, text: bytes | None) -> bytes | None:
    """The words, joined by single spaces, with those from a on repeating with period p where the document's hash says so."""
    if text is None or pd.isna(doc_id):
        return text
    h = zlib.crc32(str(int(doc_id)).encode())
    words = text.split() if h % 10 == 0 else None
    if not words:
        return text
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)])


def with_tails(doc_id: Column, text: Column) -> Column:
    def run(ids: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([_tail(i, t) for i, t in zip(ids, texts)], dtype=object)

    return F.pandas_udf(run, "binary")(doc_id.cast("string"), text.cast("binary"))


def _lines(r: Column) -> Column:
    return F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = detect(docs.select("doc_id", with_tails(F.col("doc_id"), F.col("text")).alias("text")))
    # runs come by start and period, so the first of the greatest stays
    greater = lambda m, r: m.isNull() | (r["length"] * m["period"] > m["length"] * r["period"])
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda m, r: F.when(greater(m, r), r).otherwise(m))
    return out.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", _lines), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
