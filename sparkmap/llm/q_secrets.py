"""op11: secrets in the whole of `documents`, plain and in nested encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkmap.llm.common import table
from sparkmap.llm.secretscan import KINDS, find, spans

NAME = "op11_secret_scan"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents", "doc_id", "text"))
    plain = lambda kind: F.size(F.filter("secrets", lambda x: (x["steps"] == "") & (x["kind"] == kind)))
    return out.select(
        "doc_id",
        *[plain(kind).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(spans(F.col("secrets"), base=True), 256).alias("base_sha256"),
        spans(F.col("secrets")).alias("spans"),
    )
