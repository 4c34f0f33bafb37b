"""op1: fingerprints and near-duplicate components of the whole of `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkmap.llm.common import table
from sparkmap.llm.simhash import cluster

NAME = "op1_simhash"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cluster(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
