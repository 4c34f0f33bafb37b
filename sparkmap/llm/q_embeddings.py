"""op7: near-duplicates among all of `embeddings`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkmap.llm.common import table
from sparkmap.llm.embeddings import near_duplicates

NAME = "op7_embeddings"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
