"""op5: the whole of `documents` in 24 shards under the law `rows`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkmap.llm.common import table
from sparkmap.llm.sharding import shard

NAME = "op5_sharding"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
