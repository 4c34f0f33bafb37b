"""op8: the toxicity of every text of `documents`; a third of the documents is held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkmap.llm.common import table
from sparkmap.llm.toxicity import fit, may_learn, score

NAME = "op8_toxicity"
THRESHOLD = 0.7


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs.where(may_learn()), table(spark, sf_dir, "labels", "doc_id", "toxic").where(may_learn()))
    return score(docs, model).select(
        "doc_id",
        F.coalesce(~may_learn(), F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"),
    )
