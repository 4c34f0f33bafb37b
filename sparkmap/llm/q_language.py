"""op6: the language of every text of `documents`; a quarter of the documents is held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkmap.llm.common import table
from sparkmap.llm.language import fit, identify, may_learn

NAME = "op6_language"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = fit(docs.where(may_learn()))
    held = F.coalesce(~may_learn(), F.lit(False)).alias("held_out")
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held, "lang_pred", "score")
