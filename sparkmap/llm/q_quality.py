"""op4: rule statistics and verdicts for the whole of `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkmap.llm.common import table
from sparkmap.llm.quality import judge

NAME = "op4_quality"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly"
    )
