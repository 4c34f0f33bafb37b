"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for _module in ("q_simhash", "q_tokenfiles", "q_packing", "q_quality", "q_sharding", "q_language", "q_embeddings", "q_toxicity", "q_mixing", "q_linededup", "q_secrets", "q_whitening", "q_runs"):
    _m = import_module(f"sparkmap.llm.{_module}")
    QUERIES[_m.NAME] = _m.query
    if getattr(_m, "SQL", None):
        ORACLES[_m.NAME] = _m.SQL
