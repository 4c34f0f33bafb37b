"""op9: the whole of `documents` mixed to 5 : 2 : 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkmap.llm.common import table
from sparkmap.llm.mixing import SEED, mix

NAME = "op9_mixing"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


SQL = rf"""
WITH words AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    coalesce(length(text) - length(translate(text, '#*$%&|<>', '')), 0) AS symbols,
    md5(concat_ws('|', '{SEED}', coalesce(doc_id::VARCHAR, '-'), md5(text))) AS tie
  FROM documents),
sized AS (
  SELECT doc_id, source, size, tie,
    -ln(1.0::DOUBLE - ('0x' || left(tie, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE)
      / ((size + 1)::DOUBLE / (size + symbols + 1)::DOUBLE) AS key
  FROM words),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
    source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total
  FROM sources),
levels AS (
  SELECT *, cap / weight AS reach,
    (total - coalesce(sum(cap) OVER before, 0.0::DOUBLE))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0::DOUBLE)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aims AS (
  SELECT source, source_size,
    coalesce(least(cap, max(CASE WHEN level <= reach THEN level END) OVER () * weight), cap) AS target
  FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM aims),
run AS (
  SELECT s.*, p.source_size, p.target, p.epochs, round(p.target - p.epochs * p.source_size)::BIGINT AS budget,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY key, tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS before
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, size, source_size, target, epochs,
  (epochs * size + greatest(0, least(size, budget - before)))::BIGINT AS taken
FROM run
"""
