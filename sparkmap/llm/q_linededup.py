"""op10: the whole of `documents` without repeated lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkmap.llm.common import table
from sparkmap.llm.linededup import LEAST_CHARS, dedup

NAME = "op10_line_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


#: One edit leaves the first or the last four characters of so long a line alone, so near lines are sought
#: among all pairs of distinct lines of equal or neighbouring length with the same first or the same last four.
SQL = rf"""
WITH parts AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no
  FROM documents WHERE text IS NOT NULL),
long AS (SELECT * FROM parts WHERE length(line) >= {LEAST_CHARS}),
firsts AS (
  SELECT line, min((doc_id, no)) AS place, length(line) AS n, left(line, 4) AS head, right(line, 4) AS tail
  FROM long GROUP BY line),
near AS (
  SELECT DISTINCT b.line FROM firsts a JOIN firsts b
    ON a.n - b.n BETWEEN -1 AND 1 AND a.head = b.head AND a.place < b.place AND levenshtein(a.line, b.line) <= 1
  UNION
  SELECT DISTINCT b.line FROM firsts a JOIN firsts b
    ON a.n - b.n BETWEEN -1 AND 1 AND a.tail = b.tail AND a.place < b.place AND levenshtein(a.line, b.line) <= 1),
gone AS (
  SELECT l.doc_id, l.no FROM long l JOIN firsts f USING (line)
  WHERE (l.doc_id, l.no) <> f.place OR line IN (SELECT line FROM near)),
lost AS (SELECT doc_id, list(no) AS nos, count(*) AS k FROM gone GROUP BY doc_id)
SELECT d.doc_id,
  CASE WHEN k IS NULL THEN text ELSE
    array_to_string(list_transform(list_filter(
      list_zip(string_split(text, chr(10)), range(1, len(string_split(text, chr(10))) + 1)),
      lambda x: NOT list_contains(nos, x[2])), lambda x: x[1]), chr(10)) END AS text,
  coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(k, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN lost ON d.doc_id = lost.doc_id
"""
