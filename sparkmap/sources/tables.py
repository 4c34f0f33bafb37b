"""Table readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from sparkmap.functions.numeric import finite
from sparkmap.functions.text import valid_text


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Plain or gzip CSV with a header; the schema is given, never inferred."""
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False)


def read_tsv(spark: SparkSession, path: str, wanted: Sequence[str] | None = None) -> DataFrame:
    """TSV as text columns; of `wanted`, what exists is read and the rest is NULL.  A file of another header is an error."""
    df = spark.read.csv(path, sep="\t", header=True, enforceSchema=False)
    if wanted is None:
        return df
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in wanted])


def read_json_docs(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON document per file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_tree(
    spark: SparkSession, paths: Sequence[str], keys: Sequence[str] = ("sub", "ses"), wanted: Sequence[str] | None = None
) -> DataFrame:
    """TSV files of a directory tree, with `key-value` parts of the path as columns.

    One read per layout (glob): files of a glob share their header - one that
    does not is an error, never a silent shift of columns - while globs may
    differ and are united by name.  Adds `file` and one column per key.
    """
    out = None
    for path in paths:
        df = spark.read.csv(path, sep="\t", header=True, enforceSchema=False).withColumn("file", F.col("_metadata.file_path"))
        for key in keys:
            value = F.regexp_extract("file", rf"(?:^|[/_=]){key}-([A-Za-z0-9]+)", 1)
            df = df.withColumn(key, F.nullif(value, F.lit("")))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if wanted is None:
        return out
    have = [F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in wanted]
    return out.select(*keys, "file", *have)


def read_cells(spark: SparkSession, paths: Sequence[str], keys: Sequence[str] = ("sub", "ses"), sep: str = "\t") -> DataFrame:
    """Rows of text tables whose headers differ from file to file: keys of the path, `file`, `columns`, `cells`.

    `columns` is the header as it stands, `cells` maps each column name in lower
    case to its value (of names that agree in lower case the first counts; a
    short row has NULL at its end).  The header is each file's first line, so
    files are split and read like any text; a file without rows gives none.
    """
    lines = spark.read.text(list(paths)).select(
        F.col("value"), F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id")).alias("at"),
    )
    tab = F.lit("\\Q" + sep + "\\E")
    header = lines.groupBy("file").agg(F.min(F.struct("at", "value")).alias("h")).select(
        "file", F.col("h.at").alias("_first"), F.split("h.value", tab).alias("columns")
    )
    low = F.transform("columns", lambda c: F.lower(F.trim(c)))
    named = header.withColumn("_low", low)
    rows = lines.join(named, "file").where((F.col("at") != F.col("_first")) & (F.col("value") != "")).withColumn("_v", F.split("value", tab))
    first = F.filter(F.sequence(F.lit(1), F.size("_low")), lambda i: F.array_position("_low", F.get("_low", i - 1)) == i)
    cells = F.map_from_entries(F.transform(first, lambda i: F.struct(F.get("_low", i - 1), F.get("_v", i - 1))))
    found = [F.nullif(F.regexp_extract("file", rf"(?:^|[/_=]){key}-([A-Za-z0-9]+)", 1), F.lit("")).alias(key) for key in keys]
    return rows.select(*found, "file", "columns", cells.alias("cells"))


def column_evidence(cells: DataFrame) -> DataFrame:
    """What each column of each file holds: rows, present values, and the share of these that are numbers."""
    long = cells.select("file", F.explode("cells").alias("column_name", "value"))
    there = valid_text(F.col("value"))
    number = F.when(there, F.coalesce(finite(F.col("value").try_cast("double")), F.lit(False)).cast("double"))
    return long.groupBy("file", "column_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(there).alias("n_present"), F.avg(number).alias("numeric_share")
    )


def pick_column(df: DataFrame, candidates: Sequence[str], strict: bool = False) -> str:
    """First column that matches a candidate regardless of case; strict wants exactly one match."""
    by_key = {}
    for c in df.columns:
        by_key.setdefault(c.strip().lower(), c)
    hits = [by_key[c.strip().lower()] for c in candidates if c.strip().lower() in by_key]
    if not hits or (strict and len(set(hits)) != 1):
        raise ValueError(f"{len(hits)} of {list(candidates)} found in {df.columns}")
    return hits[0]


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write once; an existing table is an error."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def write_sorted_csv_gz(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Key-sorted compressed export: range-partitioned, so part files are in order too."""
    df.orderBy(*keys).write.mode("errorifexists").option("compression", "gzip").csv(path, header=True)


def write_manifest(df: DataFrame, path: str) -> None:
    """Nested one-row summary as one JSON document."""
    df.coalesce(1).write.mode("errorifexists").json(path)  # a single row

