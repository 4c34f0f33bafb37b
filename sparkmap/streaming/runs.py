"""Incremental ingest of recording runs.

`ingest_runs_incremental` extracts each file by itself.  `ingest_samples` is for
runs whose samples come in several files: windows reach across file borders, so
a run is extracted once all its samples are there.  A ledger, one row for each
(batch, run), tells when that is; the final write is refused while a run is open.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

PARTS = 16  # folders of pieces a batch; only those of the runs it closes are read again


def pending_runs(source: DataFrame, done: DataFrame, run: str = "run_base") -> DataFrame:
    """Rows of runs that have no result yet."""
    return source.join(done.select(run).distinct(), run, "left_anti")


def ingest_runs_incremental(
    spark: SparkSession,
    source: str,
    schema,
    target: str,
    checkpoint: str,
    extract: Callable[[DataFrame], DataFrame] = lambda df: df,
    run: str = "run_base",
    max_files: int = 1000,
) -> None:
    """Extract every new file of `source` once and append it to `target`, one folder per run.

    The file stream's checkpoint remembers what was read, also after a restart.
    A batch replaces its own `batch` folder, so one that is repeated after a
    failure leaves no duplicates.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            extract(batch)
            .withColumn("batch", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch", run)
            .parquet(target)
        )

    query = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files)
        .parquet(source)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _replace(df: DataFrame, batch_id: int, path: str, *by: str) -> None:
    """Write a batch's rows in place of those it wrote before a failure."""
    (
        df.withColumn("batch", F.lit(batch_id).cast("long"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch", *by)
        .parquet(path)
    )


def _read(spark: SparkSession, path: str, columns: StructType) -> DataFrame:
    """A written table with its own column types (not those guessed from folder names)."""
    return spark.read.schema(StructType([*columns.fields, *spark.range(0).select(F.col("id").alias("batch")).schema.fields])).parquet(path)


def ledger(spark: SparkSession, folder: str, run: str = "run_base") -> DataFrame:
    """How many samples of each run each batch brought: `run`, `n_rows`, `batch`."""
    return _read(spark, f"{folder}/ledger", spark.createDataFrame([], f"`{run}` string, n_rows long").schema)


def ingest_samples(
    spark: SparkSession,
    source: str,
    schema,
    expected: DataFrame,
    cut: Callable[[DataFrame], DataFrame],
    extract: Callable[[DataFrame], DataFrame],
    folder: str,
    run: str = "run_base",
    max_files: int = 1000,
) -> None:
    """Read every new file of `source` once and extract each run when its last sample is there.

    `expected`: run, n_rows (samples that its recording holds).  `cut` keeps the
    samples inside event windows, `extract` turns all kept samples of some runs
    into trials.  Below `folder`: `pieces` (what `cut` kept, by batch and part of the runs),
    `ledger` and `trials`, each row with its batch.  A batch replaces its own
    rows, and which runs it closes follows from the ledger up to it, so a batch
    that is repeated after a failure changes nothing.
    """
    wanted = expected.select(F.col(run).cast("string").alias(run), F.col("n_rows").alias("n_expected"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn(run, F.col(run).cast("string"))
        kept = cut(batch).withColumn("part", F.pmod(F.xxhash64(run), F.lit(PARTS)).cast("long"))
        _replace(kept, batch_id, f"{folder}/pieces", "part")
        _replace(batch.groupBy(run).agg(F.count(F.lit(1)).alias("n_rows")), batch_id, f"{folder}/ledger")
        counts = ledger(spark, folder, run).where(F.col("batch") <= batch_id).groupBy(run).agg(
            F.sum("n_rows").alias("n_seen"), F.sum(F.when(F.col("batch") < batch_id, F.col("n_rows")).otherwise(0)).alias("n_before")
        )
        closing = counts.join(wanted, run).where("n_seen >= n_expected AND n_before < n_expected").select(run)
        pieces = _read(spark, f"{folder}/pieces", kept.schema).where(F.col("batch") <= batch_id).drop("batch")
        whole = pieces.join(closing.withColumn("part", F.pmod(F.xxhash64(run), F.lit(PARTS)).cast("long")), ["part", run], "left_semi")
        _replace(extract(whole.drop("part")), batch_id, f"{folder}/trials")

    query = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files)
        .parquet(source)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def ledger_report(expected: DataFrame, seen: DataFrame, run: str = "run_base") -> DataFrame:
    """Each run's expected and seen samples and its status: completed, open, overfull, waiting or unexpected."""
    counts = seen.groupBy(run).agg(F.sum("n_rows").alias("n_seen"))
    e, n = F.col("n_expected"), F.coalesce("n_seen", F.lit(0))
    status = (
        F.when(e.isNull(), "unexpected").when(n == 0, "waiting").when(n < e, "open").when(n > e, "overfull").otherwise("completed")
    )
    wanted = expected.select(F.col(run).cast("string").alias(run), F.col("n_rows").alias("n_expected"))
    return wanted.join(counts, run, "full").select(run, "n_expected", n.alias("n_seen"), status.alias("status"))


def finalise(spark: SparkSession, expected: DataFrame, trials: StructType, folder: str, target: str, run: str = "run_base") -> DataFrame:
    """Write the trials once, to `target`, and return them; refused while any expected run is not complete.

    `trials` are the columns that `extract` gave.  Runs that nobody expected are never extracted.
    """
    gate = finalise_gate(ledger_report(expected, ledger(spark, folder, run), run)).first()
    if not gate.passed:
        raise RuntimeError(f"finalisation blocked: {gate.n_completed} of {gate.n_expected} runs complete")
    _read(spark, f"{folder}/trials", trials).drop("batch").write.mode("errorifexists").parquet(target)
    return spark.read.schema(trials).parquet(target)


def progress_report(expected: DataFrame, done: DataFrame, available: DataFrame, run: str = "run_base") -> DataFrame:
    """Status of every run: completed, ready, waiting (no file yet) or unexpected."""
    flag = lambda df, name: df.select(run).distinct().withColumn(name, F.lit(True))
    status = (
        F.when(F.col("_e").isNull(), "unexpected")
        .when(F.col("_d"), "completed")
        .when(F.col("_a"), "ready")
        .otherwise("waiting")
    )
    return (
        flag(expected, "_e")
        .join(flag(done, "_d"), run, "full")
        .join(flag(available, "_a"), run, "full")
        .select(run, status.alias("status"))
    )


def finalise_gate(report: DataFrame) -> DataFrame:
    """One row: whether every expected run is complete."""
    return report.where("status <> 'unexpected'").agg(
        F.count(F.lit(1)).alias("n_expected"), F.count_if(F.col("status") == "completed").alias("n_completed")
    ).withColumn("passed", F.col("n_expected") == F.col("n_completed"))
