"""Session defaults and the shared place where long lineages are cut."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_stage_folder: ContextVar[str | None] = ContextVar("stage_folder", default=None)


def build_session(app: str = "sparkmap", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Nothing here is required for right results.  AQE coalesces small shuffles,
    turns joins into broadcasts once a side has been *measured* to be small and
    splits skewed join partitions.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        b = b.config(key, value)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; where that is unset, a folder under the
    session's `spark.sql.warehouse.dir`, which every executor reaches as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write `df` once to the shared folder and continue from the written table.

    Used where several jobs read one expensive intermediate.  The copy survives
    the loss of executors, keeps column pruning for its readers, and its size is
    known to the planner, so a broadcast of it is decided on a measured size.
    """
    spark = df.sparkSession
    path = f"{_stage_folder.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def stage_tables(spark: SparkSession) -> Iterator[str]:
    """What `materialize` writes inside the block goes to a folder of its own, which is removed at the block's end.

    Whatever is still wanted then must have been written elsewhere within the
    block; frames that read the folder's tables are of no use after it.
    """
    folder = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    before = _stage_folder.set(folder)
    try:
        yield folder
    finally:
        _stage_folder.reset(before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str = "stage") -> DataFrame:
    """The rows of `make()`, written once; tables that `make` materialized on its way are removed."""
    path = f"{_stage_folder.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with stage_tables(spark):
        rows = make()
        rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs that run inside the block hand Python at most `most` rows at a time; the setting before comes back after it.

    For rows as long as whole texts, of which the default 10,000 take tens of MB on either side of each task.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    if before is None or not 0 < int(before) <= most:
        spark.conf.set(key, most)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
