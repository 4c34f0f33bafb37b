"""op12: the whitened components of the whole of `embeddings`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkmap.llm.common import table
from sparkmap.llm.whitening import TOP, identity_error, whiten

NAME = "op12_whitening"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    values = model.values[:TOP] if model else []
    error = identity_error(rows, len(values))
    shares = F.array(*[F.lit(float(v / model.total)) for v in values]) if len(values) else F.array().cast("array<double>")
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("pos", "whitened")).select(
        "vec_id",
        (F.col("pos") + 1).cast("int").alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("pos")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
