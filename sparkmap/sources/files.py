"""File inventories: paths, sizes and content hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from hashlib import sha1, sha256
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)


def _empty(read: DataFrame) -> DataFrame:
    """Paths of the files without a byte: Spark lists them but reads no row of them."""
    listed = [(re.sub(r"^file:/+", "file:/", unquote(p)),) for p in read.inputFiles()]  # the listing that the driver has made anyway
    return read.sparkSession.createDataFrame(listed, "path string").join(read.select("path"), "path", "left_anti")


def path_table(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, length and modification time (NULL for an empty file) of the files below root; contents are not read."""
    read = _files(spark, root, pattern)
    none = _empty(read).select("path", F.lit(0).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modificationTime"))
    return read.select("path", "length", "modificationTime").unionByName(none)


def forbidden(path: Column, suffixes: Sequence[str], directories: Sequence[str] = ()) -> Column:
    low = F.lower(path)
    hit = F.lit(False)
    for s in suffixes:
        hit = hit | low.endswith(s.lower())
    for d in directories:
        hit = hit | low.contains(f"/{d.lower()}/")
    return hit


def guard_sources(paths: DataFrame, suffixes: Sequence[str], directories: Sequence[str] = ()) -> DataFrame:
    """The path table itself; reading it fails at the first forbidden path."""
    bad = forbidden(F.col("path"), suffixes, directories)
    stop = F.raise_error(F.concat(F.lit("forbidden source: "), F.col("path"))).cast("boolean")
    return paths.where(F.when(bad, stop).otherwise(F.lit(True)))


def candidate_paths(paths: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Paths whose file name holds a keyword, with suffix and a derivative flag."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    hit = F.lit(False)
    for k in keywords:
        hit = hit | name.contains(k.lower())
    return (
        paths.where(hit)
        .withColumn("file_name", name)
        .withColumn("suffix", F.regexp_extract(name, r"(\.[a-z0-9]+(?:\.gz)?)$", 1))
        .withColumn("is_derivative", F.lower("path").contains("/derivatives/"))
    )


def inventory(contents: DataFrame) -> DataFrame:
    """File name, path, size, sha256 and git blob id of each row (path, content)."""
    content, length = F.col("content"), F.octet_length("content").cast("long")
    header = F.concat(F.encode(F.concat(F.lit("blob "), length.cast("string")), "UTF-8"), F.unhex(F.lit("00")))
    return contents.select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        "path",
        length.alias("length"),
        F.sha2(content, 256).alias("sha256"),
        F.sha1(F.concat(header, content)).alias("git_blob"),
    )


WHOLE_BYTES = 1 << 28  # files up to this size are read as one row
BLOCK_BYTES = 1 << 23


def _streamed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of files read in blocks from the file system that their path names."""
    from pyarrow.fs import FileSystem

    for frame in frames:
        rows = []
        for path, length in zip(frame["path"], frame["length"]):
            store, name = FileSystem.from_uri(quote(re.sub(r"^file:/+", "file:///", path), safe="/:@"))
            plain, blob, size = sha256(), sha1(b"blob %d\0" % length), 0
            with store.open_input_stream(name) as f:
                while block := f.read(BLOCK_BYTES):
                    plain.update(block)
                    blob.update(block)
                    size += len(block)
            if size != length:
                raise RuntimeError(f"{path} changed while it was read: {length} bytes listed, {size} read")
            rows.append((path.rsplit("/", 1)[-1], path, size, plain.hexdigest(), blob.hexdigest()))
        yield pd.DataFrame(rows, columns=["file_name", "path", "length", "sha256", "git_blob"])


def file_inventory(spark: SparkSession, root: str, pattern: str = "*", whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """The inventory of the files below root, of any size.

    Files up to `whole_bytes` are read as rows, from any store that Spark reads.
    Larger ones are hashed in blocks by a task each, through a file system that
    pyarrow knows (local or shared folders, HDFS, S3, GCS).
    """
    read = _files(spark, root, pattern)
    small = inventory(read.where(F.col("length") <= whole_bytes).select("path", "content"))
    none = inventory(_empty(read).withColumn("content", F.lit(b"")))
    large = read.where(F.col("length") > whole_bytes).select("path", "length")
    hashed = large.repartition(spark.sparkContext.defaultParallelism, "path").mapInPandas(
        _streamed, "file_name string, path string, length long, sha256 string, git_blob string"
    )
    return small.unionByName(none).unionByName(hashed)


def manifest_diff(actual: DataFrame, expected: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """changed, missing and extra files."""
    a = actual.select(key, F.col(digest).alias("_a"))
    e = expected.select(key, F.col(digest).alias("_e"))
    status = (
        F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(F.col("_a") != F.col("_e"), "changed")
    )
    return a.join(e, key, "full").withColumn("status", status).where("status IS NOT NULL").select(key, "status")
