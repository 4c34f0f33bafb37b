"""Token ids of a corpus in files of directly addressable codes.

Documents are dealt out by ranges of doc_id, sorted, encoded and packed; each
Spark partition writes a run of blocks in ascending order.  A block holds whole
documents.  Blocks travel in Parquet containers, one row each, so that any store
Spark can write to will do and a lost task leaves nothing behind:

    part, block          where the block stands: partition, then number in it
    first                ids of the partition before this block
    doc_ids, n_tokens    the documents in the block
    codes                the packed ids (see `codes`)

Defined cases: a null text is empty and has its end id alone; a null doc_id comes
first; rows that repeat a doc_id stand next to each other, in the order of their
texts' hashes; an empty table gives files without blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from sparkmap.llm.codes import Block, pack
from sparkmap.llm.encoding import ID, encoder

BLOCK_IDS = 1 << 18
BATCH = 1024
SCHEMA = "part int, block int, first long, doc_ids array<long>, n_tokens array<int>, codes binary"


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int, block_ids: int = BLOCK_IDS) -> None:
    """Encodes `text` of `docs` in ascending doc_id order into files under `path`."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary).encode
        part = TaskContext.get().partitionId()
        end = np.array([end_id], ID).tobytes()
        ids: list[bytes] = []
        doc_ids: list[int | None] = []
        sizes: list[int] = []
        first = block = 0

        def full() -> pd.DataFrame:
            return pd.DataFrame(
                {"part": [part], "block": [block], "first": [first], "doc_ids": [doc_ids], "n_tokens": [sizes], "codes": [pack(np.frombuffer(b"".join(ids), ID))]}
            )

        for b in batches:
            numbers, texts = b["doc_id"].astype(object).where(b["doc_id"].notna(), None).tolist(), b["text"].tolist()
            for i in range(0, len(texts), BATCH):
                for d, x in zip(numbers[i : i + BATCH], encode(texts[i : i + BATCH])):
                    ids.append(x + end)
                    doc_ids.append(None if d is None else int(d))
                    sizes.append(len(x) // 4 + 1)
                    if sum(sizes) >= block_ids:
                        yield full()
                        first, block = first + sum(sizes), block + 1
                        ids, doc_ids, sizes = [], [], []
        if sizes:
            yield full()

    # a hash stands for the text where rows repeat a doc_id, so that the sample for the ranges holds no texts
    order = ["doc_id", "tie"]
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.drop("tie").mapInPandas(blocks, SCHEMA).write.option("compression", "uncompressed").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The blocks, with `before`: ids of all blocks that come earlier.

    A block's own place in its partition is written with it; only one number for
    each partition passes through the window and the broadcast.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    sizes = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n)
    upto = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = files.groupBy("part").agg(F.sum(sizes).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before_part")
    )
    return files.join(F.broadcast(starts), "part").withColumn("before", F.col("before_part") + F.col("first")).drop("before_part")


def documents(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, each read by its place in its block."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for codes, doc_ids, sizes, before in zip(b["codes"], b["doc_ids"], b["n_tokens"], b["before"]):
                block, ends = Block(codes), np.cumsum(sizes)
                starts = ends - sizes
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array([None if d is None or d != d else int(d) for d in doc_ids], "Int64"),
                        "start": starts + before,
                        "n_tokens": np.asarray(sizes, np.int64),
                        "ids_crc32": [zlib.crc32(block.slice(s, e).astype(ID).tobytes()) for s, e in zip(starts, ends)],
                    }
                )

    return blocks.select("codes", "doc_ids", "n_tokens", "before").mapInPandas(
        each, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def tokens_at(blocks: DataFrame, places: DataFrame) -> DataFrame:
    """Random access: (place, id) for each `place` of `places`, a place being a number of ids from the start of the
    corpus.  Places meet their block by an equi join on stretches of the corpus that a block touches."""
    step = BLOCK_IDS
    size = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n)
    touched = blocks.select("codes", "before", size.alias("n")).withColumn(
        "stretch", F.explode(F.sequence(F.floor(F.col("before") / step), F.floor((F.col("before") + F.col("n") - 1) / step)))
    )
    wanted = places.select("place").where("place IS NOT NULL").withColumn("stretch", F.floor(F.col("place") / step))
    met = wanted.join(touched, "stretch").where("place >= before AND place < before + n")

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = [Block(c)[int(i)] for c, i in zip(b["codes"], b["place"] - b["before"])]
            yield pd.DataFrame({"place": b["place"], "id": ids})

    return met.select("codes", "place", "before").mapInPandas(look_up, "place long, id long")
