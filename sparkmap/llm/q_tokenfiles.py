"""op2: all of `documents` as ids in files of directly addressable codes, read back."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkmap.llm.common import table
from sparkmap.llm.tokenfiles import documents, read, write
from sparkmap.session import shared_folder

NAME = "op2_token_files"
END_ID = 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents", "doc_id", "text"), path, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return documents(read(spark, path))
