"""Documents to packed training sequences in four stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table, which is written as Parquet
and read again before the next stage. All stages but the last return the columns of
``documents``.

1. quality: documents that the adaptive rules reject go.
2. near copies: one document of each group of near copies stays.
3. personal data: found spans are replaced by their kind.
4. packing: what is left is cut and packed into sequences of at most 1024 tokens.

The stages accept what their operators do: nulls in any column, empty and very long texts,
repeated rows, empty tables and extra columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadastra.llm import packing, pii, quality, simhash
from cadastra.llm.vocab import vocabulary
from cadastra.session import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask_texts(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut_pieces(docs, vocabulary("byte_bpe_50k.json")))


STAGES = [("quality", quality_rules), ("near_copies", near_copies), ("personal_data", personal_data), ("packing", packed)]

#: Python decides on words, fingerprints, spans and token ids, which SQL cannot do alike.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
