"""From raw documents to packed training sequences, one operator a stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; ``run`` writes and rereads what passes between them. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import mixing, packing, quality, tgm_join
from ledgerlens.llm.common import public_byte_bpe, stored


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the pairwise quality ranker rejects."""
    ranker = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, ranker)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: five-word shingles,
    Jaccard similarity of 0.8 or more."""
    return tgm_join.keep_one_each(docs, size=5, percent=80)


def curriculum(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat, cut and order documents by the mix of their sources."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens."""
    return packing.pack(docs, 1024, **public_byte_bpe())


STAGES = [("quality", quality_filter), ("near_duplicates", near_duplicates), ("mixing", curriculum), ("packing", packed)]

#: SQL cannot express the learnt ranker or the tokeniser; tests/llm compare the
#: stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
