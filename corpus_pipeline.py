"""The corpus pipeline: quality rules, exact dedup, n-gram Jaccard join, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
documents, whatever these are. Null and repeated ids, null texts, repeated rows and empty tables go through each stage;
what becomes of them is said at the operators.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm.bpe import bpe_digests
from lectern.llm.common import table
from lectern.llm.exact_dedup import exact_unique
from lectern.llm.mixing import mixed
from lectern.llm.ngram_join import near_unique
from lectern.llm.quality import good_rows
from lectern.session import new_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return good_rows(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id; one without any only if all are."""
    return exact_unique(docs, keep="smallest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 or more connect, the one with the smallest doc_id; one without any only if all are."""
    return near_unique(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the rates that bring the domains to their targets."""
    return mixed(docs, table(spark, sf_dir, "labels"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of what they decode to."""
    return bpe_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("mixing", mixing), ("byte_bpe", bpe)]

#: Perplexity, fitted rates and merges can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what a stage returns is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = new_folder(spark, "pipeline")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
