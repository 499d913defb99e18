"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last return the columns of `documents`, whatever
further columns there are and whatever their names.  Null and empty texts and very long ones go through every stage whole; rows that share
an id are judged by row; of equal rows the second stage keeps one; null ids stay; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispensary.llm._spark import checkpoint_dir, table
from dispensary.llm.decontaminate import decontaminate
from dispensary.llm.near_dedup import near_dedup
from dispensary.llm.quality import good_documents
from dispensary.llm.sentencepiece_codec import encode_decode
from dispensary.llm.substring_dedup import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, on five-word shingles, stays, the one with the smallest id."""
    return near_dedup(docs, size=5)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts; every document stays."""
    return without_repeats(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a benchmark passage contaminates go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as ids, and the digest of the text that they decode to."""
    out = encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("benchmark", benchmark), ("encode", encode)]

#: SQL has no SentencePiece and no language model; run() is tested against its stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written to the shared folder before the next one reads it, and
    removed when that one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    at = f"{checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{at}/{k}-{name}"
    return docs
