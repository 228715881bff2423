"""Corpus pipeline: documents of good quality, without repeated lines, near copies and benchmark passages, as subword ids.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import bpe, decontaminate, lines, quality, simhash
from cairn.llm.common import checkpoint_folder, table
from cairn.llm.queries import WORD_BPE


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are alike the first stays; a text may become empty, its document remains."""
    return lines.dedup_lines(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the document with the least doc_id stays."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and digests of the ids and of what they decode to."""
    return bpe.digests(bpe.encode(docs, WORD_BPE), "ids").select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("quality", good_quality), ("lines", without_repeated_lines), ("near_copies", one_of_each_group), ("benchmark", without_benchmark), ("tokens", as_tokens)]

#: The classifier is trained, so SQL can't express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what lies between them is written under the shared checkpoint folder, and goes when the stage after it has been written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}_{name}")
            docs = spark.read.parquet(f"{folder}/{i}_{name}")
            if i:
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{i - 1}_{STAGES[i - 1][0]}")
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return docs
