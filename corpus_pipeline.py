"""From raw documents to a training mix: quality, near-duplicates, repeated passages, benchmark leaks, source weights.

Each stage passes all columns on. Rows with a null id or text go through every stage: they are scored as they are, are
linked with nothing and cut nowhere, and the mix takes whole copies of them alone. Ties and repeated rows are decided as
the operators state, very long texts are read whole, and an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from citeloom.llm import decontamination, mixing, near_duplicates, quality, substring_dedup
from citeloom.llm._common import shared_folder, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects, with a score below 0.7, go; a null or empty text has the score of no evidence."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")), least=0.7)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, linked from 80 % of their shingles up, the document with the smallest id stays."""
    return near_duplicates.without_near_duplicates(docs, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut; documents that nothing is left of go, null and empty texts stay."""
    return substring_dedup.without_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of benchmark items are cut; documents without any other word go, null and empty texts stay."""
    return decontamination.without_items(docs, table(spark, sf_dir, "benchmark"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size_of, target_of and how often in copies_of; columns of these names that were there before go."""
    return mixing.mix_sources(docs, keep=True).where("copies_of > 0")


STAGES = [
    ("quality classifier", quality_classifier),
    ("minhash near-dedup", minhash_near_dedup),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", mix_to_targets),
]

#: SQL can train no classifier, so it can't give the rows of the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written to the cluster's shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
