"""The corpus pipeline: from documents to packed token sequences, in five stages.

A stage gets the documents that the one before it kept, read again from Parquet, and all but the last return the columns
of documents. run() chains them, writing each stage's rows in the folder that the cluster shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerweave.llm import decontamination, packing, quality, quality_rules, simhash_dedup
from ledgerweave.llm.common import read, stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from the labels of those in docs, by the same split as its query."""
    return quality.accept(docs, read(spark, sf_dir, "labels"), quality.METADATA)


def line_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without their host's boilerplate lines."""
    return quality_rules.apply_rules(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): that of the least doc_id."""
    return simhash_dedup.deduplicate_near_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents, with their sequences and offsets."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", line_rules),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs


QUERIES = {"pipeline": run}
#: SQL can express neither the fitted classifier nor token ids; tests hold run() against brute force.
ORACLE_SQL: dict[str, str | None] = {"pipeline": None}
