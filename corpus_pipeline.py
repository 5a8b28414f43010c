"""Training-data pipeline over ``documents``: toxicity, line dedup, SimHash
near-dedup, benchmark decontamination, byte-level BPE.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``, works on all rows its
predecessor kept, and is written as Parquet and read again before the next.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from topicflow.llm.common import read_table, stored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier rejects go."""
    from topicflow.llm.toxicity import keep_clean
    return keep_clean(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go from every document but the first that has them."""
    from topicflow.llm.line_dedup import line_dedup as dedup
    return dedup(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    from topicflow.llm.simhash import keep_one
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    from topicflow.llm.decontam import keep_clean
    return keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of what is left, as digests."""
    from topicflow.llm.bpe import digests
    return digests(docs)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("SimHash near-dedup", simhash_near_dedup),
          ("benchmark decontamination", decontamination), ("byte-level BPE", byte_bpe)]

#: A trained classifier cannot be expressed in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
