"""The corpus pipeline: five stages, each one operator, each read from what its predecessor wrote.

Every stage takes all the rows that its predecessor kept, judges them anew and lets its decision take
effect; all but the last return the columns of ``documents``. Empty tables pass through; the operators'
docstrings define nulls, ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import decontam, mixing, near_dedup, suffix_dedup, toxicity
from spanloom.llm._spark import read, saved


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at or above their language's threshold go."""
    return toxicity.reject(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id: five-word shingles, 0.8 or more."""
    return near_dedup.deduplicate(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay where they occur first, and are cut elsewhere."""
    return suffix_dedup.remove(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mixture takes of each document: doc_id, source, size, source_size, target, taken."""
    return mixing.digest(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("source mixing", mix_sources),
]

#: Learned scores, hashed trees and pseudorandom draws have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is between two stages is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = saved(docs, f"stage-{number}")
    return docs
