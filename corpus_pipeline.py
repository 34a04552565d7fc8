"""A training corpus from ``documents``: language ID, exact and near deduplication, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns the
columns of documents; the last one returns pieces of packed sequences. Stages share the executors' memory, and
Python workers and direct memory keep what an earlier one took at its peak: those with Python limit the session's
Arrow batches, so that what they hold at once is no whole partition. The first one limits the rows that scans hold, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geocadence.llm import exact_dedup, language_id, mixing, near_dedup, packing
from geocadence.llm.common import limit_arrow, limit_scans, quoted, staged
from geocadence.llm.queries import BPE


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mostly in one known language; those without letters or of no clear language go."""
    limit_arrow(spark, "1m")
    limit_scans(spark, 512)
    return language_id.accepted(docs, least=0.5)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of all documents of equal text: the one with the largest doc_id."""
    return exact_dedup.unique_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 on five-word shingles."""
    limit_arrow(spark, "512k")
    return near_dedup.representatives(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at tempered weights; documents come as often as their source's quota takes them."""
    return mixing.mix_sources(docs).select(*quoted(docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids."""
    limit_arrow(spark, "1m")
    return packing.pack(docs, BPE, end_id=0, cache=50_000)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]
#: The language stage is a fitted model and the packing depends on it; SQL can't express either.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
