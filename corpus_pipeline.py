"""A corpus from raw documents to packed sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
Stages have the session send rows to Python in small batches, from then on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import line_dedup, mixing, near_dedup, packing, quality
from quantloom.llm.common import small_batches, stored, table
from quantloom.llm.queries import tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that fail the base rule or are anomalous."""
    small_batches(spark)
    return quality.filter_quality(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that occur before, or nearly so; every document stays, with what is left of its text."""
    small_batches(spark)
    return line_dedup.without_repeated_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves the first document of each class of near copies."""
    small_batches(spark)
    return near_dedup.first_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that each source comes near its share of the words."""
    small_batches(spark)
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the pieces of every document in sequences."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_documents),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Isolation forest, signatures and local search have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
