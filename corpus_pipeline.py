"""A corpus from raw documents to shards; see STAGES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidecue.llm.common import discard, materialize, table
from tidecue.llm.decontam import drop_leaks
from tidecue.llm.jaccard import keep_one_of_each
from tidecue.llm.mixing import mix_documents
from tidecue.llm.quality import keep_good
from tidecue.llm.sharding import shard


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A null or empty text fails; repeated rows are judged one by one; an empty table stays empty."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: links are a Jaccard similarity of 0.8 or more of 5-word shingles, checked exactly.

    Null, empty and blank texts are one group. Rows of one doc_id with different texts are looked at one by one; of rows that are the same in all columns one stays.
    """
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item. A null or empty text leaks none; without a benchmark all stay; repeated rows go or stay together."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes the block of its first word; those without words have none and go. Null is a source of its own."""
    return mix_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document that is left; repeated rows have a slot each, a null text counts as empty."""
    return shard(docs)


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("sharding", sharding),
]

#: The stages learn rules and search semantically, which SQL can't express. Tests hold operators to brute force, and run() to its stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            kept = materialize(kept, f"stage-{k}")
            discard(docs)  # of the stage before, which has been read for the last time
        docs = kept
    return docs
