"""Training corpus pipeline: quality, exact copies, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read back
as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuelake.llm.common import materialise
from cuelake.llm.exact_dedup import drop_copies
from cuelake.llm.ngram_jaccard import drop_near_copies
from cuelake.llm.packing import packed_documents
from cuelake.llm.quality import good_documents
from cuelake.llm.suffix_dedup import drop_repeats
from cuelake.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents judged of low quality or toxic go; ties with the threshold go too. A null text is judged as an empty one, rows with
    null or repeated ids each by its own text; columns of any names come back as they were; an empty table gives no rows."""
    return good_documents(ship(spark), docs, sf_dir)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays, and one row where rows repeat. Null texts are equal to empty ones; other
    texts of a repeated or missing id stay; an empty table gives no rows; columns may have any names."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts connected by a Jaccard similarity of 0.8 on five-word shingles that of the smallest doc_id stays. Texts without words and
    rows without an id link with nothing and stay; rows that repeat an id are told apart; an empty table gives no rows; columns may have any names."""
    return drop_near_copies(docs, n=5, similarity=(8, 10))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes that stand anywhere else are cut out; every document stays. Null texts stay null, texts of any length are
    read whole, repeated rows repeat each other; an empty table gives no rows; columns may have any names."""
    return drop_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the sequences of 4096 tokens. Null and empty texts are one token; rows with null or
    repeated ids are documents of their own; an empty table gives no rows."""
    return packed_documents(docs)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]

#: No SQL expresses a fitted classifier, so the pipeline is tested against plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
