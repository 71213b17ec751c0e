"""From raw documents to packed training sequences, in five stages.

Toxic documents go, then all but one of each group of exact copies and of near copies; secrets are masked
in what is left, and the documents are packed. Each stage takes the documents that the one before kept; all but
the last return their columns as they came. Rows with nulls, empty texts and repeated rows pass through the
stages as the operators' docstrings say; an empty table gives no piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfcast.llm.exact_dedup import distinct_documents
from shelfcast.llm.jaccard import distinct_by_similarity
from shelfcast.llm.packing import packing_digest
from shelfcast.llm.secrets import mask_secrets
from shelfcast.llm.tables import read, written
from shelfcast.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return distinct_documents(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return distinct_by_similarity(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing_digest(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("n-gram Jaccard join", jaccard_join),
          ("secret scans", secret_scans), ("best-fit packing", packing)]
ORACLE_SQL = None  # classifiers and tokenizers are beyond SQL; tests/llm/test_pipeline.py compares with plain loops


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"after-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
