"""The corpus pipeline: from raw documents to packed training sequences.

``STAGES`` are applied in order.  Each takes ``(spark, docs, sf_dir)`` and works on all rows that
its predecessor kept; all but the last return the columns of ``documents``.  Between stages the
rows are written as Parquet and read again, so that each stage starts from plain files and a
lost executor costs no more than the tasks it ran.  A stage's files are removed once its successor's
are complete; those that the result is read from stay, in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import packing, pii, quality_classifier, simhash, toxicity
from corvane.llm.common import remove_path, scratch_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier rejects (operator 10)."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the toxicity classifier rejects (operator 9)."""
    return toxicity.keep_harmless(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (operator 8)."""
    return simhash.one_of_each(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts (operator 3)."""
    return pii.redact_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences: ``(doc_id, piece, n_pieces, length, bin, capacity, offset, token_ids)`` (operator 6)."""
    return packing.pack_documents(docs, tokens=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("toxicity", harmless),
    ("near_duplicates", distinct),
    ("pii", private),
    ("packing", packed),
]

#: SQL can't express the stages' models and packing; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the rows of the last."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        at = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            remove_path(spark, before)
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)
