"""The training-data queries: ``QUERIES`` by name, ``ORACLES`` their DuckDB SQL where SQL can say it.

Every query covers its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import bpe, fingerprint, langid, packing, pii, quality_classifier, quality_rules, simhash, toxicity
from corvane.llm.common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, decoded again to see that the text comes back."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count at every prefix, and what fits common budgets."""
    return bpe.token_counts(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's identifiers with their source spans, and the text without them."""
    return pii.find_in_documents(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quartile bucket digest, its class of equal ones, and its links to others."""
    return fingerprint.group_documents(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under rules whose cutoffs are shown to spare good documents."""
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in bins of permitted sequence lengths."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by the network trained on a sample of them."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify_documents(docs, langid.train(docs))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of near-duplicates."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by the weakly supervised classifier."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, its own evidence and its site's together."""
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_bpe, op2_token_counts, op3_pii, op4_fingerprints, op5_quality_rules, op6_packing, op7_language, op8_simhash, op9_toxicity, op10_quality_classifier)
}

#: The others' models, encodings, packings and searches are beyond SQL; their tests hold them against brute force.
ORACLES: dict[str, str] = {"op5_quality_rules": quality_rules.ORACLE_SQL}
