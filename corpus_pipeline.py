"""The training-data pipeline over ``documents``: each stage reads what the one before kept.

Defined cases of all stages: null texts count as empty ones, and quality rules
reject both, since they have no words; null ids, languages, hosts and lengths
stay as they are; an empty table gives an empty result; other columns, whatever
their names, are kept; very long texts are read whole; repeated rows are judged
alike, and near-dedup keeps one of them. Of near duplicates with equal ids the
text with the least hash stays, and of equal rows the one that is least as JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ravelin.llm import decontamination, packing, quality_rules, secrets, simhash
from ravelin.llm.base import materialise, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines above the limits are removed; rejected documents go. Lines are equal without regard to case, digits and white space."""
    return quality_rules.clean_documents(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least id; fingerprints of SimHash within two bits link, and sets at a similarity of 0.8."""
    return simhash.drop_near_duplicates(docs, found=simhash.linked_documents(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go; items that repeat, or have no words, change nothing."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes, and texts without secrets stay as they are."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed along the curve; documents at one place of it are ordered by id and row."""
    return packing.pack(docs, light=True)  # workers still hold what the stages before have read


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: Fingerprints, token ids and curve keys can't be expressed in SQL; tests hold the stages against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
