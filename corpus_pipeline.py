"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

Part of the training-data subpackage (tidegraph.llm).

Defined results, as in each operator: null and empty texts have no words and fail
the quality rules; texts of any length are taken whole; ties and repeated rows are
judged each, and rows that repeat an id stay or go together as near duplicates;
null ids are never anyone's duplicate's id; an empty table gives an empty result;
extra columns of any name pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import decontamination, mixing, quality_rules, secrets, wide_simhash
from tidegraph.llm.common import table


#: Words of a shingle and Jaccard similarity of their sets in the near-duplicate stage.
WIDTH, SIMILARITY = 5, 0.8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.kept(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles), the document with the smallest id stays."""
    return wide_simhash.deduplicate(docs, SIMILARITY, WIDTH)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of texts."""
    return _counted(decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind."""
    return _counted(secrets.redact(docs, secrets.train(secrets.labelled_findings(spark))))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come near their targets."""
    return mixing.emit(docs)


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, if they have it, as their text now has."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]

#: SQL can express neither the fingerprints nor the estimates. Tests hold the rows of the near-duplicate and decontamination stages
#: against all pairs and all windows, and those of the others against the verdicts, findings and copies of their operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix made of sf_dir's documents.

    Each stage is written to the checkpoint folder that executors share and
    read from there by the next.
    """
    from tidegraph.llm.common import stage_table

    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
