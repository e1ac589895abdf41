"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), where docs is what the one before kept,
and returns a DataFrame; ``run`` writes it as Parquet into the shared folder and
reads it again for the next. All but the last return the columns of documents.

Defined results, beyond those of the operators: an empty table stays empty; rows
that repeat a document are one document from near_dedup on; columns besides
those of documents are carried through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.llm import decontaminate as tiling, near_dedup as sketches, packing as packer
from orrery.llm import quality_rules as rules, queries, secret_scan as secrets, shared


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy v1 rejects go."""
    return rules.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each component of 80 percent similarity."""
    return sketches.representatives(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover half of a benchmark item or more go."""
    return tiling.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kinds, and n_chars counts the text that is left."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 2048 tokens, with their ids."""
    return packer.pack(docs, queries.byte_bpe())


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Sketches, tiles and recipes are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage kept is deleted when the next one's is written."""
    tables, docs = shared.Tables(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, tables.write(stage(spark, docs, sf_dir), name)
        tables.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
