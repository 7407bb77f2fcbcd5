"""The corpus pipeline: its stages, each of which calls one operator of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from redactlake.llm import common, exact_dedup, language, mixing, packing, simhash

#: (name, function of spark, docs and sf_dir). All but the last return the columns of documents.
STAGES = [
    ("language", language.stage_language),
    ("exact_dedup", exact_dedup.stage_exact_dedup),
    ("simhash", simhash.stage_simhash),
    ("mixing", mixing.stage_mixing),
    ("packing", packing.stage_packing),
]

#: Language model, fingerprints and tokenizer can't be expressed in SQL; a test holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each result written and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
