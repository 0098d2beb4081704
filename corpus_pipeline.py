"""From documents to token ids: language, near duplicates, benchmark passages, secrets, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import stages
from factloom.llm.common import table, written

STAGES = [
    ("language_id", stages.keep_identified),
    ("minhash_neardup", stages.keep_one_of_group),
    ("decontamination", stages.drop_contaminated),
    ("secret_scan", stages.redact_secrets),
    ("byte_bpe", stages.tokenise),
]

#: Signatures, a forest and merges can't be expressed in SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to all documents; each one's result is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
