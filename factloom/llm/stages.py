"""The stages of the corpus pipeline: each takes and returns documents, and its decisions take effect."""

from __future__ import annotations

from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, decontaminate, language, neardup, secrets
from factloom.llm.common import maybe_broadcast, table, written

TOKENIZER_FILE = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=1)
def tokenizer() -> bpe.Tokenizer:
    """Built once: it is of fixed size and never changes."""
    return bpe.Tokenizer.from_file(public_tokenizers.path(TOKENIZER_FILE), public_tokenizers.PATTERN)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without text or letters (`und`) go. lang becomes the prediction."""
    found = language.identify(docs, language.fit(language.training_rows(docs)))
    found = found.where(F.col("lang_pred") != language.UNDETERMINED)
    return found.select(*(F.col("lang_pred").alias("lang") if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns))


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by five-word shingles: the one of the smallest doc_id."""
    groups = neardup.near_duplicates(docs, size=5, percent=80)
    gone = written(groups.where("not kept").select("doc_id").distinct(), "repeats")
    left = docs.join(maybe_broadcast(gone, 200_000), "doc_id", "left_anti")
    return left.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    gone = written(found.select("doc_id").distinct(), "leaks")
    return docs.join(maybe_broadcast(gone, 200_000), "doc_id", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    found = written(secrets.findings(docs).select("doc_id", "value"), "secrets")
    return secrets.redacted(docs, found).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of every document."""
    coded = bpe.encode(docs, tokenizer(), F.struct("doc_id", "lang", "source"))
    return coded.select("row.doc_id", "row.lang", "row.source", F.size("ids").cast("long").alias("n_tokens"), "ids")
