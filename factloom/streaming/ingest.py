"""Incremental extraction: a stream of documents into a chunk table, resumable and safe to repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.chunks import chunk_lines
from factloom.operators.extract import quantitative_values
from factloom.operators.quota import global_quota
from factloom.sources.facts_io import sink_chunks
from factloom.sources.versions import replace_by_key

QUOTAS = "doc_id long, total long, with_qv long, wanted int"


def process(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """doc_id, chunk_id, qv_ord, value, type, normalized of a batch of documents."""
    return quantitative_values(chunk_lines(docs, size, overlap), "chunk_text", "doc_id", "chunk_id")


def stream_quantities(spark: SparkSession, source: str, target: str, checkpoint: str, size: int = 1000, overlap: int = 200, files_per_batch: int = 100):
    """Start a query that reads new document files of a folder and replaces their documents' rows in target (see facts_io.load_chunks).

    The checkpoint remembers the files; a batch that runs again replaces the same documents again.
    """
    schema = spark.read.parquet(source).schema  # source: a folder or a pattern
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def batch(rows: DataFrame, _: int) -> None:
        sink_chunks(process(rows, size, overlap), target, "doc_id")

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def stream_quotas(spark: SparkSession, source: str, target: str, checkpoint: str, target_share: float = 0.35, files_per_batch: int = 100):
    """Start a query that reads new fact files of a folder and keeps each document's running quota in target (see versions.current
    with QUOTAS): facts so far, those with quantities, and how many are wanted.

    The counts are Spark's own state, by document, in the checkpoint. A batch replaces the rows of the documents that it
    changes, under its number, so one that runs again after a failure changes nothing.
    """
    schema = spark.read.parquet(source).schema
    facts = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    counts = global_quota(facts, target_share)

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "total", "with_qv", "wanted")
        replace_by_key(rows, target, "doc_id", version=number + 1)

    writer = counts.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
