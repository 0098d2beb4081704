"""Tables whose rows are replaced by key: readers see a replacement whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, write string, registered timestamp"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def stage(rows: DataFrame, path: str, key: str, keys: DataFrame | None = None) -> str:
    """Write rows, and the keys that they replace, under a name of their own, which no reader knows yet. Returns the name."""
    write = uuid.uuid4().hex
    rows.write.parquet(f"{path}/data/write={write}")
    spark = rows.sparkSession
    replaced = spark.read.schema(rows.schema).parquet(f"{path}/data/write={write}").select(key).distinct()
    replaced = replaced if keys is None else replaced.union(keys.select(key)).distinct()
    replaced.write.parquet(f"{path}/keys/write={write}")
    return write


def publish(spark: SparkSession, path: str, write: str, version: int | None = None) -> int:
    """Make a staged write the latest: one row of the manifest, a single file, which appears at once or not at all.

    version: its place among the writes, one more than the last if none is given. Of writes with one version a single one counts.
    """
    if version is None:
        spark.createDataFrame([], MANIFEST).write.mode("append").parquet(f"{path}/manifest")  # the folder may not be there yet
        version = (_manifest(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    row = spark.createDataFrame([(version, write)], "version long, write string").withColumn("registered", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return version


def replace_by_key(rows: DataFrame, path: str, key: str, keys: DataFrame | None = None, version: int | None = None) -> int:
    """Replace all rows of the keys in rows (and of `keys`, which may have none) and register them. Returns the version.

    A writer that dies before the last step leaves files that nobody reads.
    """
    return publish(rows.sparkSession, path, stage(rows, path, key, keys), version)


def writes(spark: SparkSession, path: str) -> list[str]:
    """The names of the registered writes, in order."""
    return [r.write for r in _manifest(spark, path).groupBy("write").agg(F.max("version").alias("v")).orderBy("v", "write").collect()]


def registered(spark: SparkSession, path: str, key: str, kind: str = "long") -> DataFrame:
    """key, version and write of every key that was written, by its latest write. A null key is one like others."""
    known = _manifest(spark, path).groupBy("write").agg(F.max("version").alias("version"))
    keys = spark.read.schema(f"{key} {kind}, write string").parquet(f"{path}/keys").join(known, "write")
    return keys.groupBy(key).agg(F.max(F.struct("version", "write")).alias("l")).select(key, "l.version", "l.write")


def current(spark: SparkSession, path: str, key: str, schema: str, kind: str = "long") -> DataFrame:
    """The rows of each key's latest write."""
    rows = spark.read.schema(f"{schema}, write string").parquet(f"{path}/data")
    latest = registered(spark, path, key, kind).select(F.col(key).alias("_key"), F.col("write").alias("_write"))
    found = rows.join(latest, rows[key].eqNullSafe(F.col("_key")) & (rows["write"] == F.col("_write")), "left_semi")
    return found.drop("write")


def produced_once(chunks: DataFrame, produce: Callable[[DataFrame], DataFrame], schema: str, path: str, label: str = "") -> DataFrame:
    """doc_id, chunk_id and what `produce` makes of each chunk's text, from a store that grows: the place of a costly model.

    produce: takes a DataFrame with content and chunk_text, and returns content and the columns of `schema`. content is the digest of
    the text, the schema and the label, so a text is produced once however many chunks hold it, and anew under another schema
    or label (as of the model and its prompt). What runs of others add meanwhile may be produced twice, and counts once.
    """
    spark = chunks.sparkSession
    content = F.sha2(F.concat_ws("\x00", F.lit(schema), F.lit(label), F.col("chunk_text")), 256)
    named = chunks.where("chunk_text is not null").select("doc_id", "chunk_id", "chunk_text", content.alias("content"))
    spark.createDataFrame([], "content string, run string").write.mode("append").parquet(f"{path}/done")
    spark.createDataFrame([], f"content string, {schema}, run string").write.mode("append").parquet(f"{path}/answers")
    done = spark.read.schema("content string, run string").parquet(f"{path}/done")
    # hints: answers with long keys that repeat are small as files and large in memory, so their size says nothing about a broadcast
    fresh = named.join(done.hint("merge"), "content", "left_anti").groupBy("content").agg(F.first("chunk_text").alias("chunk_text"))
    run = uuid.uuid4().hex
    fresh.write.parquet(f"{path}/asked/run={run}")
    asked = spark.read.schema("content string, chunk_text string").parquet(f"{path}/asked/run={run}")
    if asked.limit(1).count():
        produce(asked).withColumn("run", F.lit(run)).write.mode("append").parquet(f"{path}/answers")
        asked.select("content", F.lit(run).alias("run")).write.mode("append").parquet(f"{path}/done")  # known as done only once its answers are there
    first = spark.read.schema("content string, run string").parquet(f"{path}/done").groupBy("content").agg(F.min("run").alias("run"))
    answers = spark.read.schema(f"content string, {schema}, run string").parquet(f"{path}/answers").join(first.hint("merge"), ["content", "run"], "left_semi").drop("run")
    return named.select("doc_id", "chunk_id", "content").join(answers.hint("merge"), "content").drop("content")
