"""Shared helpers: table reads, written intermediates, words and shingle hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it. Only a local session may name none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"{tempfile.gettempdir()}/factloom-{spark.sparkContext.applicationId}"
    return named.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write the rows to the shared folder and read them back.

    A lost executor then costs a reread of a file, never a recomputation of the whole chain.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, rows: int) -> bool:
    """True if df has at most `rows` rows; reads no more than that from it."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast only behind a check of the number of rows; else Spark joins by shuffle."""
    return F.broadcast(df) if small_enough(df, rows) else df


def least_hash(rows: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """At most `most` rows of each group, those whose keys have the least hash; ties by key.

    A threshold from the group's number of rows leaves little more than that before anything is
    shuffled and ranked, so a group of any size takes no more room in a task than `most` asks for.
    """
    h = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    counts = rows.groupBy(group).agg(F.count("*").alias("_n"))
    kept = rows.join(maybe_broadcast(counts, 10_000), group).where(h * F.col("_n") < F.lit((most * 5 // 4 + 200) * (1 << 30)))
    turn = F.row_number().over(Window.partitionBy(group).orderBy(h, key))
    return kept.withColumn("_n", turn).where(F.col("_n") <= most).drop("_n")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case A-Z, then words are runs of anything but ASCII white space (20, 09 to 0D)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the `size`-word shingles; a shorter text is one shingle."""
    words = words_of(text)
    if not words:
        return np.empty(0, U64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))
    n = max(1, len(words) - size + 1)
    acc = np.full(n, min(len(words), size), U64)
    for k in range(min(len(words), size)):
        acc = mix64(acc * U64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(acc)
