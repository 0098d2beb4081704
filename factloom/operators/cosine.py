"""All pairs of vectors whose cosine reaches a bound, exactly: packed tiles, bounds on pairs of tiles, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.sources.facts_io import stored

#: Vectors of a tile at most, but for the chance of a hash; signs that can order a label's vectors; rows compared at once.
TILE_ROWS, SIGNS, STRIP, FOUND = 2_048, 8, 256, 50_000
#: Angles within which rounding may move a bound.
SLACK = 1e-6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def usable(vectors: DataFrame) -> DataFrame:
    """key, vec_id, kind, vector of the rows that have a cosine: key names a vector of a kind (label and width)."""
    rows = vectors.where("vec_id is not null and label is not null").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("vector", lambda x: x != 0))
    kind = F.concat_ws(":", F.size("vector"), F.col("label").cast("string"))
    key = F.sha2(F.concat_ws(",", kind, F.array_join(F.col("vector").cast("array<string>"), ",")), 256)
    return rows.select(key.alias("key"), "vec_id", kind.alias("kind"), "vector").distinct()


def _signs(seed: int) -> Column:
    """SIGNS bits: the sides of as many planes that a vector lies on. They only order vectors; no pair depends on them."""

    def bit(p: int) -> Column:
        def signed(x: Column, i: Column) -> Column:
            return F.when(F.pmod(F.xxhash64(i, F.lit(p), F.lit(seed)), F.lit(2)) == 0, x).otherwise(-x)

        total = F.aggregate(F.transform("vector", signed), F.lit(0.0), lambda s, v: s + v)
        return F.when(total > 0, 1 << p).otherwise(0)

    return sum((bit(p) for p in range(1, SIGNS)), bit(0))


def _pack(rows: pa.Table) -> pa.Table:
    """One row for a tile, with a cone (centre and angle) that holds all its vectors."""
    x = rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    centre = unit.mean(0)
    length = np.sqrt(centre @ centre)
    centre = centre / length if length > SLACK else unit[0]
    angle = float(np.arccos(np.clip(unit @ centre, -1, 1)).max())
    return pa.table(
        {
            "kind": rows["kind"].slice(0, 1),
            "tile": rows["tile"].slice(0, 1),
            "keys": pa.array([rows["key"].to_pylist()], pa.list_(pa.string())),
            "data": pa.array([x.tobytes()], pa.binary()),
            "centre": pa.array([centre.tolist()], pa.list_(pa.float64())),
            "angle": pa.array([angle], pa.float64()),
        }
    )


def _compare(least: float):
    """Every pair of two tiles (of one tile, every pair once): a product of matrices, then the exact cosine."""

    def unpack(keys: list[str], data: bytes):
        x = np.frombuffer(data, np.float64).reshape(len(keys), -1)
        length = np.sqrt(np.cumsum(x * x, axis=1)[:, -1])
        return np.array(keys, object), x, length, x / length[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys_a, a, length_a, unit_a = unpack(row["keys_a"], row["data_a"])
                keys_b, b, length_b, unit_b = unpack(row["keys_b"], row["data_b"])
                for at in range(0, len(a), STRIP):
                    near = unit_a[at : at + STRIP] @ unit_b.T >= least - SLACK
                    if row["same"]:
                        near &= np.arange(at, at + len(near))[:, None] < np.arange(len(b))
                    left, right = np.nonzero(near)
                    left += at
                    for k in range(0, len(left), FOUND):
                        p, q = left[k : k + FOUND], right[k : k + FOUND]
                        # summed from the first component to the last, as Spark's expression does
                        exact = np.cumsum(a[p] * b[q], axis=1)[:, -1] / (length_a[p] * length_b[q])
                        keep = exact >= least
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys_a[p[keep]], pa.string()), pa.array(keys_b[q[keep]], pa.string()), pa.array(exact[keep])],
                            names=["key_a", "key_b", "cosine"],
                        )

    return run


def close_vectors(distinct: DataFrame, least: float, seed: int = 11, tile_rows: int = TILE_ROWS) -> DataFrame:
    """key_a, key_b, cosine: every pair of different keys of a kind whose cosine is at least `least`, once.

    distinct: key, kind, vector. A kind's vectors are dealt into tiles of about tile_rows, by signs so
    that like ones meet, then by a hash. Two tiles are compared whole in a task, unless the cones
    around them lie so far apart that no pair can reach the bound. All pairs of a kind are
    covered, so without gaps between groups the work grows with the square of its vectors.
    """
    rows = stored(distinct.select("key", "kind", "vector", _signs(seed).alias("signs")), "vectors")
    counts = rows.groupBy("kind", "signs").agg(F.count("*").alias("n"))
    totals = counts.groupBy("kind").agg(F.sum("n").alias("total"))
    depth = F.least(F.lit(SIGNS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("total") / tile_rows)).cast("int")))
    cells = counts.join(totals, "kind").withColumn("cell", F.col("signs") % F.pow(F.lit(2), depth).cast("int"))
    sizes = cells.groupBy("kind", "cell").agg(F.ceil(F.sum("n") / tile_rows).cast("long").alias("parts"))
    cells = cells.join(sizes, ["kind", "cell"]).select("kind", "signs", "cell", "parts")
    part = F.pmod(F.xxhash64("key"), F.col("parts"))
    dealt = rows.join(cells, ["kind", "signs"]).select("key", "kind", "vector", F.concat_ws("/", "kind", "cell", part).alias("tile"))
    schema = "kind string, tile string, keys array<string>, data binary, centre array<double>, angle double"
    packed = stored(dealt.groupBy("tile").applyInArrow(_pack, schema), "tiles")

    cone = lambda s: packed.select("kind", F.col("tile").alias(f"tile_{s}"), F.col("centre").alias(f"centre_{s}"), F.col("angle").alias(f"angle_{s}"))
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("centre_a"), F.col("centre_b")))))
    gap = F.greatest(F.lit(0.0), apart - F.col("angle_a") - F.col("angle_b") - SLACK)
    pairs = cone("a").join(cone("b"), "kind").where("tile_a <= tile_b").where((F.col("tile_a") == F.col("tile_b")) | (F.cos(gap) >= least - SLACK))
    held = lambda s: packed.select(F.col("tile").alias(f"tile_{s}"), F.col("keys").alias(f"keys_{s}"), F.col("data").alias(f"data_{s}"))
    pairs = pairs.select("tile_a", "tile_b").join(held("a"), "tile_a").join(held("b"), "tile_b")
    pairs = pairs.withColumn("same", F.col("tile_a") == F.col("tile_b")).repartition("tile_a", "tile_b")
    return pairs.drop("tile_a", "tile_b").mapInArrow(_compare(least), "key_a string, key_b string, cosine double")
