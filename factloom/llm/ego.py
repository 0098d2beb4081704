"""Near-duplicate vectors by an epsilon grid order join on leading principal dimensions.

Vectors of a kind (label and width) are scaled to length 1, turned so that the principal dimensions
come first, and sorted by the cells of a grid that is as wide as the greatest distance of a link.
Intervals of that sequence are packed into tiles, and tiles are the leaves of a tree. Pairs of nodes are
followed down from the roots, a level at a time: pairs that lie provably too far apart are dropped,
pairs that lie wholly within reach are counted as they are, and the tiles of the rest are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import maybe_broadcast, written
from factloom.llm.graph import components

#: Principal dimensions of the grid, and vectors that the directions are fitted on at most (those of least hash).
DIMENSIONS, SAMPLE = 6, 20_000
#: Vectors and bytes of a tile at most, nodes under a node, tiles that one tile is compared with in a task.
TILE_ROWS, TILE_BYTES, FAN, TOGETHER = 1_024, 4 << 20, 8, 16
#: Rounding may move a bound by so much; cosines nearer to the threshold than this are summed again in order.
SLACK, NARROW = 1e-6, 1e-9
NODE = "kind string, at long, weight long, first long, centre array<double>, angle double, low array<double>, high array<double>"
TILE = "kind string, part int, seq long, weight long, first long, ids array<long>, weights array<long>, data binary, centre array<double>, angle double, low array<double>, high array<double>"


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, kind, vector, lo, hi: one row of each vec_id with a label and a cosine, the least if they differ; lo and hi name the vector."""
    rows = vectors.where("vec_id is not null and label is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector")
    )
    rows = rows.where(F.forall("vector", _finite) & F.exists("vector", lambda x: x != 0))
    rows = rows.withColumn("kind", F.concat_ws(":", F.size("vector").cast("string"), "label"))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("kind", "vector")).alias("r")).select("vec_id", "r.kind", "r.vector")
    return rows.select("*", F.xxhash64("kind", "vector").alias("lo"), F.xxhash64(F.lit(1), "vector", "kind").alias("hi"))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component comes to 1 first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def principal(distinct: DataFrame) -> dict[int, np.ndarray]:
    """For each width in a bounded sample, its leading principal directions. They steer the order alone, no result."""
    h = F.pmod(F.xxhash64("lo"), F.lit(1 << 30))
    rows = distinct.where(h * F.lit(distinct.count()) < F.lit((SAMPLE * 5 // 4) * (1 << 30))).orderBy(h, "lo").limit(SAMPLE)
    by_width: dict[int, list] = {}
    for v in rows.select("vector").toPandas()["vector"]:
        by_width.setdefault(len(v), []).append(v)
    found = {}
    for width, held in by_width.items():
        x = scaled(np.array(held, np.float64))
        _, axes = np.linalg.eigh(x.T @ x - len(x) * np.outer(x.mean(0), x.mean(0)))
        found[width] = np.ascontiguousarray(axes[:, ::-1][:, :DIMENSIONS])
    return found


def _turned(unit: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """Leading coordinates; a width that the sample lacks keeps its first ones. Fewer dimensions are filled with zeros."""
    y = unit @ axes[unit.shape[1]] if unit.shape[1] in axes else unit[:, :DIMENSIONS]
    return np.pad(y, ((0, 0), (0, DIMENSIONS - y.shape[1])))


def _cells(axes: dict[int, np.ndarray], reach: float):
    """Adds each vector's grid cells, in the order of the principal dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            ends = vectors.offsets.to_numpy()
            flat, size = vectors.values.to_numpy(zero_copy_only=False), np.diff(ends)
            cells = np.empty((batch.num_rows, DIMENSIONS), np.int32)
            for width in np.unique(size):
                rows = np.flatnonzero(size == width)
                x = flat[ends[rows][:, None] + np.arange(width)]
                cells[rows] = np.floor(_turned(scaled(x), axes) / reach)
            offsets = pa.array(np.arange(batch.num_rows + 1) * DIMENSIONS, pa.int32())
            cells = pa.ListArray.from_arrays(offsets, pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=[*batch.schema.names, "cells"])

    return run


def _cone(x: np.ndarray, spare: np.ndarray | float = 0.0) -> tuple[list[float], float]:
    """A direction and an angle around it that hold all rows of x, each with the angle to spare."""
    centre = x.mean(0)
    length = float(np.sqrt(centre @ centre))
    centre = centre / length if length > 1e-3 else x[0]
    return centre.tolist(), float((np.arccos(np.clip(x @ centre, -1, 1)) + spare).max())


def _tiles(axes: dict[int, np.ndarray], most: int):
    """Packs the sorted rows of a partition: an interval of the sequence of one kind makes a tile."""

    def packed(part: int, seq: int, kind: str, rows: list[tuple]) -> pa.RecordBatch:
        ids, vectors, weights = map(list, zip(*rows, strict=True))
        x = np.array(vectors, np.float64)
        unit = scaled(x)
        y = _turned(unit, axes)
        centre, angle = _cone(unit)
        tile = [kind, part, seq, sum(weights), min(ids), ids, weights, x.tobytes(), centre, angle, y.min(0).tolist(), y.max(0).tolist()]
        kinds = [pa.string(), pa.int32(), *[pa.int64()] * 3, *[pa.list_(pa.int64())] * 2, pa.binary(), pa.list_(pa.float64()), pa.float64(), *[pa.list_(pa.float64())] * 2]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(tile, kinds, strict=True)], names=[c.split()[0] for c in TILE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, kind, rows = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            for k, rep, vector, weight in zip(*(batch.column(c).to_pylist() for c in ("kind", "rep", "vector", "weight")), strict=True):
                if rows and (k != kind or len(rows) >= most or len(rows) * len(vector) * 8 >= TILE_BYTES):
                    yield packed(part, seq, kind, rows)
                    seq, rows = seq + 1, []
                kind = k
                rows.append((rep, vector, weight))
        if rows:
            yield packed(part, seq, kind, rows)

    return run


def _merged(group: pa.Table) -> pa.Table:
    """One node over its at most FAN children."""
    centre, angle = _cone(np.array(group["centre"].to_pylist()), group["angle"].to_numpy())
    low, high = np.array(group["low"].to_pylist()).min(0), np.array(group["high"].to_pylist()).max(0)
    first = group.slice(0, 1)
    return pa.table(
        {
            "kind": first["kind"],
            "at": pa.array([first["at"][0].as_py() // FAN]),
            "weight": pa.array([sum(group["weight"].to_pylist())]),
            "first": pa.array([min(group["first"].to_pylist())]),
            "centre": pa.array([centre]),
            "angle": pa.array([angle]),
            "low": pa.array([low.tolist()]),
            "high": pa.array([high.tolist()]),
        }
    )


def _side(nodes: DataFrame, s: str) -> DataFrame:
    return nodes.select("kind", *(F.col(c).alias(f"{c}_{s}") for c in nodes.columns if c != "kind"))


def _judged(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs of nodes (columns of _side) that aren't too far apart, and whether all their vectors lie within reach."""
    reach, angle = 2 - 2 * least, math.acos(least)
    gap = lambda low, high: F.greatest(F.lit(0.0), low - high)
    box = sum((F.pow(gap(F.col("low_a")[d], F.col("high_b")[d]) + gap(F.col("low_b")[d], F.col("high_a")[d]), 2) for d in range(DIMENSIONS)), F.lit(0.0))
    dot = F.aggregate(F.zip_with("centre_a", "centre_b", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    between = F.when(F.col("at_a") == F.col("at_b"), F.lit(0.0)).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))
    spare = F.col("angle_a") + F.col("angle_b")
    judged = pairs.where(box <= reach + SLACK).withColumn("between", between).where(F.col("between") - spare <= angle + SLACK)
    return judged.withColumn("near", F.col("between") + spare < angle - SLACK)


def _compared(least: float):
    """Links between a tile and each of the others (of a tile with itself, every pair once), counted for each vector."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        mine = next(r for r in rows if r["other"] is None)
        load = lambda r: (np.array(r["ids"]), np.array(r["weights"]), np.frombuffer(r["data"], np.float64).reshape(len(r["ids"]), -1))
        ids_a, weights_a, a = load(mine)
        unit_a, total_a = scaled(a), np.zeros(len(a), np.int64)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for other in rows:
            if other["other"] is None:
                continue
            same = other["other"] == mine["at"]
            ids_b, weights_b, b = (ids_a, weights_a, a) if same else load(other)
            cosine = unit_a @ (unit_a if same else scaled(b)).T
            near = cosine >= least
            p, q = np.nonzero(np.abs(cosine - least) < NARROW)
            if len(p):
                # summed from the first component to the last, as a loop would
                length = lambda x: np.sqrt(np.cumsum(x * x, axis=1)[:, -1])
                exact = np.cumsum(a[p] * b[q], axis=1)[:, -1] / (length(a[p]) * length(b[q]))
                near[p, q] = np.where(np.isfinite(exact), exact, cosine[p, q]) >= least
            if same:
                near[np.arange(len(a)), np.arange(len(a))] = False
            if not near.any():
                continue
            total_a += near @ weights_b
            # The smallest id that links within these two tiles reach: a star for each group of them
            root_a, root_b = ids_a, ids_b
            far = np.iinfo(np.int64).max
            while True:
                now_b = np.minimum(root_b, np.where(near, root_a[:, None], far).min(0))
                now_a = np.minimum(root_a, np.where(near, now_b[None, :], far).min(1))
                if (now_a == root_a).all() and (now_b == root_b).all():
                    break
                root_a, root_b = now_a, now_b
            found = root_a < ids_a
            out.append((ids_a[found], np.zeros(int(found.sum()), np.int64), root_a[found]))
            if not same:
                found = near.any(0)
                out.append((ids_b[found], weights_a @ near[:, found], root_b[found]))
        found = total_a > 0
        out.append((ids_a[found], total_a[found], ids_a[found]))
        ids, n, root = (np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True))
        return pa.table({"id": ids, "n": n, "root": root})

    return run


def _links(distinct: DataFrame, least: float, tile_rows: int) -> tuple[DataFrame, DataFrame]:
    """(id, n): links of the different vectors, copies counted; (a, b): edges that join the same vectors into groups."""
    axes = principal(distinct)
    reach = math.sqrt(2 - 2 * least)
    rows = distinct.select("kind", "rep", "vector", "weight", F.col("lo").alias("h"))
    schema = "kind string, rep long, vector array<double>, weight long, h long, cells array<int>"
    rows = written(rows.mapInArrow(_cells(axes, reach), schema), "cells")
    order = ["kind", "cells", "h", "rep"]
    tiles = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_tiles(axes, tile_rows), TILE)
    tiles = written(tiles, "tiles")
    # Places of tiles in the sequence of their kind
    at = F.row_number().over(Window.partitionBy("kind").orderBy("part", "seq")) - 1
    places = written(tiles.select("kind", "part", "seq", at.cast("long").alias("at")), "places")
    tiles = written(tiles.join(places, ["kind", "part", "seq"]).drop("part", "seq"), "placed")

    levels = [tiles.select(*(c.split()[0] for c in NODE.split(", ")))]
    while (levels[-1].agg(F.max("at")).first()[0] or 0) > 0:
        groups = levels[-1].groupBy("kind", (F.col("at") / FAN).cast("long").alias("up"))
        levels.append(written(groups.applyInArrow(_merged, NODE), "nodes"))

    top = levels[-1]
    pairs = written(_judged(_side(top, "a").join(_side(top, "b"), "kind").where("at_a <= at_b"), least).select("kind", "at_a", "at_b", "near"), "frontier")
    whole = []
    for level in range(len(levels) - 1, -1, -1):
        kept = pairs.where("near").select("kind", F.lit(level).alias("level"), "at_a", "at_b")
        nodes = levels[level].select("kind", "at", "weight", "first")
        kept = kept.join(_side(nodes, "a"), ["kind", "at_a"]).join(_side(nodes, "b"), ["kind", "at_b"])
        root = F.least("first_a", "first_b").alias("root")
        whole.append(kept.select("kind", "level", F.col("at_a").alias("node"), F.col("weight_b").alias("n"), root, (F.col("at_a") == F.col("at_b")).alias("own")))
        whole.append(kept.where("at_a <> at_b").select("kind", "level", F.col("at_b").alias("node"), F.col("weight_a").alias("n"), root, F.lit(False).alias("own")))
        pairs = pairs.where("not near").select("kind", "at_a", "at_b")
        if level:
            under = levels[level - 1].withColumn("up", (F.col("at") / FAN).cast("long"))
            down = pairs.withColumnsRenamed({"at_a": "up_a", "at_b": "up_b"})
            down = down.join(_side(under, "a"), ["kind", "up_a"]).join(_side(under, "b"), ["kind", "up_b"])
            down = _judged(down.where("at_a <= at_b"), least).select("kind", "at_a", "at_b", "near")
            pairs = written(down, "frontier")

    # What is left is compared: a tile meets TOGETHER others in a task
    pairs = pairs.withColumn("chunk", (F.col("at_b") / TOGETHER).cast("long"))
    payload = tiles.select("kind", "at", "ids", "weights", "data")
    mine = pairs.select("kind", F.col("at_a").alias("at"), "chunk").distinct().join(payload, ["kind", "at"])
    mine = mine.select("kind", "at", "chunk", F.lit(None).cast("long").alias("other"), "ids", "weights", "data")
    theirs = pairs.join(payload.withColumnRenamed("at", "at_b"), ["kind", "at_b"])
    theirs = theirs.select("kind", F.col("at_a").alias("at"), "chunk", F.col("at_b").alias("other"), "ids", "weights", "data")
    met = mine.union(theirs).groupBy("kind", "at", "chunk").applyInArrow(_compared(least), "id long, n long, root long")
    met = written(met, "met")

    wide = whole[0]
    for other in whole[1:]:
        wide = wide.union(other)
    wide = written(wide, "whole")
    # Each level's nodes come to the tiles under them, with what all their vectors have in common
    held = []
    for level in range(len(levels)):
        here = wide.where(F.col("level") == level).withColumnRenamed("node", "up")
        under = tiles.select("kind", "at", "first", (F.col("at") / FAN**level).cast("long").alias("up"))
        held.append(under.join(here, ["kind", "up"]).select("kind", "at", "first", "n", "root", "own"))
    near = held[0]
    for other in held[1:]:
        near = near.union(other)
    near = written(near, "near")
    sums = near.groupBy("kind", "at").agg(F.sum("n").alias("n"), F.max("own").alias("own"), F.first("first").alias("first"))
    each = sums.join(tiles.select("kind", "at", F.arrays_zip("ids", "weights").alias("v")), ["kind", "at"])
    each = written(each.select("first", "n", "own", F.explode("v").alias("v")).select(
        F.col("v.ids").alias("id"), (F.col("n") - F.when(F.col("own"), F.col("v.weights")).otherwise(0)).alias("n"), F.col("first").alias("root")
    ), "each")

    counts = met.select("id", "n").union(each.select("id", "n")).groupBy("id").agg(F.sum("n").alias("n"))
    edges = met.select("id", "root").union(each.select("id", "root")).union(near.select("first", "root")).toDF("a", "b")
    return written(counts.where("n > 0"), "counts"), edges.where("a <> b")


def near_vectors(vectors: DataFrame, least: float = 0.93, tile_rows: int = TILE_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label; other columns are ignored).

    Two vec_ids are linked if their labels are equal and not null, their vectors equally wide, and the cosine of these,
    in double precision, is at least `least` (0 to 1, 1 excluded). n_links counts the other vec_ids linked directly; component_id is
    the smallest one reachable, itself included. Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing. Rows that repeat a vec_id count once, with the least label and vector that can link, and all get
    its result; rows without vec_id link with nothing and are kept. An empty table gives no rows.

    Equal vectors are compared as one, and vectors within reach of each other as groups, so copies and near copies of any
    number are never paired. No task holds more than TOGETHER + 1 tiles, whose rows and bytes are bounded. Vectors of a
    kind without gaps wider than a link's distance are all compared, by products of matrices.
    """
    rows = written(usable(vectors), "usable")
    distinct = rows.groupBy("lo", "hi").agg(
        F.first("kind").alias("kind"), F.first("vector").alias("vector"), F.min("vec_id").alias("rep"), F.count("*").alias("weight")
    )
    distinct = written(distinct, "distinct")
    counts, edges = _links(distinct, least, tile_rows)
    groups = written(components(edges), "groups")
    of = distinct.select("lo", "hi", "rep", "weight").join(counts, F.col("rep") == F.col("id"), "left").join(groups, F.col("rep") == F.col("node"), "left")
    of = of.select("lo", "hi", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    found = rows.select("vec_id", "lo", "hi").join(maybe_broadcast(of, 200_000), ["lo", "hi"]).select("vec_id", "n", "component")
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(found, "vec_id", "left")
    component = F.coalesce("component", "vec_id").alias("component_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
