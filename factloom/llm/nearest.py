"""Maximum inner product search: stable projections, kd-trees, incremental neighbours, a chi-square stop.

Vectors are dealt into cells of the projected space, and each cell into packs of bounded size. A pack
holds the leaves of its own kd-tree, built once and written. A query is first answered from its home
pack; its k-th best score then says, by the chi-square law, how far in the projected space a nearer
vector may lie, and only packs, leaves and projected neighbours within that reach are verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import written

#: Projected dimensions at most (even, for the closed form of the chi-square law) and the seed of the directions.
DIMENSIONS, SEED = 24, 20
#: Probability with which a nearer vector would have come before, at the projected distance where a search stops.
CONFIDENCE = 0.8
#: The cells are fitted on at most so many vectors, those with the least hash; every vector is indexed.
SAMPLE, LEAST_SAMPLE_OF_CELL = 50_000, 12
#: Vectors of a pack and queries of a batch, but for the chance of a hash; vectors of a leaf.
PACK_ROWS, BATCH_QUERIES, LEAF = 16_384, 2_048, 64
#: Leaves that are opened together at first, without and with a known reach; the number doubles, so that early ones
#: set the reach for the rest.
FIRST_LEAVES, LEAVES_IN_REACH = 4, 64
FOUND = "q_row long, query_id long, vec_id long, score double, verified long"


def chi_square_cdf(x: float, m: int) -> float:
    """P(X <= x) for m degrees of freedom, m even."""
    half = x / 2
    term = total = math.exp(-half)
    for i in range(1, m // 2):
        term *= half / i
        total += term
    return 1 - total


def chi_square_quantile(p: float, m: int) -> float:
    lo, hi = 0.0, 1000.0
    while hi - lo > 1e-9:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, m) < p else (lo, mid)
    return hi


def directions(dims: int, m: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """Gaussian (2-stable) directions made orthogonal and as long as they are on average.

    A squared projected distance is then about chi-square times the squared distance, and varies
    less than with free directions. Fewer dimensions than m stay as they are.
    """
    m = min(m, dims - dims % 2) or 2
    free = np.random.default_rng(seed).standard_normal((max(dims, m), m))
    return np.linalg.qr(free)[0][:dims] * math.sqrt(max(dims, m))


class Space:
    """Projections of vectors and of queries.

    Inner products become distances if one coordinate (the lift) makes all candidates equally long
    and is 0 for queries: squared distance = |q|^2 + top - 2 * inner product.
    """

    def __init__(self, width: int, top: float, confidence: float):
        away = directions(width + 1)
        self.away, self.lift, self.top = away[:-1], away[-1], top
        self.stop = chi_square_quantile(confidence, away.shape[1])

    def of_vectors(self, x: np.ndarray) -> np.ndarray:
        return x @ self.away + np.sqrt(np.maximum(self.top - (x * x).sum(1), 0))[:, None] * self.lift

    def of_queries(self, x: np.ndarray) -> np.ndarray:
        return x @ self.away

    def reach(self, queries: np.ndarray, worst: np.ndarray) -> np.ndarray:
        """Squared projected distance within which a vector better than `worst` lies with the wanted probability."""
        return self.stop * np.maximum((queries * queries).sum(-1) + self.top - 2 * worst, 0.0)


def split(points: np.ndarray, least: int, depth: int = 64) -> tuple[list, np.ndarray, np.ndarray]:
    """A kd-tree by medians of the widest dimension: nested (dimension, value, left, right), with a number for a
    leaf; the points in order of leaves; where each leaf starts. Points that are all equal make one leaf."""
    order, starts = np.arange(len(points)), []

    def build(a: int, b: int, depth: int):
        part = points[order[a:b]]
        if b - a >= 2 * least and depth:
            at = int((part.max(0) - part.min(0)).argmax())
            value = float(np.partition(part[:, at], (b - a - 1) // 2)[(b - a - 1) // 2])
            left = part[:, at] <= value
            if 0 < (n := int(left.sum())) < b - a:
                order[a:b] = np.concatenate([order[a:b][left], order[a:b][~left]])
                return (at, value, build(a, a + n, depth - 1), build(a + n, b, depth - 1))
        starts.append(a)
        return len(starts) - 1

    tree = build(0, len(points), depth) if len(points) else 0
    return tree, order, np.array(starts, np.int64)


def locate(tree, points: np.ndarray) -> np.ndarray:
    """The number of the leaf in which each point lies."""
    out = np.zeros(len(points), np.int32)

    def walk(node, rows: np.ndarray) -> None:
        if isinstance(node, tuple):
            left = points[rows, node[0]] <= node[1]
            walk(node[2], rows[left])
            walk(node[3], rows[~left])
        else:
            out[rows] = node

    walk(tree, np.arange(len(points)))
    return out


def exact_scores(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    return np.cumsum(vectors * q, axis=1)[:, -1] if vectors.size else np.zeros(len(vectors))


class Pack:
    """A pack with its leaves: their boxes in the projected space, and the vectors in order of leaves."""

    def __init__(self, space: Space, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, starts: np.ndarray):
        self.space, self.rows, self.ids, self.vectors = space, rows, ids, vectors
        self.points = space.of_vectors(vectors)
        self.starts, self.ends = starts, np.append(starts[1:], len(rows))
        self.lo, self.hi = (f.reduceat(self.points, starts) for f in (np.minimum, np.maximum))

    def search(self, row: int, q: np.ndarray, p: np.ndarray, worst: float, k: int):
        """(ids, scores, number verified): the candidates of a query that may be among its k best.

        worst: a score that k others are known to have. Leaves come nearest first; of their vectors
        those within reach are verified on the original components, and better scores shorten the
        reach, until no leaf is within it.
        """
        gap = np.maximum(self.lo - p, 0) + np.maximum(p - self.hi, 0)
        far = (gap * gap).sum(1)
        order = np.argsort(far, kind="stable")
        best_s, best_i, verified, at = np.empty(0), np.empty(0, np.int64), 0, 0
        step = LEAVES_IN_REACH if worst > -math.inf else FIRST_LEAVES
        while at < len(order):
            reach = float(self.space.reach(q, np.float64(worst)))
            group = order[at : at + step]
            group = group[far[group] <= reach]
            if not len(group):
                break
            at, step = at + step, step * 2
            near = np.concatenate([np.arange(self.starts[g], self.ends[g]) for g in group])
            if reach < math.inf:
                d = self.points[near] - p
                near = near[np.einsum("ij,ij->i", d, d) <= reach]
            verified += len(near)
            s = self.vectors[near] @ q
            near = near[(s >= worst - 1e-9 * (1 + abs(worst))) if worst > -math.inf else np.ones(len(s), bool)]
            near = near[self.rows[near] != row]
            s = np.concatenate([best_s, exact_scores(self.vectors[near], q)])
            i = np.concatenate([best_i, self.ids[near]])
            keep = np.lexsort((i, -s))[:k]
            best_s, best_i = s[keep], i[keep]
            if len(best_s) == k:
                worst = max(worst, best_s[-1])
        return best_i, best_s, verified


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _binary(x: np.ndarray, kind) -> pa.Array:
    return pa.array([np.ascontiguousarray(x, kind).tobytes()], pa.binary())


def _locating(space: Space, tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = pa.array(locate(tree, space.of_vectors(_matrix(batch.column("vector")))))
                yield pa.RecordBatch.from_arrays([*batch.columns, cell], names=[*batch.schema.names, "cell"])

    return run


PACK = "cell int, part int, lo array<double>, hi array<double>, rows binary, ids binary, vectors binary, starts binary"
BATCH = "cell int, part int, lo array<double>, hi array<double>, reach double, rows binary, ids binary, vectors binary, worst binary"


def _pack(space: Space):
    def run(table: pa.Table) -> pa.Table:
        x = _matrix(table["vector"])
        points = space.of_vectors(x)
        _, order, starts = split(points, LEAF)
        box = [pa.array([f(points, axis=0).tolist()], pa.list_(pa.float64())) for f in (np.min, np.max)]
        held = [_binary(table[c].to_numpy()[order], np.int64) for c in ("row", "vec_id")]
        columns = [table["cell"].slice(0, 1), table["part"].slice(0, 1), *box, *held, _binary(x[order], np.float64), _binary(starts, np.int64)]
        return pa.table(columns, names=[c.split()[0] for c in PACK.split(", ")])

    return run


def _batch(space: Space):
    def run(table: pa.Table) -> pa.Table:
        x, worst = _matrix(table["vector"]), table["worst"].to_numpy()
        points = space.of_queries(x)
        box = [pa.array([f(points, axis=0).tolist()], pa.list_(pa.float64())) for f in (np.min, np.max)]
        reach = pa.array([float(space.reach(x, worst).max())])
        held = [_binary(table[c].to_numpy(), np.int64) for c in ("row", "vec_id")]
        columns = [table["cell"].slice(0, 1), table["part"].slice(0, 1), *box, reach, *held, _binary(x, np.float64), _binary(worst, np.float64)]
        return pa.table(columns, names=[c.split()[0] for c in BATCH.split(", ")])

    return run


def _search(space: Space, k: int):
    """The answers of a pack (rows, ids, vectors, starts) to a batch of queries (q_rows, q_ids, q_vectors, q_worst)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                held = {n: batch.column(n)[at].as_buffer() for n in batch.schema.names}
                get = lambda n, kind: np.frombuffer(held[n], kind)
                rows, q_rows = get("rows", np.int64), get("q_rows", np.int64)
                pack = Pack(space, rows, get("ids", np.int64), get("vectors", np.float64).reshape(len(rows), -1), get("starts", np.int64))
                queries = get("q_vectors", np.float64).reshape(len(q_rows), -1)
                points, ids, worst = space.of_queries(queries), get("q_ids", np.int64), get("q_worst", np.float64)
                out = []
                for n, row in enumerate(q_rows.tolist()):
                    found, s, verified = pack.search(row, queries[n], points[n], float(worst[n]), k)
                    # one row without a vector says how many were verified, so that the count outlives empty answers
                    out.append((np.full(len(found) + 1, row), np.full(len(found) + 1, ids[n]), found, s, verified))
                none = np.array([True])
                mask = np.concatenate([np.concatenate([none, np.zeros(len(o[2]), bool)]) for o in out])
                column = lambda i, kind: np.concatenate([np.concatenate([np.zeros(1, kind), o[i]]) for o in out])
                count = np.concatenate([np.concatenate([[o[4]], np.zeros(len(o[2]), np.int64)]) for o in out])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([o[0] for o in out])),
                        pa.array(np.concatenate([o[1] for o in out])),
                        pa.array(column(2, np.int64), mask=mask),
                        pa.array(column(3, np.float64), mask=mask),
                        pa.array(count.astype(np.int64)),
                    ],
                    names=[c.split()[0] for c in FOUND.split(", ")],
                )

    return run


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and vector (doubles) of the vectors that take part: not null or zero, all components finite."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col(column).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0))


def _best(found: DataFrame, k: int) -> DataFrame:
    """q_row, query_id, best (the k best answers in order) and verified. A query has at most k answers of each pack."""
    hit = F.when(F.col("vec_id").isNotNull(), F.struct((-F.col("score")).alias("s"), "vec_id"))
    return found.groupBy("q_row").agg(
        F.first("query_id").alias("query_id"), F.slice(F.array_sort(F.collect_list(hit)), 1, k).alias("best"), F.sum("verified").alias("verified")
    )


def _dealt(rows: DataFrame, most: int) -> DataFrame:
    """rows with part: a hash of the row among as many parts as its cell needs to hold at most about `most` rows."""
    parts = rows.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    return rows.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts")


def nearest(vectors: DataFrame, queries: Column, k: int = 20, confidence: float = CONFIDENCE, pack_rows: int = PACK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score, verified: for each row that `queries` holds for, the k rows with the largest inner product.

    vectors: as usable() returns them (widths other than the most frequent one take no part; of two
    equally frequent the smaller). Every row is a candidate but the query's own, so rows that repeat
    a vec_id are candidates of their own, and each of them that is a query has an answer of its own.
    Ties go to the smaller vec_id; fewer candidates than k are all returned; an empty table gives no
    rows. verified: the number of vectors that were compared for the query.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector", F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = written(rows, "vectors")  # row numbers are fixed from here on
    width = rows.groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, verified long")
    rows = rows.where(F.size("vector") == width["w"])
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    space = Space(width["w"], rows.agg(F.max(norm)).first()[0], confidence)

    cells = width["count"] / pack_rows
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE if cells > 1 else 1).select("vector").toArrow()
    depth = max(0, math.ceil(math.log2(cells)))
    tree, _, starts = split(space.of_vectors(_matrix(sample["vector"])), LEAST_SAMPLE_OF_CELL, depth)
    kind = "row long, vec_id long, vector array<double>, asks boolean, cell int"
    located = written(rows.mapInArrow(_locating(space, tree), kind), "located")
    packs = written(_dealt(located.drop("asks"), pack_rows).groupBy("cell", "part").applyInArrow(_pack(space), PACK), "packs")

    def batches(asked: DataFrame) -> DataFrame:
        return written(_dealt(asked, BATCH_QUERIES).groupBy("cell", "part").applyInArrow(_batch(space), BATCH), "queries")

    def answers(pairs: DataFrame, asked: DataFrame) -> DataFrame:
        """pairs: cell, part of a pack, q_cell, q_part of a batch. Each pack and batch travels once for each pair."""
        of_pack = packs.select("cell", "part", "rows", "ids", "vectors", "starts")
        of_batch = asked.select(*(F.col(c).alias(f"q_{c}") for c in ("cell", "part", "rows", "ids", "vectors", "worst")))
        both = pairs.join(of_pack, ["cell", "part"]).join(of_batch, ["q_cell", "q_part"]).repartition("cell", "part", "q_cell", "q_part")
        names = ["rows", "ids", "vectors", "starts", "q_rows", "q_ids", "q_vectors", "q_worst"]
        return both.select(*names).mapInArrow(_search(space, k), FOUND)

    asks = located.where("asks").drop("asks")
    first = batches(asks.withColumn("worst", F.lit(-math.inf)))
    key = [F.col("cell").alias("q_cell"), F.col("part").alias("q_part")]
    home = first.select("cell", *key).join(packs.where("part = 0").select("cell", "part"), "cell")
    home = written(answers(home, first), "found")

    # With k answers from home, only what may be better than the last of them is looked for elsewhere
    last = F.when(F.size("best") == k, -F.element_at("best", -1)["s"]).otherwise(-math.inf)
    known = _best(home, k).select(F.col("q_row").alias("row"), last.alias("worst"))
    second = batches(asks.join(known, "row"))
    every = second.select(*key, F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi"), "reach")
    every = every.select("*", F.explode(F.sequence(F.lit(0), F.lit(max(1, len(starts)) - 1))).alias("cell"))
    pairs = every.join(packs.select("cell", "part", "lo", "hi"), "cell").where("not (cell = q_cell and part = 0)")
    gap = F.expr("transform(arrays_zip(lo, hi, q_lo, q_hi), z -> greatest(z.lo - z.q_hi, z.q_lo - z.hi, 0D))")
    pairs = pairs.where(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x) <= F.col("reach"))
    rest = answers(pairs.select("cell", "part", "q_cell", "q_part"), second)

    merged = written(home.unionByName(rest), "nearest").transform(lambda found: _best(found, k))
    ranked = merged.select("query_id", "verified", F.posexplode("best").alias("at", "hit"))
    return ranked.select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score"), "verified"
    )
