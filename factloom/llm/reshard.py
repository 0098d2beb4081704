"""Resharding by minimum-cost flow: the fewest bytes move from old shards into new ones of equal capacity."""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import shared_dir, written

#: Pieces of an old shard at least, and rows of one where a table has more: rows are dealt into pieces by hash, and all
#: but the pieces at a cut move whole.
PIECES, ROWS_PER_PIECE = 256, 50_000
#: Pieces of all old shards together, at most; larger tables have larger pieces, whose windows spill.
MOST_PIECES = 400_000


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Bytes from each old shard i to each new shard j, at the least total of cost(i, j) a byte.

    Successive shortest augmenting paths with potentials (Dijkstra), on the network source, old
    shards, new shards, sink. The network has as many nodes as there are shards, whatever the data.
    """
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    graph: list[list[list]] = [[] for _ in range(n + m + 2)]

    def arc(u: int, v: int, room: int, price: int) -> None:
        graph[u].append([v, room, price, len(graph[v])])
        graph[v].append([u, 0, -price, len(graph[u]) - 1])

    for i, s in enumerate(supply):
        arc(source, i, s, 0)
        for j in range(m):
            arc(i, n + j, s, cost(i, j))
    for j, c in enumerate(capacity):
        arc(n + j, sink, c, 0)
    potential = [0] * len(graph)
    while True:
        far = [float("inf")] * len(graph)
        far[source], came = 0, [None] * len(graph)
        heap = [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for k, (v, room, price, _) in enumerate(graph[u]):
                if room and (x := d + price + potential[u] - potential[v]) < far[v]:
                    far[v], came[v] = x, (u, k)
                    heapq.heappush(heap, (x, v))
        if came[sink] is None:
            break
        potential = [p + (d if d < float("inf") else 0) for p, d in zip(potential, far, strict=True)]
        push, v = float("inf"), sink
        while v != source:
            u, k = came[v]
            push, v = min(push, graph[u][k][1]), u
        v = sink
        while v != source:
            u, k = came[v]
            graph[u][k][1] -= push
            graph[v][graph[u][k][3]][1] += push
            v = u
    return {
        (i, e[0] - n): supply[i] - e[1] for i in range(n) for e in graph[i] if n <= e[0] < n + m and supply[i] > e[1] and e[2] >= 0
    }


@dataclass
class Transfers:
    """Cuts of the old shards: shard old holds bytes lo to hi, in piece order, for shard new."""

    cuts: list[tuple[int, int, int, int]]
    moved: int
    total: int


def plan(sizes: list[int], shards: int) -> Transfers:
    """Cut old shards so that new ones are equal to a byte, moving as few bytes as can be.

    A byte that stays costs 0 and one that moves 1. New shard j continues old shard j; the first
    total % shards new shards get one byte more.
    """
    total = sum(sizes)
    capacity = [total // shards + (j < total % shards) for j in range(shards)]
    flow = min_cost_flow(sizes, capacity, lambda i, j: 0 if i == j else 1)
    cuts, moved = [], 0
    for i in range(len(sizes)):
        at = 0
        for j in sorted((j for a, j in flow if a == i), key=lambda j: (j != i, j)):
            cuts.append((i, j, at, at + flow[i, j]))
            at += flow[i, j]
            moved += flow[i, j] * (i != j)
    return Transfers(cuts, moved, total)


ORDER = ["doc_id", "text_crc32", "size"]


def laid_out(docs: DataFrame, old_shards: int, pieces: int = PIECES) -> DataFrame:
    """docs with size, text_crc32, old_shard and piece; columns of these names are replaced.

    size: UTF-8 bytes of the text, plus 1; a null text has none and its checksum is that of no bytes.
    The old shard is the checksum of doc_id modulo old_shards; a null doc_id is in shard 0. The piece is
    a hash of doc_id and text, so rows that share only one of them, null or not, are dealt over all pieces.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    home = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(old_shards)), F.lit(0))
    size, checksum = (F.octet_length(text) + 1).cast("long"), F.crc32(text)
    piece = F.pmod(F.xxhash64("doc_id", checksum, size, F.lit(3)), F.lit(pieces)).cast("int")
    return docs.withColumns({"size": size, "text_crc32": checksum, "old_shard": home.cast("int"), "piece": piece})


def pieces_for(rows: int, old_shards: int) -> int:
    """Pieces of an old shard: more for more rows, but never over MOST_PIECES of all (or one for each old shard)."""
    return max(1, min(max(PIECES, rows // (old_shards * ROWS_PER_PIECE)), MOST_PIECES // old_shards))


def running(value: str, part: str, *order: str) -> Column:
    """The sum of value over the rows before this one, within part."""
    before = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(before), F.lit(0))


class Resharding:
    """The transfers from old shards to new ones for a laid out table, and where each row goes.

    Rows follow one another in their old shard by piece and by order within it; a row goes where its
    middle byte falls, so a new shard is off its capacity by less than a row at each cut. Only the
    totals of old shards come to the driver. Where each piece begins is summed by Spark over the
    totals of pieces, of which there are at most MOST_PIECES.
    """

    def __init__(self, layout: DataFrame, shards: int):
        spark = layout.sparkSession
        pieces = written(layout.groupBy("old_shard", "piece").agg(F.sum("size").alias("bytes")), "pieces")
        totals = {r[0]: r[1] for r in pieces.groupBy("old_shard").agg(F.sum("bytes")).collect()}  # a row for each old shard
        self.transfers = plan([totals.get(i, 0) for i in range(1 + max(totals, default=0))], shards)
        cuts = spark.createDataFrame(self.transfers.cuts, "old_shard int, new int, a long, b long")
        self.cuts = cuts.groupBy("old_shard").agg(F.array_sort(F.collect_list(F.struct("a", "b", "new"))).alias("cuts"))
        begun = pieces.withColumn("lo", running("bytes", "old_shard", "piece")).join(F.broadcast(self.cuts), "old_shard")
        whole = F.expr("get(filter(cuts, c -> c.a <= lo and lo + bytes <= c.b), 0).new")
        self.places = written(begun.select("old_shard", "piece", "lo", whole.alias("whole")), "places")

    def place(self, layout: DataFrame) -> DataFrame:
        """layout with the new shard. Pieces that no cut divides are placed where they are read, without a shuffle."""
        columns = layout.columns
        placed = layout.join(F.broadcast(self.places), ["old_shard", "piece"])  # at most MOST_PIECES rows
        whole = placed.where("whole is not null").withColumn("shard", F.col("whole"))
        before = Window.partitionBy("old_shard", "piece").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
        middle = F.col("lo") + F.coalesce(F.sum("size").over(before), F.lit(0)) + F.expr("size div 2")
        cut = placed.where("whole is null").withColumn("middle", middle).join(F.broadcast(self.cuts), "old_shard")
        cut = cut.withColumn("shard", F.expr("filter(cuts, c -> middle < c.b)[0].new"))
        return whole.select(*columns, "shard").unionByName(cut.select(*columns, "shard"))


def slotted(rows: DataFrame) -> DataFrame:
    """rows (shard, old_shard, piece, ...) with a gapless slot in each shard: rows of earlier pieces, plus the turn."""
    piece = ["shard", "old_shard", "piece"]
    counts = rows.groupBy(*piece).agg(F.count("*").alias("n"))
    # at most MOST_PIECES rows, and one more for each cut
    first = counts.select(*piece, running("n", "shard", "old_shard", "piece").alias("first"))
    turn = F.row_number().over(Window.partitionBy(*piece).orderBy(*ORDER))
    return rows.join(F.broadcast(first), piece).withColumn("slot", F.col("first") + turn - 1).drop("first")


def rewrite(docs: DataFrame, move: Resharding, old_shards: int, pieces: int, folder: str) -> DataFrame:
    """Write the old shards into folder/old, and all shards that gain or lose rows anew, whole, into folder/new.

    A shard that the transfers leave alone stays in its old files. Returns the rows of all new shards
    (the columns of docs and shard) as read back from the files that now hold them.
    """
    read = docs.sparkSession.read
    old = laid_out(docs, old_shards, pieces)
    old.write.partitionBy("old_shard").parquet(f"{folder}/old")
    placed = move.place(read.schema(old.schema).parquet(f"{folder}/old"))
    changed = sorted({shard for i, j, _, _ in move.transfers.cuts if i != j for shard in (i, j)})
    affected = F.col("shard").isin(changed) if changed else F.lit(False)
    columns = [*docs.columns, "shard"]
    placed.where(affected).select(*columns).write.partitionBy("shard").parquet(f"{folder}/new")
    new = read.schema(placed.select(*columns).schema).parquet(f"{folder}/new")
    return placed.where(~affected).select(*columns).unionByName(new)


def resharded(docs: DataFrame, old_shards: int = 6, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law (`bytes`), shard, slot, grown_shard (null) and old_shard of every row.

    Sizes and checksums are those of the rows in the new shards' files. Equal rows are
    interchangeable, so repeated rows are placed each; a null doc_id is in shard 0 of old; rows of
    any size are never cut; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    pieces = pieces_for(docs.count(), old_shards)
    layout = written(laid_out(docs, old_shards, pieces).drop("text"), "layout")
    move = Resharding(layout, shards)
    back = rewrite(docs, move, old_shards, pieces, f"{shared_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}")
    rows = slotted(written(laid_out(back, old_shards, pieces).drop("text"), "assigned"))
    fixed = {"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}
    return rows.withColumns(fixed).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "old_shard"
    )
