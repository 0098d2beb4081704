"""Near-duplicate groups by SuperMinHash signatures, banding, exact verification and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import U64, maybe_broadcast, mix64, shingle_set, written
from factloom.llm.graph import components

#: 40 bands of 5: a pair at 0.8 shares no band with probability (1 - 0.8**5)**40, about 1e-7.
BANDS, ROWS = 40, 5
#: Bands that first link groups; the others are then read only where they join different groups.
FIRST_BANDS = 8
#: Elements that are hashed together in one numpy pass; bounds a worker's memory.
CHUNK = 100_000


def superminhash(doc: np.ndarray, element: np.ndarray, docs: int, m: int) -> np.ndarray:
    """SuperMinHash signatures, docs x m, of the sets {element[doc == d]}.

    Each element draws ranks j + r through its own random permutation of the m positions, one
    position a round, so that its ranks differ between positions; a set stops after the round in
    which no later rank can lower any of its minima. All sets go through round j together.
    """
    h = np.full(docs * m, np.inf)
    live = np.arange(len(element))
    state = mix64(element ^ U64(0x5851F42D4C957F2D))
    perm = None
    for j in range(m):
        state = mix64(state + U64(0x9E3779B97F4A7C15))
        k = j + (((state & U64(0xFFFFFFFF)) * U64(m - j)) >> U64(32)).astype(np.int64)
        if j == 0:
            at = first = k
        else:
            row = np.arange(len(live))
            at = perm[row, k].astype(np.int64)
            perm[row, k] = perm[:, j]
        # 32 bits decide the position and the upper 32 the rank; ties between ranks are harmless
        np.minimum.at(h, doc[live] * m + at, j + (state >> U64(32)).astype(np.float64) * 2.0**-32)
        open_doc = h.reshape(docs, m).max(axis=1) >= j + 1
        keep = open_doc[doc[live]]
        if not keep.any():
            break
        if not keep.all():
            live, state = live[keep], state[keep]
        if j == 0:
            perm = np.empty((len(live), m), np.int16)
            perm[:] = np.arange(m, dtype=np.int16)
            perm[np.arange(len(live)), first[keep]] = 0
        elif not keep.all():
            perm = perm[keep]
    return h.reshape(docs, m)


def _band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band and set; the band's number is part of it."""
    bits = signature.view(U64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), (len(signature), bands)).copy()
    for i in range(rows):
        key = mix64(key * U64(0x9E3779B97F4A7C15) + bits[:, :, i])
    return key.view(np.int64)


def _sign(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(ids):
                sets, held, start = [], 0, at
                while at < len(ids) and held < CHUNK:
                    sets.append(shingle_set(texts[at].as_py(), size))
                    held += len(sets[-1])
                    at += 1
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                keys = np.zeros((len(sets), bands), np.int64)
                if len(full):
                    flat = np.concatenate(sets)
                    doc = np.repeat(np.arange(len(full)), n[full])
                    keys[full] = _band_keys(superminhash(doc, flat, len(full), bands * rows), bands, rows)
                    ends = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    lo, hi = np.zeros(len(sets), U64), np.zeros(len(sets), U64)
                    lo[full] = np.add.reduceat(mix64(flat), ends)
                    hi[full] = np.bitwise_xor.reduceat(mix64(flat + U64(0x632BE59BD9B4E019)), ends)
                else:
                    lo = hi = np.zeros(len(sets), U64)
                offsets = pa.array(np.arange(0, len(sets) * bands + 1, bands, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(start, at - start),
                        pa.array(n),
                        pa.array(lo.view(np.int64)),
                        pa.array(hi.view(np.int64)),
                        pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())),
                    ],
                    names=["doc_id", "n_shingles", "set_lo", "set_hi", "bands"],
                )

    return run


def signatures(docs: DataFrame, size: int = 2, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the whole set, and one key for each band."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _sign(size, bands, rows),
        "doc_id long, n_shingles long, set_lo long, set_hi long, bands array<long>",
    )


def _confirm(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            ok = []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != last:
                    last, held = b, shingle_set(tb, size)
                mine = shingle_set(ta, size)
                both = len(np.intersect1d(mine, held, assume_unique=True))
                ok.append(100 * both >= percent * (len(mine) + len(held) - both))
            keep = pa.array(ok, pa.bool_())
            yield batch.select([0, 1]).filter(keep)

    return run


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; texts travel only for documents in a pair."""
    needed = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(
        maybe_broadcast(needed, 200_000), "doc_id", "left_semi"
    )
    texts = written(texts.dropDuplicates(["doc_id"]), "texts")
    both = (
        pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )
    return both.mapInArrow(_confirm(size, percent), "a long, b long")


def _still_apart(members: DataFrame) -> DataFrame:
    """The members (key, component, ...) of buckets in which more than one component meets."""
    keys = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    keys = written(keys.where("lo < hi").select("key"), "buckets")
    return members.join(maybe_broadcast(keys, 500_000), "key", "left_semi")


def _grouped(members: DataFrame, group: DataFrame) -> DataFrame:
    named = members.join(group, F.col("rep") == F.col("node"), "left")
    return named.select(*members.columns, F.coalesce("component", "rep").alias("component"))


def _explode_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t, size) for t in part.column(3).to_pylist()]
                take = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
                key = pa.array(np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i).take(take) for i in range(3)), key], names=["rep", "n", "component", "key"]
                )

    return run


def _rare_shingles(left: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """rep, n, component, key and turn: for each set, the n - ceil(percent% of n) + 1 shingles that fewest others have.

    Two sets with k shingles in common share one of the first n - k + 1 of each, in any order that
    is the same for all (prefix filter). By rarity, sets that were edited in different places hardly
    ever do, however large their group.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string")).dropDuplicates(["rep"])
    found = maybe_broadcast(left, 200_000).join(texts, "rep").select("rep", "n", "component", "text")
    shingles = found.mapInArrow(_explode_sets(size), "rep long, n long, component long, key long")
    shingles = written(shingles, "shingles")
    counted = shingles.join(shingles.groupBy("key").agg(F.count("*").alias("c")), "key")
    turn = Window.partitionBy("rep").orderBy("c", "key")  # the rows of one document
    counted = counted.withColumn("turn", F.row_number().over(turn))
    first = counted.where(f"turn <= n - (({percent} * n + 99) div 100) + 1 and c > 1")
    return first.select("rep", "n", "component", "key", "turn")


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (columns doc_id and text; others are ignored).

    Documents are linked if 100 * |A and B| >= percent * |A or B| for their distinct `size`-word
    shingles; component_id is the smallest doc_id reachable and kept marks it. A text of fewer words
    is one shingle; a null text or one without words has no shingles and is linked with nothing.
    Rows that repeat a doc_id count as one document. A null doc_id is never linked: its
    component_id is null and it is kept. An empty table gives no rows.

    Equal sets collapse first, so copies are never paired. Buckets link their members to one member
    (a star), twice with other members. Documents whose buckets still hold other components go
    through an exact search by rare shingles, which pairs those of different components alone.
    """
    signed = written(signatures(docs, size), "signatures")
    named = signed.where("n_shingles > 0 and doc_id is not null")
    sets = written(
        named.groupBy("set_lo", "set_hi").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
        ),
        "sets",
    )
    # Below 4 shingles only equal sets reach 0.8 (3 of 4 is less); for a lower threshold all sets are searched.
    searched = sets.where(f"100 * n >= {percent} * (n + 1)")

    near = F.expr(f"100 * least(n, n_b) >= {percent} * greatest(n, n_b)")
    first = searched.select("rep", "n", F.posexplode(F.slice("bands", 1, FIRST_BANDS)).alias("band", "key"))
    # Two bands share an order of the documents, so that one group has a few centres, not one for each band.
    centre = first.groupBy("key").agg(
        F.count("*").alias("members"),
        F.min(F.struct(F.xxhash64("rep", F.expr("band div 2")).alias("h"), "rep", "n")).alias("c"),
    )
    centre = centre.where("members > 1").select("key", F.col("c.rep").alias("b"), F.col("c.n").alias("n_b"))
    star = (
        first.join(centre, "key").where(near & F.expr("rep <> b")).select(F.col("rep").alias("a"), "b").distinct()
    )
    star = written(star, "pairs")
    links = written(_verified(star, docs, size, percent), "links")
    group = written(components(links), "groups")

    apart = _grouped(searched.select("rep", "n", "bands"), group)
    apart = written(_still_apart(apart.select("rep", "n", "component", F.explode("bands").alias("key"))), "apart")
    # Another centre for every bucket: whoever has links in its buckets meets most of them here
    centre = apart.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep", "key").alias("h"), "rep", "n", "component")).alias("c"))
    centre = centre.select("key", F.col("c.rep").alias("b"), F.col("c.n").alias("n_b"), F.col("c.component").alias("component_b"))
    star = apart.join(centre, "key").where(near & F.expr("component <> component_b"))
    star = written(star.select(F.greatest("rep", "b").alias("a"), F.least("rep", "b").alias("b")).distinct(), "pairs")
    links = written(links.union(_verified(star, docs, size, percent)), "links")
    apart = _grouped(apart.drop("component"), written(components(links), "groups"))
    left = written(_still_apart(apart).select("rep", "n", "component").distinct(), "left")

    rows = written(_rare_shingles(left, docs, size, percent), "prefixes")
    rows = written(_still_apart(rows), "prefixes")
    other = rows.select(
        "key", F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("component_b"), F.col("turn").alias("turn_b")
    )
    # least: shingles that two sets of these sizes have in common if they are similar enough
    least = f"(({percent} * (n + n_b) + {99 + percent}) div {100 + percent})"
    first = F.expr(f"turn <= n - {least} + 1 and turn_b <= n_b - {least} + 1")
    rest = rows.join(other, "key").where(near & F.expr("component < component_b") & first)
    rest = written(rest.select(F.col("rep").alias("a"), "b").distinct(), "pairs")
    joined = components(links.union(_verified(rest, docs, size, percent)))

    home = sets.select("set_lo", "set_hi", "rep").join(joined, F.col("rep") == F.col("node"), "left")
    home = home.select("set_lo", "set_hi", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_lo", "set_hi").join(
        home, (["set_lo", "set_hi"]), "left"
    )
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
