"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming bands, exact verification.

DataFrame functions only.

1. Every window of an item's length is slid over each text. A window in which too few places hold a
   shingle of any item can't be similar to one (both >= percent of the union), so it is passed over;
   that loses nothing. All others are fingerprinted.
2. Fingerprints of 64 bits are cut into BANDS bands. Two that differ in at most RADIUS bits differ in
   at most RADIUS // BANDS bits of one of them (pigeonhole), so a join with all such neighbours of the
   items' bands finds every pair within the radius. At similarity 0.8 the distance is about 9.7 with
   a standard deviation of 2.9, and more than RADIUS with a probability of 0.0006; unrelated windows
   are within it with 0.0008.
3. The weighted Jaccard similarity of the two multisets of shingles, exactly.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import maybe_broadcast, written

SHINGLE, PERCENT, RADIUS, BANDS = 5, 80, 19, 4
#: Item shingles up to which the item side is broadcast; beyond it Spark joins by shuffle.
BROADCAST_SHINGLES = 1_000_000
#: Rows of a task that looks for the starts of windows.
PLACES_PER_TASK = 5_000
TEXT, WINDOW = ["doc_id", "copy", "n"], ["doc_id", "copy", "n", "start"]


def _words(text: Column) -> Column:
    """Lower-case runs of letters and digits, so that case and punctuation don't hide a passage."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(size: int) -> Column:
    """Hashes of the `size`-word shingles of the column words, in order."""
    parts = ", ".join(f"words[i + {k}]" if k else "words[i]" for k in range(size))
    return F.expr(
        f"if(size(words) < {size}, cast(array() as array<bigint>),"
        f" transform(sequence(0, size(words) - {size}), i -> xxhash64({parts})))"
    )


def fingerprints(rows: DataFrame, key: list[str], name: str = "print") -> DataFrame:
    """SimHash of the shingles h of each key: bit j is set if most of the hashes have it.

    A sum counts bits j and j + 32 at once, in the two halves of a long.
    """
    votes = [F.sum(F.expr(f"shiftrightunsigned(h, {j}) & 4294967297L")).alias(f"v{j}") for j in range(32)]
    low = [f"if(2 * (v{j} & 4294967295L) > size, {1 << j}L, 0L)" for j in range(32)]
    high = [f"if(2 * shiftrightunsigned(v{j}, 32) > size, shiftleft(1L, {j + 32}), 0L)" for j in range(32)]
    return rows.groupBy(*key).agg(F.count("*").alias("size"), *votes).select(*key, F.expr(" | ".join(low + high)).alias(name))


def banded(prints: DataFrame, key: list[str], name: str, around: int = 0) -> DataFrame:
    """key, name, band and bits: a row for each band, and for all values at most `around` bits from the band's."""
    width = 64 // BANDS
    bands = ", ".join(f"struct({b} as band, shiftrightunsigned({name}, {b * width}) & {(1 << width) - 1}L as bits)" for b in range(BANDS))
    rows = prints.select(*key, name, F.expr(f"inline(array({bands}))"))
    if not around:
        return rows
    flips = [sum(1 << b for b in chosen) for k in range(around + 1) for chosen in combinations(range(width), k)]
    return rows.select("*", F.explode(F.lit(flips)).alias("flip")).withColumn("bits", F.expr("bits ^ flip")).drop("flip")


def within_radius(prints: DataFrame, items: DataFrame) -> DataFrame:
    """n, print, item_id: all pairs of the distinct prints (n, print) and items (n, item_id, print_i) within RADIUS bits."""
    near = banded(items, ["n", "item_id"], "print_i", RADIUS // BANDS).hint("shuffle_hash")  # some 10,000 rows an item
    pairs = banded(prints, ["n"], "print").join(near, ["n", "band", "bits"])
    return pairs.where(f"bit_count(print ^ print_i) <= {RADIUS}").select("n", "print", "item_id").distinct()


def contaminated(docs: DataFrame, items: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, similarity, start_word and n_words: the most similar window, for each document and item.

    A pair is returned if some window of the document, as long as the item, has a weighted Jaccard
    similarity to it of at least percent / 100, over `size`-word shingles weighted by their number.
    An item of fewer words is one shingle and must occur word for word. Texts and keys that are null,
    and texts without words, match nothing. Rows that repeat a doc_id are searched each by
    themselves; the pair is returned once. A window at the end of a text may be cut off by it; it
    then has fewer shingles. Ties go to the first window. Other columns are ignored.
    """
    spark = docs.sparkSession
    items = items.where("item_id is not null and text is not null").select(
        F.col("item_id").cast("long"), _words(F.col("text").cast("string")).alias("words")
    )
    items = written(items.where("size(words) > 0").distinct().withColumn("k", F.least(F.size("words"), F.lit(size))), "items")
    lengths = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most `size` values
    texts = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long"), F.col("text").cast("string")
    )
    found = [_search(texts, items.where(F.col("k") == k), k, percent) for k in lengths]
    if not found:
        return spark.createDataFrame([], "doc_id long, item_id long, similarity double, start_word int, n_words int")
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words")).alias("best")
    return hits.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id",
        "item_id",
        F.col("best.similarity").alias("similarity"),
        (-F.col("best.back")).alias("start_word"),
        F.col("best.n_words").alias("n_words"),
    )


def _starts(percent: int) -> Column:
    """Where windows of n shingles start that hold enough places: ceil(percent (n + own) / (100 + percent)) of them.

    places: the positions in a text of `length` shingles that hold a shingle of any item, in order.
    The whole windows whose first place is places[i] hold enough if the place that completes their
    number is within reach. Windows that the end cuts off are tried one by one.
    """
    whole = f"cast(ceil({percent} * 2 * n / {100 + percent}.0) as int)"
    first = f"greatest(0, places[i + {whole} - 1] - n + 1, if(i = 0, 0, places[i - 1] + 1))"
    last = "least(places[i], length - n)"
    none = "cast(array() as array<int>)"
    full = (
        f"if(size(places) < {whole}, {none}, flatten(transform(sequence(0, size(places) - {whole}),"
        f" i -> if({first} <= {last}, sequence({first}, {last}), {none}))))"
    )
    # fewer than percent% of n shingles can't reach the similarity
    lo, hi = "greatest(0, length - n + 1)", f"length - cast(ceil({percent} * n / 100.0) as int)"
    enough = f"get(places, size(places) - cast(ceil({percent} * (n + length - s) / {100 + percent}.0) as int)) >= s"
    cut = f"if({lo} <= {hi}, filter(sequence({lo}, {hi}), s -> {enough}), {none})"
    return F.expr(f"concat({full}, {cut})")


def _search(texts: DataFrame, items: DataFrame, size: int, percent: int) -> DataFrame:
    # shingles are exploded where they are made: the optimiser would repeat their expression for a filter on their number
    item = items.select("item_id", "words", (F.size("words") - size + 1).alias("n"))
    item_h = item.select("item_id", "n", F.explode(_shingles(size)).alias("h"))
    lengths = [r["n"] for r in item_h.select("n").distinct().orderBy("n").collect()]  # the different lengths of items
    known = maybe_broadcast(item_h.select("h").distinct(), BROADCAST_SHINGLES)

    copy = F.xxhash64("text").alias("copy")  # tells rows that repeat a doc_id apart
    cut = texts.select("doc_id", copy, _words(F.col("text")).alias("words")).withColumn("length", F.size("words") - size + 1)
    places = cut.select("doc_id", "copy", "length", F.posexplode(_shingles(size)).alias("pos", "h"))
    places = places.join(known, "h").groupBy("doc_id", "copy", "length").agg(F.array_sort(F.collect_set("pos")).alias("places"))
    least = F.array([F.lit(n) for n in lengths])
    places = places.select("*", F.explode(F.filter(least, lambda n: F.size("places") * 100 >= n * percent)).alias("n"))
    places = written(places, "places")
    # few bytes, but much to do: dealt by rows
    places = places.repartition(places.count() // PLACES_PER_TASK + 1).select(*TEXT, _starts(percent).alias("starts"))
    places = written(places, "starts").where("size(starts) > 0")

    chosen = maybe_broadcast(places.select("doc_id", "copy").distinct(), 200_000)
    again = texts.withColumn("copy", copy).join(chosen, ["doc_id", "copy"], "left_semi").dropDuplicates(["doc_id", "copy"])
    again = written(again.select("doc_id", "copy", _words(F.col("text")).alias("words")).select("doc_id", "copy", _shingles(size).alias("shingles")), "texts")

    def shingles_of(starts: DataFrame, *key: str) -> DataFrame:
        """One row for each shingle h of the windows that start at `starts`; those of a text and length stay together."""
        first = starts.withColumns({"first": F.array_min("starts"), "last": F.array_max("starts")})
        # only the part of a text in which its windows lie travels with them
        held = first.join(again, ["doc_id", "copy"]).withColumn("part", F.expr("slice(shingles, first + 1, last - first + n)"))
        held = held.select(*TEXT, *key, "starts", "first", "part").repartition(*TEXT)
        held = held.select(*TEXT, *key, "first", "part", F.explode("starts").alias("start"))
        return held.select(*WINDOW, *key, F.explode(F.expr("slice(part, start - first + 1, n)")).alias("h"))

    prints = written(fingerprints(shingles_of(places), WINDOW), "prints")
    item_prints = fingerprints(item_h.select("n", "item_id", "h"), ["n", "item_id"], "print_i")
    near = written(within_radius(prints.select("n", "print").distinct(), item_prints), "near")
    pairs = prints.join(maybe_broadcast(near, 200_000), ["n", "print"]).groupBy(*TEXT, "item_id").agg(F.collect_list("start").alias("starts"))

    weights = shingles_of(written(pairs, "pairs"), "item_id").groupBy(*WINDOW, "item_id", "h").agg(F.count("*").alias("w"))
    item_weights = item_h.groupBy("item_id", "h").agg(F.count("*").alias("w_i"))
    # both: shingles in common; own: shingles of the window
    sums = weights.join(maybe_broadcast(item_weights, BROADCAST_SHINGLES), ["item_id", "h"], "left").groupBy(*WINDOW, "item_id").agg(
        F.sum(F.least("w", F.coalesce("w_i", F.lit(0)))).alias("both"), F.sum("w").alias("own")
    )
    close = sums.where(f"100 * both >= {percent} * (own + n - both)")
    similarity = F.col("both") / (F.col("own") + F.col("n") - F.col("both"))
    return close.select("doc_id", "item_id", "start", (F.col("n") + size - 1).alias("n_words"), similarity.alias("similarity"))
