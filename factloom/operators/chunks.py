"""Line chunks of documents, and their joins with facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import lines_of

#: Lines from one part of a document to the next.
PART = 64


def chunk_lines(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """doc_id, chunk_id, start_line, end_line, chunk_text: windows of `size` lines, stepping size - overlap.

    The last chunk is the first that reaches the last line. Lines count from 1, both ends included.
    """
    step = size - overlap
    rows = docs.select("doc_id", lines_of(F.col("text")).alias("lines")).where("lines is not null")
    last = F.expr(f"if(size(lines) <= {size}, 0, cast(ceil((size(lines) - {size}) / {step}) as int))")
    rows = rows.select("doc_id", "lines", F.explode(F.sequence(F.lit(0), last)).alias("chunk_id"))
    start = F.col("chunk_id") * step + 1
    return rows.select(
        "doc_id",
        "chunk_id",
        start.alias("start_line"),
        F.least(start + size - 1, F.size("lines")).alias("end_line"),
        F.array_join(F.slice("lines", start, F.lit(size)), "\n").alias("chunk_text"),
    )


def chunk_range(chunks: DataFrame, first: int, last: int) -> DataFrame:
    return chunks.where(F.col("chunk_id").between(first, last))


def join_fact_chunk(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    return facts.join(chunks, ["doc_id", "chunk_id"])


def pending_chunks(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks that are not done, holes included."""
    return chunks.join(done.select("doc_id", "chunk_id").distinct(), ["doc_id", "chunk_id"], "left_anti")


def line_parts(documents: DataFrame) -> DataFrame:
    """doc_id, part, part_lines: the lines of each document from every PART-th on, twice as many, so that neighbours overlap."""
    starts = F.expr(f"if(size(lines) > 0, sequence(0, cast((size(lines) - 1) div {PART} as int)), array())")
    parts = F.transform(starts, lambda p: F.slice("lines", p * PART + 1, F.lit(2 * PART)))
    return documents.select("doc_id", F.posexplode(parts).alias("part", "part_lines"))


def with_cited_lines(facts: DataFrame, documents: DataFrame, reach: int = 0) -> DataFrame:
    """facts with cited_lines (the cited ones and `reach` more on either side) and first_cited, the number of the first.

    A range of up to PART lines lies in one part, since parts overlap, so its fact meets it by one equi-join and no text is
    shuffled again. Different longer ranges are put together from every second part that they touch. Neither a fact
    nor a task ever holds a whole document. Both are null for a fact without a location or a
    document; a range outside its document has no lines. Without an end, a range is one line.
    """
    sizes = documents.select("doc_id", F.size("lines").alias("_size")).where("_size >= 0")
    low = F.greatest(F.lit(1), F.col("start_line") - reach)
    high = F.least(F.col("_size"), F.coalesce("end_line", "start_line") + reach)
    there = F.col("_size").isNotNull() & F.col("start_line").isNotNull()
    ends = facts.join(sizes, "doc_id", "left").withColumns({"first_cited": F.when(there, low), "_last": F.when(there, high)}).drop("_size")
    part = lambda line: F.expr(f"cast(({line} - 1) div {PART} as int)")
    parts = line_parts(documents)
    piece = F.slice("part_lines", F.col("first_cited") - F.col("part") * PART, F.greatest(F.lit(0), F.col("_last") - F.col("first_cited") + 1))
    none = F.when(F.col("first_cited").isNotNull(), F.array().cast("array<string>"))
    long = F.coalesce(part("_last") > part("first_cited") + 1, F.lit(False))
    short = ends.where(~long).withColumn("part", part("first_cited")).join(parts, ["doc_id", "part"], "left")
    short = short.withColumn("cited_lines", F.coalesce(piece, none)).drop("part", "part_lines", "_last")
    wide = ends.where(long)
    return short.unionByName(wide.join(_long_ranges(wide, parts), ["doc_id", "first_cited", "_last"], "left").drop("_last"))


def _long_ranges(wide: DataFrame, parts: DataFrame) -> DataFrame:
    """doc_id, first_cited, _last, cited_lines of the different ranges."""
    touched = F.expr(f"sequence(cast((first_cited - 1) div {PART} as int), cast((_last - 1) div {PART} as int), 2)")
    ranges = wide.select("doc_id", "first_cited", "_last").distinct().withColumn("part", F.explode(touched))
    begin = F.greatest(F.lit(1), F.col("first_cited") - F.col("part") * PART)
    length = F.least(F.lit(2 * PART), F.col("_last") - F.col("part") * PART) - begin + 1
    found = ranges.join(parts, ["doc_id", "part"])
    pieces = F.array_sort(F.collect_list(F.struct("part", F.slice("part_lines", begin, length).alias("l"))))
    found = found.groupBy("doc_id", "first_cited", "_last").agg(pieces.alias("_pieces"))
    return found.select("doc_id", "first_cited", "_last", F.flatten(F.col("_pieces.l")).alias("cited_lines"))


def join_fact_lines(facts: DataFrame, documents: DataFrame, reach: int = 0) -> DataFrame:
    """facts with cited_text: the cited lines and `reach` more on either side, within the document."""
    rows = with_cited_lines(facts, documents, reach)
    return rows.withColumn("cited_text", F.array_join("cited_lines", "\n")).drop("cited_lines", "first_cited")
