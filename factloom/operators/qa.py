"""Questions over facts: ordinals, retrieval, answers, citations, prompt texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import question_citations
from factloom.operators.chunks import join_fact_lines


def number_facts(facts: DataFrame, *order: str) -> DataFrame:
    """facts with fact_id from 1, by doc_id and then `order` (fact_no).

    No task sorts all facts: each is ranked within its document, and documents are offset by the
    counts before them, within a range of ids, then within a range of such ranges, and so on. However
    sparse ids are, the last level has at most 1,845 ranges, and no range more than 10,000 below it.
    """
    first = facts.groupBy(F.col("doc_id").cast("long").alias("_at0")).agg(F.count("*").alias("_n"))
    levels = [first]
    for k in range(1, 5):
        above = F.floor(F.col(f"_at{k - 1}") / 10_000).alias(f"_at{k}")
        levels.append(levels[-1].groupBy(above).agg(F.sum("_n").alias("_n")))
    ahead = None
    for k in range(4, -1, -1):
        up = [] if k == 4 else [F.floor(F.col(f"_at{k}") / 10_000).alias(f"_at{k + 1}")]
        rows = levels[k].select("*", *up)
        window = Window.partitionBy(*(f"_at{k + 1}" for _ in up)).orderBy(f"_at{k}").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_inside", F.coalesce(F.sum("_n").over(window), F.lit(0)))
        if ahead is not None:
            rows = rows.join(ahead, f"_at{k + 1}").withColumn("_inside", F.col("_inside") + F.col("_ahead"))
        ahead = rows.select(f"_at{k}", F.col("_inside").alias("_ahead"))
    offsets = ahead.toDF("doc_id", "_before")
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy(*(order or ("fact_no",))))
    return facts.join(offsets, "doc_id").withColumn("fact_id", F.col("_before") + turn).drop("_before")


def order_by_chunk(facts: DataFrame) -> DataFrame:
    return facts.orderBy("doc_id", "chunk_id", "fact_no")


def ranked_facts(facts: DataFrame, question: str, k: int | None = None) -> DataFrame:
    """The facts of each document that share words with a question, with overlap and rank, the k best if k is given;
    ties by confidence, then ordinal."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.lit(question)), r"[^a-z0-9]+"), lambda w: F.length(w) > 2))
    claim = F.array_distinct(F.split(F.lower("claim"), r"[^a-z0-9]+"))
    scored = facts.withColumn("overlap", F.size(F.array_intersect(claim, words))).where("overlap > 0")
    best = Window.partitionBy("doc_id").orderBy(F.desc("overlap"), F.desc("confidence"), "fact_no")
    ranked = scored.withColumn("rank", F.row_number().over(best))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def answer_question(facts: DataFrame, question: str, k: int = 5) -> DataFrame:
    """doc_id, answer, confidence, hits: the claims of the k best facts, each with its citation.

    confidence is High with three facts or more, Medium with one or two. A document without any hit
    has no row, since nothing in it answers.
    """
    best = ranked_facts(facts, question)
    said = F.when(F.col("rank") <= k, F.struct("rank", F.concat("claim", F.lit(" [Fact "), F.col("fact_no").cast("string"), F.lit("]")).alias("text")))
    rows = best.groupBy("doc_id").agg(F.array_sort(F.collect_list(said)).alias("l"), F.count("*").alias("hits"))
    confidence = F.when(F.col("hits") >= 3, "High").otherwise("Medium")
    return rows.select("doc_id", F.array_join(F.col("l.text"), " ").alias("answer"), confidence.alias("confidence"), "hits")


def cited_facts(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts that an answer (doc_id, answer) cites, in order of citation; numbers out of range are passed over."""
    cited = answers.select("doc_id", F.posexplode(question_citations(F.col("answer"))).alias("position", "number"))
    cited = cited.select("doc_id", "position", F.col("number").try_cast("int").alias("fact_no"))
    return cited.join(facts, ["doc_id", "fact_no"])


def facts_with_context(facts: DataFrame, documents: DataFrame, reach: int = 10) -> DataFrame:
    """facts with the lines around; a fact without a location or text is kept without."""
    out = join_fact_lines(facts, documents, reach)
    return out.withColumn("cited_text", F.nullif(F.col("cited_text"), F.lit(""))).withColumnRenamed("cited_text", "context")


def facts_with_summary(facts: DataFrame, summaries: DataFrame) -> DataFrame:
    return facts.join(summaries, "doc_id", "left")


def fact_entry(context: Column | None = None) -> Column:
    parts = [
        F.concat(F.lit("[Fact "), F.col("fact_no").cast("string"), F.lit("] "), F.col("claim")),
        F.concat(F.lit("Location: "), F.col("source_location")),
        F.concat(F.lit("Evidence: "), F.substring(F.coalesce("evidence_quote", F.lit("")), 1, 150)),
    ]
    if context is not None:
        parts.append(F.concat(F.lit("Context: "), F.substring(context, 1, 300)))
    return F.concat_ws("\n", *parts)


def facts_prompt_text(facts: DataFrame, context: str | None = None, per_part: int = 200) -> DataFrame:
    """doc_id, part_no, part: the facts of a document as ordered text, per_part facts to a part."""
    text = fact_entry(None if context is None else F.col(context))
    rows = facts.select("doc_id", F.floor((F.col("fact_no") - 1) / per_part).cast("int").alias("part_no"), "fact_no", text.alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("fact_no", "text")))
    return rows.groupBy("doc_id", "part_no").agg(ordered.alias("l")).select("doc_id", "part_no", F.array_join(F.col("l.text"), "\n\n").alias("part"))


def rejected_split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    return validated.where("is_valid"), validated.where("not is_valid")


def first_match_per_group(rows: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    return rows.groupBy(*group).agg(F.min_by(value, order).alias(value))
