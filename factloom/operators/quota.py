"""Quotas: how many facts are wanted, and which ones fill the place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.patterns import QUANTITIES, quantities
from factloom.functions.text import bound, context_entities, has_context, quantity_context
from factloom.operators.extract import generated_claim, noted
from factloom.operators.score import count_of, quality_score
from factloom.sources.facts_io import stored


#: Characters of a context that are quoted.
QUOTE = 250


def quota(total: Column, with_qv: Column, target: float, available: Column | None = None) -> Column:
    """Facts to add so that the share with quantities reaches the target; 0 if it has, or none can be made."""
    need = ((target * total - with_qv) / (1 - target)).cast("int") + 1
    below = (total == 0) | (with_qv / F.greatest(total, F.lit(1)) < target)
    wanted = F.when(below, need).otherwise(0)
    return wanted if available is None else F.when(available > 0, wanted).otherwise(0)


def _counts() -> list[Column]:
    return [F.count("*").alias("total"), F.sum((count_of(F.col("quantitative_values")) > 0).cast("int")).alias("with_qv")]


def _claims() -> Column:
    """The claims of a chunk in order, in small letters, joined by a blank."""
    ordered = F.array_sort(F.collect_list(F.struct("fact_no", F.lower("claim").alias("c"))))
    return F.array_join(ordered["c"], " ").alias("claims")


def chunk_quota(facts: DataFrame, chunk_values: DataFrame, target: float = 0.5) -> DataFrame:
    """doc_id, chunk_id, total, with_qv, available and wanted of every chunk that has quantities or facts."""
    have = facts.groupBy("doc_id", "chunk_id").agg(*_counts())
    there = chunk_values.groupBy("doc_id", "chunk_id").agg(F.count("*").alias("available"))
    both = have.join(there, ["doc_id", "chunk_id"], "full").fillna(0, ["total", "with_qv", "available"])
    return both.withColumn("wanted", quota(F.col("total"), F.col("with_qv"), target, F.col("available")))


def missing_qv(chunk_values: DataFrame, facts: DataFrame) -> DataFrame:
    """Quantities of a chunk that are in no claim of it, these joined by a blank, and in no fact's list."""
    claims = facts.groupBy("doc_id", "chunk_id").agg(_claims())
    used = facts.select("doc_id", "chunk_id", F.explode("quantitative_values").alias("value")).distinct()
    left = chunk_values.join(used, ["doc_id", "chunk_id", "value"], "left_anti")
    left = left.join(claims, ["doc_id", "chunk_id"], "left")
    return left.where(~F.contains(F.coalesce("claims", F.lit("")), F.lower("value"))).drop("claims")


def _placed(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_id, chunk_text, source_location, source_doc: the place is that of the chunk, if chunks have start_line
    and end_line; the source is their source_doc, if they have one."""
    none = F.lit(None).cast("string")
    place = F.concat(F.lit("Lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    return chunks.select(
        "doc_id", "chunk_id", "chunk_text",
        (place if {"start_line", "end_line"} <= set(chunks.columns) else none).alias("source_location"),
        (F.col("source_doc") if "source_doc" in chunks.columns else none).alias("source_doc"),
    )


def _made(found: DataFrame, columns: list[str], claim: Column, entities: bool) -> DataFrame:
    """columns of found (with value, type, _context, source_doc, source_location) and the facts made of them.

    claim: what generated_claim makes of `_noted`, what is noted of the context.
    """
    made = found.withColumn("_noted", noted(F.col("_context"))).withColumn("_made", claim)
    none = F.array().cast("array<string>")
    named = F.nullif(context_entities(F.col("_context")), none) if entities else F.lit(None).cast("array<string>")
    return made.select(
        *columns, "_made.*", "source_doc", "source_location", F.substring("_context", 1, QUOTE).alias("evidence_quote"),
        F.array("value").alias("quantitative_values"), named.alias("entities"), F.lit(True).alias("auto_generated"),
    )


def _with_more(done: Column, more: Column, absent: Callable[[Column], Column]) -> Column:
    """struct(listed, absent) with more quantities, numbered on from those listed; absent: those with context that pass the test."""
    at = F.size(done["listed"])
    placed = F.transform(more, lambda q, i: F.struct((at + i).alias("qv_ord"), q["value"].alias("value"), q["type"].alias("type"), q["has_context"].alias("has_context")))
    left = lambda new: F.filter(new, lambda q: q["has_context"] & absent(q["value"]))
    return bound(placed, lambda new: F.struct(F.concat(done["listed"], new).alias("listed"), F.concat(done["absent"], left(new)).alias("absent")))


def _until_filled(text: Column, wanted: Column, absent: Callable[[Column], Column]) -> Column:
    """struct(listed, absent) of a text's quantities in order. It is searched for a family only while fewer than wanted are absent."""
    none = F.array().cast("array<struct<qv_ord:int,value:string,type:string,has_context:boolean>>")
    found = F.struct(none.alias("listed"), none.alias("absent"))
    for kind in QUANTITIES:
        more = lambda done: F.when(F.size(done["absent"]) < wanted, _quantities(text, kind)).otherwise(F.array())  # noqa: B023, E731
        found = bound(found, lambda done: _with_more(done, more(done), absent))  # noqa: B023
    return found


def generate_missing_facts(chunks: DataFrame, facts: DataFrame, target: float = 0.5) -> DataFrame:
    """Facts for quantities: first those that are missing, then all again in order, until each chunk's quota is filled.

    A quantity without context takes no place. A chunk's quantities stay in its row until they are picked, so chunks and
    facts are read once and meet by one join. Texts are searched only where facts are wanted, family by family until
    those that are missing fill the quota, and contexts only for what is picked.
    """
    used = F.array_distinct(F.flatten(F.collect_list("quantitative_values"))).alias("used")
    have = facts.groupBy("doc_id", "chunk_id").agg(*_counts(), used, _claims())
    rows = _placed(chunks.where("doc_id is not null and chunk_id is not null")).join(have, ["doc_id", "chunk_id"], "left").fillna(0, ["total", "with_qv"])
    rows = rows.withColumn("wanted", quota(F.col("total"), F.col("with_qv"), target)).where("wanted > 0")

    text = F.col("chunk_text")
    absent = lambda v: ~F.coalesce(F.array_contains("used", v), F.lit(False)) & ~F.contains(F.coalesce("claims", F.lit("")), F.lower(v))
    rows = rows.withColumn("_found", _until_filled(text, F.col("wanted"), absent))
    turn = lambda held, n: F.transform(held, lambda q: q.withField("pass", F.lit(n)))
    both = F.concat(turn(F.col("_found.absent"), 1), turn(F.filter("_found.listed", lambda q: q["has_context"]), 2))
    picked = F.transform(F.slice(both, F.lit(1), F.col("wanted")), lambda q: F.struct(q.alias("q"), quantity_context(q["value"], text).alias("_context")))
    columns = ["doc_id", "chunk_id", "qv_ord", "value", "type", "pass"]
    found = rows.select("doc_id", "chunk_id", "source_location", "source_doc", F.inline(picked)).select("*", "q.*").drop("q")

    first, again = (generated_claim(F.col("type"), F.col("value"), F.col("_noted"), table) for table in ("missing", "again"))
    made = _made(found, columns, F.when(F.col("pass") == 1, first).otherwise(again), entities=True)
    return made.withColumn("confidence", F.when(F.col("pass") == 1, 0.8).otherwise(0.75))


def global_missing_qv(chunk_values: DataFrame, facts: DataFrame) -> DataFrame:
    """doc_id, value, type of the distinct quantities of a document that no fact lists."""
    used = facts.select("doc_id", F.explode("quantitative_values").alias("value")).distinct()
    return chunk_values.select("doc_id", "value", "type").distinct().join(used, ["doc_id", "value"], "left_anti")


def first_chunk_with_qv(chunk_values: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, value, chunk_id: the first chunk of a document whose lower-case text holds a quantity's.

    Found as a quantity it may stand in an earlier chunk as a part of something else, so the chunks before are searched.
    """
    first = stored(chunk_values.groupBy("doc_id", "value").agg(F.min("chunk_id").alias("known")), "known")
    before = first.join(chunks.select("doc_id", "chunk_id", "chunk_text"), "doc_id")
    before = before.where((F.col("chunk_id") < F.col("known")) & F.contains(F.lower("chunk_text"), F.lower("value")))
    before = before.groupBy("doc_id", "value").agg(F.min("chunk_id").alias("earlier"))
    return first.join(before, ["doc_id", "value"], "left").select("doc_id", "value", F.coalesce("earlier", "known").alias("chunk_id"))


def global_quota(facts: DataFrame, target: float = 0.35) -> DataFrame:
    have = facts.groupBy("doc_id").agg(*_counts())
    return have.withColumn("wanted", quota(F.col("total"), F.col("with_qv"), target))


def generate_global_facts(chunks: DataFrame, chunk_values: DataFrame, facts: DataFrame, target: float = 0.35) -> DataFrame:
    """Unused quantities of a document by value and type, until its quota is filled, with the context of the first chunk
    that holds them. A quantity without context there takes no place."""
    chunk_values = stored(chunk_values, "quantities")
    chunks = stored(chunks, "chunks")
    free = global_missing_qv(chunk_values, facts).join(first_chunk_with_qv(chunk_values, chunks), ["doc_id", "value"])
    free = stored(free, "free")
    odd = free.where(_odd(F.col("value"))).join(chunks.select("doc_id", "chunk_id", "chunk_text"), ["doc_id", "chunk_id"])
    odd = odd.where(has_context(F.col("value"), F.col("chunk_text"))).select(free.columns)
    free = free.where(~_odd(F.col("value"))).union(odd)
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("value", "type"))
    wanted = global_quota(facts, target).select("doc_id", "wanted")
    picked = free.withColumn("_turn", turn).join(wanted, "doc_id").where("_turn <= wanted").select("doc_id", "chunk_id", "value", "type")
    found = picked.join(_placed(chunks), ["doc_id", "chunk_id"]).withColumn("_context", quantity_context(F.col("value"), F.col("chunk_text"))).drop("chunk_text")
    found = stored(found, "contexts")  # else each of the many tests of a context would search the chunk for it
    claim = generated_claim(F.col("type"), F.col("value"), F.col("_noted"), "document")
    return _made(found, picked.columns, claim, entities=False).withColumn("confidence", F.lit(0.75))


def _odd(value: Column) -> Column:
    """Quantities that the search for their context may not find: a plus sign isn't taken literally there."""
    return F.contains(value, F.lit("+"))


def _quantities(text: Column, *kinds: str) -> Column:
    """Array of (value, type, has_context) of a chunk's text; see patterns.quantities."""
    there = lambda v: F.when(_odd(v), has_context(v, text)).otherwise(True)
    return F.transform(quantities(text, *kinds), lambda q: F.struct(q["value"].alias("value"), q["type"].alias("type"), there(q["value"]).alias("has_context")))


def chunk_quantities(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_id, qv_ord, value, type, has_context of every chunk."""
    found = chunks.select("doc_id", "chunk_id", F.posexplode(_quantities(F.col("chunk_text"))).alias("qv_ord", "qv"))
    return found.select("doc_id", "chunk_id", "qv_ord", "qv.*")


def quota_filter(facts: DataFrame, target: float = 0.35) -> DataFrame:
    """All facts with quantities, and the best others so that the share is the target; by document.

    One window gives the count and the rank, so there is one shuffle. If the share is above the
    target already, no others are kept.
    """
    doc = Window.partitionBy("doc_id")
    has = count_of(F.col("quantitative_values")) > 0
    rows = facts.withColumns({"has_qv": has, "quality_score": quality_score(facts)})
    best = doc.orderBy("has_qv", F.desc("quality_score"), "fact_no")
    rows = rows.withColumns({"turn": F.row_number().over(best), "with_qv": F.sum(F.col("has_qv").cast("int")).over(doc)})
    room = (F.col("with_qv") / target).cast("int") - F.col("with_qv")
    return rows.where(F.col("has_qv") | (F.col("turn") <= room)).drop("turn", "with_qv")


def score_range(kept: DataFrame) -> DataFrame:
    return kept.where("not has_qv").groupBy("doc_id").agg(F.max("quality_score").alias("best"), F.min("quality_score").alias("worst"))


def values_minus(facts: DataFrame) -> DataFrame:
    """doc_id, fact_no, fresh: the quantities in a claim that its list doesn't have; repeats in the claim repeat."""
    old = F.coalesce("quantitative_values", F.array().cast("array<string>"))
    found = F.transform(quantities(F.col("claim")), lambda q: q["value"])
    return facts.select("doc_id", "fact_no", F.filter(found, lambda v: ~F.array_contains(old, v)).alias("fresh"))


def retro_tag_qv(facts: DataFrame) -> DataFrame:
    """Append the quantities in a claim that its list doesn't have yet; repeats in the claim repeat."""
    old = F.coalesce("quantitative_values", F.array().cast("array<string>"))
    found = F.transform(quantities(F.col("claim")), lambda q: q["value"])
    fresh = F.filter(found, lambda v: ~F.array_contains(old, v))
    return facts.withColumn("quantitative_values", F.when((F.size(old) > 0) | (F.size(fresh) > 0), F.concat(old, fresh)))
