"""Counts, shares and profiles of fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.score import contains_generic_terms, count_of, is_test_result_only


def _share(test: Column) -> Column:
    return F.avg(F.when(test, 1.0).otherwise(0.0))


def _number(test: Column) -> Column:
    return F.sum(F.when(test, 1).otherwise(0))


def has_details() -> Column:
    return F.coalesce(F.col("process_details.who"), F.col("process_details.when"), F.col("process_details.how")).isNotNull()


def chunk_stats(validated: DataFrame) -> DataFrame:
    """extracted, validated, rejected and rate of each chunk, and of each document (chunk_id null), in one pass."""
    rows = validated.rollup("doc_id", "chunk_id").agg(F.count("*").alias("extracted"), _number(F.col("is_valid")).alias("validated"))
    rows = rows.where("doc_id is not null").withColumn("rejected", F.col("extracted") - F.col("validated"))
    return rows.withColumn("rate", F.col("validated") / F.col("extracted"))


def qv_coverage(facts: DataFrame, *by: str) -> DataFrame:
    return facts.groupBy(*by).agg(_share(count_of(F.col("quantitative_values")) > 0).alias("coverage"))


def extraction_coverage(chunks: DataFrame, facts: DataFrame, values: dict[str, Column], by=("doc_id", "chunk_id")) -> DataFrame:
    """by, and for each name of `values` (arrays over chunks) name_total, name_extracted and name_coverage: how many of a
    chunk's values occur in its claims, run together; 1 if there are none. Repeats count."""
    ordered = F.array_sort(F.collect_list(F.struct("fact_no", F.lower("claim").alias("c"))))
    claims = facts.groupBy(*by).agg(ordered.alias("l")).select(*by, F.array_join(F.col("l.c"), " ").alias("claims"))
    rows = chunks.select(*by, *(v.alias(f"_{name}") for name, v in values.items())).join(claims, list(by), "left")
    text = F.coalesce("claims", F.lit(""))
    for name in values:
        total, found = F.size(f"_{name}"), F.size(F.filter(f"_{name}", lambda v: F.contains(text, F.lower(v))))
        share = F.when(total > 0, found / total).otherwise(1.0)
        rows = rows.withColumns({f"{name}_total": total, f"{name}_extracted": found, f"{name}_coverage": share})
    return rows.drop("claims", *(f"_{name}" for name in values))


def enhancement_stats(facts: DataFrame, *by: str) -> DataFrame:
    return facts.groupBy(*by).agg(
        F.count("*").alias("total"),
        _number(count_of(F.col("quantitative_values")) > 0).alias("with_qv"),
        _number(is_test_result_only(F.col("claim"))).alias("test_only"),
        _number(contains_generic_terms(F.col("claim"))).alias("generic"),
        _number(F.col("specificity_score") >= 0.7).alias("specific"),
        F.avg("specificity_score").alias("mean_specificity"),
    )


def fact_set_profile(facts: DataFrame, *by: str) -> DataFrame:
    s = F.coalesce("specificity_score", F.lit(0.0))
    return facts.groupBy(*by).agg(
        F.count("*").alias("total"),
        _share(count_of(F.col("quantitative_values")) > 0).alias("qv_share"),
        _share(count_of(F.col("entities")) > 0).alias("entity_share"),
        _share(has_details()).alias("process_share"),
        _number(s >= 0.7).alias("high"),
        _number((s >= 0.5) & (s < 0.7)).alias("medium"),
        _number(s < 0.5).alias("low"),
        F.avg(s).alias("mean_specificity"),
    )


def fact_density(facts: DataFrame, lines: DataFrame) -> DataFrame:
    """Facts per 100 lines of each document."""
    n = lines.groupBy("doc_id").agg(F.count("*").alias("lines"))
    k = facts.groupBy("doc_id").agg(F.count("*").alias("facts"))
    return n.join(k, "doc_id", "left").select("doc_id", (F.coalesce("facts", F.lit(0)) / F.col("lines") * 100).alias("density"))


def compare_runs(first: DataFrame, second: DataFrame) -> DataFrame:
    """metric, before, after, delta and change in percent of two runs' profiles."""
    names = ["total", "qv_share", "entity_share", "process_share", "mean_specificity"]
    stack = ", ".join(f"'{n}', cast({n} as double)" for n in names)
    long = [fact_set_profile(f).selectExpr(f"stack({len(names)}, {stack}) as (metric, value)").withColumn("run", F.lit(r)) for f, r in ((first, "before"), (second, "after"))]
    wide = long[0].unionByName(long[1]).groupBy("metric").pivot("run", ["before", "after"]).agg(F.first("value"))
    delta = F.col("after") - F.col("before")
    return wide.withColumns({"delta": delta, "change": F.try_divide(delta * 100, F.col("before"))})


# The targets of a fact set and the least value that counts as close.
TARGETS = {"qv_share": (0.35, 0.30), "mean_specificity": (0.70, 0.65), "entity_share": (0.40, 0.35), "process_share": (0.40, 0.35)}
DENSITY = (8.0, 12.0)


def target_assessment(facts: DataFrame, lines: DataFrame, *by: str) -> DataFrame:
    """by, metric, value and verdict (`met`, `close` or `missed`); the density of facts is met within its bounds or missed."""
    profile = fact_set_profile(facts, *by)
    stack = ", ".join(f"'{n}', {n}, double({t}), double({c})" for n, (t, c) in TARGETS.items())
    long = profile.selectExpr(*by, f"stack({len(TARGETS)}, {stack}) as (metric, value, target, near)")
    verdict = F.expr("case when value >= target then 'met' when value >= near then 'close' else 'missed' end")
    shares = long.select(*by, "metric", "value", verdict.alias("verdict"))
    n, k = lines.groupBy(*by).agg(F.count("*").alias("lines")), facts.groupBy(*by).agg(F.count("*").alias("facts"))
    dense = n.join(k, list(by)).withColumn("value", F.col("facts") / F.col("lines") * 100)
    verdict = F.when(F.col("value").between(*DENSITY), "met").otherwise("missed")
    return shares.unionByName(dense.select(*by, F.lit("density").alias("metric"), "value", verdict.alias("verdict")))


def facts_by_type(facts: DataFrame) -> DataFrame:
    kinds = facts.groupBy(F.coalesce("fact_type", F.lit("unknown")).alias("fact_type")).agg(F.count("*").alias("n"))
    return kinds.orderBy(F.desc("n"), "fact_type")


def session_stats(facts: DataFrame) -> DataFrame:
    """Processed chunks of each document: number, list and last."""
    done = F.array_sort(F.collect_set("chunk_id")).alias("processed")
    return facts.groupBy("doc_id").agg(F.countDistinct("chunk_id").alias("chunks"), done, F.max("chunk_id").alias("last_chunk"))


def session_info(facts: DataFrame, summaries: DataFrame) -> DataFrame:
    """First and last chunk, facts, whether there is a summary, and the chunk to go on with."""
    rows = facts.groupBy("doc_id").agg(F.min("chunk_id").alias("first_chunk"), F.max("chunk_id").alias("last_chunk"), F.count("*").alias("facts"))
    named = summaries.select("doc_id", F.lit(True).alias("has_summary")).distinct()
    rows = rows.join(named, "doc_id", "left").withColumn("has_summary", F.coalesce("has_summary", F.lit(False)))
    return rows.withColumn("next_chunk", F.col("last_chunk") + 1)


def multi_quote_stats(facts: DataFrame) -> DataFrame:
    n = count_of(F.col("evidence_quotes"))
    out = facts.agg(F.count("*").alias("total"), _number(n == 1).alias("single"), _number(n > 1).alias("multi"))
    return out.withColumn("multi_percent", F.coalesce(F.try_divide(F.col("multi") * 100.0, F.col("total")), F.lit(0.0)))


def progress(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """The last chunk done and the share done of each document."""
    there = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    last = done.groupBy("doc_id").agg(F.max("chunk_id").alias("last_chunk"), F.countDistinct("chunk_id").alias("n"))
    rows = there.join(last, "doc_id", "left")
    return rows.select("doc_id", "chunks", "last_chunk", (F.coalesce("n", F.lit(0)) / F.col("chunks")).alias("share"))


def specificity_distribution(facts: DataFrame, *by: str) -> DataFrame:
    s = F.coalesce("specificity_score", F.lit(0.0))
    return facts.groupBy(*by).agg(F.avg(s).alias("average"), _share(s >= 0.7).alias("high_share"))


def consolidated_totals(facts: DataFrame) -> DataFrame:
    """Facts of each document, and of all (doc_id null)."""
    return facts.rollup("doc_id").agg(F.count("*").alias("fact_count"))


def knowledge_stats(facts: DataFrame) -> DataFrame:
    """Facts by type and in all (fact_type null), with the share that has quantities."""
    kinds = facts.withColumn("fact_type", F.coalesce("fact_type", F.lit("unknown"))).rollup("fact_type")
    return kinds.agg(F.count("*").alias("n"), _share(count_of(F.col("quantitative_values")) > 0).alias("qv_share"))
