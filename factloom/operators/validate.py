"""Quote validation against the source, recovery and correction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import bound, is_match, match_ratio, quote_snippet
from factloom.operators.chunks import with_cited_lines
from factloom.operators.propose import propose_quotes

LEAST = 0.7
QUOTES = "array<struct<quote: string, source_location: string, relevance: string>>"


def quotes_of(facts: DataFrame) -> Column:
    """A fact's quotes, or its single one; facts may lack either column."""
    listed = F.col("evidence_quotes") if "evidence_quotes" in facts.columns else F.lit(None).cast(QUOTES)
    if "evidence_quote" not in facts.columns:
        return listed
    single = F.struct(F.col("evidence_quote").alias("quote"), F.lit(None).cast("string").alias("source_location"), F.lit(None).cast("string").alias("relevance"))
    return F.when(F.size(listed) > 0, listed).when(F.col("evidence_quote") != "", F.array(single))


def ratios(quotes: Column, text: Column) -> Column:
    return F.transform(quotes, lambda q: match_ratio(q["quote"], text))


def all_match(quotes: Column, text: Column) -> Column:
    """True if there is a quote and every one of them matches."""
    return (F.coalesce(F.size(quotes), F.lit(0)) > 0) & F.forall(quotes, lambda q: is_match(match_ratio(q["quote"], text), LEAST))


def validate_in_chunk(facts: DataFrame, text: str = "chunk_text") -> DataFrame:
    """facts with is_valid: every quote (a single one if there is no list) is in the chunk; generated facts are taken unseen."""
    seen = F.coalesce(all_match(quotes_of(facts), F.col(text)), F.lit(False))
    return facts.withColumn("is_valid", skip_auto_generated(F.col("auto_generated"), seen))


def skip_auto_generated(generated: Column, valid: Column) -> Column:
    return F.coalesce(generated, F.lit(False)) | valid


def _near(facts: DataFrame, documents: DataFrame, reach: int) -> tuple[DataFrame, Column]:
    """facts with the cited lines (exact_text) and those around (cited_text), and their scope."""
    near = with_cited_lines(facts, documents, reach)
    begin = F.greatest(F.lit(1), F.col("start_line"))
    exact = F.slice("cited_lines", begin - F.col("first_cited") + 1, F.greatest(F.lit(0), F.coalesce("end_line", "start_line") - begin + 1))
    near = near.withColumns({"exact_text": F.array_join(exact, "\n"), "cited_text": F.array_join("cited_lines", "\n")})
    quotes = quotes_of(facts)
    return near, F.when(all_match(quotes, F.col("exact_text")), "exact").when(all_match(quotes, F.col("cited_text")), "expanded")


def validate_in_lines(facts: DataFrame, documents: DataFrame, reach: int = 5) -> DataFrame:
    """facts with is_valid and scope (`exact`, `expanded` or null): every quote (a single one if there is no list) is in the
    cited lines, or near them. Facts without quotes or place have no scope."""
    near, scope = _near(facts, documents, reach)
    out = near.withColumn("scope", scope).withColumn("is_valid", F.col("scope").isNotNull())
    return out.drop("exact_text", "cited_text", "cited_lines", "first_cited")


def medium_confidence(facts: DataFrame, documents: DataFrame, reach: int = 5, low: float = 0.40, high: float = 0.70) -> DataFrame:
    """Facts that aren't found in the cited lines or near them, and whose best rounded match there is in [low, high), with
    best_match and best_quote: candidates for recovery, which looks further around."""
    near, scope = _near(facts, documents, reach)
    rated = F.zip_with(quotes_of(facts), ratios(quotes_of(facts), F.col("cited_text")), lambda q, r: F.struct(F.round(r, 2).alias("r"), q["quote"].alias("q")))
    # the first of the quotes that match best
    best = F.array_max(F.transform(rated, lambda x, i: F.struct(x["r"].alias("r"), (-i).alias("i"), x["q"].alias("q"))))
    failed = near.withColumn("_best", best).withColumns({"best_match": F.col("_best.r"), "best_quote": F.col("_best.q")}).drop("_best").where(scope.isNull())
    return failed.where(bound(F.col("best_match"), lambda m: (m >= low) & (m < high))).drop("exact_text", "cited_text", "cited_lines", "first_cited")


def recover_quotes(facts: DataFrame, documents: DataFrame, proposals: DataFrame | None = None, reach: int = 20, least: float = 0.8) -> DataFrame:
    """doc_id, fact_no, corrected_quote, corrected_location, was_recovered of facts that medium_confidence names, with best_quote.

    proposals (doc_id, fact_no, found, quote, confidence): those of a model; without, of propose_quotes. One is taken if it
    is sure enough and stands in the lines around. The location is all of these lines.
    """
    if proposals is None:
        proposals = propose_quotes(facts, documents, reach, "best_quote")
    rows = with_cited_lines(facts.select("doc_id", "fact_no", "start_line", "end_line"), documents, reach)
    rows = rows.join(proposals.select("doc_id", "fact_no", "found", "quote", "confidence"), ["doc_id", "fact_no"])
    stands = is_match(match_ratio(F.col("quote"), F.array_join("cited_lines", "\n")), LEAST)
    rows = rows.withColumn("was_recovered", F.coalesce(F.col("found") & (F.col("confidence") >= least) & stands, F.lit(False)))
    taken = lambda c: F.when(F.col("was_recovered"), c)
    return rows.select("doc_id", "fact_no", taken(F.col("quote")).alias("corrected_quote"), taken(_around()).alias("corrected_location"), "was_recovered")


def _around() -> Column:
    """The place of the lines in cited_lines."""
    last = F.col("first_cited") + F.size("cited_lines") - 1
    return F.concat(F.lit("Lines "), F.col("first_cited").cast("string"), F.lit("-"), last.cast("string"))


def correct_quotes(rejected: DataFrame, documents: DataFrame, proposals: DataFrame | None = None, least: float = 0.3, reach: int = 30) -> DataFrame:
    """Rejected facts (with match_percentage) worth a try, with was_corrected, corrected_quote, corrected_location,
    correction_confidence and validation_score (1 exact, 0.8 partial, null if not corrected); proposals as for recover_quotes."""
    tried = rejected.where(F.coalesce("match_percentage", F.lit(0.0)) >= least)
    if proposals is None:
        proposals = propose_quotes(tried, documents, reach)
    rows = with_cited_lines(tried.select("doc_id", "fact_no", "start_line", "end_line", "match_percentage"), documents, reach)
    rows = rows.join(proposals.select("doc_id", "fact_no", "found", "quote", "confidence"), ["doc_id", "fact_no"], "left")
    ratio = match_ratio(F.col("quote"), F.array_join("cited_lines", "\n"))
    score = F.when(F.col("found"), F.when(ratio >= 1.0, 1.0).when(is_match(ratio, LEAST), 0.8))
    rows = rows.withColumn("validation_score", score).withColumn("was_corrected", F.col("validation_score").isNotNull())
    taken = lambda c: F.when(F.col("was_corrected"), c)
    return rows.select(
        "doc_id", "fact_no", "match_percentage", "was_corrected", taken(F.col("quote")).alias("corrected_quote"), taken(_around()).alias("corrected_location"),
        F.when(F.col("found"), F.col("confidence")).otherwise(0.0).alias("correction_confidence"), "validation_score",
    )


def correct_facts(facts: DataFrame, documents: DataFrame, by: str = "doc_id", high: float = 0.8, least: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(corrections, summary) of all facts whose match_percentage is below `high`; a fact without one isn't rejected.

    summary: by, total_facts (rejected ones), corrected, failed (those not tried included) and correction_rate.
    """
    rejected = facts.where(F.coalesce("match_percentage", F.lit(1.0)) < high)
    corrections = correct_quotes(rejected, documents, least=least)
    good = corrections.where("was_corrected").groupBy(by).agg(F.count("*").alias("corrected"))
    total = rejected.groupBy(by).agg(F.count("*").alias("total_facts")).join(good, by, "left")
    total = total.withColumn("corrected", F.coalesce("corrected", F.lit(0)))
    failed = F.col("total_facts") - F.col("corrected")
    return corrections, total.select(by, "total_facts", "corrected", failed.alias("failed"), (F.col("corrected") / F.col("total_facts")).alias("correction_rate"))


def error_text(quotes: Column, failed: Column) -> Column:
    """`k/n quotes not found` with the beginning of the first quote; null if none failed."""
    text = F.concat(failed.cast("string"), F.lit("/"), F.size(quotes).cast("string"), F.lit(" quotes not found: "), quote_snippet(quotes))
    return F.when(failed > 0, text)


def validation_stats(validated: DataFrame, *by: str) -> DataFrame:
    """total, valid, invalid and rate (0 if there are none)."""
    valid = F.sum(F.col("is_valid").cast("long"))
    return (
        validated.groupBy(*by)
        .agg(F.count("*").alias("total"), F.coalesce(valid, F.lit(0)).alias("valid"))
        .withColumn("invalid", F.col("total") - F.col("valid"))
        .withColumn("rate", F.coalesce(F.try_divide("valid", "total"), F.lit(0.0)))
    )
