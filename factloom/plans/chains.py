"""Compositions: what happens to the facts of a chunk, how a fact set is curated, rule-based extraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import patterns as P
from factloom.operators import score
from factloom.operators.extract import control_facts, control_rows, generated_claim, noted, quantitative_values
from factloom.operators.quota import generate_missing_facts, quota_filter, retro_tag_qv
from factloom.sources.facts_io import stored


def post_process_chain(facts: DataFrame, chunks: DataFrame, target: float = 0.5) -> DataFrame:
    """Rescore, enrich from the chunk, tag quantities, drop facts of little value, then make facts for the quantities
    that each chunk's quota is short of. Those have auto_generated set, their ordinal in the chunk's quantities in
    qv_ord, and no fact_no. stats.extraction_coverage and stats.enhancement_stats report on the result."""
    kept = refined(facts, chunks)
    held = stored(kept, "refined")  # read by the quota, the search for what is missing, and the result
    made = generate_missing_facts(chunks, held, target)
    made = made.select(
        "doc_id", "chunk_id", "qv_ord", "claim", "fact_type", "control_family", "specificity_score", "source_doc", "source_location", "evidence_quote",
        "confidence", "auto_generated", "quantitative_values", "entities",
    )
    return held.unionByName(made, allowMissingColumns=True)


def refined(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """The facts that are kept, rescored, enriched and tagged."""
    text = F.col("chunk_text")
    specs = F.array_distinct(F.concat(*(P.hits(text, r) for r in (P.ENCRYPTION, P.AUTHENTICATION, P.NETWORK))))
    found = chunks.select("doc_id", "chunk_id", specs.alias("specs"), P.distinct_hits(text, P.ROLES).alias("roles"), F.array_distinct(P.quantities(text)).alias("chunk_values"))
    rows = score.rescore_specificity(facts).join(found, ["doc_id", "chunk_id"], "left")
    rows = score.tag_quantitative(score.enrich_role(score.enrich_entities(rows))).drop("specs", "roles", "chunk_values")
    kept, _ = score.filter_low_value(rows)
    return score.filter_low_specificity(kept)


def curate_chain(facts: DataFrame, target: float = 0.35) -> DataFrame:
    return facts.transform(retro_tag_qv).transform(lambda f: quota_filter(f, target))


def extract_facts(chunks: DataFrame) -> DataFrame:
    """Facts by rule: one for each quantity of a chunk, claimed by its context, and those of its control tables."""
    rows = quantitative_values(chunks.withColumn("_noted", noted(F.col("chunk_text"))), "chunk_text", "doc_id", "chunk_id", "_noted")
    made = generated_claim(F.col("type"), F.col("value"), F.col("_noted"))
    found = rows.select("doc_id", "chunk_id", "qv_ord", "value", "type", made["claim"].alias("claim"), made["fact_type"].alias("fact_type"))
    controls = control_facts(control_rows(chunks, "doc_id", "chunk_id"))
    none = F.lit(None)
    controls = controls.select(
        "doc_id", "chunk_id", none.cast("int").alias("qv_ord"), "value", none.cast("string").alias("type"), "claim", "fact_type"
    )
    return found.unionByName(controls)


def facts_of_producer(chunks: DataFrame, produce: Callable, schema: str) -> DataFrame:
    """Facts that `produce` makes (a function over iterators of pandas frames of chunks, as mapInPandas takes it): the
    place of a model. schema: of its facts."""
    return chunks.mapInPandas(produce, schema)


def summarize_documents(docs: DataFrame) -> DataFrame:
    """A summary by rule: lines, characters, and the first line as a title."""
    lines = F.split("text", "\n", -1)
    return docs.where("text is not null").select("doc_id", F.size(lines).alias("lines"), F.length("text").alias("chars"), F.substring(lines[0], 1, 80).alias("title"))


# The phrases that each specialised pass looks for; the other two passes go by quantities and specifications.
PASSES = {
    "cuec": ["user entity", "customer responsibility", "the user entity is responsible for", "complementary controls"],
    "test_procedures": ["inspection", "observation", "inquiry", "re-performance"],
}


def specialized_pass(rows: DataFrame, pass_type: str, text: str = "line") -> DataFrame:
    """The rows that a pass is about, with pass_type; none for an unknown pass."""
    return specialized_passes(rows, [pass_type], text)


def specialized_passes(rows: DataFrame, pass_types: list[str], text: str = "line") -> DataFrame:
    """The rows of several passes, which are read once: one for each pass that a row belongs to."""
    named = F.array(*(F.when(_belongs(F.col(text), p), F.lit(p)) for p in pass_types))
    return rows.withColumn("pass_type", F.explode(named)).where("pass_type is not null")


def _belongs(column: Column, pass_type: str) -> Column:
    if pass_type in PASSES:
        return score.holds(F.lower(column), PASSES[pass_type])
    if pass_type == "quantitative":
        return P.any_hit(column, [rule for rules in P.QUANTITIES.values() for rule in rules])
    if pass_type == "technical_specs":
        return P.any_hit(column, P.ENCRYPTION + P.AUTHENTICATION + P.NETWORK)
    return F.lit(False)


def specialized_facts(rows: DataFrame, pass_type: str, text: str = "line") -> DataFrame:
    """rows (with line_no) that a pass is about, with the facts that it makes of them: pass_type, claim, fact_type, quantitative_values,
    entities, source_location and evidence_quote.

    quantitative: one fact for each different quantity, claimed by the line; technical_specs: one for each specification;
    cuec and test_procedures: the line itself, the latter with the sample sizes in it. None for an unknown pass.
    """
    column, none = F.col(text), F.lit(None).cast("array<string>")
    whole = F.trim(column)
    place = F.concat(F.lit("Lines "), F.col("line_no").cast("string"), F.lit("-"), F.col("line_no").cast("string"))
    kept = [*rows.columns, F.lit(pass_type).alias("pass_type"), place.alias("source_location"), whole.alias("evidence_quote")]

    def facts(found: DataFrame, claim: Column, kind: Column, quantities: Column, entities: Column) -> DataFrame:
        made = [claim.alias("claim"), kind.alias("fact_type"), quantities.alias("quantitative_values"), entities.alias("entities")]
        return found.select(*kept, *made)

    if pass_type == "quantitative":  # rows without any go with explode, so the rules are matched once
        found = rows.withColumn("_noted", noted(column)).withColumn("_q", F.explode(F.array_distinct(P.quantities(column))))
        found = found.withColumn("_made", generated_claim(F.col("_q.type"), F.col("_q.value"), F.col("_noted")))
        return facts(found, F.col("_made.claim"), F.col("_made.fact_type"), F.array("_q.value"), none)
    if pass_type == "technical_specs":
        specs = F.concat(*(P.distinct_hits(column, r) for r in (P.ENCRYPTION, P.AUTHENTICATION, P.NETWORK)))
        found = rows.withColumn("_spec", F.explode(specs))
        return facts(found, F.concat(F.lit("System uses "), "_spec"), F.lit("technical_control"), none, F.array("_spec"))
    found = specialized_pass(rows, pass_type, text)  # none for an unknown pass
    if pass_type == "test_procedures":
        samples = P.distinct_hits(column, P.SAMPLE)
        return facts(found, whole, F.lit("test_result"), F.when(F.size(samples) > 0, samples), none)
    return facts(found, whole, F.lit("process"), none, none)
