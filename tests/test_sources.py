"""Replacement by key, stores of answers, running quotas, rejects, summaries."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import quota, summary
from factloom.sources import facts_io, versions
from factloom.streaming import ingest

SCHEMA = "doc_id long, text string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def read(spark, path):
    return sorted((tuple(r) for r in versions.current(spark, path, "doc_id", SCHEMA).collect()), key=str)


def test_replacement_is_whole_or_not_at_all(spark):
    path = facts_io.scratch(spark, "versions")
    assert versions.replace_by_key(table(spark, [(1, "a"), (1, "b"), (2, "c"), (None, "n")]), path, "doc_id") == 1
    before = read(spark, path)
    assert before == [(1, "a"), (1, "b"), (2, "c"), (None, "n")]
    write = versions.stage(table(spark, [(1, "x"), (3, "y"), (None, "m")]), path, "doc_id")
    assert read(spark, path) == before  # the writer died here
    assert versions.publish(spark, path, write) == 2
    assert read(spark, path) == [(1, "x"), (2, "c"), (3, "y"), (None, "m")]
    # a key without rows has none from then on; it stays registered
    versions.replace_by_key(table(spark, []), path, "doc_id", keys=table(spark, [(2, "")]))
    assert read(spark, path) == [(1, "x"), (3, "y"), (None, "m")]
    known = {r.doc_id: r.version for r in versions.registered(spark, path, "doc_id").collect()}
    assert known == {1: 2, 2: 3, 3: 2, None: 2}


def test_a_batch_that_runs_twice_counts_once(spark):
    path = facts_io.scratch(spark, "versions")
    for _ in range(2):
        versions.replace_by_key(table(spark, [(1, "a"), (2, "b")]), path, "doc_id", version=7)
    assert read(spark, path) == [(1, "a"), (2, "b")]


def test_answers_are_produced_once(spark):
    path, asked = facts_io.scratch(spark, "store"), []

    def produce(rows):
        asked.append(sorted(r.chunk_text for r in rows.collect()))
        return rows.select("content", F.upper("chunk_text").alias("claim"))

    chunks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (3, 0, None)], "doc_id int, chunk_id int, chunk_text string")
    more = chunks.union(spark.createDataFrame([(4, 0, "c"), (4, 1, "b")], chunks.schema))
    run = lambda rows, **k: sorted(tuple(r) for r in versions.produced_once(rows, produce, "claim string", path, **k).collect())
    assert run(chunks) == [(1, 0, "A"), (1, 1, "B"), (2, 0, "A")]
    assert run(chunks) == [(1, 0, "A"), (1, 1, "B"), (2, 0, "A")]
    assert run(more) == [(1, 0, "A"), (1, 1, "B"), (2, 0, "A"), (4, 0, "C"), (4, 1, "B")]
    assert asked == [["a", "b"], ["c"]]
    assert run(chunks, label="another model")[0] == (1, 0, "A") and asked[-1] == ["a", "b"] and len(asked) == 3


@pytest.mark.parametrize("files", [1, 5])
def test_running_quotas_equal_the_batch(spark, files):
    pick = random.Random(files)
    rows = [(pick.randrange(6), k, ["v"] if pick.random() < 0.2 else None) for k in range(120)]
    facts = spark.createDataFrame(rows, "doc_id int, fact_no int, quantitative_values array<string>")
    base = facts_io.scratch(spark, "stream")
    half = facts.where("fact_no < 60")
    half.repartition(files).write.parquet(f"{base}/facts")
    go = lambda: ingest.stream_quotas(spark, f"{base}/facts", f"{base}/quotas", f"{base}/checkpoint", files_per_batch=2).awaitTermination()
    held = lambda: sorted(tuple(r) for r in versions.current(spark, f"{base}/quotas", "doc_id", ingest.QUOTAS).collect())
    want = lambda df: sorted(tuple(r) for r in quota.global_quota(df).collect())
    go()
    assert held() == want(half)
    facts.where("fact_no >= 60").repartition(files).write.mode("append").parquet(f"{base}/facts")
    go()  # goes on from the checkpoint
    assert held() == want(facts)
    go()
    assert held() == want(facts)


def test_records_that_cannot_be_read(spark):
    texts = ['{"facts": [{"claim": "a"}]}', '{"documents": {"d": {"facts": [{"claim": "b"}]}}}', '{"facts": []}', '{"x": 1}', "[1]", "{", "", None, '{"facts": [{"claim": "c"']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "at int, json string")
    facts, rejects = facts_io.checked_facts_json(rows)
    assert sorted((r.document or "", r.claim) for r in facts.collect()) == [("", "a"), ("d", "b")]
    assert {r["at"]: r.reason for r in rejects.collect()} == {3: "neither documents nor facts", **dict.fromkeys((4, 5, 6, 7, 8), "not JSON")}
    with pytest.raises(ValueError, match="neither documents nor facts"):
        facts_io.scan_facts_json(rows.where("at = 3"))
    assert facts_io.scan_facts_json(rows, strict=False).count() == 2 and facts_io.scan_facts_json(rows.where("at < 3")).count() == 2
    pages = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id int, page_no int")
    assert facts_io.page_select(pages, 0, strict=True).count() == 2 and facts_io.page_select(pages, 1).count() == 1
    for number in (1, -1):
        with pytest.raises(IndexError, match=f"page {number} of document"):
            facts_io.page_select(pages, number, strict=True)


def test_summaries(spark):
    report = [
        "1. Overview of the System", "CC6.1 Access is reviewed daily by Acme Cloud", "", "ID  Owner  Port", "h1  Acme Cloud  443", "h2  Acme Cloud  80", "CONTROL TESTING", "| CC6.2 | No exceptions noted |",
        "In 2019 and 2023 the encryption of Acme Cloud was tested.", None, "Complementary User Entity Controls",
    ]
    rows = [(1, n, x) for n, x in enumerate(report, 1)] + [(2, 1, ""), (3, 1, "encryption everywhere")]
    got = {r.doc_id: r for r in summary.summarize(spark.createDataFrame(rows, "doc_id int, line_no int, line string")).collect()}
    one = got[1]
    assert (one.document_type, one.structural_pattern) == ("SOC 2 report", "claim-based")
    assert one.section_headings == ["1. Overview of the System", "CONTROL TESTING", "Complementary User Entity Controls"]
    assert [(s.section_type, s.headings) for s in one.section_types] == [("System Description", 1), ("Control Testing", 1), ("CUEC", 1)]
    assert tuple(one.table_structure) == (3, 3, ["ID", "Owner", "Port"])
    assert one.key_entities[0] == "Acme Cloud" and "encryption" not in one.primary_topics and "acme" in one.primary_topics
    assert one.scope.endswith("years 2019 to 2023") and one.scope.startswith("11 lines") and one.fact_density_pattern.startswith("9 quantities")
    empty = got[2]
    assert empty.document_type == "technical document" and empty.table_structure is None and empty.section_types == [] and empty.key_entities == []
    assert empty.fact_density_pattern == "0 quantities per 100 lines, most of them none" and empty.extraction_guidance
