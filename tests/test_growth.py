"""Work that must not grow faster than its input: values computed once, texts shuffled once, few files."""

import glob
import random
import re
from types import SimpleNamespace

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.functions import patterns
from factloom.functions import text as T
from factloom.llm import bpe
from factloom.operators import chunks, consensus, extract, propose, quota, score
from factloom.plans import chains
from factloom.sources import facts_io, versions


def written(column) -> str:
    return column._jc.toString()


def test_a_quote_is_normalised_once(spark):
    """Not for each word of the text, which a lambda would do."""
    spark.range(1)
    assert written(T.match_ratio(F.col("q"), F.col("t"))).count("regexp_replace") == 2


@pytest.mark.parametrize("q,t,want", [("a b c", "x A  b y", 2 / 3), (None, "a", None), ("a", None, None), ("", "a", 1.0), ("z", "", 0.0), ("a  b", "x a b", 1.0)])
def test_ratios(spark, q, t, want):
    row = spark.createDataFrame([(q, t)], "q string, t string").select(T.match_ratio(F.col("q"), F.col("t")).alias("r")).first()
    assert row.r == (None if want is None else pytest.approx(want))


def test_a_quantity_is_taken_apart_once(spark):
    spark.range(1)
    assert written(score.qv_matches_claim(F.col("v"), F.col("k"), F.col("c"))).count("regexp_extract") == 3


def test_a_range_meets_one_part(spark):
    """Texts of ranges up to a part's length needn't be put together from pieces, which shuffled them."""
    docs = spark.createDataFrame([(1, [str(i) for i in range(1, 131)])], "doc_id int, lines array<string>")
    assert [(r.part, len(r.part_lines), r.part_lines[0]) for r in chunks.line_parts(docs).orderBy("part").collect()] == [(0, 128, "1"), (1, 66, "65"), (2, 2, "129")]


def test_files_do_not_grow_with_chunks(spark):
    """Rows of many keys in one write, of which some are written again."""
    path = facts_io.scratch(spark, "chunks")
    rows = spark.range(600).selectExpr("cast(id div 6 as int) as doc_id", "if(id % 6 = 5, null, cast(id % 6 as int)) as chunk_id", "id as fact_no").coalesce(2)
    facts_io.sink_chunks(rows, path, "doc_id", "chunk_id")
    assert len(glob.glob(f"{path}/data/**/*.parquet", recursive=True)) <= 2
    assert sorted(facts_io.load_all_facts(spark, path).collect(), key=str) == sorted(rows.collect(), key=str)
    facts_io.sink_chunks(rows.where("doc_id < 9 and chunk_id is null").withColumn("fact_no", F.col("fact_no") + 1000), path, "doc_id", "chunk_id")
    got = {(r.doc_id, r.chunk_id): r.fact_no for r in facts_io.load_all_facts(spark, path).collect()}
    assert len(got) == 600 and got[0, None] == 1005 and got[9, None] == 59 and got[0, 0] == 0
    assert facts_io.load_all_facts(spark, path, 3).count() == 6


def test_answers_are_not_broadcast(spark):
    path = facts_io.scratch(spark, "store")
    chunks_ = spark.range(50).selectExpr("cast(id as int) as doc_id", "0 as chunk_id", "concat('text ', id) as chunk_text")
    found = versions.produced_once(chunks_, lambda asked: asked.select("content", F.upper("chunk_text").alias("claim")), "claim string", path)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 50


def test_a_quote_that_stands_there_is_not_aligned(monkeypatch):
    monkeypatch.setattr(propose, "local_alignment", None)
    assert propose.proposal("B c", ["a b", "c b", "C d"]) == ("b\nc", 1.0, 0, 1)
    assert propose.proposal("c d", ["a c", " c  d"]) == ("c  d", 1.0, 1, 1)


def test_rules_are_tried_only_where_they_can_match(spark):
    """The same matches as without the words that rules need, also of letters that only fold into ASCII."""
    words = "daily EVERY 30 dayſ weeKs wıthin 24 hours real-tİme upon request at least 3 times per year on a regular basis 90-day retention samples sampled 5 of 9 items inspected all".split(" ")
    words += "١٢ percent 5% than more 7 above exceeds uptime of 99.5%x uſers over 1,200 100+ countries\n tested reviewed out of minimum sample months seconds no less".split(" ")
    pick = random.Random(2)
    texts = [pick.choice([" ", "\n"]).join(pick.choices(words, k=pick.randrange(0, 40))) for _ in range(400)] + [None, "", " ".join(words)]
    rules = [r for family in patterns.QUANTITIES.values() for r in family]
    plain = F.concat(*(F.regexp_extract_all("t", F.lit(patterns.FLAGS + r), F.lit(0)) for r in rules))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(plain.alias("want"), patterns.hits(F.col("t"), rules).alias("got"), F.expr("t is null").alias("none"), patterns.quantities(F.col("t")).alias("q")).collect()
    assert set(patterns.NEEDED) == set(rules)
    for r in rows:
        assert r.got == (r.want or []) == [q.value for q in r.q]
    assert sum(len(r.got) for r in rows) > 500


def test_ids_take_the_room_of_a_piece(spark, monkeypatch):
    """Not that of a whole batch of texts, of which an executor holds one for each core."""
    monkeypatch.setattr(bpe, "PIECE", 100)
    texts = ["a b" * 20, None, "", "é" * 80, "x" * 500, "c", "d"] * 9
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["row", "text"])
    shared = SimpleNamespace(value=bpe.Tokenizer({bytes([b]): b for b in range(256)}, public_tokenizers.PATTERN))
    out = list(bpe._encode(shared)(iter([batch.slice(1), batch.slice(0, 0)])))
    assert [(r["row"], bytes(r["ids"])) for b in out for r in b.to_pylist()] == [(i, (t or "").encode()) for i, t in enumerate(texts)][1:]
    assert all(len(b) == 1 or sum(map(len, b.column(1).to_pylist())) <= 100 for b in out)


def test_a_chunk_is_searched_once_for_what_is_claimed(spark):
    """Not once more for each of its quantities, with its text beside each."""
    texts = spark.createDataFrame([(1, 1, "Backup daily\nsampled 5 items, 3 days")], "doc_id int, chunk_id int, chunk_text string")
    got = {r.claim for r in chains.extract_facts(texts).collect()}
    assert {"Backups performed daily", "Testing sampled sampled 5 items", "Duration specified as 3 days"} <= got
    assert "lower" not in written(extract.generated_claim(F.col("k"), F.col("v"), F.col("n")))


def test_passes_read_rows_once(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["daily TLS 1.2", "USER ENTITY inspection", "ſample of 5", "none", None])], "line_no int, line string")
    names = ["quantitative", "technical_specs", "cuec", "test_procedures", "other"]
    found = chains.specialized_passes(rows, names)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    want = {(0, "quantitative"), (0, "technical_specs"), (1, "cuec"), (1, "test_procedures"), (2, "quantitative")}
    assert {(r.line_no, r.pass_type) for r in found.collect()} == want == {(r.line_no, n) for n in names for r in chains.specialized_pass(rows, n).collect()}


@pytest.mark.parametrize("buckets", [1, 512])
def test_near_claims_without_a_shuffle_of_words(spark, monkeypatch, buckets):
    """Groups equal those by all pairs, however words are counted; claims without words, unknown documents."""
    monkeypatch.setattr(consensus, "BUCKETS", buckets)
    pick = random.Random(5)
    claims = {(d, " ".join(sorted(pick.sample("abcdefgh", pick.randrange(5, 9))))) for d in (1, 2, None) for _ in range(12)} | {(1, ""), (2, "zz")}
    found = consensus._near_groups(spark.createDataFrame([(d, c, c.split()) for d, c in claims], "doc_id int, claim string, words array<string>"), 80)
    got = {}
    for r in found.collect():
        got.setdefault(bytes(r["_group"]), set()).add((r.doc_id, r.claim))
    near = lambda a, b: a[0] == b[0] and 100 * len({*a[1].split()} & {*b[1].split()}) >= 80 * len({*a[1].split()} | {*b[1].split()})
    want, left = [], set(claims)
    while left:
        group, ahead = set(), [left.pop()]
        while ahead:
            group.add(x := ahead.pop())
            ahead += (close := {y for y in left if near(x, y)})
            left -= close
        want.append(group)
    assert sorted(got.values(), key=str) and {frozenset(g) for g in got.values()} == {frozenset(g) for g in want}
    assert 2 < len(want) < len(claims)


def test_a_context_is_searched_from_its_first_hit(spark):
    """Not from every place of a text, each as far as the reach. The same contexts as from every place."""
    spark.range(1)
    patterns_ = re.findall(r"\(\?is\)(.)", written(T.quantity_context(F.col("v"), F.col("t"))))
    assert len(patterns_) == 2 and set(patterns_) == {"^"}
    pick = random.Random(3)
    words = ["5 days", "5 Days", "ab", "\n", " ", "é", "𝄞", "1.5%", "1x5%", "100+ users", "1000 users", "(a)", "A", "K"]
    rows = [(v, "".join(pick.choices(words, k=pick.randrange(0, 25)))) for v in ("5 days", "1.5%", "100+ users", "(a)", "ab", "k", None) for _ in range(60)] + [("ab", None), ("ab", "")]
    got = spark.createDataFrame(rows, "v string, t string").select("v", "t", T.quantity_context(F.col("v"), F.col("t"), 7).alias("c"))
    for r in got.collect():
        hit = r.v and r.t and re.search("(?isa).{0,7}" + re.sub(r"([()])", r"\\\1", r.v) + ".{0,7}", r.t)
        assert r.c == (re.sub(r"(?a)\s+", " ", hit[0]).strip(" ") or None if hit else None), r
    assert sum(r.c is not None for r in got.collect()) > 200


def test_missing_facts_read_rows_once(spark):
    """A chunk's quantities aren't written, nor its text and facts read again for each use of them."""
    text = "Backup daily; tested 5 users, 30 days"
    texts = {(1, 0): text, (1, 1): text, (1, 2): text, (1, 3): text, (None, 0): text, (1, None): text, (2, 0): None, (2, 1): "nothing", (3, 0): "for 100+ users only"}
    parts = spark.createDataFrame([(d, c, t, 1, 2, "s") for (d, c), t in texts.items()], "doc_id int, chunk_id int, chunk_text string, start_line int, end_line int, source_doc string")
    held = [
        (1, 0, 1, "Backup DAILY", None), (1, 0, 2, "x", ["30 days", None]), (1, 1, 1, "Backup DAILY", None), (1, 1, 2, None, [None]), (1, 1, 3, "y", []),
        (1, 3, 1, "Daily", None), (1, 3, 3, "5 users", None), (1, 3, 2, "30 days, tested", None), (2, 9, 1, "no chunk", None), (None, 0, 1, "z", None),
    ]
    facts = spark.createDataFrame(held, "doc_id int, chunk_id int, fact_no int, claim string, quantitative_values array<string>")
    made = quota.generate_missing_facts(parts, facts)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2 and "Relation" not in plan
    got = sorted((r.doc_id, r.chunk_id, r["pass"], r.qv_ord, r.value, r.confidence) for r in made.collect())
    again = [(1, 3, 2, i, v, 0.75) for i, v in enumerate(["daily", "30 days", "tested 5 users", "5 users"])]
    assert got == [(1, 1, 1, 1, "30 days", 0.8), (1, 1, 1, 2, "tested 5 users", 0.8), (1, 2, 1, 0, "daily", 0.8), *again]
    row = made.where("chunk_id = 2").first()
    assert (row.claim, row.fact_type, row.source_location, row.source_doc, row.evidence_quote) == ("Backups performed daily", "technical_control", "Lines 1-2", "s", text)
    assert row.entities == ["Backup"] and row.quantitative_values == ["daily"] and row.auto_generated


@pytest.mark.parametrize("target", [0.3, 0.8])
def test_missing_facts_fill_the_quota_in_order(spark, target):
    """The same as all quantities, ranked, wherever the search of a text may end."""
    pick = random.Random(7)
    words = ["daily", "Monthly", "every 3 days", "within 24 hours", "90-day retention", "sampled 5 items", "99.5%x", "more than 7", "100+ users", "over 1,200 users", "12 servers", "and", "café"]
    said = lambda n: " ".join(pick.choices(words, k=pick.randrange(0, n)))
    parts = spark.createDataFrame([(i % 9, i // 9, said(25)) for i in range(90)], "doc_id int, chunk_id int, chunk_text string").cache()
    held = [(i % 9, pick.randrange(0, 9), i, said(4), pick.choice([None, [], ["daily"], ["3 days", None], ["sampled 5 items", "7"]])) for i in range(200)]
    facts = spark.createDataFrame(held, "doc_id int, chunk_id int, fact_no int, claim string, quantitative_values array<string>").cache()
    values = quota.chunk_quantities(parts).cache()
    wanted = {(r.doc_id, r.chunk_id): r.wanted for r in quota.chunk_quota(facts, values, target).collect()}
    ranked = {}
    for turn, rows in ((1, quota.missing_qv(values, facts)), (2, values)):
        for r in rows.where("has_context").collect():
            ranked.setdefault((r.doc_id, r.chunk_id), []).append((turn, r.qv_ord, r.value, r.type))
    want = {(*chunk, *q) for chunk, all_ in ranked.items() for q in sorted(all_)[: wanted[chunk]]}
    got = [(r.doc_id, r.chunk_id, r["pass"], r.qv_ord, r.value, r.type) for r in quota.generate_missing_facts(parts, facts, target).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len({q[5] for q in want}) > 3 and {q[2] for q in want} == ({1, 2} if target > 0.5 else {1})
