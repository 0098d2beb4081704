"""BM25 over a written index against plain sums, with parts and levels of any size."""

import math
import random
import re
from collections import Counter

import pytest

from factloom.operators import index
from factloom.sources import facts_io


def plain_search(rows, question, k):
    claims = {}
    for doc, no, claim in rows:
        claims.setdefault((doc, no), []).extend(re.findall("[a-z0-9]+", (claim or "").lower()))
    mean = sum(map(len, claims.values())) / len(claims)
    df = Counter(w for words in claims.values() for w in set(words))
    found = []
    for key, words in claims.items():
        held = Counter(words)
        score = 0.0
        for w in set(re.findall("[a-z0-9]+", question.lower())):
            if held[w]:
                idf = math.log(1 + (len(claims) - df[w] + 0.5) / (df[w] + 0.5))
                score += idf * held[w] * 2.2 / (held[w] + 1.2 * (0.25 + 0.75 * len(words) / mean))
        if score:
            found.append((-round(score, 9), *key))
    return [(d, n) for _, d, n in sorted(found)[:k]]


@pytest.mark.parametrize(("part", "ranked"), [(3, 40), (1024, 1_000_000)])
def test_search_equals_plain_sums(spark, part, ranked):
    pick = random.Random(part)
    words = [f"t{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    rows = [(d, n, " ".join(pick.choices(words, weights, k=pick.randrange(0, 12)))) for d in range(12) for n in range(pick.randrange(5, 25))]
    rows += [(50, 1, None), (50, 2, ""), (50, 3, "T1, t2; t39!"), (50, 4, "t1"), (50, 5, "t1"), (50, 5, "t1")]
    table = spark.createDataFrame(rows, "doc_id long, fact_no long, claim string")
    held = index.write_index(table, facts_io.scratch(spark, "index"), part, ranked)
    assert held.facts == len({r[:2] for r in rows})
    for question in ("t0 t1", "T39?", "t0 t39 t20 t20", "nowhere"):
        for k in (2, 500):
            got = [(r.doc_id, r.fact_no) for r in index.search(held, question, k).orderBy("rank").collect()]
            assert got == plain_search(rows, question, k), (question, k)


def test_answers(spark):
    table = spark.createDataFrame([(1, 1, "alpha beta"), (1, 2, "alpha"), (2, 1, "gamma")], "doc_id long, fact_no long, claim string")
    held = index.write_index(table, facts_io.scratch(spark, "index"))
    said = index.answer(held, table, "alpha?").first()
    assert said.answer == "alpha [Fact 1:2] alpha beta [Fact 1:1]" and said.confidence == "Medium" and said.hits == 2
    none = index.answer(held, table, "delta").first()
    assert none.answer == "" and none.confidence == "Low" and none.hits == 0


def test_no_facts(spark):
    held = index.write_index(spark.createDataFrame([], "doc_id long, fact_no long, claim string"), facts_io.scratch(spark, "index"))
    assert index.search(held, "alpha").count() == 0
