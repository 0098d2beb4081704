"""Quote proposals: alignment against plain tables, recovery and correction end to end."""

import random

import numpy as np
import pytest

from factloom.operators import propose, validate


def best_by_table(quote, text):
    """All cells of the table: the best score, then the earliest end, then the latest start."""
    n = len(text)
    row, best = [(0, j) for j in range(n + 1)], (0, 0, 0)
    for w in quote:
        new = [max((row[0][0] - propose.GAP, row[0][1]), (0, 0))]
        for j in range(1, n + 1):
            step = propose.MATCH if text[j - 1] == w else -propose.OTHER
            new.append(max((0, j), (row[j - 1][0] + step, row[j - 1][1]), (row[j][0] - propose.GAP, row[j][1]), (new[j - 1][0] - propose.GAP, new[j - 1][1])))
        row = new
        for end, (score, start) in enumerate(row):
            if score > 0 and (score, -end, start) > (best[0], -best[2], best[1]):
                best = score, start, end
    return best


@pytest.mark.parametrize("seed", range(6))
def test_alignment_equals_the_table(seed):
    pick = random.Random(seed)
    for _ in range(150):
        quote = [pick.randrange(6) for _ in range(pick.randrange(1, 9))]
        text = [pick.randrange(6) for _ in range(pick.randrange(0, 25))]
        assert propose.local_alignment(np.array(quote), np.array(text, np.int64)) == best_by_table(quote, text)


def test_windows_hold_the_best_alignment():
    """Passages with words left out, put in and replaced, in texts much longer than a window."""
    pick = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    for _ in range(120):
        text = [pick.choice(vocabulary) for _ in range(600)]
        at = pick.randrange(500)
        quote = text[at : at + pick.randrange(6, 40)]
        for _ in range(pick.randrange(0, 4)):
            k = pick.randrange(len(quote))
            quote[k : k + pick.randrange(0, 2)] = [pick.choice(vocabulary)] * pick.randrange(0, 2)
        found = propose.proposal(" ".join(quote), [" ".join(text[k : k + 9]) for k in range(0, 600, 9)])
        score, start, end = best_by_table(quote, text)
        assert found[0].split() == text[start:end] and found[1] == score / (propose.MATCH * len(quote))
        assert found[2:] == (start // 9, (end - 1) // 9)


def test_odd_quotes():
    assert propose.proposal(None, ["a"]) is None and propose.proposal("", ["a"]) is None and propose.proposal("a", None) is None
    assert propose.proposal("a b", []) is None and propose.proposal("x y", ["a b", ""]) is None
    assert propose.proposal("The cat, sat", ["", "so: THE  CAT", "(sat) down"]) == ("THE  CAT\n(sat)", 1.0, 1, 2)
    assert propose.proposal("... b", ["a ... b"]) == ("... b", 1.0, 0, 0)
    assert propose.proposal("b b b", ["b"]) == ("b", pytest.approx(0.0 + 2 / 6), 0, 0)
    long = " ".join(f"w{i}" for i in range(3000))
    assert propose.proposal(long, [long]) == (long, 1.0, 0, 0)


LINES = [f"line {i} of the control report says item {i * 7}" for i in range(1, 81)]
LINES[39] = "The Security Team reviews firewall rules every 30 days and records the outcome"


@pytest.fixture
def documents(spark):
    return spark.createDataFrame([(1, LINES)], "doc_id int, lines array<string>")


def facts(spark, quotes):
    rows = [(1, k, "c", q, s, s, m) for k, (q, s, m) in enumerate(quotes)]
    return spark.createDataFrame(rows, "doc_id int, fact_no int, claim string, evidence_quote string, start_line int, end_line int, match_percentage double")


def test_recovery(spark, documents):
    right = LINES[39]
    quotes = [
        ("The Security Team line item review firewall rules every month", 40, None),  # medium here: too far from the source
        ("line 52 of the control firewall rules every 30 days and records", 52, None),  # best text is 12 lines up
        (right, 40, None),  # found as it is
        ("nothing like it", 40, None),
        (None, 40, None),
        (right, None, None),
    ]
    held = facts(spark, quotes)
    tried = validate.medium_confidence(held, documents)
    assert {r.fact_no for r in tried.collect()} <= {0, 1}
    got = {r.fact_no: r for r in validate.recover_quotes(tried, documents).collect()}
    assert not any(r.was_recovered for r in got.values())
    close = tried.withColumn("best_quote", tried.claim.substr(0, 0)).limit(0)
    assert validate.recover_quotes(close, documents).count() == 0
    moved = facts(spark, [("Security Team reviews firewall rules every 30 days and logs the outcome", 55, None)]).withColumnRenamed("evidence_quote", "best_quote")
    row = validate.recover_quotes(moved, documents).first()
    assert row.was_recovered and row.corrected_quote == right.removeprefix("The ") and row.corrected_location == "Lines 35-75"


def test_correction(spark, documents):
    held = facts(
        spark,
        [
            ("the security team reviews rules every 30 days", 60, 0.7), ("line 60 of the control report", 60, 0.79), ("line 60 of the", 60, 0.8), ("line 60 of the", 60, None),
            ("nothing like it", 60, 0.4), ("line 60 of the", 60, 0.2), ("line 60 of the", 90, 0.5), ("line 60 of the", 900, 0.5),
        ],
    )
    corrections, summary = validate.correct_facts(held, documents)
    got = {r.fact_no: r for r in corrections.collect()}
    assert set(got) == {0, 1, 4, 6, 7}  # not rejected: 2 and 3; not tried: 5
    assert got[0].corrected_quote == "The Security Team reviews firewall rules every 30 days" and got[0].validation_score == 1.0
    assert got[0].corrected_location == "Lines 30-80" and 0.8 < got[0].correction_confidence < 1
    assert got[1].corrected_quote == "line 60 of the control report" and got[1].correction_confidence == 1.0
    assert not got[4].was_corrected and got[4].corrected_quote is None and got[4].correction_confidence == 0.0
    assert got[6].corrected_quote == "line 60 of the" and not got[7].was_corrected
    assert tuple(summary.first()) == (1, 6, 3, 3, 0.5)


def test_a_model_can_propose(spark, documents):
    held = facts(spark, [("x", 40, 0.5), ("y", 40, 0.5), ("z", 40, 0.5)])
    told = spark.createDataFrame([(1, 0, True, "firewall rules every 30 days", 0.9), (1, 1, True, "not in the text at all", 0.9)], "doc_id int, fact_no int, found boolean, quote string, confidence double")
    got = {r.fact_no: (r.was_corrected, r.validation_score) for r in validate.correct_quotes(held, documents, told).collect()}
    assert got == {0: (True, 1.0), 1: (False, None), 2: (False, None)}
