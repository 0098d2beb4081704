"""Goldens worked out by hand, and native expressions against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.functions import patterns as P
from factloom.functions import text as T
from factloom.operators import extract, score


def column(spark, rows, expr, name="text"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"id int, {name} string")
    return [r[0] for r in df.select(expr(F.col(name)), "id").orderBy("id").collect()]


def test_quantities(spark):
    got = column(spark, ["Backups run daily and every 30 days", "sampled 25 items", "99.95% uptime", "at 2 AM", None, ""], P.quantities)
    assert [(q.value, q.type, q.normalized) for q in got[0]] == [
        ("daily", "frequency", "daily"), ("every 30 days", "frequency", "every 30 days"), ("30 days", "duration", None),
    ]
    assert [(q.value, q.type) for q in got[1]] == [("sampled 25 items", "sample_size")]
    assert got[2] == []
    assert [(q.value, q.type) for q in got[3]] == [("at 2", "percentage")]
    assert got[4] == [] and got[5] == []


@pytest.mark.parametrize("rules", [*P.QUANTITIES.values(), P.ENCRYPTION, P.AUTHENTICATION, P.NETWORK])
def test_rules_agree_with_python(spark, rules):
    rng = random.Random(5)
    parts = "daily every 30 days 24-hour sampled of 5 items TLS 1.3 TLS AES-256 ports 80 and 443 édes des password age at 7% percent over 1,000 users\nweekly".split(" ")
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(150)]
    want = [[m.group(0) for rule in rules for m in re.finditer(rule, t, re.I)] for t in texts]
    assert column(spark, texts, lambda c: P.hits(c, rules)) == want


def ratio(quote, text):
    norm = lambda s: re.sub(r"\s+", " ", s).strip().replace(" –", "–").replace("– ", "–")
    q, t = norm(quote), norm(text)
    if q in t:
        return 1.0
    words, done = q.lower().split(" "), 0
    for w in t.lower().split(" "):
        if done < len(words) and words[done] == w:
            done += 1
    return done / len(words)


def test_match_ratio(spark):
    rng = random.Random(3)
    pairs = [("", "a b"), ("a b", ""), ("b c", "a b c"), ("a x c", "A B c"), ("a –b", "a–b")]
    pairs += [(" ".join(rng.choices("a b c d".split(), k=rng.randrange(1, 6))), " ".join(rng.choices("a b c  D".split(" "), k=rng.randrange(0, 9)))) for _ in range(200)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, q string, t string")
    got = [r[0] for r in df.select(T.match_ratio(F.col("q"), F.col("t")), "id").orderBy("id").collect()]
    assert got == pytest.approx([ratio(*p) for p in pairs])


def test_line_ranges(spark):
    got = column(spark, ["Lines 3-9", "Line 4", "Page 3", "Lines 9-4", "Lines 10-12-15", None, "", "lines 3", "LINES 3-4", " 7 - 8 "], T.parse_line_range)
    assert [g and tuple(g) for g in got] == [(3, 9), (4, 4), None, (9, 4), None, None, None, None, None, (7, 8)]


def test_specificity(spark):
    rows = [
        ("Policies exist", None, None, None), ("Uses TLS 1.3", ["TLS 1.3"], None, None),
        ("CISO reviews daily", ["x"], ["daily"], ("CISO", "daily", "tool")), ("staff reviews periodically", None, None, ("staff", None, None)),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, c string, e array<string>, v array<string>, d struct<who:string,when:string,how:string>")
    got = [r[0] for r in df.select(score.specificity_score(F.col("c"), F.col("e"), F.col("v"), F.col("d")), "id").orderBy("id").collect()]
    assert got == pytest.approx([0.3, 0.5, 1.0, 0.2])


def test_claims(spark):
    texts = ["No exceptions noted.", "Management reviews access daily.", "Senior management risk", "uses encryption with AES", "encryption is on"]
    assert column(spark, texts, score.is_test_result_only) == [True, False, False, False, False]
    assert column(spark, texts, score.contains_generic_terms) == [False, True, False, False, True]


def read_table(lines):
    """Control rows by one reading from the top, a line at a time."""
    lines = [x.strip() for x in lines]
    opens = lambda x: re.match(r"[A-Z]{2,3}\d+\.\d+\s", x)
    tests = lambda x: re.search(r"(?:inspected|observed|performed|conducted|reviewed|examined|validated|tested)\s", x, re.I)
    ends = lambda x: re.search(r"\bno\s+exceptions?\s+noted\b", x, re.I)
    at, found, n = 0, [], len(lines)
    while at < n:
        control = opens(lines[at])
        if not control and not tests(lines[at]):
            at += 1
            continue
        test = at
        if control:
            test = at + 1
            while test < n and not tests(lines[test]):
                test += 1
        stop = test
        while stop < n and not ends(lines[stop]):
            stop += 1
        stop = min(n, stop + 1)
        begin, described = at, lines[at:test]
        if not control:
            described = []
            while begin > 0 and len(described) < 6 and not ends(lines[begin - 1]):
                begin -= 1
                described = [lines[begin], *described] if lines[begin] else described
        tested = " ".join(lines[test:stop])
        if described and tested:
            verdict = "No Exceptions Noted" if "No Exception" in tested else "Unknown"
            found.append((lines[at].split()[0] if control else None, " ".join(described), tested, verdict, begin, stop))
        at = stop
    return found


def control_rows(spark, tables, **more):
    df = spark.createDataFrame([(i, None if t is None else "\n".join(t)) for i, t in enumerate(tables)], "at int, chunk_text string")
    got = [[] for _ in tables]
    for r in extract.control_rows(df, "at", **more).orderBy("at", "start_line").collect():
        got[r.at].append(tuple(r)[1:])
    return got


def test_control_rows(spark):
    table = ["CC1.2 Access is reviewed", "quarterly by the CISO.", "Inspected the reviews", "for 25 users", "No Exceptions Noted", "", "Backups run", "Observed the backups", "No Exception Noted"]
    gap = ["Desc of the control.", "", "Inspected the thing", "No Exceptions Noted"]
    rows, other, *none = control_rows(spark, [table, gap, [], [""], None, ["Inspected at once"], ["CC1.1 without test"]])
    assert rows[0] == ("CC1.2", "CC1.2 Access is reviewed quarterly by the CISO.", "Inspected the reviews for 25 users No Exceptions Noted", "No Exceptions Noted", 0, 5)
    assert rows[1] == (None, "Backups run", "Observed the backups No Exception Noted", "No Exceptions Noted", 5, 9)
    assert other == [(None, "Desc of the control.", "Inspected the thing No Exceptions Noted", "No Exceptions Noted", 0, 4)]
    assert none == [[]] * 5
    assert control_rows(spark, [gap], first_line=11)[0][0][4:] == (11, 15)


def test_control_rows_equal_a_reading(spark):
    rng = random.Random(8)
    kinds = ["CC6.1 control", "CC6.1 Inspected twice", "plain text", "", "  ", "was Inspected by", "tested it No Exceptions Noted", "no exception noted", "more words", "PI1.2", "\tReviewed the list "]
    tables = [[rng.choice(kinds) + (f" {i}" if rng.random() < 0.4 else "") for i in range(rng.randrange(0, 30))] for _ in range(300)]
    assert control_rows(spark, tables) == [read_table(t) for t in tables]


def test_control_facts(spark):
    table = ["CC1.2 The Security Team and CISO review TLS 1.3 daily", "Inspected that sampled 5 items hold", "No Exceptions Noted"]
    df = spark.createDataFrame([("\n".join(table),)], "chunk_text string")
    got = extract.control_facts(extract.control_rows(df, first_line=7)).collect()
    assert [(r.claim, r.fact_type, r.quantitative_values, r.entities, r.process_details and r.process_details.who) for r in got] == [
        (table[0], "technical_control", None, None, None), ("Control performed daily", "process", ["daily"], None, None),
        ("Security Team is responsible for control execution", "organizational", None, None, "Security Team"), ("CISO is responsible for control execution", "organizational", None, None, "CISO"),
        ("System uses TLS 1.3", "technical_control", None, ["TLS 1.3"], None), ("Auditor tested sampled 5 items", "test_result", ["sampled 5 items"], None, None),
    ]
    assert {r.source_location for r in got} == {"Lines 7-10"} and got[-1].evidence_quote == " ".join(table[1:])


def test_frequency_names(spark):
    said = ["Every Day", "real-time", "continuously", "every 30 days", "on a yearly basis", "semi-annually", "every quarter", None]
    assert column(spark, said, P.normalize_frequency) == ["daily", "continuous", "continuous", "every 30 days", "annually", "annually", "quarterly", None]


def test_entities_of_a_context(spark):
    got = column(spark, ["The TLS Gateway and OpenSSL run on Big  Iron", "no names", None], T.context_entities)
    assert got == [["Big  Iron", "OpenSSL", "The TLS Gateway"], [], None]


@pytest.mark.parametrize(
    ("value", "kind", "claim", "same"),
    [
        ("99.95%", "percentage", "uptime of 99% is met", False), ("99.95%", "percentage", "99.95 percent uptime", True), ("90%", "percentage", "above 90.0% of", True),
        ("90-day period", "duration", "a three month window", False), ("90 days", "duration", "a three month window", True), ("90 days", "duration", "a ninety-day window", True),
        ("90 days", "duration", "kept ninety days", True), ("5 hours", "duration", "a 5-hour limit", True), ("5+ users", "count", "has 5 percent", True),
        ("quarterly", "frequency", "reviewed every 3 months", True), ("quarterly", "frequency", "reviewed every month", False), ("daily", "frequency", "Runs DAILY", True),
        ("sampled 5 items", "sample_size", "5 items sampled", False),
    ],
)
def test_quantities_in_claims(spark, value, kind, claim, same):
    row = spark.createDataFrame([(value, kind, claim)], "v string, k string, c string")
    assert row.select(score.qv_matches_claim(F.col("v"), F.col("k"), F.col("c"))).first()[0] is same


def test_cleaning_and_citations(spark):
    dirty = "a\n\n  Toc ........................ 4\nb ========== c\nx #\n"
    assert column(spark, [dirty, "", None], T.clean_ocr_text) == ["a\nb --- c\nx ", "", None]
    assert column(spark, ["[Fact 2] so [Fact 1], [Fact 2]", "none"], T.question_citations) == [["2", "1"], []]
