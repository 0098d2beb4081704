"""Similar facts and their groups against brute-force cosine."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions.measures import measure
from factloom.operators import consensus, cosine

SCHEMA = "vec_id long, embedding array<float>, label int"


def close(rows, least):
    """Pairs by hand, as {(a, b): cosine}."""
    out = {}
    for n, (a, x, p) in enumerate(rows):
        for b, y, q in rows[:n]:
            if p == q and len(x) == len(y):
                x64, y64 = np.array(x, np.float64), np.array(y, np.float64)
                c = x64 @ y64 / (np.sqrt(x64 @ x64) * np.sqrt(y64 @ y64))
                if c >= least:
                    out[min(a, b), max(a, b)] = c
    return out


def groups(ids, pairs):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


def vectors():
    """Mostly one label: loose pairs near the bound, tight groups far apart, equal ones, another width."""
    rng = np.random.default_rng(8)
    rows = [rng.standard_normal(16) for _ in range(150)]
    rows += [c + 0.1 * rng.standard_normal(16) for c in 4 * rng.standard_normal((6, 16)) for _ in range(20)]
    rows += [rows[0]] * 30
    out = [(int(i), np.float32(x).tolist(), int(k % 7 == 0)) for k, (i, x) in enumerate(zip(rng.permutation(1000), rows))]
    return out + [(2000 + i, np.float32(rng.standard_normal(3)).tolist(), 0) for i in range(20)]


@pytest.mark.parametrize("least", [0.4, 0.85])
def test_similar_facts_equal_brute_force(spark, least):
    rows = vectors()
    odd = [(5000, None, 0), (5001, [0.0] * 16, 0), (5002, [float("nan")] * 16, 0), (5003, [None] * 16, 0), (5004, [1.0] * 16, None), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    want = close(rows, least)
    assert len(want) > 100
    got = consensus.similar_facts(df, least).collect()
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == set(want)
    assert all(abs(r.cosine - want[r.a, r.b]) < 1e-12 for r in got)

    ids = [i for i, _, _ in rows + odd if i is not None]
    nodes = spark.createDataFrame([(i,) for i in ids], "node long")
    found = {r.node: r.cluster for r in consensus.fact_clusters(consensus.similar_links(df, least), nodes).collect()}
    assert found == groups(ids, want)


def test_small_tiles_lose_no_pair(spark):
    rows = vectors()
    known = cosine.usable(spark.createDataFrame(rows, SCHEMA)).dropDuplicates(["key"])
    id_of = {r.key: r.vec_id for r in known.select("key", "vec_id").collect()}
    distinct = [r for r in rows if r[0] in set(id_of.values())]
    got = [tuple(sorted((id_of[r.key_a], id_of[r.key_b]))) for r in cosine.close_vectors(known, 0.4, tile_rows=16).collect()]
    assert len(got) == len(set(got)) and set(got) == set(close(distinct, 0.4))


def test_semantic_dedup_equals_brute_force(spark):
    """Chains of near copies, equal claims, ties, null claims, confidences and documents, against all pairs by hand."""
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(30)]
    rows = []
    for _ in range(12):
        claim = list(rng.choice(vocabulary, 12))
        for _ in range(8):
            claim = list(claim)
            claim[rng.integers(12)] = str(rng.choice(vocabulary))
            rows.append((int(rng.integers(3)), " ".join(claim).title() + ".", float(rng.integers(4)) / 4))
    rows += [(1, None, 0.5), (1, "", 0.7), (1, "...", 0.6), (None, "one two", 0.5), (None, "Two, one", None), (2, "lone", None)]
    rows = [(d, no, c, p) for no, (d, c, p) in enumerate(rows)]
    facts = spark.createDataFrame(rows, "doc_id int, fact_no int, claim string, confidence double")

    sets = {no: (d, frozenset(re.findall(r"\w+", (c or "").lower()))) for d, no, c, _ in rows}
    linked = lambda x, y: x == y or (x[0] == y[0] and 100 * len(x[1] & y[1]) >= 80 * len(x[1] | y[1]))
    root = groups(sets, [(a, b) for a in sets for b in sets if a < b and linked(sets[a], sets[b])])
    best = {}
    for _, no, _, p in rows:
        rank = (-1.0 if p is None else p, -no)
        best[root[no]] = max(best.get(root[no], rank), rank)
    got = consensus.semantic_dedup(facts)
    assert got.columns == facts.columns and len(best) < len(rows) - 20
    assert sorted(r.fact_no for r in got.collect()) == sorted(-no for _, no in best.values())
    assert consensus.semantic_dedup(facts.where("false")).count() == 0


@pytest.mark.parametrize(
    ("value", "kind", "want"),
    [
        ("every 30 days", "frequency", ("repeat", 720, 720)), ("Monthly", "frequency", ("repeat", 672, 744)), ("quarterly", "frequency", ("repeat", 2160, 2208)),
        ("semi-annually", "frequency", ("repeat", 4032, 4464)), ("2 times per day", "frequency", ("repeat", 12, 12)), ("at least 2 times per week", "frequency", ("repeat", 0, 84)),
        ("within 2 business days", "frequency", ("repeat", 0, 48)), ("real-time", "frequency", ("repeat", 0, 0)), ("upon request", "frequency", None),
        ("90-day retention", "duration", ("lasting", 2160, 2160)), ("1 month", "duration", ("lasting", 672, 744)), ("99.95%", "percentage", ("share", 99.95, 99.95)),
        ("less than 5%", "percentage", ("share", 0, 5)), ("over 1,200 users", "count", ("count", 1200, float("inf"))), ("100+ users", "count", ("count", 100, float("inf"))),
        ("sampled 25 items", "sample_size", ("count", 25, 25)), ("some", "other", None), (None, "count", None),
    ],
)
def test_quantities_have_a_scale(spark, value, kind, want):
    got = spark.createDataFrame([(value, kind)], "v string, k string").select(measure(F.col("v"), F.col("k")).alias("m")).first().m
    assert (got and tuple(got)) == want


def said(spark, claims):
    return spark.createDataFrame([(d, n, c) for n, (d, c) in enumerate(claims)], "doc_id int, fact_no int, claim string")


def test_contradictions(spark):
    claims = [
        (1, "The CISO reviews the firewall rules every 30 days"), (1, "The CISO reviews the firewall rules quarterly"), (1, "CISO reviews the firewall rules monthly"),
        (2, "Backups of all user data run monthly"), (2, "Backups of all user data run every 30 days"), (2, "Logs are kept for 90 days"), (2, "Logs are kept for 1 year"),
        (3, "Backups of all user data run daily"), (3, None), (3, ""), (4, "Uptime of 99 percent"), (4, "Uptime of 99.5 percent"), (4, "Uptime of 98 percent"),
    ]
    got = {(r.doc_id, r.scale): (r.facts, r.statements, r.low_value, r.high_value) for r in consensus.contradictions(said(spark, claims)).collect()}
    assert got == {
        (1, "repeat"): (3, 3, "every 30 days", "quarterly"), (2, "lasting"): (2, 2, "90 days", "1 year"), (4, "share"): (3, 3, "5 percent", "99 percent"),
    }


def test_related_facts_equal_a_search(spark):
    import random

    pick = random.Random(2)
    links = sorted({(d, pick.randrange(30), f"C{pick.randrange(25)}") for d in range(3) for _ in range(45)}) + [(9, k, "HOT") for k in range(200)]
    starts = [(d, n) for d in range(3) for n in (0, 1, 29)] + [(9, 5), (77, 1), (0, 0)]

    def reached(doc, start, hops):
        found, frontier = {start: 0}, {start}
        for hop in range(1, hops + 1):
            controls = {c for d, f, c in links if d == doc and f in frontier}
            frontier = {f for d, f, c in links if d == doc and c in controls} - set(found)
            found |= dict.fromkeys(frontier, hop)
        return found

    table = spark.createDataFrame(links, "doc_id int, fact_no int, control_id string")
    for hops in (0, 1, 3):
        got = consensus.related_facts(spark.createDataFrame(starts, "doc_id int, fact_no int"), table, hops).collect()
        want = {(d, s, f, h) for d, s in starts for f, h in reached(d, s, hops).items()}
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_medoids(spark):
    rows = [(1, [0.0, 1.0], 1), (2, [4.0, 1.0], 1), (3, [1.0, 1.0], 1), (4, [1.0, 1.0], 1), (5, [7.0, 7.0], 1), (6, None, 1), (7, [1.0, 2.0, 3.0], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    clusters = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (4, 10), (5, 20), (6, 20), (7, 10), (8, 30)], "node long, cluster long")
    got = {r.cluster: (r["size"], r.centroid, r.medoid, r.distance) for r in consensus.medoids(clusters, vectors).collect()}
    assert got == {10: (4, [1.5, 1.0], 3, 0.5), 20: (1, [7.0, 7.0], 5, 0.0)}
