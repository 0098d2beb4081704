"""Every query with an oracle equals it on the smallest tables; properties of chunks and quotas."""

import math

import duckdb
import pytest

import __spark_entry__
from factloom import catalog
from factloom.operators import chunks, quota, stats
from factloom.sources import fixtures

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    if isinstance(v, (bool, str)):
        return str(v)
    return f"{round(float(v), 6) + 0.0:.6f}"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = duck.execute(catalog.oracle_sql()[name])
    assert got == rows([c[0] for c in want.description], want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows_only(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("size,overlap", [(10, 2), (5, 0), (7, 6), (1000, 200)])
def test_chunks_cover_all_lines(spark, size, overlap):
    texts = ["\n".join(f"l{i}" for i in range(n)) for n in (1, 2, 4, 5, 6, 9, 10, 11, 18, 19, 40)] + ["", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "doc_id long, text string")
    got = {}
    for r in chunks.chunk_lines(docs, size, overlap).orderBy("doc_id", "chunk_id").collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(range(len(texts)))
    for doc, parts in got.items():
        lines = texts[doc].split("\n")
        assert parts[0].start_line == 1 and parts[-1].end_line == len(lines)
        for p in parts:
            assert p.chunk_text == "\n".join(lines[p.start_line - 1 : p.end_line])
        for a, b in zip(parts, parts[1:]):
            assert b.start_line == a.start_line + size - overlap and a.end_line < len(lines)


def test_quota_filter_reaches_its_target(spark):
    kept = quota.quota_filter(fixtures.facts(spark, SF), 0.6)
    assert all(r.coverage >= 0.6 for r in stats.qv_coverage(kept, "doc_id").collect() if r.coverage > 0)


def test_retro_tag_twice_adds_no_value(spark):
    once = quota.retro_tag_qv(fixtures.facts(spark, SF))
    twice = quota.retro_tag_qv(once)
    values = lambda df: {(r.doc_id, r.fact_no): set(r.quantitative_values or []) for r in df.select("doc_id", "fact_no", "quantitative_values").collect()}
    assert values(once) == values(twice)


@pytest.mark.parametrize("reach", [0, 5, 70])
def test_cited_lines_equal_slices(spark, reach):
    """Ranges within, across and beyond parts of a document; without location, end or document; repeated facts."""
    sizes = {1: 0, 2: 1, 3: chunks.PART, 4: chunks.PART + 1, 5: 3 * chunks.PART + 7}
    docs = spark.createDataFrame(
        [(d, [f"{d}:{i}" for i in range(1, n + 1)]) for d, n in sizes.items()] + [(6, None)], "doc_id int, lines array<string>"
    )
    spots = [(1, 1), (1, 500), (60, 70), (64, 64), (65, 65), (64, 129), (190, 260), (199, 199), (300, 310), (10, 5), (7, None), (None, None), (None, 3), (-4, 2)]
    cited = [(d, no, a, b) for d in (*sizes, 6, 7) for no, (a, b) in enumerate(spots)]
    facts = spark.createDataFrame(cited + cited[:20], "doc_id int, fact_no int, start_line int, end_line int")
    got = chunks.join_fact_lines(facts, docs, reach).collect()
    assert len(got) == len(cited) + 20
    for r in got:
        want = None
        if r.doc_id in sizes and r.start_line is not None:
            last = r.start_line if r.end_line is None else r.end_line
            numbers = range(max(1, r.start_line - reach), min(sizes[r.doc_id], last + reach) + 1)
            want = "\n".join(f"{r.doc_id}:{i}" for i in numbers)
        assert r.cited_text == want, r
