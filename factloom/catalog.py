"""Registered queries of the fact engine and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import oracles as O
from factloom.functions import patterns as P
from factloom.functions import text as T
from factloom.operators import chunks, consensus, extract, index, propose, qa, quota, score, stats, summary, validate
from factloom.oracles import fx, hits, joined
from factloom.plans import chains
from factloom.sources import facts_io, fixtures, versions
from factloom.streaming import ingest

_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that must return the same rows."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def bar(column) -> F.Column:
    return F.array_join(column, "|")


def pages_of(spark: SparkSession, d: str) -> DataFrame:
    """Web pages as the pages of documents of up to fifty; every seventh page is the last of its document."""
    p = table(spark, d, "pages").where("page_id % 50 < 50 - page_id div 50 % 7")
    return p.select(F.expr("page_id div 50").alias("doc_id"), (F.col("page_id") % 50).alias("page_no"), F.col("html").alias("text"))


PAGES = "select page_id // 50 as doc_id, page_id % 50 as page_no, html as text from pages where page_id % 50 < 50 - page_id // 50 % 7"


# --- sources and sinks


@query("select doc_id, length(text) as chars, md5(text) as digest from documents")
def scan_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    "select doc_id, i as line_no, l[i] as line from (select doc_id, l, unnest(range(1, len(l) + 1)) as i"
    " from (select doc_id, string_split(text, chr(10)) as l from documents))"
)
def scan_lines(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(T.lines_of(F.col("text"))).alias("at", "line"))
    return rows.select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), "line")


@query(
    f"select doc_id, count(*) as pages, sum(length(text)) as total_chars,"
    f" md5(string_agg(text, chr(10) || chr(10) || '=== PAGE BREAK ===' || chr(10) || chr(10) order by page_no)) as digest from ({PAGES}) group by doc_id"
)
def assemble_pages(spark, d):
    rows = facts_io.assemble_pages(pages_of(spark, d))
    return rows.select("doc_id", "pages", "total_chars", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("select doc_id, length(trim(text)) < 50 as low_text from documents")
def page_low_text_flag(spark, d):
    return facts_io.page_low_text_flag(table(spark, d, "documents")).select("doc_id", "low_text")


@query(f"select doc_id, md5(text) as digest from ({PAGES}) where page_no = 1")
def page_select(spark, d):
    return facts_io.page_select(pages_of(spark, d), 1).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"select doc_id, count(*) as pages, sum(strlen(text)) as size, max(length(text)) as longest_page from ({PAGES}) group by doc_id")
def document_info(spark, d):
    return facts_io.document_info(pages_of(spark, d)).withColumn("longest_page", F.col("longest_page").cast("long"))


@query(
    f"select doc_id, count(*) as pages, sum(length(text)) as total_chars, sum(case when length(trim(text)) < 50 then 1 else 0 end) as low_text_pages"
    f" from ({PAGES}) group by doc_id"
)
def extraction_metadata(spark, d):
    return facts_io.extraction_metadata(pages_of(spark, d))


FACT_COLUMNS = ["claim", "source_doc", "source_location", "evidence_quote", "confidence", "fact_type"]


@query(fx("select source_doc as document, claim, source_location, evidence_quote, confidence, fact_type from fx_facts"))
def scan_facts_json(spark, d):
    rows = facts_io.scan_facts_json(facts_io.consolidate_facts(fixtures.facts(spark, d)))
    return rows.select("document", *[c for c in FACT_COLUMNS if c != "source_doc"])


@query(fx("select source_doc, count(*) as fact_count from fx_facts group by source_doc"))
def consolidate_facts(spark, d):
    return facts_io.consolidate_facts(fixtures.facts(spark, d)).select("source_doc", "fact_count")


def _raw_json(spark, d):
    """Facts as a model might answer: plain JSON, in a fence of either kind, or none at all."""
    rows = fixtures.facts(spark, d)
    body = F.to_json(F.struct("claim", "fact_no"))
    raw = F.expr("fact_no % 4")
    raw = F.when(raw == 0, body).when(raw == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).when(raw == 2, F.concat(F.lit("```\n"), body, F.lit("```"))).otherwise("sorry")
    return rows.select("doc_id", "fact_no", raw.alias("raw"))


@query(fx("select doc_id, fact_no, case when fact_no % 4 < 3 then claim end as claim from fx_facts"))
def parse_llm_json(spark, d):
    parsed = T.parse_llm_json(F.col("raw"), "claim string, fact_no int", "claim")
    return _raw_json(spark, d).select("doc_id", "fact_no", parsed["claim"].alias("claim"))


def _damaged(spark, d):
    claim = F.when(F.col("fact_no") % 10 != 0, F.col("claim"))
    confidence = F.when(F.col("fact_no") % 7 == 0, F.lit(1.5)).otherwise(F.col("confidence"))
    return fixtures.facts(spark, d).withColumns({"claim": claim, "confidence": confidence})


@query(fx("select doc_id, fact_no, case when fact_no % 10 = 0 then 'no claim' when fact_no % 7 = 0 then 'confidence not within 0 and 1' end as reason from fx_facts"))
def fact_schema_check(spark, d):
    valid, rejects = facts_io.fact_schema_check(_damaged(spark, d))
    return valid.select("doc_id", "fact_no", F.lit(None).cast("string").alias("reason")).union(rejects.select("doc_id", "fact_no", "reason"))


@query(fx(
    "select doc_id % 4 as kind, case doc_id % 4 when 1 then 'not JSON' when 2 then 'neither documents nor facts' end as reason, count(distinct doc_id) as texts, sum((doc_id % 4 in (0, 3))::int) as facts from fx_facts group by all"
))
def rejected_records(spark, d):
    """Fact texts of which some are cut off and some lack both forms: how many of each were read or rejected."""
    rows = facts_io.consolidate_facts(fixtures.facts(spark, d)).withColumn("doc_id", F.regexp_extract("source_doc", r"(\d+)", 1).cast("int"))
    flat = F.to_json(F.struct(F.map_values(F.from_json("json", facts_io.CONSOLIDATED)["documents"])[0]["facts"].alias("facts")))
    kind = F.col("doc_id") % 4
    told = F.when(kind == 1, F.expr("substr(json, 1, length(json) - 9)")).when(kind == 2, F.lit('{"session_id": "x"}')).when(kind == 3, flat).otherwise(F.col("json"))
    facts, rejects = facts_io.checked_facts_json(rows.select("doc_id", told.alias("json")))
    bad = rejects.select((F.col("doc_id") % 4).alias("kind"), "reason", F.lit(1).alias("texts"), F.lit(0).alias("facts"))
    number = F.regexp_extract("source_doc", r"(\d+)", 1).cast("int")
    good = facts.groupBy(number.alias("doc_id")).agg(F.count("*").alias("facts")).select((F.col("doc_id") % 4).alias("kind"), F.lit(None).cast("string").alias("reason"), F.lit(1).alias("texts"), "facts")
    return bad.union(good).groupBy("kind", "reason").agg(F.sum("texts").alias("texts"), F.sum("facts").alias("facts"))


def _stored(spark, d, twice=False):
    rows = fixtures.facts(spark, d).select("doc_id", "chunk_id", "fact_no", "claim")
    path = facts_io.scratch(spark, "facts")
    facts_io.sink_chunks(rows, path, "doc_id", "chunk_id")
    if twice:  # chunks that are written again don't double
        facts_io.sink_chunks(rows.where("chunk_id < 3"), path, "doc_id", "chunk_id")
    return path


@query(fx("select doc_id, chunk_id, fact_no, claim from fx_facts"))
def sink_chunk_facts(spark, d):
    return facts_io.load_all_facts(spark, _stored(spark, d))


@query(fx("select doc_id, chunk_id, fact_no, claim from fx_facts"))
def load_all_facts(spark, d):
    return facts_io.load_all_facts(spark, _stored(spark, d)).orderBy("doc_id", "chunk_id", "fact_no")


@query(fx("select doc_id, chunk_id, fact_no, claim from fx_facts"))
def resume_union(spark, d):
    return facts_io.load_all_facts(spark, _stored(spark, d, twice=True))


@query(fx("select doc_id, chunk_id, md5(chunk_text) as digest from fx_chunks"))
def sink_chunk_text(spark, d):
    path = facts_io.scratch(spark, "chunks")
    facts_io.sink_chunks(fixtures.chunks(spark, d), path, "doc_id")
    return facts_io.load_chunks(spark, path).select("doc_id", "chunk_id", F.md5(F.col("chunk_text").cast("binary")).alias("digest"))


SUMMARY = "select doc_id, cast(len(string_split(text, chr(10))) as int) as lines, cast(length(text) as int) as chars, string_split(text, chr(10))[1][:80] as title from documents"


@query(f"select doc_id, lines, chars, case when doc_id % 2 = 0 then 'new ' else '' end || title as title, case when doc_id % 2 = 0 then 2 else 1 end as version from ({SUMMARY})")
def sink_summary(spark, d):
    """Summaries of all documents; then those of every second one are replaced, and a later writer dies before it registers its own."""
    path = facts_io.scratch(spark, "summaries")
    rows = chains.summarize_documents(table(spark, d, "documents"))
    versions.replace_by_key(rows, path, "doc_id")
    versions.replace_by_key(rows.where("doc_id % 2 = 0").withColumn("title", F.concat(F.lit("new "), "title")), path, "doc_id")
    versions.stage(rows.where("doc_id % 3 = 0").withColumn("title", F.lit("lost")), path, "doc_id")
    read = versions.current(spark, path, "doc_id", "doc_id long, lines int, chars int, title string")
    return read.join(versions.registered(spark, path, "doc_id").select("doc_id", "version"), "doc_id")


@query(SUMMARY)
def outline_documents(spark, d):
    return chains.summarize_documents(table(spark, d, "documents"))


GAP = "' *\\| *|\\t+| {2,}'"
KIND_SQL = (
    r"regexp_matches(line, '(?i)[A-Z]{2,3}[0-9]+[.][0-9]+ |exceptions? noted|trust services')", r"regexp_matches(line, '(?i)vulnerabilit|severity|exploit|finding')",
    r"regexp_matches(line, '(?i)\b(must|shall|policy|policies)\b')", r"regexp_matches(line, '(?i)architecture|component|data flow|diagram')",
)
SHAPE_SQL = (r"regexp_matches(trim(line), '^\|? *[A-Z]{2,3}[0-9]+[.][0-9]+ ')", r"regexp_matches(line, '(?i)vulnerabilit|severity|exploit|finding')", r"regexp_matches(trim(line), '^([Ss]tep +)?[0-9]+[.)] ')")
REPORTS = (
    f"rep as (select doc_id, line_no, {fixtures.REPORT_LINE} as line from fx_lines),"
    " kinds as (select doc_id, count(*) as lines, sum(length(line)) as chars, " + ", ".join(f"sum(({x})::int) as k{i}" for i, x in enumerate(KIND_SQL)) + ", "
    + ", ".join(f"sum(({x})::int) as s{i}" for i, x in enumerate(SHAPE_SQL)) + ", "
    + ", ".join(f"sum(len({hits('line', rules)})) as q{i}" for i, rules in enumerate(P.QUANTITIES.values()))
    + r", min(list_min(y)) as y0, max(list_max(y)) as y1 from (select *, list_transform(regexp_extract_all(line, '\b((?:19|20)[0-9]{2})\b', 1), lambda v: v::int) as y from rep) group by doc_id),"
    " heads as (select doc_id, line_no, trim(line) as h from rep where length(trim(line)) between 3 and 80 and not regexp_matches(trim(line), '[.!?;,]$')"
    " and (regexp_matches(trim(line), '^[0-9]+([.][0-9]+)*[.]? +[A-Z]') or regexp_matches(trim(line), '^[^a-z]*[A-Z]{2}[^a-z]*$') or regexp_matches(trim(line), '^[A-Z][A-Za-z]*( ([A-Z][A-Za-z]*|and|of|the|for|in|to))+$'))),"
    " listed as (select doc_id, list(h order by line_no)[1:12] as l, sum(regexp_matches(h, '(?i)system|overview|description|background')::int) as a, sum(regexp_matches(h, '(?i)control test|test|control activit')::int) as b,"
    " sum(regexp_matches(h, '(?i)user entity|complementary|customer responsib')::int) as c, sum(regexp_matches(h, '(?i)privacy|confidential')::int) as d, sum(regexp_matches(h, '(?i)finding|result|exception')::int) as e from heads group by doc_id),"
    rf" cell as (select doc_id, line_no, string_split_regex(regexp_replace(trim(line), '^\| *| *\|$', '', 'g'), {GAP}) as c from rep),"
    " paired as (select x.doc_id, x.line_no, x.c from cell x where len(x.c) > 1 and exists (select 1 from cell y where y.doc_id = x.doc_id and len(y.c) = len(x.c) and abs(y.line_no - x.line_no) = 1)),"
    " shaped as (select doc_id, len(c) as n, count(*) as k, min_by(c, line_no) as header from paired group by all), tabled as (select doc_id, max_by(header, [k, n]) as header, max(k) as k from shaped group by doc_id),"
    " word as (select doc_id, w, count(*) as tf from (select doc_id, unnest(regexp_split_to_array(lower(line), '[^a-z]+')) as w from rep) where length(w) >= 4 group by all),"
    " weighed as (select doc_id, w, round(tf * ln((select count(distinct doc_id) from rep) / df::double), 6) as s from word join (select w, count(*) as df from word group by w) using (w)),"
    " topic as (select doc_id, array_to_string(list(w order by s desc, w)[1:5], '|') as topics from weighed group by doc_id),"
    r" phrase as (select doc_id, p, count(*) as n from (select doc_id, unnest(list_distinct(regexp_extract_all(line, '\b[A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)*\b', 0))) as p from rep) where length(p) > 2 group by all),"
    " named as (select doc_id, array_to_string(list(p order by n desc, p)[1:8], '|') as entities from phrase group by doc_id)"
)
SUMMARIZED = (
    "select doc_id, case when greatest(k0, k1, k2, k3) = 0 then 'technical document' when k0 = greatest(k0, k1, k2, k3) then 'SOC 2 report' when k1 = greatest(k1, k2, k3) then 'penetration test report'"
    " when k2 >= k3 then 'security policy' else 'architecture document' end as document_type,"
    " case when greatest(s0, s1, s2) = 0 then 'descriptive' when s0 = greatest(s0, s1, s2) then 'claim-based' when s1 >= s2 then 'findings-based' else 'procedural' end as structural_pattern,"
    " concat_ws('|', case when a > 0 then 'System Description:' || a end, case when b > 0 then 'Control Testing:' || b end, case when c > 0 then 'CUEC:' || c end, case when d > 0 then 'Privacy:' || d end, case when e > 0 then 'Findings:' || e end) as section_types,"
    " array_to_string(l, '|') as section_headings, case when header is not null then len(header) || ':' || k || ':' || array_to_string(header, '|') end as table_structure,"
    " floor((q0 + q1 + q2 + q3 + q4) * 100 / lines)::int || ' quantities per 100 lines, most of them ' || case greatest(q0, q1, q2, q3, q4) when 0 then 'none' when q0 then 'frequency' when q1 then 'duration' when q2 then 'sample_size' when q3 then 'percentage' else 'count' end as fact_density_pattern,"
    " lines || ' lines, ' || chars || ' characters' || case when y0 is null then '' else ', years ' || y0 || ' to ' || y1 end as scope, topics, entities"
    " from kinds join listed using (doc_id) left join tabled using (doc_id) left join topic using (doc_id) left join named using (doc_id)"
)
GUIDED = (
    f"select *, case document_type when 'SOC 2 report' then 'controls, technologies, procedures, and who performs them, when and how' when 'penetration test report' then 'vulnerabilities, their severity, affected systems'"
    f" when 'security policy' then 'requirements, responsibilities, enforcement' when 'architecture document' then 'components, data flows, security measures' else 'quantities, technologies, roles' end as extraction_guidance from ({SUMMARIZED})"
)


def _flat_summary(rows):
    """A summary's lists as text."""
    table_text = F.concat_ws(":", F.col("table_structure.columns").cast("string"), F.col("table_structure.lines").cast("string"), bar(F.col("table_structure.header")))
    return rows.select(
        "doc_id", "document_type", "structural_pattern", bar(F.transform("section_types", lambda s: F.concat(s["section_type"], F.lit(":"), s["headings"].cast("string")))).alias("section_types"),
        bar(F.col("section_headings")).alias("section_headings"), F.when(F.col("table_structure").isNotNull(), table_text).alias("table_structure"), "fact_density_pattern", "scope",
        bar(F.col("primary_topics")).alias("topics"), bar(F.col("key_entities")).alias("entities"), "extraction_guidance",
    )


@query(fx(GUIDED, REPORTS))
def summarize_documents(spark, d):
    """All ten parts of a summary of every report."""
    return _flat_summary(summary.summarize(fixtures.report_lines(spark, d)))


# --- chunks and generators

CHUNKED = (
    "with n as (select doc_id, string_split(text, chr(10)) as l from documents), c as (select doc_id, l, unnest(range(0,"
    " case when len(l) <= 10 then 1 else cast(ceil((len(l) - 10) / 8.0) as int) + 1 end)) as chunk_id from n)"
    " select doc_id, cast(chunk_id as int) as chunk_id, cast(chunk_id * 8 + 1 as int) as start_line, cast(least(chunk_id * 8 + 10, len(l)) as int) as end_line,"
    " md5(array_to_string(list_slice(l, chunk_id * 8 + 1, chunk_id * 8 + 10), chr(10))) as digest from c"
)


def _chunked(spark, d):
    return chunks.chunk_lines(table(spark, d, "documents"), 10, 2)


def _digest(rows):
    return rows.withColumn("digest", F.md5(F.col("chunk_text").cast("binary"))).drop("chunk_text")


@query(CHUNKED)
def chunk_lines(spark, d):
    return _digest(_chunked(spark, d))


@query(f"select * from ({CHUNKED}) where chunk_id between 1 and 3")
def chunk_range(spark, d):
    return _digest(chunks.chunk_range(_chunked(spark, d), 1, 3))


@query(f"select * from ({CHUNKED}) join (select doc_id from documents where lang <> 'en') using (doc_id)")
def pending_chunks(spark, d):
    """The chunks that are left when those of English documents are done."""
    done = chunks.chunk_lines(table(spark, d, "documents").where("lang = 'en'"), 10, 2)
    return _digest(chunks.pending_chunks(_chunked(spark, d), done))


@query(fx(
    "select doc_id, line_no, cast(i - 1 as int) as qv_ord, q[i].value as value, q[i].type as type, case when q[i].type = 'frequency' then "
    f"{O.normalized('q[i].value')} end as normalized from (select doc_id, line_no, q, unnest(range(1, len(q) + 1)) as i from"
    f" (select doc_id, line_no, {O.quantities('line')} as q from fx_lines))"
))
def quantitative_values(spark, d):
    return extract.quantitative_values(fixtures.lines(spark, d), "line", "doc_id", "line_no")


def _family(name: str, rules: list[str], distinct: bool = False):
    items = hits("line", rules)
    items = O.first_seen(items) if distinct else items

    def run(spark, d):
        found = (P.distinct_hits if distinct else P.hits)(F.col("line"), rules)
        return fixtures.lines(spark, d).select("doc_id", "line_no", bar(found).alias("found"))

    run.__name__ = name
    query(fx(f"select doc_id, line_no, coalesce({joined(items)}, '') as found from fx_lines"))(run)


for _name, _rules in (("frequencies", P.FREQUENCY), ("durations", P.DURATION), ("sample_sizes", P.SAMPLE), ("percentages", P.PERCENTAGE), ("counts", P.COUNT)):
    _family(f"extract_{_name}", _rules)
for _name, _rules in (("encryption_specs", P.ENCRYPTION), ("authentication_specs", P.AUTHENTICATION), ("network_specs", P.NETWORK), ("roles", P.ROLES)):
    _family(f"extract_{_name}", _rules, distinct=True)


@query(fx(f"select doc_id, line_no, {O.normalized('line')} as normalized from fx_lines"))
def normalize_frequency(spark, d):
    return fixtures.lines(spark, d).select("doc_id", "line_no", P.normalize_frequency(F.col("line")).alias("normalized"))


@query(fx("select * from ctl_rows", O.CONTROL))
def control_rows(spark, d):
    return extract.control_rows(fixtures.control_chunks(spark, d), "doc_id", "chunk_id")


@query(fx(f"select doc_id, chunk_id, control_id, 'Lines ' || start_line || '-' || end_line as source_location, claim, fact_type, value, md5(evidence_quote) as quote from ({O.control_facts()})", O.CONTROL))
def control_facts(spark, d):
    rows = extract.control_facts(extract.control_rows(fixtures.control_chunks(spark, d), "doc_id", "chunk_id"))
    return rows.select("doc_id", "chunk_id", "control_id", "source_location", "claim", "fact_type", "value", F.md5(F.col("evidence_quote").cast("binary")).alias("quote"))


# --- text functions


@query(f"select doc_id, md5(replace(replace({O.norm('text')}, ' –', '–'), '– ', '–')) as digest from documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalize_text(F.col("text")).cast("binary")).alias("digest"))


#: Places as facts give them: a range, a line, with other white space, of pages, in small letters, of three numbers.
TOLD = (
    "case fact_no % 6 when 0 then source_location when 1 then 'Line ' || cast(start_line as varchar(20)) when 2 then '  ' || replace(source_location, '-', ' - ')"
    " when 3 then replace(source_location, 'Lines', 'Pages') when 4 then lower(source_location) else source_location || '-7' end"
)


@query(fx("select doc_id, fact_no, case when fact_no % 6 < 3 then start_line end as start_line, case fact_no % 6 when 0 then end_line when 1 then start_line when 2 then end_line end as end_line from fx_facts"))
def parse_line_range(spark, d):
    return fixtures.facts(spark, d).select("doc_id", "fact_no", T.parse_line_range(F.expr(TOLD)).alias("r")).select("doc_id", "fact_no", "r.*")


@query(fx("select doc_id, fact_no, case when fact_no % 6 in (0, 1, 2, 5) then start_line end as start_line, case when fact_no % 6 in (0, 5) then end_line when fact_no % 6 in (1, 2) then start_line end as end_line from fx_facts"))
def parse_line_range_loose(spark, d):
    told = F.concat(F.lit("see "), F.expr(TOLD), F.lit(" of the report"))
    return fixtures.facts(spark, d).select("doc_id", "fact_no", T.parse_line_range_loose(told).alias("r")).select("doc_id", "fact_no", "r.*")


@query(fx(f"select doc_id, fact_no, round({O.ratio('evidence_quote', 'claim')}, 6) as ratio from fx_facts"))
def quote_match(spark, d):
    ratio = T.match_ratio(F.col("evidence_quote"), F.col("claim"))
    return fixtures.facts(spark, d).select("doc_id", "fact_no", F.round(ratio, 6).alias("ratio"))


@query(
    "select doc_id, md5(array_to_string(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' and not"
    " (length(x) - length(replace(x, '.', '')) > 20 and length(trim(replace(x, '.', ''))) < 10)), lambda x: regexp_replace(regexp_replace(regexp_replace(x,"
    " '[.:]{10,}', ' ... ', 'g'), '[=-]{5,}', '---', 'g'), '[@#$%^&*](\\s|$)', '\\1', 'g')), chr(10))) as digest from documents"
)
def clean_ocr_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.clean_ocr_text(F.col("text")).cast("binary")).alias("digest"))


def _answers(spark, d):
    """Texts that cite facts: of each document's chunk, its first fact twice and one that isn't there."""
    rows = fixtures.facts(spark, d).groupBy("doc_id").agg(F.min("fact_no").alias("lo"), F.max("fact_no").alias("hi"))
    mark = lambda c: F.concat(F.lit("[Fact "), c.cast("string"), F.lit("]"))
    text = F.concat_ws(" so ", mark(F.col("hi")), mark(F.col("lo")), mark(F.col("hi")), F.lit("[Fact 999999]"))
    return rows.select("doc_id", text.alias("answer"))


@query(fx("select doc_id, max(fact_no) || '|' || min(fact_no) || '|999999' as cited from fx_facts group by doc_id having min(fact_no) < max(fact_no)"))
def question_citations(spark, d):
    rows = _answers(spark, d).select("doc_id", T.question_citations(F.col("answer")).alias("c")).where("size(c) = 3")
    return rows.select("doc_id", bar(F.col("c")).alias("cited"))


@query(
    "select doc_id, array_to_string(list_slice(list_sort(list_distinct(list_filter(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g'),"
    " '\\b[A-Z][A-Za-z]+(?:\\s+[A-Z][A-Za-z]+)*\\b', 0), lambda x: length(x) > 2))), 1, 5), '|') as entities from documents"
)
def context_entities(spark, d):
    return table(spark, d, "documents").select("doc_id", bar(T.context_entities(F.col("text"))).alias("entities"))


@query(fx(
    "select f.doc_id, f.fact_no, substr(trim(regexp_replace(regexp_extract(c.chunk_text, '(?is).{0,200}' || f.qv || '.{0,200}', 0), '\\s+', ' ', 'g')), 1, 250) as context"
    " from fx_facts f join fx_chunks c using (doc_id, chunk_id) where f.qv is not null"
))
def qv_context(spark, d):
    rows = fixtures.facts(spark, d).where("qv is not null").join(fixtures.chunks(spark, d), ["doc_id", "chunk_id"])
    return rows.select("doc_id", "fact_no", F.substring(T.quantity_context(F.col("qv"), F.col("chunk_text")), 1, 250).alias("context"))


# --- predicates, enrichment and scores


def _fact(expr, name):
    return lambda spark, d: fixtures.facts(spark, d).select("doc_id", "fact_no", expr().alias(name))


@query(fx(f"select doc_id, fact_no, {O.PURE} as test_only from (select * replace (case when fact_no % 3 = 0 then 'No exceptions were noted.' else claim end as claim) from fx_facts)"))
def is_test_result_only(spark, d):
    claim = F.when(F.col("fact_no") % 3 == 0, "No exceptions were noted.").otherwise(F.col("claim"))
    return fixtures.facts(spark, d).select("doc_id", "fact_no", score.is_test_result_only(claim).alias("test_only"))


@query(fx(f"select doc_id, fact_no, {O.GENERIC} as generic from fx_facts"))
def contains_generic_terms(spark, d):
    return fixtures.facts(spark, d).select("doc_id", "fact_no", score.contains_generic_terms(F.col("claim")).alias("generic"))


@query(fx(
    "select doc_id, fact_no, coalesce(nullif(concat_ws('; ', case when regexp_matches(lower(claim), '\\bit (staff|personnel)\\b') then '''IT staff'' → specify team (Security team, Operations team, etc.)' end,"
    " case when regexp_matches(lower(claim), '\\bmanagement\\b') then '''management'' → specify role (Security Manager, CISO, etc.)' end,"
    " case when regexp_matches(lower(claim), '\\b(periodic|periodically|regular|regularly|ongoing)\\b') then '''periodic/regular/ongoing'' → specify frequency (daily, weekly, monthly, etc.)' end), ''), 'Unspecified generic terms') as advice from fx_facts"
))
def generic_term_feedback(spark, d):
    return fixtures.facts(spark, d).select("doc_id", "fact_no", score.generic_term_feedback(F.col("claim")).alias("advice"))


@query(fx(f"select f.doc_id, f.fact_no, q.qv_ord, {O.QV_MATCH} as matches from fx_facts f join chunk_qv q using (doc_id, chunk_id)", O.CHUNK_QV))
def qv_matches_claim(spark, d):
    values = quota.chunk_quantities(fixtures.chunks(spark, d))
    rows = fixtures.facts(spark, d).join(values, ["doc_id", "chunk_id"])
    return rows.select("doc_id", "fact_no", "qv_ord", score.qv_matches_claim(F.col("value"), F.col("type"), F.col("claim")).alias("matches"))


@query(fx(f"select doc_id, fact_no, round({O.SPECIFICITY}, 6) as score from fx_facts"))
def specificity_score(spark, d):
    s = score.specificity_score(F.col("claim"), F.col("entities"), F.col("quantitative_values"), F.col("process_details"))
    return fixtures.facts(spark, d).select("doc_id", "fact_no", F.round(s, 6).alias("score"))


RESCORED = f"case when specificity_score is null or abs(specificity_score - {O.SPECIFICITY}) > 0.1 then {O.SPECIFICITY} else specificity_score end"


@query(fx(f"select doc_id, fact_no, round({RESCORED}, 6) as score from fx_facts"))
def rescore_specificity(spark, d):
    return score.rescore_specificity(fixtures.facts(spark, d)).select("doc_id", "fact_no", F.round("specificity_score", 6).alias("score"))


def _in_chunk(spark, d):
    text = F.col("chunk_text")
    specs = F.array_distinct(F.concat(*(P.hits(text, r) for r in (P.ENCRYPTION, P.AUTHENTICATION, P.NETWORK))))
    found = fixtures.chunks(spark, d).select("doc_id", "chunk_id", specs.alias("specs"), P.distinct_hits(text, P.ROLES).alias("roles"), F.array_distinct(P.quantities(text)).alias("chunk_values"))
    return fixtures.facts(spark, d).join(found, ["doc_id", "chunk_id"])


SPECS = P.ENCRYPTION + P.AUTHENTICATION + P.NETWORK


@query(fx(
    f"select f.doc_id, f.fact_no, {joined('list_sort(list_distinct(list_concat(case when entity is null then [] else [entity] end, list_filter(' + hits('chunk_text', SPECS) + ', lambda x: contains(lower(claim), lower(x))))))')} as entities"
    " from fx_facts f join fx_chunks using (doc_id, chunk_id)"
))
def enrich_entities(spark, d):
    return score.enrich_entities(_in_chunk(spark, d)).select("doc_id", "fact_no", bar(F.array_sort("entities")).alias("entities"))


@query(fx(
    f"select f.doc_id, f.fact_no, coalesce(who, list_filter({O.first_seen(hits('chunk_text', P.ROLES))}, lambda x: contains(lower(claim), lower(x)))[1]) as who"
    " from fx_facts f join fx_chunks using (doc_id, chunk_id)"
))
def enrich_role(spark, d):
    return score.enrich_role(_in_chunk(spark, d)).select("doc_id", "fact_no", F.col("process_details.who").alias("who"))


TAGGED = (
    "tagged as (select f.doc_id, f.fact_no, list_sort(list_distinct(list_concat(case when any_value(f.qv) is null then [] else [any_value(f.qv)] end,"
    f" coalesce(list(q.value) filter (where {O.QV_MATCH}), [])))) as l from fx_facts f left join chunk_qv q using (doc_id, chunk_id) group by f.doc_id, f.fact_no)"
)


@query(fx(f"select doc_id, fact_no, {joined('l')} as found from tagged", O.CHUNK_QV, TAGGED))
def tag_quantitative(spark, d):
    return score.tag_quantitative(_in_chunk(spark, d)).select("doc_id", "fact_no", bar(F.array_sort("quantitative_values")).alias("found"))


@query(_ORACLES["tag_quantitative"])
def join_claim_qv(spark, d):
    return tag_quantitative(spark, d)


@query(fx(f"select doc_id, fact_no, round(case when qv is null and ({O.GENERIC}) then greatest(0.3, confidence - 0.3) else confidence end, 6) as confidence from fx_facts where qv is not null or not ({O.PURE})"))
def filter_low_value(spark, d):
    return score.filter_low_value(fixtures.facts(spark, d))[0].select("doc_id", "fact_no", F.round("confidence", 6).alias("confidence"))


@query(fx("select doc_id, fact_no from fx_facts where coalesce(specificity_score, 0.0) >= 0.5 or qv is not null"))
def filter_low_specificity(spark, d):
    return score.filter_low_specificity(fixtures.facts(spark, d)).select("doc_id", "fact_no")


SECTIONS = {"Encryption": ["tls", "aes-256"], "Access": ["user", "access"], "Network": ["firewall"]}


@query(fx(
    "select doc_id, line_no, case when contains(lower(line), 'tls') or contains(lower(line), 'aes-256') then 'Encryption' when contains(lower(line), 'user') or contains(lower(line), 'access')"
    " then 'Access' when contains(lower(line), 'firewall') then 'Network' else 'Unknown' end as section from fx_lines"
))
def detect_section(spark, d):
    return extract.detect_section(fixtures.lines(spark, d), SECTIONS, "line").select("doc_id", "line_no", "section")


@query(fx("select doc_id, fact_no, 1 as quotes, evidence_quote as primary_quote from fx_facts"))
def evidence_normalize(spark, d):
    bare = fixtures.facts(spark, d).withColumn("evidence_quotes", F.when(F.col("fact_no") % 2 == 0, F.col("evidence_quotes")))
    return score.evidence_normalize(bare).select("doc_id", "fact_no", F.size("all_quotes").alias("quotes"), "primary_quote")


RETRO = (
    f"retro as (select doc_id, fact_no, list_concat(case when qv is null then [] else [qv] end, list_filter(list_transform({O.quantities('claim')}, lambda x: x.value), lambda x: qv is null or x <> qv)) as l from fx_facts)"
)


@query(fx(f"select doc_id, fact_no, nullif({joined('l')}, '') as found from retro", RETRO))
def retro_tag_qv(spark, d):
    return quota.retro_tag_qv(fixtures.facts(spark, d)).select("doc_id", "fact_no", bar(F.col("quantitative_values")).alias("found"))


@query(fx(f"select doc_id, fact_no, {joined('l')} as found from (select doc_id, fact_no, list_filter(list_transform({O.quantities('claim')}, lambda x: x.value), lambda x: qv is null or x <> qv) as l from fx_facts)"))
def values_minus(spark, d):
    return quota.values_minus(fixtures.facts(spark, d)).select("doc_id", "fact_no", bar(F.col("fresh")).alias("found"))


@query(fx("select doc_id, fact_no, coalesce(concat_ws('|', qv, 'daily'), 'daily') as found from (select doc_id, fact_no, nullif(qv, 'daily') as qv from fx_facts)"))
def values_union(spark, d):
    both = F.array_union(F.array_remove(F.coalesce("quantitative_values", F.array().cast("array<string>")), "daily"), F.array(F.lit("daily")))
    return fixtures.facts(spark, d).select("doc_id", "fact_no", bar(both).alias("found"))


@query(fx(f"select doc_id, fact_no, round({O.QUALITY}, 6) as quality from fx_facts"))
def quality_score(spark, d):
    rows = fixtures.facts(spark, d)
    return rows.select("doc_id", "fact_no", F.round(score.quality_score(rows), 6).alias("quality"))


def _claims(table: str) -> str:
    return f"select doc_id, line_no, '{table}' as claims, value, type, unnest({O.claim(table, 'lower(line)')}) from line_qv"


LINE_QV = f"line_qv as (select doc_id, line_no, line, unnest({O.quantities('line')}, recursive := true) from fx_lines)"


@query(fx(" union all ".join(map(_claims, ("missing", "again", "document"))), LINE_QV))
def generate_fact_claim(spark, d):
    """What each of the three tables claims of a line's quantities."""
    lines = fixtures.lines(spark, d).withColumn("_noted", extract.noted(F.col("line")))
    rows = extract.quantitative_values(lines, "line", "doc_id", "line_no", "_noted")
    made = lambda t: F.struct(F.lit(t).alias("claims"), extract.generated_claim(F.col("type"), F.col("value"), F.col("_noted"), t).alias("m"))
    each = rows.select("doc_id", "line_no", "value", "type", F.explode(F.array(*map(made, ("missing", "again", "document")))).alias("c"))
    return each.select("doc_id", "line_no", "c.claims", "value", "type", "c.m.*")


@query(fx(
    f"select doc_id, chunk_id, cast(i - 1 as int) as qv_ord, value, type, ({O.claim('missing', 'lower(chunk_text)')}).claim as claim from (select doc_id, chunk_id, chunk_text, i, q[i].value as value, q[i].type as type from"
    f" (select *, unnest(range(1, len(q) + 1)) as i from (select *, {O.quantities('chunk_text')} as q from ctl_chunks)))"
    f" union all select doc_id, chunk_id, null, value, null, claim from ({O.control_facts()})", O.CONTROL
))
def extract_facts(spark, d):
    return chains.extract_facts(fixtures.control_chunks(spark, d)).drop("fact_type")


@query(fx(
    "select doc_id, line_no, 'quantitative' as pass_type from fx_lines where len(" + O.quantities("line") + ") > 0 union all"
    " select doc_id, line_no, 'technical_specs' from fx_lines where len(" + hits("line", SPECS) + ") > 0"
))
def specialized_pass(spark, d):
    rows = fixtures.lines(spark, d)
    out = chains.specialized_passes(rows, ["quantitative", "technical_specs", "cuec", "test_procedures", "other"])
    return out.select("doc_id", "line_no", "pass_type")


#: Lines of which some speak of customers' duties or of tests.
SPECIAL = "case when line_no % 19 = 0 then '  By inspection and inquiry, sampled 5 items of ' || line when line_no % 23 = 0 then 'The user entity is responsible for ' || line else line end"


def _made_of(pass_type: str, where: str, claim: str, kind: str, items: str = "['']") -> str:
    return (
        f"select doc_id, line_no, '{pass_type}' as pass_type, {claim} as claim, {kind} as fact_type, 'Lines ' || line_no || '-' || line_no as source_location, trim(line) as evidence_quote"
        f" from (select *, unnest({items}) as x from special where {where})"
    )


QUANTITIES_OF = O.first_seen(O.quantities("line"))


@query(fx(
    f"select doc_id, line_no, 'quantitative' as pass_type, m.claim as claim, m.fact_type as fact_type, 'Lines ' || line_no || '-' || line_no as source_location, trim(line) as evidence_quote, value as held"
    f" from (select *, {O.claim('missing', 'lower(line)')} as m from (select doc_id, line_no, line, unnest({QUANTITIES_OF}, recursive := true) from special))"
    f" union all select *, claim[13:] from ({' union all '.join(_made_of('technical_specs', 'true', chr(39) + 'System uses ' + chr(39) + ' || x', chr(39) + 'technical_control' + chr(39), O.first_seen(hits('line', r))) for r in (P.ENCRYPTION, P.AUTHENTICATION, P.NETWORK))})"
    f" union all select *, '' from ({_made_of('cuec', O.any_of('lower(line)', 'user entity', 'customer responsibility', 'complementary controls'), 'trim(line)', chr(39) + 'process' + chr(39))})"
    f" union all select *, array_to_string({O.first_seen(hits('evidence_quote', P.SAMPLE))}, '|') from ({_made_of('test_procedures', O.any_of('lower(line)', 'inspection', 'observation', 'inquiry', 're-performance'), 'trim(line)', chr(39) + 'test_result' + chr(39))})",
    f"special as (select doc_id, line_no, {SPECIAL} as line from fx_lines)",
))
def specialized_facts(spark, d):
    """The facts of all four passes."""
    rows = fixtures.lines(spark, d).select("doc_id", "line_no", F.expr(SPECIAL).alias("line"))
    out = chains.specialized_facts(rows, "quantitative")
    for name in ("technical_specs", "cuec", "test_procedures", "other"):
        out = out.unionByName(chains.specialized_facts(rows, name))
    held = F.coalesce(bar(F.col("quantitative_values")), bar(F.col("entities")), F.lit(""))
    return out.select("doc_id", "line_no", "pass_type", "claim", "fact_type", "source_location", "evidence_quote", held.alias("held"))


# --- validation


def _single_quotes(spark, d):
    """Facts of which a third have a single quote instead of a list."""
    return fixtures.facts(spark, d).withColumn("evidence_quotes", F.when(F.col("fact_no") % 3 != 0, F.col("evidence_quotes")))


def _validated(spark, d):
    return validate.validate_in_lines(_single_quotes(spark, d), fixtures.document_lines(spark, d))


@query(fx("select doc_id, fact_no, scope, scope is not null as is_valid from validated", O.VALIDATED))
def validate_in_lines(spark, d):
    return _validated(spark, d).select("doc_id", "fact_no", "scope", "is_valid")


STATS = "count(*) as total, sum(case when scope is not null then 1 else 0 end) as valid, sum(case when scope is null then 1 else 0 end) as invalid, round(avg(case when scope is not null then 1.0 else 0.0 end), 6) as rate"


@query(fx(f"select doc_id, {STATS} from validated group by doc_id", O.VALIDATED))
def validate_facts(spark, d):
    return validate.validation_stats(_validated(spark, d), "doc_id").withColumn("rate", F.round("rate", 6))


@query(fx(f"select {STATS} from validated", O.VALIDATED))
def validation_stats(spark, d):
    return validate.validation_stats(_validated(spark, d)).withColumn("rate", F.round("rate", 6))


@query(fx(f"select doc_id, chunk_id, {STATS} from validated group by doc_id, chunk_id", O.VALIDATED))
def validate_session(spark, d):
    return validate.validation_stats(_validated(spark, d), "doc_id", "chunk_id").withColumn("rate", F.round("rate", 6))


@query(fx("select doc_id, fact_no from validated where scope is null", O.VALIDATED))
def show_invalid_only(spark, d):
    return validate_in_lines(spark, d).where("not is_valid").select("doc_id", "fact_no")


@query(fx("select doc_id, fact_no, scope is not null as is_valid from validated", O.VALIDATED))
def rejected_split(spark, d):
    valid, rejected = qa.rejected_split(facts_io.stored(_validated(spark, d).select("doc_id", "fact_no", "is_valid"), "validated"))
    return valid.select("doc_id", "fact_no", "is_valid").union(rejected.select("doc_id", "fact_no", "is_valid"))


@query(fx("select scope is not null as is_valid, doc_id, count(*) as n from validated group by all", O.VALIDATED))
def write_validation_report(spark, d):
    path = facts_io.scratch(spark, "report")
    _validated(spark, d).select("doc_id", "fact_no", "scope", "is_valid").write.json(path)
    back = spark.read.schema("doc_id int, fact_no int, scope string, is_valid boolean").json(path)
    return back.groupBy("is_valid", "doc_id").agg(F.count("*").alias("n"))


IN_CHUNK = f"in_chunk as (select f.*, auto_generated or {O.ratio('evidence_quote', 'chunk_text')} >= 0.7 as is_valid from fx_facts f join fx_chunks using (doc_id, chunk_id))"


def _in_chunk_validated(spark, d):
    return validate.validate_in_chunk(chunks.join_fact_chunk(_single_quotes(spark, d), fixtures.chunks(spark, d)))


@query(fx("select doc_id, fact_no, is_valid from in_chunk", IN_CHUNK))
def validate_in_chunk(spark, d):
    return _in_chunk_validated(spark, d).select("doc_id", "fact_no", "is_valid")


@query(fx("select doc_id, fact_no, auto_generated or fact_no % 2 = 0 as is_valid from fx_facts"))
def skip_auto_generated(spark, d):
    return fixtures.facts(spark, d).select("doc_id", "fact_no", validate.skip_auto_generated(F.col("auto_generated"), F.col("fact_no") % 2 == 0).alias("is_valid"))


@query(fx("select doc_id, chunk_id, count(*) as extracted, sum(is_valid::int) as validated, count(*) - sum(is_valid::int) as rejected, round(avg(is_valid::int), 6) as rate from in_chunk group by rollup (doc_id, chunk_id) having doc_id is not null", IN_CHUNK))
def chunk_stats(spark, d):
    return stats.chunk_stats(_in_chunk_validated(spark, d)).withColumn("rate", F.round("rate", 6))


@query(fx(f"select * from (select v.doc_id, v.fact_no, round({O.ratio('v.evidence_quote', O.cited(5))}, 2) as best_match from validated v join fx_facts f using (doc_id, fact_no) join fx_docs d using (doc_id) where v.scope is null) where best_match >= 0.4 and best_match < 0.7", O.VALIDATED))
def medium_confidence(spark, d):
    rows = validate.medium_confidence(_single_quotes(spark, d), fixtures.document_lines(spark, d))
    return rows.select("doc_id", "fact_no", "best_match")


@query()
def propose_quotes(spark, d):
    """Verbatim texts for the quotes of all facts, from the 20 lines around their places."""
    rows = propose.propose_quotes(fixtures.facts(spark, d), fixtures.document_lines(spark, d), 20)
    return rows.withColumn("confidence", F.round("confidence", 6))


@query()
def recover_quote(spark, d):
    """Facts of medium confidence and the quotes that could be recovered for them."""
    docs = fixtures.document_lines(spark, d)
    return validate.recover_quotes(validate.medium_confidence(_single_quotes(spark, d), docs), docs)


def _rated(spark, d):
    """Facts with the share of their quote that their own place holds."""
    docs = fixtures.document_lines(spark, d)
    near = chunks.join_fact_lines(fixtures.facts(spark, d), docs, 5)
    return near.withColumn("match_percentage", T.match_ratio(F.col("evidence_quote"), F.col("cited_text"))).drop("cited_text"), docs


@query()
def correct_quotes(spark, d):
    """Quotes in place of those of rejected facts."""
    rows = validate.correct_facts(*_rated(spark, d))[0]
    return _rounded(rows, "match_percentage", "correction_confidence")


@query()
def correct_facts_from_file(spark, d):
    """Counts and rate of the rejected facts that could be corrected, by document."""
    return _rounded(validate.correct_facts(*_rated(spark, d))[1], "correction_rate")


@query(fx(f"select f.doc_id, f.fact_no, md5({O.cited(30)}) as digest from fx_facts f join fx_docs d using (doc_id)"))
def expand_context(spark, d):
    rows = chunks.join_fact_lines(fixtures.facts(spark, d), fixtures.document_lines(spark, d), 30)
    return rows.select("doc_id", "fact_no", F.md5(F.col("cited_text").cast("binary")).alias("digest"))


@query(fx("select doc_id, fact_no, case when fact_no % 2 = 0 then '1/1 quotes not found: ' || case when length(evidence_quote) > 60 then evidence_quote[:60] || '...' else evidence_quote end end as error from fx_facts"))
def quote_snippet(spark, d):
    quotes = F.transform("evidence_quotes", lambda q: q["quote"])
    failed = F.when(F.col("fact_no") % 2 == 0, 1).otherwise(0)
    return fixtures.facts(spark, d).select("doc_id", "fact_no", validate.error_text(quotes, failed).alias("error"))


# --- joins


@query(fx("select doc_id, fact_no, length(chunk_text) as chars from fx_facts join fx_chunks using (doc_id, chunk_id)"))
def join_fact_chunk(spark, d):
    rows = chunks.join_fact_chunk(fixtures.facts(spark, d), fixtures.chunks(spark, d))
    return rows.select("doc_id", "fact_no", F.length("chunk_text").cast("long").alias("chars"))


@query(fx(f"select f.doc_id, f.fact_no, {O.cited(0)} as cited_text from fx_facts f join fx_docs d using (doc_id)"))
def join_fact_lines(spark, d):
    return chunks.join_fact_lines(fixtures.facts(spark, d), fixtures.document_lines(spark, d)).select("doc_id", "fact_no", "cited_text")


def _sure_facts(spark, d):
    """An earlier, stricter run, to be compared with the whole one."""
    return fixtures.facts(spark, d).where("confidence >= 0.9")


SURE = "part as (select * from fx_facts where confidence >= 0.9)"
PART = "part as (select * from fx_facts)"
MISSING = (
    "missing as (select q.* from chunk_qv q where not exists (select 1 from part p where p.doc_id = q.doc_id and p.chunk_id = q.chunk_id and p.qv = q.value) and not contains(coalesce("
    "(select string_agg(lower(claim), ' ' order by fact_no) from part p where p.doc_id = q.doc_id and p.chunk_id = q.chunk_id), ''), lower(q.value)))"
)


@query(fx("select * exclude (has_context) from missing", O.CHUNK_QV, PART, MISSING))
def missing_qv(spark, d):
    rows = quota.missing_qv(quota.chunk_quantities(fixtures.chunks(spark, d)), fixtures.facts(spark, d))
    return rows.select("doc_id", "chunk_id", "qv_ord", "value", "type")


GLOBAL = "free as (select distinct doc_id, value, type from chunk_qv q where not exists (select 1 from part p where p.doc_id = q.doc_id and p.qv = q.value))"


@query(fx("select * from free", O.CHUNK_QV, PART, GLOBAL))
def global_missing_qv(spark, d):
    return quota.global_missing_qv(quota.chunk_quantities(fixtures.chunks(spark, d)), fixtures.facts(spark, d)).select("doc_id", "value", "type")


FIRST = (
    "firsts as (select doc_id, value, min(c.chunk_id) as chunk_id from (select distinct doc_id, value from chunk_qv) join fx_chunks c using (doc_id)"
    " where contains(lower(c.chunk_text), lower(value)) group by all)"
)


@query(fx("select * from firsts", O.CHUNK_QV, FIRST))
def first_chunk_with_qv(spark, d):
    rows = fixtures.chunks(spark, d)
    return quota.first_chunk_with_qv(quota.chunk_quantities(rows), rows)


@query(fx("select distinct value, type from chunk_qv", O.CHUNK_QV))
def distinct_values(spark, d):
    return quota.chunk_quantities(fixtures.chunks(spark, d)).select("value", "type").distinct()


@query(fx("select doc_id, hi as fact_no, 0 as position from (select doc_id, max(fact_no) hi, min(fact_no) lo from fx_facts group by 1) union all select doc_id, lo, 1 from (select doc_id, max(fact_no) hi, min(fact_no) lo from fx_facts group by 1) where lo < hi"))
def cited_facts(spark, d):
    return qa.cited_facts(_answers(spark, d), fixtures.facts(spark, d)).select("doc_id", "fact_no", "position")


@query(fx(f"select f.doc_id, f.fact_no, md5(nullif({O.cited(10)}, '')) as digest from fx_facts f join fx_docs d using (doc_id)"))
def facts_with_context(spark, d):
    rows = qa.facts_with_context(fixtures.facts(spark, d), fixtures.document_lines(spark, d))
    return rows.select("doc_id", "fact_no", F.md5(F.col("context").cast("binary")).alias("digest"))


@query(fx("select f.doc_id, f.fact_no, s.s_name as title from fx_facts f left join (select s_suppkey, s_name from supplier where s_acctbal > 0) s on s.s_suppkey = f.doc_id"))
def facts_with_summary(spark, d):
    names = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("doc_id"), F.col("s_name").alias("title"))
    return qa.facts_with_summary(fixtures.facts(spark, d), names).select("doc_id", "fact_no", "title")


# --- aggregates


@query(fx("select doc_id, chunk_id, round(avg(case when qv is null then 0.0 else 1.0 end), 6) as coverage from fx_facts group by all"))
def qv_coverage(spark, d):
    return stats.qv_coverage(fixtures.facts(spark, d), "doc_id", "chunk_id").withColumn("coverage", F.round("coverage", 6))


def _covered(name: str) -> str:
    found = f"len(list_filter({name}, lambda x: contains(coalesce(c, ''), lower(x))))"
    return f"len({name}) as {name}_total, {found} as {name}_extracted, round(case when len({name}) = 0 then 1.0 else {found} / cast(len({name}) as double) end, 6) as {name}_coverage"


SPEC_LISTS = " || ".join(O.first_seen(hits("chunk_text", r)) for r in (P.ENCRYPTION, P.AUTHENTICATION, P.NETWORK))


@query(fx(
    f"select doc_id, chunk_id, {_covered('quantitative')}, {_covered('specs')}, {_covered('roles')} from (select doc_id, chunk_id, list_transform({O.quantities('chunk_text')}, lambda x: x.value) as quantitative,"
    f" {SPEC_LISTS} as specs, {O.first_seen(hits('chunk_text', P.ROLES))} as roles from fx_chunks)"
    " left join (select doc_id, chunk_id, string_agg(lower(claim), ' ' order by fact_no) as c from fx_facts group by all) using (doc_id, chunk_id)"
))
def extraction_coverage(spark, d):
    text = F.col("chunk_text")
    values = {
        "quantitative": F.transform(P.quantities(text), lambda q: q["value"]),
        "specs": F.concat(*(P.distinct_hits(text, r) for r in (P.ENCRYPTION, P.AUTHENTICATION, P.NETWORK))),
        "roles": P.distinct_hits(text, P.ROLES),
    }
    rows = stats.extraction_coverage(fixtures.chunks(spark, d), fixtures.facts(spark, d), values)
    return _rounded(rows, *(f"{name}_coverage" for name in values))


@query(fx(f"select doc_id, count(*) as total, count(qv) as with_qv, sum(({O.PURE})::int) as test_only, sum(({O.GENERIC})::int) as generic, sum(coalesce(specificity_score >= 0.7, false)::int) as specific, round(avg(specificity_score), 6) as mean_specificity from fx_facts group by doc_id"))
def enhancement_stats(spark, d):
    return stats.enhancement_stats(fixtures.facts(spark, d), "doc_id").withColumn("mean_specificity", F.round("mean_specificity", 6))


PROFILE = (
    "count(*) as total, round(avg((qv is not null)::int), 6) as qv_share, round(avg((entity is not null)::int), 6) as entity_share, round(avg((who is not null)::int), 6) as process_share,"
    " sum((coalesce(specificity_score, 0) >= 0.7)::int) as high, sum((coalesce(specificity_score, 0) >= 0.5 and coalesce(specificity_score, 0) < 0.7)::int) as medium,"
    " sum((coalesce(specificity_score, 0) < 0.5)::int) as low, round(avg(coalesce(specificity_score, 0)), 6) as mean_specificity"
)


def _rounded(rows, *names):
    return rows.withColumns({n: F.round(n, 6) for n in names})


@query(fx(f"select doc_id, {PROFILE} from fx_facts group by doc_id"))
def fact_set_profile(spark, d):
    return _rounded(stats.fact_set_profile(fixtures.facts(spark, d), "doc_id"), "qv_share", "entity_share", "process_share", "mean_specificity")


@query(fx("select doc_id, round(coalesce(k, 0) / cast(n as double) * 100, 6) as density from (select doc_id, count(*) n from fx_lines group by 1) left join (select doc_id, count(*) k from fx_facts group by 1) using (doc_id)"))
def fact_density(spark, d):
    return _rounded(stats.fact_density(fixtures.facts(spark, d), fixtures.lines(spark, d)), "density")


@query(fx(
    f"select a.metric, round(b.v, 6) as before, round(a.v, 6) as after, round(a.v - b.v, 6) as delta, round((a.v - b.v) * 100 / b.v, 6) as change from"
    f" (unpivot (select total::double as total, qv_share::double as qv_share, entity_share::double as entity_share, process_share::double as process_share, mean_specificity::double as mean_specificity from (select {PROFILE.replace('round(', '(').replace(', 6)', ')')} from fx_facts)) on columns(*) into name metric value v) a join"
    f" (unpivot (select total::double as total, qv_share::double as qv_share, entity_share::double as entity_share, process_share::double as process_share, mean_specificity::double as mean_specificity from (select {PROFILE.replace('round(', '(').replace(', 6)', ')')} from part)) on columns(*) into name metric value v) b using (metric)", SURE
))
def compare_runs(spark, d):
    return _rounded(stats.compare_runs(_sure_facts(spark, d), fixtures.facts(spark, d)), "before", "after", "delta", "change")


@query(fx(
    "select doc_id, 'density' as metric, round(v, 6) as value, case when v between 8 and 12 then 'met' else 'missed' end as verdict from (select doc_id, count(*) n from fx_lines group by 1) join (select doc_id, count(*) k from fx_facts group by 1) using (doc_id), lateral (select k / n::double * 100 as v) union all"
    " select doc_id, metric, round(value, 6) as value, case when value >= target then 'met' when value >= near then 'close' else 'missed' end as verdict from (select doc_id, avg((qv is not null)::int) a, avg(coalesce(specificity_score, 0)) b, avg((entity is not null)::int) c, avg((who is not null)::int) e from fx_facts group by doc_id),"
    " lateral (values ('qv_share', a, 0.35, 0.30), ('mean_specificity', b, 0.70, 0.65), ('entity_share', c, 0.40, 0.35), ('process_share', e, 0.40, 0.35)) t(metric, value, target, near)"
))
def target_assessment(spark, d):
    return _rounded(stats.target_assessment(fixtures.facts(spark, d), fixtures.lines(spark, d), "doc_id"), "value")


@query(fx("select fact_type, count(*) as n from fx_facts group by fact_type"))
def facts_by_type(spark, d):
    return stats.facts_by_type(fixtures.facts(spark, d))


@query(fx("select doc_id, count(distinct chunk_id) as chunks, array_to_string(list_sort(list(distinct chunk_id)), '|') as processed, max(chunk_id) as last_chunk from fx_facts group by doc_id"))
def session_stats(spark, d):
    return stats.session_stats(fixtures.facts(spark, d)).withColumn("processed", bar(F.col("processed").cast("array<string>")))


@query(fx("select doc_id, min(chunk_id) as first_chunk, max(chunk_id) as last_chunk, count(*) as facts, doc_id in (select s_suppkey from supplier where s_acctbal > 0) as has_summary, max(chunk_id) + 1 as next_chunk from fx_facts group by doc_id"))
def session_info(spark, d):
    names = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").cast("int").alias("doc_id"))
    return stats.session_info(fixtures.facts(spark, d), names)


@query(fx("select count(*) as total, sum((fact_no % 3 <> 0)::int) as single, sum((fact_no % 3 = 0)::int) as multi, round(sum((fact_no % 3 = 0)::int) * 100.0 / count(*), 6) as multi_percent from fx_facts"))
def multi_quote_stats(spark, d):
    twice = F.when(F.col("fact_no") % 3 == 0, F.concat("evidence_quotes", "evidence_quotes")).otherwise(F.col("evidence_quotes"))
    return _rounded(stats.multi_quote_stats(fixtures.facts(spark, d).withColumn("evidence_quotes", twice)), "multi_percent")


@query(fx("select doc_id, count(*) as chunks, max(case when contains(chunk_text, 'within 24 hours') then chunk_id end) as last_chunk, round(avg((contains(chunk_text, 'within 24 hours'))::int), 6) as share from fx_chunks group by doc_id"))
def progress(spark, d):
    rows = fixtures.chunks(spark, d)
    return _rounded(stats.progress(rows, rows.where("contains(chunk_text, 'within 24 hours')")), "share")


@query(fx("select doc_id, round(avg(coalesce(specificity_score, 0)), 6) as average, round(avg((coalesce(specificity_score, 0) >= 0.7)::int), 6) as high_share from fx_facts group by doc_id"))
def specificity_distribution(spark, d):
    return _rounded(stats.specificity_distribution(fixtures.facts(spark, d), "doc_id"), "average", "high_share")


@query(fx("select doc_id, count(*) as fact_count from fx_facts group by rollup (doc_id)"))
def consolidated_totals(spark, d):
    return stats.consolidated_totals(fixtures.facts(spark, d))


@query(fx("select fact_type, count(*) as n, round(avg((qv is not null)::int), 6) as qv_share from fx_facts group by rollup (fact_type)"))
def knowledge_stats(spark, d):
    return _rounded(stats.knowledge_stats(fixtures.facts(spark, d)), "qv_share")


# --- quotas and order

WANTED = (
    "quotas as (select doc_id, chunk_id, coalesce(t, 0) as total, coalesce(k, 0) as with_qv, coalesce(a, 0) as available from (select doc_id, chunk_id, count(*) t, count(qv) k from part group by all)"
    " full join (select doc_id, chunk_id, count(*) a from chunk_qv group by all) using (doc_id, chunk_id)),"
    " wanted as (select *, cast(case when available = 0 then 0 when total = 0 or with_qv / total::double < 0.5 then trunc((0.5 * total - with_qv) / 0.5) + 1 else 0 end as int) as wanted from quotas)"
)


@query(fx("select * from wanted", O.CHUNK_QV, PART, WANTED))
def chunk_quota(spark, d):
    return quota.chunk_quota(fixtures.facts(spark, d), quota.chunk_quantities(fixtures.chunks(spark, d)))


def _generated(rows: str, table: str, *columns: str) -> str:
    """The facts that a table makes of rows (doc_id, chunk_id, value, type, columns) in their chunks."""
    wide = "" if table == "document" else f"nullif(array_to_string({O.entities('ctx')}, '|'), '') as entities, "
    span = "'Lines ' || (chunk_id * 40 + 1) || '-' || (chunk_id * 40 + len(string_split(chunk_text, chr(10)))) as source_location"
    return (
        f"select doc_id, chunk_id, value, type, {''.join(c + ', ' for c in columns)}unnest(m), {wide}'supplier-' || doc_id as source_doc, {span}, md5(ctx[:250]) as quote from"
        f" (select *, {O.claim(table, 'lower(ctx)')} as m from (select *, {O.context('value', 'chunk_text')} as ctx from ({rows}) join fx_chunks using (doc_id, chunk_id)))"
    )


PICKED = (
    "picked as (select doc_id, chunk_id, qv_ord, value, type, pass from (select *, row_number() over (partition by doc_id, chunk_id order by pass, qv_ord) as turn from"
    " (select *, 1 as pass from missing where has_context union all select *, 2 from chunk_qv where has_context)) join wanted using (doc_id, chunk_id) where turn <= wanted)"
)


@query(fx(
    f"{_generated('select * from picked where pass = 1', 'missing', 'qv_ord', 'pass')} union all {_generated('select * from picked where pass = 2', 'again', 'qv_ord', 'pass')}",
    O.CHUNK_QV, PART, WANTED, MISSING, PICKED
))
def generate_missing_facts(spark, d):
    rows = fixtures.placed_chunks(spark, d)
    made = quota.generate_missing_facts(rows, fixtures.facts(spark, d))
    quote = F.md5(F.col("evidence_quote").cast("binary")).alias("quote")
    return made.select("doc_id", "chunk_id", "qv_ord", "value", "type", "pass", *MADE, bar(F.col("entities")).alias("entities"), "source_doc", "source_location", quote)


MADE = ["claim", "fact_type", "control_family", "specificity_score"]
GLOBAL_WANTED = "whole as (select doc_id, count(*) as total, count(qv) as with_qv, cast(case when count(qv) / count(*)::double < 0.35::double then trunc((0.35::double * count(*) - count(qv)) / (1 - 0.35::double)) + 1 else 0 end as int) as wanted from part group by doc_id)"


@query(fx("select * from whole", PART, GLOBAL_WANTED))
def global_quota(spark, d):
    return quota.global_quota(fixtures.facts(spark, d))


GLOBAL_PICKED = (
    "chosen as (select doc_id, chunk_id, value, type from (select *, row_number() over (partition by doc_id order by value, type) as turn from free join firsts using (doc_id, value)"
    " join fx_chunks using (doc_id, chunk_id) where regexp_matches(chunk_text, '(?i)' || value)) join whole using (doc_id) where turn <= wanted)"
)


@query(fx(_generated("select * from chosen", "document"), O.CHUNK_QV, PART, GLOBAL, GLOBAL_WANTED, FIRST, GLOBAL_PICKED))
def generate_global_facts(spark, d):
    rows = fixtures.placed_chunks(spark, d)
    made = quota.generate_global_facts(rows, quota.chunk_quantities(rows), fixtures.facts(spark, d))
    return made.select("doc_id", "chunk_id", "value", "type", *MADE, "source_doc", "source_location", F.md5(F.col("evidence_quote").cast("binary")).alias("quote"))


KEPT = (
    f"scored as (select *, qv is not null as has_qv, {O.QUALITY} as quality_score from fx_facts), ranked as (select *, row_number() over (partition by doc_id order by has_qv, quality_score desc, fact_no) as turn,"
    " count(qv) over (partition by doc_id) as k from scored), kept as (select * from ranked where has_qv or turn <= trunc(k / 0.35::double) - k)"
)


@query(fx("select doc_id, fact_no, has_qv, round(quality_score, 6) as quality_score from kept", KEPT))
def quota_filter(spark, d):
    return _rounded(quota.quota_filter(fixtures.facts(spark, d)).select("doc_id", "fact_no", "has_qv", "quality_score"), "quality_score")


@query(fx("select doc_id, round(max(quality_score), 6) as best, round(min(quality_score), 6) as worst from kept where not has_qv group by doc_id", KEPT))
def score_range(spark, d):
    return _rounded(quota.score_range(quota.quota_filter(fixtures.facts(spark, d))), "best", "worst")


CURATED = KEPT.replace("qv is not null as has_qv", "len(l) > 0 as has_qv").replace("from fx_facts)", "from fx_facts join retro using (doc_id, fact_no))").replace("count(qv) over", "sum((len(l) > 0)::int) over")


@query(fx("select doc_id, fact_no, has_qv from kept", RETRO, CURATED))
def curate_chain(spark, d):
    return chains.curate_chain(fixtures.facts(spark, d)).select("doc_id", "fact_no", "has_qv")


@query(fx("select doc_id, chunk_id, fact_no from fx_facts"))
def order_by_chunk(spark, d):
    return qa.order_by_chunk(fixtures.facts(spark, d)).select("doc_id", "chunk_id", "fact_no")


@query(fx("select doc_id, fact_no, row_number() over (order by doc_id, fact_no) as fact_id from fx_facts"))
def number_facts(spark, d):
    return qa.number_facts(fixtures.facts(spark, d)).select("doc_id", "fact_no", "fact_id")


@query(fx("select doc_id, chunk_id, min_by(claim, fact_no) as claim from fx_facts group by all"))
def first_match_per_group(spark, d):
    return qa.first_match_per_group(fixtures.facts(spark, d), ["doc_id", "chunk_id"], "fact_no", "claim")


@query(fx("select doc_id, fact_no, claim from fx_facts"))
def union_facts(spark, d):
    rows = fixtures.facts(spark, d).select("doc_id", "fact_no", "claim")
    return rows.where("fact_no % 2 = 0").unionByName(rows.where("fact_no % 2 = 1"))


@query(fx("select doc_id, fact_no from fx_facts where qv is null"))
def non_qv_facts(spark, d):
    return fixtures.facts(spark, d).where(score.count_of(F.col("quantitative_values")) == 0).select("doc_id", "fact_no")


# --- chains and questions


@query()
def post_process_chain(spark, d):
    rows = chains.post_process_chain(fixtures.facts(spark, d), fixtures.chunks(spark, d))
    return rows.select("doc_id", "fact_no", F.round("specificity_score", 6).alias("score"), bar(F.array_sort("quantitative_values")).alias("found"), F.round("confidence", 6).alias("confidence"))


QUESTION = "Who reviews firewall rules daily?"


@query(fx(
    "select doc_id, md5(string_agg(case when rank <= 5 then claim || ' [Fact ' || fact_no || ']' end, ' ' order by rank)) as answer, case when count(*) >= 3 then 'High' else 'Medium' end as confidence, count(*) as hits from (select *, row_number() over (partition by doc_id order by overlap desc, confidence desc, fact_no) as rank from (select *, len(list_intersect(list_distinct(regexp_split_to_array(lower(claim), '[^a-z0-9]+')), ['who', 'reviews', 'firewall', 'rules', 'daily'])) as overlap from fx_facts) where overlap > 0) group by doc_id"
))
def answer_by_document(spark, d):
    return qa.answer_question(fixtures.facts(spark, d), QUESTION).withColumn("answer", F.md5(F.col("answer").cast("binary")))


QUESTIONS = ["Who reviews firewall rules daily?", "What is sampled above 95 percent, and by the CISO?", "Real-time alerts on TLS 1.3 sessions", "zebra"]

BM25 = (
    "words as (select doc_id, fact_no, claim, list_filter(regexp_split_to_array(lower(claim), '[^a-z0-9]+'), lambda x: x <> '') as l from fx_facts),"
    " norm as (select count(*) as n, avg(len(l)) as mean from words),"
    " tf as (select doc_id, fact_no, len(l) as size, term, count(*) as tf from (select doc_id, fact_no, l, unnest(l) as term from words) group by all),"
    " df as (select term, count(*) as df from tf group by term),"
    " asked as (select q, question, unnest(list_distinct(list_filter(regexp_split_to_array(lower(question), '[^a-z0-9]+'), lambda x: x <> ''))) as term from (values "
    + ", ".join(f"({i}, '{q}')" for i, q in enumerate(QUESTIONS))
    + ") v(q, question)),"
    " scored as (select question, doc_id, fact_no, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * size / mean))), 9) as score"
    " from asked join tf using (term) join df using (term), norm group by all),"
    " best as (select *, row_number() over (partition by question order by score desc, doc_id, fact_no) as rank from scored)"
)


def _index(spark, d):
    return index.write_index(fixtures.facts(spark, d), facts_io.scratch(spark, "index"))


def _each_question(run):
    rows = [run(q) for q in QUESTIONS]
    out = rows[0]
    for other in rows[1:]:
        out = out.union(other)
    return out


@query(fx("select question, doc_id, fact_no, cast(rank as int) as rank, round(score, 6) as score from best where rank <= 20", BM25))
def retrieve_facts(spark, d):
    """The 20 best facts of all documents for each question."""
    held = _index(spark, d)
    found = _each_question(lambda q: index.search(held, q, 20).select(F.lit(q).alias("question"), "doc_id", "fact_no", "rank", "score"))
    return _rounded(found, "score")


@query(fx(
    "select question, coalesce(string_agg(claim || ' [Fact ' || doc_id || ':' || fact_no || ']', ' ' order by rank), '') as answer, count(doc_id) as hits,"
    " case when count(doc_id) >= 3 then 'High' when count(doc_id) > 0 then 'Medium' else 'Low' end as confidence"
    " from (select distinct question from asked) left join (select * from best join fx_facts using (doc_id, fact_no) where rank <= 5) using (question) group by question", BM25
))
def answer_question(spark, d):
    """An answer to each question from the facts of all documents."""
    held, rows = _index(spark, d), fixtures.facts(spark, d)
    return _each_question(lambda q: index.answer(held, rows, q))


@query(fx(
    "select doc_id, cast((fact_no - 1) // 200 as int) as part_no, md5(string_agg('[Fact ' || fact_no || '] ' || claim || chr(10) || 'Location: ' || source_location || chr(10) || 'Evidence: ' || evidence_quote[:150], chr(10) || chr(10) order by fact_no)) as digest from fx_facts group by all"
))
def facts_prompt_text(spark, d):
    rows = qa.facts_prompt_text(fixtures.facts(spark, d))
    return rows.select("doc_id", "part_no", F.md5(F.col("part").cast("binary")).alias("digest"))


@query(fx(
    "select doc_id, cast(c as int) as chunk_id, cast(i - 1 as int) as qv_ord, q[i].value as value, q[i].type as type, case when q[i].type = 'frequency' then "
    f"{O.normalized('q[i].value')} end as normalized from (select *, unnest(range(1, len(q) + 1)) as i from (select doc_id, c, {O.quantities('t')} as q from"
    " (select doc_id, c, array_to_string(list_slice(lines, c * 8 + 1, c * 8 + 10), chr(10)) as t from (select doc_id, lines, unnest(range(0,"
    " case when len(lines) <= 10 then 1 else cast(ceil((len(lines) - 10) / 8.0) as int) + 1 end)) as c from fx_docs))))"
))
def stream_quantities(spark, d):
    """The stream of documents, run until all files are read, and its table read back."""
    base = facts_io.scratch(spark, "stream")
    docs = fixtures.document_lines(spark, d).select("doc_id", F.array_join("lines", "\n").alias("text"))
    docs.write.parquet(f"{base}/documents")
    ingest.stream_quantities(spark, f"{base}/documents", f"{base}/table", f"{base}/checkpoint", 10, 2).awaitTermination()
    rows = facts_io.load_chunks(spark, f"{base}/table")
    return rows.select("doc_id", "chunk_id", "qv_ord", "value", "type", "normalized")


@query(fx("select * from whole", PART, GLOBAL_WANTED))
def stream_quotas(spark, d):
    """Running quotas over a stream of fact files, read in batches of one file."""
    base = facts_io.scratch(spark, "stream")
    fixtures.facts(spark, d).select("doc_id", "fact_no", "quantitative_values").repartition(3, "fact_no").write.parquet(f"{base}/facts")
    ingest.stream_quotas(spark, f"{base}/facts", f"{base}/quotas", f"{base}/checkpoint", files_per_batch=1).awaitTermination()
    return versions.current(spark, f"{base}/quotas", "doc_id", ingest.QUOTAS)


@query(fx(f"select doc_id, chunk_id, value, type, 2 as runs from chunk_qv", O.CHUNK_QV))
def producer_store(spark, d):
    """What a producer makes of the chunks, stored by content: two runs over growing input, each text produced once."""
    path = facts_io.scratch(spark, "store")
    rows = fixtures.chunks(spark, d)

    def produce(asked):
        return asked.select("content", F.explode(P.quantities(F.col("chunk_text"))).alias("q")).select("content", "q.value", "q.type")

    versions.produced_once(rows.where("chunk_id < 5"), produce, "value string, type string", path)
    found = versions.produced_once(rows, produce, "value string, type string", path)
    runs = spark.read.parquet(f"{path}/asked").groupBy("content").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"))
    return found.join(F.broadcast(runs)).where("most = 1").select("doc_id", "chunk_id", "value", "type", F.lit(2).alias("runs"))


# --- consensus


def _runs(spark, d):
    rows = fixtures.facts(spark, d).withColumn("instance_id", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return rows.where("fact_no % 7 >= instance_id")


RUNS = (
    "runs as (select f.*, i as instance_id from fx_facts f, (select unnest(range(0, 5)) as i) where fact_no % 7 >= i),"
    " agreed as (select doc_id, claim, count(distinct instance_id) as support_count, count(distinct instance_id) / 5.0::double as support,"
    " min({'c': -confidence, 'f': fact_no, 'q': evidence_quote}) as r from runs group by all)"
)


@query(fx("select doc_id, claim, support_count, round(support, 6) as support, support >= 0.8 as is_consensus, r.f as fact_no, r.q as evidence_quote from agreed", RUNS))
def consensus_facts(spark, d):
    return _rounded(consensus.consensus_facts(_runs(spark, d), 5).drop("confidence", "source_location"), "support")


@query(fx("select doc_id, claim, support_count from agreed where support < 0.8", RUNS))
def outlier_facts(spark, d):
    return consensus.outlier_facts(consensus.consensus_facts(_runs(spark, d), 5)).select("doc_id", "claim", "support_count")


def _hours(unit: str, last: bool) -> str:
    """Hours of a unit, the most or the least."""
    return f"case {unit} when 'second' then 1 / 3600.0::double when 'minute' then 1 / 60.0::double when 'hour' then 1 when 'day' then 24 when 'week' then 168 when 'month' then {744 if last else 672} when 'quarter' then {2208 if last else 2160} when 'year' then {8784 if last else 8760} end"


UNITS = "(second|minute|hour|day|week|month|quarter|year)"
SPAN = f"'(\\d+(?:,\\d{{3}})*(?:\\.\\d+)?)[\\s-]+(?:business\\s+)?{UNITS}'"
OFTEN = f"'(\\d+(?:,\\d{{3}})*(?:\\.\\d+)?)\\s+times?\\s+(?:per|each)\\s+{UNITS}'"
#: Quantities of claims on their scales, read once more in SQL: n units, n times a unit, names, and amounts that may be open.
MEASURED = (
    f"stated as (select distinct doc_id, fact_no, claim, value, type, lower(value) as v from (select doc_id, fact_no, claim, unnest({O.quantities('claim')}, recursive := true) from fx_facts)),"
    f" parts as (select *, try_cast(replace(regexp_extract(v, {SPAN}, 1), ',', '') as double) as n, regexp_extract(v, {SPAN}, 2) as u, try_cast(replace(regexp_extract(v, {OFTEN}, 1), ',', '') as double) as k,"
    f" regexp_extract(v, {OFTEN}, 2) as p, try_cast(replace(regexp_extract(v, '(\\d+(?:,\\d{{3}})*(?:\\.\\d+)?)', 1), ',', '') as double) as x from stated),"
    f" bounds as (select *, n * ({_hours('u', False)}) as n_low, n * ({_hours('u', True)}) as n_high, ({_hours('p', False)}) / k as k_low, ({_hours('p', True)}) / k as k_high from parts),"
    " spans as (select *, case type when 'frequency' then case when k > 0 and regexp_matches(v, 'at least|no less than|minimum of') then [0, k_high] when k > 0 then [k_low, k_high]"
    " when contains(v, 'within') and n is not null then [0, n_high] when n is not null then [n_low, n_high] when regexp_matches(v, 'real-time|continuous|ongoing') then [0, 0]"
    " when contains(v, 'semi-annual') then [4032, 4464] when contains(v, 'dail') then [24, 24] when contains(v, 'week') then [168, 168] when contains(v, 'month') then [672, 744]"
    " when contains(v, 'quarter') then [2160, 2208] when contains(v, 'annual') or contains(v, 'year') then [8760, 8784] end"
    " when 'duration' then case when n is not null then [n_low, n_high] end"
    " else case when x is null then null when regexp_matches(v, 'greater|more|above|exceeds|over|at\\s+least|\\d\\+') then [x, 'infinity'::double] when regexp_matches(v, 'less|fewer|below') then [0, x] else [x, x] end end as s from bounds),"
    " measured as (select distinct doc_id, fact_no, claim, value, case type when 'frequency' then 'repeat' when 'duration' then 'lasting' when 'percentage' then 'share' else 'count' end as scale, s[1]::double as low, s[2]::double as high"
    " from spans where s is not null)"
)


@query(fx("select doc_id, fact_no, value, scale, round(low, 6) as low, case when high < 'infinity' then round(high, 6) end as high from measured", MEASURED))
def measured_quantities(spark, d):
    """The quantities of claims as intervals; an open one has no upper end."""
    rows = consensus.measured(fixtures.facts(spark, d))
    return rows.select("doc_id", "fact_no", "value", "scale", F.round("low", 6).alias("low"), F.when(F.col("high") < float("inf"), F.round("high", 6)).alias("high"))


STOP = "'daily','weekly','monthly','quarterly','annually','yearly','continuous','continuously','ongoing','real','time','every','each','per','times','at','least','within','than','more','less','greater','fewer','over','above','below','approximately','exceeds','percent','second','seconds','minute','minutes','hour','hours','day','days','week','weeks','month','months','quarter','quarters','year','years','business','and','for','with'"
SUBJECTS = (
    f"subjects as (select distinct doc_id, claim, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(claim), '[^a-z]+'), lambda x: x <> '' and x not in ({STOP})))) as w from measured),"
    " about as (select distinct doc_id, w from subjects),"
    " alike as (select a.doc_id, a.w as wa, b.w as wb from about a join about b using (doc_id) where a.w <> b.w and 100 * len(list_intersect(a.w, b.w)) >= 80 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))),"
    " gone as (select doc_id, w, w as r from about union select n.doc_id, n.wb, h.r from gone h join alike n on n.doc_id = h.doc_id and n.wa = h.w),"
    " same as (select doc_id, w, min(r) as g from gone group by all),"
    " against as (select doc_id, scale, min(claim) as group_claim, count(distinct fact_no) as facts, count(distinct value) as statements, min(high) as low, max(low) as high,"
    " min({'e': high, 'v': value}).v as low_value, min({'e': -low, 'v': value}).v as high_value"
    " from measured m join subjects using (doc_id, claim) join same using (doc_id, w) group by doc_id, g, scale having min(high) < max(low))"
)


def recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


@query(recursive(fx("select * from against", MEASURED, SUBJECTS)))
def contradictions(spark, d):
    return consensus.contradictions(fixtures.facts(spark, d))


CLAIM_SETS = (
    "claims as (select *, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(claim), '\\W+'), lambda x: x <> ''))) as w from fx_facts),"
    " sets as (select distinct doc_id, w from claims),"
    " near as (select doc_id, a.w as wa, b.w as wb, len(list_intersect(a.w, b.w)) as k from sets a join sets b using (doc_id) where a.w <> b.w),"
    " reach as (select doc_id, w, w as r from sets union select n.doc_id, n.wb, h.r from reach h join near n on n.doc_id = h.doc_id and n.wa = h.w"
    " and 100 * k >= 80 * (len(n.wa) + len(n.wb) - k)),"
    " merged as (select doc_id, w, min(r) as g from reach group by all)"
)


@query(fx("select doc_id, min_by(fact_no, [-confidence, fact_no]) as fact_no from claims join merged using (doc_id, w) group by doc_id, g", CLAIM_SETS).replace("with ", "with recursive ", 1))
def semantic_dedup(spark, d):
    return consensus.semantic_dedup(fixtures.facts(spark, d)).select("doc_id", "fact_no")


@query(fx("select doc_id, 'CC' || (line_no % 9) as control_id, count(*) as facts, min(fact_no) as first_fact, max(fact_no) as last_fact from fx_facts group by all"))
def control_graph(spark, d):
    return consensus.control_graph(fixtures.facts(spark, d))


#: Facts name two controls here, so that controls lead to each other.
TWO = "two as (select distinct doc_id, fact_no, unnest(['CC' || (line_no % 9), 'PI' || (line_no % 7 + line_no % 5)]) as control_id from fx_facts)"


@query(recursive(fx(
    "select doc_id, start_fact, fact_no, min(h) as hops from walk group by all", TWO,
    "walk as (select doc_id, fact_no as start_fact, fact_no, 0 as h from (select doc_id, min(fact_no) as fact_no from fx_facts group by 1) union"
    " select w.doc_id, w.start_fact, b.fact_no, w.h + 1 from walk w join two a on a.doc_id = w.doc_id and a.fact_no = w.fact_no join two b on b.doc_id = a.doc_id and b.control_id = a.control_id where w.h < 2)",
)))
def related_facts(spark, d):
    """What the first fact of each document reaches within two hops."""
    second = F.concat(F.lit("PI"), (F.col("line_no") % 7 + F.col("line_no") % 5).cast("string"))
    rows = fixtures.facts(spark, d).withColumn("related_control_ids", F.array_union("related_control_ids", F.array(second)))
    links = facts_io.stored(consensus.control_links(rows), "links")
    return consensus.related_facts(rows.groupBy("doc_id").agg(F.min("fact_no").alias("fact_no")), links, 2)


@query(recursive(fx(
    "select doc_id, count(*) as claims, sum((support >= 0.8)::int) as agreed, cast(floor(avg(support) * 1000 + 0.0001) as int) as permille, coalesce(any_value(n), 0) as contradictions from agreed left join (select doc_id, count(*) n from against group by 1) using (doc_id) group by doc_id", RUNS, MEASURED, SUBJECTS
)))
def answer_report(spark, d):
    rows = consensus.answer_report(consensus.consensus_facts(_runs(spark, d), 5), consensus.contradictions(fixtures.facts(spark, d)))
    # whole thousandths, so that sums in another order round alike
    return rows.withColumn("permille", F.floor(F.col("mean_support") * 1000 + 0.0001).cast("int")).drop("mean_support")


def _labelled(spark, d):
    """Vectors grouped by label and the last digit of their id."""
    vectors = table(spark, d, "embeddings")
    return vectors.select(F.col("vec_id").alias("node"), (F.col("label") * 10 + F.col("vec_id") % 10).cast("long").alias("cluster")), vectors


CENTRES = (
    "with v as (select vec_id, label * 10 + vec_id % 10 as cluster, embedding from embeddings), c as (select cluster, i, avg(embedding[i]::double) as m from (select cluster, embedding, unnest(range(1, len(embedding) + 1)) as i from v) group by all),"
    " l as (select cluster, list(m order by i) as centroid from c group by cluster),"
    " dist as (select cluster, vec_id, centroid, round(sqrt(list_sum(list_transform(range(1, len(centroid) + 1), lambda i: (embedding[i]::double - centroid[i]) ** 2))), 9) as distance from v join l using (cluster))"
)


@query(f"{CENTRES} select cluster, count(*) as size, round(list_sum(any_value(centroid)), 6) as total, round(any_value(centroid)[7], 6) as seventh, min({{'d': distance, 'v': vec_id}}).v as medoid, round(min(distance), 6) as distance from dist group by cluster")
def cluster_centres(spark, d):
    """Centroid and medoid of each group of vectors."""
    rows = consensus.medoids(*_labelled(spark, d))
    total = F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x)
    return _rounded(rows.select("cluster", "size", total.alias("total"), F.col("centroid")[6].alias("seventh"), "medoid", "distance"), "total", "seventh", "distance")


@query()
def similar_facts(spark, d):
    return consensus.similar_facts(table(spark, d, "embeddings"), 0.4)


@query()
def fact_clusters(spark, d):
    vectors = table(spark, d, "embeddings")
    nodes = vectors.where("vec_id is not null").select(F.col("vec_id").alias("node")).distinct()
    return consensus.fact_clusters(consensus.similar_links(vectors, 0.4), nodes)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation statistics of each document."""
    return validate_facts(spark, sf_dir)


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_ORACLES)
