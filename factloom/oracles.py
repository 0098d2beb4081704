"""SQL that says what each query must return, for another engine to run on the same tables."""

from __future__ import annotations

from factloom.functions import patterns as P
from factloom.operators.score import PURE_TEST, SUBSTANCE
from factloom.sources import fixtures

LINES = fixtures.LINES.format(lineitem="lineitem")
FACTS = fixtures.FACTS.format(fx_lines="fx_lines")
CHUNKS = (
    "select doc_id, cast(floor((line_no - 1) / 40.0) as int) as chunk_id, string_agg(line, chr(10) order by line_no) as chunk_text"
    " from fx_lines group by all"
)
DOCS = "select doc_id, list(line order by line_no) as lines from fx_lines group by doc_id"


def fx(sql: str, *more: str) -> str:
    """SQL over fx_lines, fx_facts, fx_chunks and fx_docs, and further named queries."""
    recursive = "recursive " if CONTROL in more else ""
    named = [f"fx_lines as ({LINES})", f"fx_facts as ({FACTS})", f"fx_chunks as ({CHUNKS})", f"fx_docs as ({DOCS})", *more]
    return f"with {recursive}{', '.join(named)} {sql}"


def hits(text: str, rules: list[str]) -> str:
    return "flatten([" + ", ".join(f"regexp_extract_all({text}, '(?i){r}', 0)" for r in rules) + "])"


def first_seen(items: str) -> str:
    """The distinct elements of a list in order of first appearance."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def joined(items: str) -> str:
    return f"array_to_string({items}, '|')"


def any_of(text: str, *words: str) -> str:
    return "(" + " or ".join(f"contains({text}, '{w}')" for w in words) + ")"


def normalized(v: str) -> str:
    low = f"lower({v})"
    return (
        f"case when {any_of(low, 'daily', 'every day')} then 'daily' when {any_of(low, 'weekly', 'every week')} then 'weekly'"
        f" when {any_of(low, 'monthly', 'every month')} then 'monthly' when {any_of(low, 'quarterly', 'every quarter')} then 'quarterly'"
        f" when {any_of(low, 'annually', 'yearly', 'every year')} then 'annually'"
        f" when {any_of(low, 'real-time', 'continuous')} then 'continuous' else {v} end"
    )


def quantities(text: str) -> str:
    """A list of {'value', 'type'} structs, family by family."""
    parts = [f"list_transform({hits(text, rules)}, lambda x: {{'value': x, 'type': '{kind}'}})" for kind, rules in P.QUANTITIES.items()]
    return f"flatten([{', '.join(parts)}])"


CHUNK_QV = (
    "chunk_qv as (select doc_id, chunk_id, cast(i - 1 as int) as qv_ord, q[i].value as value, q[i].type as type, regexp_matches(chunk_text, '(?i)' || q[i].value) as has_context from ("
    f"select doc_id, chunk_id, chunk_text, q, unnest(range(1, len(q) + 1)) as i from (select doc_id, chunk_id, chunk_text, {quantities('chunk_text')} as q from fx_chunks)))"
)


def norm(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def ratio(quote: str, text: str) -> str:
    q, t = norm(quote), norm(text)
    fold = (
        f"list_reduce(list_transform(string_split(lower({t}), ' '), lambda w: {{'n': 0, 'w': w}}), lambda a, b: {{'n': a.n + case when"
        f" string_split(lower({q}), ' ')[a.n + 1] = b.w then 1 else 0 end, 'w': ''}}, {{'n': 0, 'w': ''}}).n"
    )
    return f"case when contains({t}, {q}) then 1.0 else {fold} / cast(len(string_split({q}, ' ')) as double) end"


def cited(reach: int) -> str:
    """The lines that a fact cites and `reach` more, joined; from fx_facts f and fx_docs d."""
    low, high = f"greatest(1, f.start_line - {reach})", f"least(len(d.lines), f.end_line + {reach})"
    return f"case when {high} >= {low} then array_to_string(list_slice(d.lines, {low}, {high}), chr(10)) else '' end"


VALIDATED = (
    f"exact as (select f.*, d.lines, {ratio('evidence_quote', cited(0))} >= 0.7 as in_lines from fx_facts f join fx_docs d using (doc_id)),"
    f" validated as (select f.* exclude (lines, in_lines), case when in_lines then 'exact' when {ratio('f.evidence_quote', cited(5))} >= 0.7"
    " then 'expanded' end as scope from exact f join fx_docs d using (doc_id))"
)

SPECIFICITY = (
    "greatest(0.0, least(1.0, cast(0.3 as double) + case when qv is not null then cast(0.2 as double) else 0 end"
    " + case when entity is not null then cast(0.2 as double) else 0 end"
    " + case when coalesce(who, '') <> '' and lower(who) not in ('management', 'personnel', 'staff', 'it personnel') then cast(0.2 as double) else 0 end"
    " + case when coalesce(who, '') <> '' then cast(0.1 as double) else 0 end"
    " + case when regexp_matches(lower(claim), 'periodically|regularly|as needed|as appropriate|certain|various') then -cast(0.2 as double) else 0 end))"
)
QUALITY = (
    "coalesce(specificity_score, 0.0) * 2 + case when entity is not null then 1.0::double else 0 end + case when who is not null then 0.5::double else 0 end"
    " + case when fact_type in ('technical_control', 'process', 'architecture') then 0.5::double when fact_type = 'organizational' then 0.3::double"
    " when fact_type = 'test_result' then -0.5::double else 0 end + case when confidence >= 0.9 then 0.3::double else 0 end"
    " - case when regexp_matches(lower(claim), 'personnel|management|appropriate|reasonable|adequate|sufficient') then 0.5::double else 0 end"
)
#: On the derived claims only these generic terms occur, and none is qualified.
GENERIC = (
    "(regexp_matches(lower(claim), '\\bit (staff|personnel|team)\\b') and not regexp_matches(lower(claim), '\\bit (staff|personnel|team)\\b.*\\b(security|operations|infrastructure|development)\\b'))"
    " or (regexp_matches(lower(claim), '\\bmanagement\\b') and not regexp_matches(lower(claim), '\\bmanagement\\b.*\\b(security|risk|compliance|senior)\\b'))"
    " or (regexp_matches(lower(claim), '\\bperiodically\\b') and not regexp_matches(lower(claim), '\\bperiodically\\b.*\\b(daily|weekly|monthly|quarterly|annually)\\b'))"
)
PURE = "regexp_matches(lower(trim(claim)), '" + "|".join(PURE_TEST) + "') and not regexp_matches(lower(claim), '" + "|".join(SUBSTANCE) + "')"

#: A claim that states a quantity, typed from the rules: equal, a synonym of a frequency, another form of a duration or a share.
_V, _C = "lower(value)", "lower(claim)"
_TIME = r"'(\d+)\s*(day|days|month|months|year|years|hour|hours|minute|minutes)'"
_NUMBER, _UNIT = f"regexp_extract({_V}, {_TIME}, 1)", f"regexp_extract({_V}, {_TIME}, 2)"
_WORD = (
    f"case {_NUMBER} when '1' then 'one' when '2' then 'two' when '3' then 'three' when '4' then 'four' when '5' then 'five' when '6' then 'six'"
    " when '7' then 'seven' when '8' then 'eight' when '9' then 'nine' when '10' then 'ten' when '30' then 'thirty' when '60' then 'sixty'"
    " when '90' then 'ninety' when '365' then 'three hundred sixty-five' end"
)
_SHARE = rf"regexp_extract({_V}, '(\d+\.?\d*)\s*%?', 1)"
QV_MATCH = (
    f"(contains({_C}, {_V}) or coalesce(case when type = 'frequency' then"
    f" (contains({_V}, 'daily') and {any_of(_C, 'every day', 'each day', 'per day', 'day-to-day')})"
    f" or (contains({_V}, 'weekly') and {any_of(_C, 'every week', 'each week', 'per week', 'week-to-week', '7 days')})"
    f" or (contains({_V}, 'monthly') and {any_of(_C, 'every month', 'each month', 'per month', 'month-to-month', '30 days')})"
    f" or (contains({_V}, 'quarterly') and {any_of(_C, 'every quarter', 'each quarter', 'per quarter', '3 months', 'three months')})"
    f" or (contains({_V}, 'semi-annually') and {any_of(_C, 'twice a year', 'every 6 months', '6-month', 'biannual')})"
    f" or (contains({_V}, 'annually') and {any_of(_C, 'every year', 'each year', 'per year', 'yearly', 'annual', '12 months', '365 days')})"
    f" when type = 'duration' then {_NUMBER} <> '' and (contains({_C}, {_NUMBER} || '-' || {_UNIT}) or coalesce(contains({_C}, {_WORD} || ' ' || {_UNIT})"
    f" or contains({_C}, {_WORD} || '-' || {_UNIT}), false) or (starts_with({_UNIT}, 'day') and case try_cast({_NUMBER} as bigint)"
    f" when 30 then {any_of(_C, '1 month', 'one month', 'monthly')} when 90 then {any_of(_C, '3 month', 'three month', 'quarterly')}"
    f" when 365 then {any_of(_C, '1 year', 'one year', 'annual')} else false end))"
    f" when type in ('percentage', 'count') then {_SHARE} <> '' and (contains({_C}, {_SHARE} || '%') or contains({_C}, {_SHARE} || ' percent')"
    f" or contains({_C}, {_SHARE} || ' per cent') or contains({_C}, printf('%.1f', try_cast({_SHARE} as double)) || '%')) else false end, false))"
)


def context(value: str, text: str) -> str:
    return f"nullif(trim(regexp_replace(regexp_extract({text}, '(?is).{{0,200}}' || {value} || '.{{0,200}}', 0), '\\s+', ' ', 'g')), '')"


def entities(text: str) -> str:
    found = f"regexp_extract_all({text}, '\\b[A-Z][A-Za-z]+(?:\\s+[A-Z][A-Za-z]+)*\\b', 0)"
    return f"list_slice(list_sort(list_distinct(list_filter({found}, lambda x: length(x) > 2))), 1, 5)"


def claim(table: str, low: str) -> str:
    """The struct that a table of claims gives for value and type among the words of `low`, typed from the rules."""
    rate = "0.65" if table == "document" else None
    c = lambda text, kind, family, r: f"{{'claim': '{text} ' || value, 'fact_type': '{kind}', 'control_family': '{family}', 'specificity_score': {rate or r}::double}}"
    backup, keep = c("Backups performed", "technical_control", "backup_recovery", "0.7"), c("Retention period of", "technical_control", "backup_recovery", "0.7")
    review, act = c("Reviews conducted", "process", "monitoring", "0.7"), c("Activity performed", "process", "compliance", "0.6")
    watch, lasts = c("Monitoring performed", "technical_control", "monitoring", "0.7"), c("Duration specified as", "metric", "compliance", "0.6")
    says, sampled = c("System specifies", "metric", "compliance", "0.6"), c("Testing sampled", "test_result", "compliance", "0.7")
    size, share = c("Sample size of", "test_result", "compliance", "0.6"), c("Percentage specified as", "metric", "compliance", "0.6")
    limit, session = c("Threshold set at", "metric", "monitoring", "0.7"), c("Session timeout set to", "technical_control", "access_control", "0.8")
    if table == "missing":
        often = (
            f"case when {any_of(low, 'backup')} then {backup} when {any_of(low, 'review', 'assess')} then {review} when {any_of(low, 'monitor', 'alert')} then {watch}"
            f" when {any_of(low, 'test')} then {c('Testing conducted', 'test_result', 'compliance', '0.7')}"
            f" when {any_of(low, 'scan')} then {c('Scanning performed', 'technical_control', 'monitoring', '0.7')} else {act} end"
        )
        lasting = (
            f"case when {any_of(low, 'reten')} then {keep} when {any_of(low, 'timeout', 'session')} then {session}"
            f" when {any_of(low, 'lock')} then {c('Account lockout duration of', 'technical_control', 'access_control', '0.8')} else {lasts} end"
        )
        sample = f"case when {any_of(low, 'sample', 'test')} then {sampled} else {size} end"
        part = (
            f"case when {any_of(low, 'threshold', 'limit')} then {limit} when {any_of(low, 'cpu')} then {c('CPU threshold of', 'metric', 'monitoring', '0.8')}"
            f" when {any_of(low, 'disk', 'storage')} then {c('Storage threshold of', 'metric', 'monitoring', '0.8')}"
            f" when {any_of(low, 'uptime', 'sla')} then {c('Uptime SLA of', 'metric', 'compliance', '0.8')} else {share} end"
        )
    elif table == "again":
        often = f"case when {any_of(low, 'backup')} then {backup} when {any_of(low, 'review', 'assess')} then {review} when {any_of(low, 'monitor', 'alert')} then {watch} else {act} end"
        lasting = f"case when {any_of(low, 'reten')} then {keep} when {any_of(low, 'timeout', 'session')} then {session} else {lasts} end"
        sample, part = sampled, f"case when {any_of(low, 'threshold', 'limit')} then {limit} else {share} end"
    else:
        often = (
            f"case when {any_of(low, 'backup')} then {backup} when {any_of(low, 'review')} then {review}"
            f" when {any_of(low, 'test', 'audit')} then {c('Testing/audit conducted', 'test_result', 'compliance', '')} else {act} end"
        )
        lasting, sample, part = f"case when {any_of(low, 'reten')} then {keep} else {lasts} end", size, says
    return f"case type when 'frequency' then {often} when 'duration' then {lasting} when 'sample_size' then {sample} when 'percentage' then {part} else {says} end"


#: Control tables, their lines' classes, and the rows that one reading from the top takes.
CONTROL = (
    f"ctl as (select doc_id, cast(floor((line_no - 1) / 40.0) as int) as chunk_id, line_no, {fixtures.CONTROL_LINE} as raw from fx_lines),"
    " ctl_chunks as (select doc_id, chunk_id, string_agg(raw, chr(10) order by line_no) as chunk_text from ctl group by all),"
    " cls as (select doc_id, chunk_id, row_number() over w - 1 as i, count(*) over (partition by doc_id, chunk_id) as n, trim(raw) as x,"
    " regexp_matches(trim(raw), '^[A-Z]{2,3}\\d+\\.\\d+\\s+') as opens, regexp_matches(trim(raw),"
    " '(?i)(Inspected|Observed|Performed|Conducted|Reviewed|Examined|Validated|Tested)\\s+') as tests, regexp_matches(trim(raw), '(?i)\\bNo\\s+Exceptions?\\s+Noted\\b') as ends"
    " from ctl window w as (partition by doc_id, chunk_id order by line_no)),"
    " begun as (select s.doc_id, s.chunk_id, s.i, s.n, s.opens, case when s.opens then coalesce((select min(t.i) from cls t where t.doc_id = s.doc_id and t.chunk_id = s.chunk_id and t.tests and t.i > s.i), s.n) else s.i end as t"
    " from cls s where s.opens or s.tests),"
    " span as (select b.*, least(b.n, coalesce((select min(e.i) from cls e where e.doc_id = b.doc_id and e.chunk_id = b.chunk_id and e.ends and e.i >= b.t), b.n) + 1) as stop from begun b),"
    " jump as (select a.doc_id, a.chunk_id, a.i, (select min(b.i) from span b where b.doc_id = a.doc_id and b.chunk_id = a.chunk_id and b.i >= a.stop) as next from span a),"
    " walk as (select doc_id, chunk_id, min(i) as i from span group by doc_id, chunk_id union all select j.doc_id, j.chunk_id, j.next from walk w join jump j on j.doc_id = w.doc_id and j.chunk_id = w.chunk_id and j.i = w.i where j.next is not null),"
    " closed as (select s.*, coalesce((select max(e.i) + 1 from cls e where e.doc_id = s.doc_id and e.chunk_id = s.chunk_id and e.ends and e.i < s.i), 0) as c from span s join walk w on w.doc_id = s.doc_id and w.chunk_id = s.chunk_id and w.i = s.i),"
    " above as (select c.doc_id, c.chunk_id, c.i, list(l.i order by l.i desc) as l from closed c join cls l on l.doc_id = c.doc_id and l.chunk_id = c.chunk_id and l.i >= c.c and l.i < c.i and l.x <> '' group by all),"
    " placed as (select c.*, case when c.opens then c.i when coalesce(len(a.l), 0) >= 6 then a.l[6] else c.c end as b from closed c left join above a using (doc_id, chunk_id, i)),"
    " ctl_rows as (select doc_id, chunk_id, control_id, description, test_procedure, case when contains(test_procedure, 'No Exception') then 'No Exceptions Noted' else 'Unknown' end as test_results, b as start_line, stop as end_line from"
    " (select p.*, case when p.opens then (select string_split(x, ' ')[1] from cls l where l.doc_id = p.doc_id and l.chunk_id = p.chunk_id and l.i = p.i) end as control_id,"
    " coalesce((select string_agg(l.x, ' ' order by l.i) from cls l where l.doc_id = p.doc_id and l.chunk_id = p.chunk_id and ((p.opens and l.i >= p.i and l.i < p.t) or (not p.opens and l.i >= p.b and l.i < p.i and l.x <> ''))), '') as description,"
    " coalesce((select string_agg(l.x, ' ' order by l.i) from cls l where l.doc_id = p.doc_id and l.chunk_id = p.chunk_id and l.i >= p.t and l.i < p.stop), '') as test_procedure from placed p) where description <> '' and test_procedure <> '')"
)


def control_facts() -> str:
    """Facts of ctl_rows: the control, its frequencies, roles and specifications, and the samples of its test."""
    def part(items: str, before: str, after: str, kind: str, quote: str) -> str:
        return (
            f"select doc_id, chunk_id, control_id, start_line, end_line, '{before}' || v || '{after}' as claim, '{kind}' as fact_type, v as value, {quote} as evidence_quote"
            f" from (select *, unnest({items}) as v from ctl_rows)"
        )

    return " union all ".join(
        [
            part("[description]", "", "", "technical_control", "description"),
            part(hits("description", P.FREQUENCY), "Control performed ", "", "process", "description"),
            part(first_seen(hits("description", P.ROLES)), "", " is responsible for control execution", "organizational", "description"),
            *(part(first_seen(hits("description", r)), "System uses ", "", "technical_control", "description") for r in (P.ENCRYPTION, P.AUTHENTICATION, P.NETWORK)),
            part(hits("test_procedure", P.SAMPLE), "Auditor tested ", "", "test_result", "test_procedure"),
        ]
    )
