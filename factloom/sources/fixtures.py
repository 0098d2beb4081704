"""Control-report lines and facts derived from the order tables, by rules that any SQL engine runs alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = """
select cast(l_suppkey as int) as doc_id,
  cast(row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_shipdate) as int) as line_no,
  case l_orderkey % 4 when 0 then 'Security Team' when 1 then 'CISO' when 2 then 'management' else 'IT staff' end || ' ' ||
  case l_linenumber % 3 when 0 then 'reviews' when 1 then 'tests' else 'monitors' end || ' ' ||
  case l_partkey % 5 when 0 then 'firewall rules' when 1 then 'backups' when 2 then 'TLS 1.3 sessions'
    when 3 then 'AES-256 keys' else 'user access' end || ' ' ||
  case l_orderkey % 7 when 0 then 'daily' when 1 then 'quarterly'
    when 2 then 'every ' || cast(30 + l_linenumber as varchar(20)) || ' days' when 3 then 'periodically'
    when 4 then 'within 24 hours' when 5 then 'and sampled ' || cast(l_partkey % 50 as varchar(20)) || ' items'
    else 'as needed' end ||
  case l_partkey % 13 when 0 then ' above 95%SLA' when 1 then ' for over 1,200 users' when 2 then ' using MFA and SSO'
    when 3 then ' with real-time alerts' when 4 then ' every day' when 5 then ' with 90-day retention'
    when 6 then ' exceeds 85 percent' when 7 then ' for 100+ users' when 8 then ' at 99.5 percent uptime' else '' end as line,
  l_orderkey, l_partkey, l_linenumber
from {lineitem}
"""

FACTS = """
select doc_id, cast(row_number() over (partition by doc_id order by line_no) as int) as fact_no, line as claim,
  'supplier-' || cast(doc_id as varchar(20)) as source_doc, line_no,
  cast(line_no + case l_partkey % 3 when 0 then 0 when 1 then 3 else 40 end as int) as start_line,
  cast(line_no + case l_partkey % 3 when 0 then 0 when 1 then 3 else 40 end + case l_partkey % 4 when 1 then 2 else 0 end as int) as end_line,
  'Lines ' || cast(line_no + case l_partkey % 3 when 0 then 0 when 1 then 3 else 40 end as varchar(20)) || '-' ||
    cast(line_no + case l_partkey % 3 when 0 then 0 when 1 then 3 else 40 end + case l_partkey % 4 when 1 then 2 else 0 end as varchar(20)) as source_location,
  case when l_linenumber % 7 = 0 then 'This sentence is nowhere in the source'
    when l_linenumber % 4 = 0 then regexp_replace(line, ' [^ ]+$', '') else line end as evidence_quote,
  case when l_partkey % 2 = 0 then case l_orderkey % 7 when 0 then 'daily' when 1 then 'quarterly'
    when 2 then 'every ' || cast(30 + l_linenumber as varchar(20)) || ' days' when 4 then 'within 24 hours'
    when 5 then 'sampled ' || cast(l_partkey % 50 as varchar(20)) || ' items' end end as qv,
  case l_partkey % 5 when 2 then 'TLS 1.3' when 3 then 'AES-256' end as entity,
  case l_orderkey % 4 when 0 then 'Security Team' when 1 then 'CISO' when 3 then 'IT staff' end as who,
  cast(0.75 as double) + (l_linenumber % 3) * cast(0.1 as double) as confidence,
  case l_partkey % 5 when 0 then 'technical_control' when 1 then 'process' when 2 then 'architecture'
    when 3 then 'metric' else 'test_result' end as fact_type,
  case when l_partkey % 7 = 0 then null else cast(0.2 as double) + (l_partkey % 8) * cast(0.1 as double) end as specificity_score,
  l_orderkey % 11 = 0 as auto_generated,
  cast(floor((line_no - 1) / cast(40.0 as double)) as int) as chunk_id
from {fx_lines} where l_orderkey % 5 = 0
"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LINES, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts in the engine's schema; their plain columns are kept beside the nested ones."""
    flat = spark.sql(FACTS, fx_lines=lines(spark, sf_dir))
    quote = F.struct(F.col("evidence_quote").alias("quote"), "source_location", F.lit(None).cast("string").alias("relevance"))
    none = F.lit(None).cast("string")
    return flat.withColumns(
        {
            "evidence_quotes": F.array(quote),
            "entities": F.when(F.col("entity").isNotNull(), F.array("entity")),
            "quantitative_values": F.when(F.col("qv").isNotNull(), F.array("qv")),
            "process_details": F.struct(F.col("who"), none.alias("when"), none.alias("how")),
            "related_control_ids": F.array(F.concat(F.lit("CC"), (F.col("line_no") % 9).cast("string"))),
        }
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and lines (an array in order) of each derived document."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines(spark, sf_dir).groupBy("doc_id").agg(ordered.alias("l")).select("doc_id", F.col("l.line").alias("lines"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, chunk_id and text: forty lines each, as the facts cite them."""
    rows = lines(spark, sf_dir).withColumn("chunk_id", F.floor((F.col("line_no") - 1) / 40).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    joined = F.array_join(F.col("l.line"), "\n").alias("chunk_text")
    return rows.groupBy("doc_id", "chunk_id").agg(ordered.alias("l")).select("doc_id", "chunk_id", joined)


def placed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunks with their source and the lines they span."""
    rows = chunks(spark, sf_dir)
    first = F.col("chunk_id") * 40 + 1
    last = first + F.size(F.split("chunk_text", "\n")) - 1
    return rows.select("*", first.alias("start_line"), last.alias("end_line"), F.concat(F.lit("supplier-"), F.col("doc_id").cast("string")).alias("source_doc"))


#: A line of a control table: ids, tests (some without an id), results and blank lines come at different distances.
CONTROL_LINE = """
case when line_no % 11 = 0 then '' when line_no % 5 = 1 and line_no % 3 <> 0 then 'CC' || cast(line_no % 9 as varchar(20)) || '.1 ' || line
  when line_no % 5 = 3 then '  Inspected that ' || line when line_no % 5 = 0 and line_no % 4 <> 0 then line || ' No Exceptions Noted ' else line end
"""


def control_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, chunk_id, chunk_text: chunks of control tables."""
    rows = lines(spark, sf_dir).withColumn("chunk_id", F.floor((F.col("line_no") - 1) / 40).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", F.expr(CONTROL_LINE).alias("line"))))
    return rows.groupBy("doc_id", "chunk_id").agg(ordered.alias("l")).select("doc_id", "chunk_id", F.array_join(F.col("l.line"), "\n").alias("chunk_text"))


#: A line of a report: headings, tables of two kinds, findings and steps among the others.
REPORT_LINE = """
case when line_no % 25 = 1 then case line_no % 4 when 0 then 'SYSTEM DESCRIPTION' when 1 then 'Control Testing and Results' when 2 then '3.1 Privacy of Data'
    else 'Complementary User Entity Controls' end
  when line_no % 25 in (8, 9, 10) then '| CC' || cast(line_no % 9 as varchar(20)) || '.1 ' || substr(line, 1, 20) || ' | Tested | No Exceptions Noted |'
  when line_no % 25 in (15, 16) then 'host' || cast(line_no as varchar(20)) || '   443   owner'
  when line_no % 25 between 17 and 20 and doc_id % 3 = 0 then 'Severity of a finding of ' || cast(2015 + line_no % 10 as varchar(20)) || '.'
  when line_no % 25 in (21, 22, 23, 24) and doc_id % 5 = 1 then cast(line_no as varchar(20)) || '. You must follow the policy'
  when line_no % 31 = 0 then 'unit' || cast(doc_id % 7 as varchar(20)) || ' keepsake ' || case doc_id % 7 when 0 then 'alpha' when 1 then 'bravo' when 2 then 'charlie' else 'delta' end
  else line end
"""


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, line of reports."""
    return lines(spark, sf_dir).select("doc_id", "line_no", F.expr(REPORT_LINE).alias("line"))
