"""Registered queries of the numbered operators and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import align, bpe, decontaminate, ego, html_text, language, neardup, nearest, repair, reshard, secrets, toxicity, warc
from factloom.llm.common import table
from factloom.llm.stages import tokenizer


def op1_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_of(spark, table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer())


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings without their values: a digest stands for each."""
    found = secrets.findings(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256")
    return found.select("doc_id", "start", "n_chars", digest, F.round("probability", 6).alias("probability"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).drop("url")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(nearest.usable(table(spark, sf_dir, "embeddings")), F.expr("vec_id % 20 = 0"))


def op6_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshard.resharded(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_of(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.token_alignment(table(spark, sf_dir, "documents"))


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego.near_vectors(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damaged_and_repaired(table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_minhash_neardup,
        op2_language_id,
        op3_byte_bpe,
        op4_decontamination,
        op5_html_text,
        op6_reshard,
        op7_toxicity,
        op8_secret_scan,
        op9_warc,
        op10_nearest,
        op11_token_alignment,
        op12_near_vectors,
        op13_conversation_repair,
    )}


#: All pairs of documents that share a shingle, exactly, and the groups that links make.
NEAR_DUPLICATES = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as l from documents),
s as (select doc_id, unnest(list_distinct(case when len(l) < 2 then l else list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]) end)) as sh from w),
n as (select doc_id, count(sh) as n from w left join s using (doc_id) group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
e as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * k >= 80 * (nx.n + ny.n - k)),
u as (select x as a, y as b from e union all select y, x from e),
r(node, root) as (select doc_id, doc_id from w union select u.b, r.root from r join u on u.a = r.node)
select doc_id, any_value(n) as n_shingles, min(root) as component_id, doc_id = min(root) as kept from r join n on n.doc_id = r.node group by doc_id
"""

#: The records that archives of these pages must hold.
ARCHIVED = """
with p as (select page_id, coalesce(html, '') as payload from pages),
d as (select page_id, strlen(payload) as payload_bytes, sha1(payload) as payload_digest from p),
g as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as first from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and first <> page_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and first <> page_id then first end as refers_to
from g
"""


def oracle_sql() -> dict:
    return {"op1_minhash_neardup": NEAR_DUPLICATES, "op9_warc": ARCHIVED}
