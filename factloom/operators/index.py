"""An inverted index of claims, written once, and BM25 searches over all documents that stop early."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.sources.facts_io import stored

K1, B = 1.2, 0.75
#: Postings of a part, postings of a term that are ranked in one task, folders of the index, facts of an answer's base.
PART, RANKED, BUCKETS = 1_024, 1_000_000, 64
#: Candidates that are broadcast; more meet their postings by shuffle.
BROADCAST = 200_000
PARTS = "term string, salt long, level long, top double, postings array<struct<doc_id: long, fact_no: long, weight: double>>, bucket int"
#: Scores are compared with so many decimals, so that the order of additions decides nothing.
DECIMALS = 9


def terms_of(text: Column) -> Column:
    """Runs of letters a to z and digits, in small letters, with repeats; none of a null text."""
    found = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    return F.coalesce(found, F.array().cast("array<string>"))


def idf(n: int, df: Column) -> Column:
    return F.log(1 + (F.lit(float(n)) - df + 0.5) / (df + 0.5))


@dataclass
class ClaimIndex:
    """facts: their number; parts, terms: tables of write_index."""

    facts: int
    parts: DataFrame
    terms: DataFrame


def write_index(facts: DataFrame, path: str, part: int = PART, ranked: int = RANKED) -> ClaimIndex:
    """The index of the claims of facts (doc_id, fact_no, claim) under a new folder.

    terms: term and df (facts that hold it). parts: a term's postings (doc_id, fact_no, weight), at most `part` of them, the
    heaviest in level 0, with the greatest weight as top. weight is the factor of BM25 that depends on the fact alone.
    A term of more than `ranked` facts is ranked in several tasks, each with levels of its own. Rows that repeat doc_id and
    fact_no are one fact. A claim without terms counts as a fact, but is never found.
    """
    spark = facts.sparkSession
    keys = (F.col(c).cast("long").alias(c) for c in ("doc_id", "fact_no"))
    lengths = facts.groupBy(*keys).agg(F.flatten(F.collect_list(terms_of(F.col("claim")))).alias("l"))
    lengths = stored(lengths.withColumn("size", F.size("l")), "claims")
    n, mean = lengths.agg(F.count("*"), F.avg("size")).first()
    mean = mean or 1.0
    tf = lengths.select("doc_id", "fact_no", "size", F.explode("l").alias("term")).groupBy("doc_id", "fact_no", "size", "term").agg(F.count("*").alias("tf"))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / mean))
    postings = stored(tf.select("term", "doc_id", "fact_no", weight.alias("weight")), "postings")
    terms = stored(postings.groupBy("term").agg(F.count("*").alias("df")), "terms")
    common = terms.where(F.col("df") > ranked).select("term", F.ceil(F.col("df") / ranked).alias("salts"))  # no more than all postings by `ranked`
    salted = postings.join(F.broadcast(common), "term", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "fact_no"), F.coalesce("salts", F.lit(1))))
    turn = F.row_number().over(Window.partitionBy("term", "salt").orderBy(F.desc("weight"), "doc_id", "fact_no")) - 1
    levels = salted.withColumns({"level": F.floor(turn / part), "bucket": F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")})
    packed = levels.groupBy("bucket", "term", "salt", "level").agg(
        F.max("weight").alias("top"), F.collect_list(F.struct("doc_id", "fact_no", "weight")).alias("postings")
    )
    packed.repartition("bucket").sortWithinPartitions("term", "level").write.partitionBy("bucket").parquet(f"{path}/parts")
    terms.write.parquet(f"{path}/terms")
    spark.createDataFrame([(n,)], "facts long").write.parquet(f"{path}/size")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> ClaimIndex:
    return ClaimIndex(spark.read.parquet(f"{path}/size").first()[0], spark.read.schema(PARTS).parquet(f"{path}/parts"), spark.read.schema("term string, df long").parquet(f"{path}/terms"))


def search(index: ClaimIndex, question: str, k: int = 10) -> DataFrame:
    """doc_id, fact_no, score, rank: the k facts of the highest BM25 score, ties by doc_id and fact_no; facts without a term of
    the question are never found, and a term that is repeated counts once.

    Levels of postings are read from the heaviest on, twice as many each time, until no fact that isn't yet seen can reach
    the k-th best score so far; then only facts that still can are looked up in the rest. All facts are covered at any k.
    """
    spark = index.parts.sparkSession
    asked = spark.range(1).select(F.explode(F.array_distinct(terms_of(F.lit(question)))).alias("term"))
    words = [r[0] for r in asked.collect()]
    known = index.terms.where(F.col("term").isin(words)).select("term", idf(index.facts, F.col("df")).alias("idf")).collect()
    weight = F.coalesce(*(F.when(F.col("term") == r.term, F.lit(r.idf)) for r in known), F.lit(0.0))
    buckets = [r[0] for r in asked.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS))).collect()]
    mine = index.parts.where(F.col("bucket").isin(buckets) & F.col("term").isin([r.term for r in known]))
    none = spark.createDataFrame([], "doc_id long, fact_no long, score double, rank int")
    if not known:
        return none

    def points(parts: DataFrame) -> DataFrame:
        rows = parts.select(weight.alias("idf"), F.explode("postings").alias("p"))
        return rows.select("p.doc_id", "p.fact_no", (F.col("idf") * F.col("p.weight")).alias("points"))

    read = 1
    while True:
        partial = points(mine.where(F.col("level") < read)).groupBy("doc_id", "fact_no").agg(F.sum("points").alias("points"))
        kth = [r[0] for r in partial.select("points").orderBy(F.desc("points")).limit(k).collect()]
        rest = mine.where(F.col("level") >= read).groupBy("term").agg((F.max("top") * F.first(weight)).alias("most")).agg(F.sum("most")).first()[0]
        least = kth[-1] if len(kth) == k else 0.0
        if rest is None or least - rest > 10.0**-DECIMALS:
            break
        read *= 2
    if rest is not None:
        able = stored(partial.where(F.col("points") + rest >= least - 10.0**-DECIMALS), "able")
        keys = able.select("doc_id", "fact_no")
        keys = F.broadcast(keys) if keys.limit(BROADCAST + 1).count() <= BROADCAST else keys
        more = points(mine.where(F.col("level") >= read)).join(keys, ["doc_id", "fact_no"], "left_semi")
        partial = able.union(more).groupBy("doc_id", "fact_no").agg(F.sum("points").alias("points"))
    best = partial.select("doc_id", "fact_no", F.round("points", DECIMALS).alias("score")).orderBy(F.desc("score"), "doc_id", "fact_no").limit(k)
    turn = F.row_number().over(Window.orderBy(F.desc("score"), "doc_id", "fact_no"))  # k rows
    return best.withColumn("rank", turn)


def answer(index: ClaimIndex, facts: DataFrame, question: str, k: int = 5) -> DataFrame:
    """question, answer, confidence, hits: the claims of the k best facts of all documents, each with its citation
    [Fact doc:no], and High with three facts or more, Medium with one or two, Low without any."""
    best = stored(search(index, question, k), "best")
    text = F.concat("claim", F.lit(" [Fact "), F.col("doc_id").cast("string"), F.lit(":"), F.col("fact_no").cast("string"), F.lit("]"))
    said = facts.join(F.broadcast(best.select("doc_id", "fact_no", "rank")), ["doc_id", "fact_no"]).groupBy("doc_id", "fact_no", "rank").agg(F.min(text).alias("text"))
    rows = said.agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("l"), F.count("*").alias("hits"))
    confidence = F.when(F.col("hits") >= 3, "High").when(F.col("hits") > 0, "Medium").otherwise("Low")
    return rows.select(F.lit(question).alias("question"), F.array_join(F.col("l.text"), " ").alias("answer"), confidence.alias("confidence"), "hits")
