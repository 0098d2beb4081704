"""Secret scans: candidates by pattern, false positives removed by a random forest.

DataFrame functions and Spark's own forest only. Labelled findings are those whose label their own
form gives away (issuer prefixes; identifiers, dates and plain words), and a table of prototypes;
the forest then decides about all others from length, character transitions, dictionary coverage,
path and neighbouring words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import maybe_broadcast, written

#: Words before an equals sign or colon that announce a credential.
KEYWORD = r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth|bearer)"
#: Assigned values of any form; otherwise runs of 12 and more characters of an encoding that hold a digit.
CANDIDATE = (
    KEYWORD + r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?[^\s\"'<>,;]{6,}"
    r"|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}-----END [A-Z ]{0,30}PRIVATE KEY-----"
    r"|(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{12,}={0,2}"
)
ASSIGNED = r"^" + KEYWORD + r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?"
#: Characters around a candidate whose words are its neighbours.
AROUND = 60
#: Pieces of a text whose lengths are summed together.
STRIDE = 256
#: The forest is fitted on at most so many labelled findings, those with the least hash.
LABELLED = 20_000
TREES, DEPTH = 20, 6
#: Neighbouring words seen with this many findings count as dictionary words.
FAMILIAR = 3

ISSUED = (
    r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_\-]{30,}"
    r"|sk_(?:live|test)_[A-Za-z0-9]{16,}|glpat-[A-Za-z0-9_\-]{16,}|eyJ[A-Za-z0-9_\-]{20,}|-----BEGIN [\s\S]*)$"
)
HARMLESS = (
    r"^(?:[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9+/_\-]+|[A-Za-z_\-]+"
    r"|[A-Za-z]+[-_/][A-Za-z]+[-_/][A-Za-z0-9_/\-]*|[A-Za-z]{4,}[0-9]{1,4})={0,2}$"
)
FEATURES = [
    "length", "digits", "uppers", "lowers", "others", "transitions", "distinct", "longest_run",
    "dictionary", "in_path", "slashes", "keyword_before", "assigned", "quoted", "closed",
]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, ordinal, start (0-based character), value, and the text around every candidate.

    Only texts with a candidate get past the first filter. The text is cut at its candidates into
    pieces (others, candidate, others, ...), and offsets and neighbours come from the pieces' lengths
    and ends, so the work is linear in the text however many candidates it has, and no row carries it.
    """
    text = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    found = text.withColumn("hits", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).where("size(hits) > 0")
    found = found.select("doc_id", "hits", F.split("text", CANDIDATE, -1).alias("gaps"))
    # the length of a text up to each candidate: of whole runs of STRIDE before it, and of the rest one by one
    found = found.withColumn("steps", F.expr("transform(gaps, (g, i) -> length(g) + if(i = 0, 0, length(hits[i - 1])))"))
    run = f"aggregate(slice(steps, r * {STRIDE} + 1, {STRIDE}), 0, (t, n) -> t + n)"
    found = found.withColumn("runs", F.expr(f"transform(sequence(0, (size(steps) - 1) div {STRIDE}), r -> {run})"))
    found = found.withColumn("ahead", F.expr("transform(runs, (x, r) -> aggregate(slice(runs, 1, r), 0, (t, n) -> t + n))"))
    rest = f"aggregate(slice(steps, (i div {STRIDE}) * {STRIDE} + 1, i % {STRIDE} + 1), 0, (t, n) -> t + n)"
    found = found.withColumn("leads", F.transform("hits", lambda m: F.length(F.regexp_extract(m, ASSIGNED, 0))))
    for end, cut in (("heads", f"left({{}}, {AROUND})"), ("tails", f"right({{}}, {AROUND})")):
        pair = f"array({cut.format('g')}, {cut.format('coalesce(get(hits, i), \'\')')})"
        found = found.withColumn(end, F.expr(f"flatten(transform(gaps, (g, i) -> {pair}))"))
    # a candidate has 6 characters at least, so these pieces hold AROUND characters or reach the end of the text
    near = 2 * (AROUND // 6 + 1) + 1
    before = f"concat(array_join(slice(tails, greatest(1, 2 * i + 2 - {near}), least(2 * i + 1, {near})), ''), left(m, leads[i]))"
    after = f"array_join(slice(heads, 2 * i + 3, {near}), '')"
    spots = (
        f"transform(hits, (m, i) -> named_struct('ordinal', i, 'start', ahead[i div {STRIDE}] + {rest} + leads[i],"
        " 'value', substring(m, leads[i] + 1), 'assigned', if(leads[i] > 0, 1, 0),"
        f" 'before', right({before}, {AROUND}), 'after', left({after}, {AROUND})))"
    )
    return found.select("doc_id", F.explode(F.expr(spots)).alias("spot")).select("doc_id", "spot.*")


def _letters(column: str) -> Column:
    return F.regexp_extract_all(F.lower(F.col(column)), F.lit(r"\p{L}{3,}"), F.lit(0))


def _key() -> list[str]:
    return ["doc_id", "ordinal", "start", "value"]


def described(found: DataFrame) -> DataFrame:
    """The features of candidates. The dictionary is the vocabulary of all their neighbourhoods."""
    around = F.array_distinct(F.concat(_letters("before"), _letters("after")))
    seen = found.select(F.explode(around).alias("word")).groupBy("word").agg(F.count("*").alias("k"))
    familiar = seen.where(f"k >= {FAMILIAR}").select("word")
    parts = found.select(F.xxhash64("value").alias("v"), F.explode(_letters("value")).alias("word"))
    covered = parts.distinct().join(familiar, "word").groupBy("v").agg(F.sum(F.length("word")).alias("covered"))

    n = F.length("value")
    share = lambda chars: F.length(F.regexp_replace("value", f"[^{chars}]", "")) / n
    kind = F.expr(
        "translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
        "value, '[0-9]', '\\u0001'), '[a-z]', '\\u0002'), '[A-Z]', '\\u0003'), '[^\\u0001-\\u0003]', '\\u0004'),"
        " '\\u0001\\u0002\\u0003\\u0004', '0aA-')"
    )
    rows = found.withColumn("kind", kind).withColumn("v", F.xxhash64("value"))
    runs = F.regexp_extract_all("kind", F.lit(r"(0+|a+|A+|-+)"), F.lit(1))
    rows = rows.select(
        *_key(),
        "before",
        "v",
        F.col("assigned").cast("double").alias("assigned"),
        n.cast("double").alias("length"),
        share("0-9").alias("digits"),
        share("A-Z").alias("uppers"),
        share("a-z").alias("lowers"),
        (1 - share("A-Za-z0-9")).alias("others"),
        (F.size(runs) / n).alias("transitions"),
        (F.size(F.array_distinct(F.split("value", ""))) / n).alias("distinct"),
        (F.array_max(F.transform(runs, lambda r: F.length(r))) / n).alias("longest_run"),
        F.col("before").rlike(r"(?:://|[/\\.@#?&])[^\s]*$").cast("double").alias("in_path"),
        (F.length("value") - F.length(F.translate("value", "/", ""))).cast("double").alias("slashes"),
        F.col("before").rlike(KEYWORD + r"\W{0,12}$").cast("double").alias("keyword_before"),
        F.col("before").rlike(r"[\"'=:`(]$").cast("double").alias("quoted"),
        F.col("after").rlike(r"^[\"'`;),]|^\s|^$").cast("double").alias("closed"),
    )
    return rows.join(covered, "v", "left").withColumn(
        "dictionary", F.least(F.lit(1.0), F.coalesce(F.col("covered"), F.lit(0)) / F.col("length"))
    )


def own_label() -> Column:
    """1 or 0 where the form of a finding gives its label away, else null."""
    value, before = F.col("value"), F.col("before")
    random_hex = value.rlike(r"^[0-9a-f]{16,}$|^[A-Za-z0-9+/_\-]{20,}={0,2}$") & (F.col("digits") >= 0.1)
    credential = (F.col("assigned") == 1) & (value.rlike(r"[0-9]") | (F.col("transitions") > 0.3)) & (F.col("distinct") > 0.2)
    return (
        F.when(value.rlike(ISSUED), 1.0)
        .when(value.rlike(r"(?i)example|sample|dummy|placeholder|changeme|x{4,}|0{6,}|\*{3,}|<|\$\{"), 0.0)
        .when(credential & random_hex, 1.0)
        .when(value.rlike(HARMLESS) & (F.col("assigned") == 0), 0.0)
        .when((F.col("in_path") == 1) & (F.col("keyword_before") == 0) & before.rlike(r"://[^\s]*$"), 0.0)
    )


def prototypes(spark: SparkSession) -> DataFrame:
    """Labelled findings made by rule from the numbers 0 to 599, so that both labels always occur."""
    h = F.expr("sha2(cast(id as string), 256)")
    b = F.base64(F.unhex(h))
    word = F.element_at(F.array(*map(F.lit, "report section release chapter invoice account".split())), (F.col("id") % 6 + 1).cast("int"))
    alike = [
        (F.upper(F.concat(F.lit("AKIA"), F.substring(h, 1, 16))), "the key ", 0, 1.0),
        (F.substring(h, 1, 40), "token = \"", 1, 1.0),
        (F.substring(h, 1, 18), "password=", 1, 1.0),
        (F.regexp_replace(F.substring(b, 1, 32), "[+/=]", "x"), "secret: ", 1, 1.0),
        (F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), "id ", 0, 0.0),
        (F.concat(word, F.lit("-"), word, F.lit("-"), F.col("id").cast("string")), "see https://example.com/", 0, 0.0),
        (F.concat(F.lit("20"), F.format_string("%02d-%02d-%02d", F.col("id") % 90 + 10, F.col("id") % 12 + 1, F.col("id") % 28 + 1), F.lit("T10")), "on ", 0, 0.0),
        (F.concat(word, word, F.col("id").cast("string")), "in the ", 0, 0.0),
        (F.substring(h, 1, 40), "commit https://example.com/tree/", 0, 0.0),
        (F.concat(F.lit("changeme"), F.col("id").cast("string")), "password=", 1, 0.0),
    ]
    made = [
        spark.range(0, 600, 1, 1).where(f"id % {len(alike)} = {i}").select(
            (-1 - F.col("id")).alias("doc_id"), F.lit(0).alias("ordinal"), F.lit(0).alias("start"), value.alias("value"),
            F.lit(assigned).alias("assigned"), F.lit(before).alias("before"), F.lit(" of the report section").alias("after"),
            F.lit(label).alias("label"),
        )
        for i, (value, before, assigned, label) in enumerate(alike)
    ]
    return reduce(DataFrame.unionByName, made).coalesce(1)


def fit(features: DataFrame, most: int = LABELLED) -> PipelineModel:
    """A forest fitted on at most `most` rows with a label, in an order that doesn't vary from run to run."""
    order = [F.xxhash64("value", "doc_id", "start"), "value", "doc_id", "start"]
    sample = features.where("label is not null").orderBy(*order).limit(most).coalesce(1)
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=3, seed=7
    )
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(sample)


def findings(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, n_chars, value and probability of every secret that the forest lets stand.

    docs: doc_id and text; other columns are ignored. A null or empty text has none; repeated rows
    give their findings again; an empty table gives none. labelled: more labelled findings, with the
    columns of candidates() and label (0.0 or 1.0), besides those that label themselves.
    """
    spark = docs.sparkSession
    key = docs.schema["doc_id"].dataType.simpleString()
    found = written(candidates(docs), "candidates").withColumn("label", F.lit(None).cast("double"))
    known = prototypes(spark) if labelled is None else prototypes(spark).unionByName(labelled.select(*found.columns))
    known = known.withColumn("doc_id", F.col("doc_id").cast(key))
    rows = described(found.drop("label")).withColumn("label", own_label())
    fixed = described(known.drop("label")).join(known.select(*_key(), "label"), _key())
    rows = written(rows, "features")
    model = fit(rows.select(*_key(), *FEATURES, "label").unionByName(fixed.select(*_key(), *FEATURES, "label")))
    scored = model.transform(rows).select(
        "doc_id", "start", F.length("value").alias("n_chars"), "value", vector_to_array("probability")[1].alias("probability")
    )
    return scored.where(F.col("probability") >= threshold)


def redacted(docs: DataFrame, found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every occurrence of its findings' values replaced by a mark, and n_chars to match.

    Longer values go first, so that a value within another can't spoil it. All rows and columns stay;
    a null text or doc_id stays as it is, and rows that repeat a doc_id lose the values of all of them.
    """
    values = found.groupBy(F.col("doc_id").alias("doc")).agg(
        F.reverse(F.array_sort(F.collect_set(F.struct(F.length("value").alias("n"), "value")))).alias("values")
    )
    # the columns of docs travel in a struct, so that no name of theirs can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own"), F.col("text").cast("string").alias("text"))
    joined = rows.join(maybe_broadcast(values, 100_000), F.col("own") == F.col("doc"), "left")
    clean = F.expr(f"if(values is null, text, aggregate(values, text, (t, v) -> replace(t, v.value, '{mark}')))")
    joined = joined.withColumn("text", clean)
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return joined.select(*(own.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
