"""Agreement between runs, similar facts and their groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.measures import measure
from factloom.functions.patterns import quantities
from factloom.operators.cosine import close_vectors, cosine, usable
from factloom.sources.facts_io import stored


def _close(vectors: DataFrame, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that have a cosine, their different vectors (the smallest id stands for equal ones), close pairs of these."""
    rows = stored(usable(vectors), "usable")
    distinct = rows.groupBy("key").agg(F.first("kind").alias("kind"), F.first("vector").alias("vector"), F.min("vec_id").alias("first"))
    distinct = stored(distinct, "distinct")
    return rows, distinct, close_vectors(distinct, least)


def similar_facts(vectors: DataFrame, least: float = 0.85) -> DataFrame:
    """a, b, cosine: every pair (a < b) within a label whose cosine is at least `least`.

    Equal vectors are compared once and their rows paired afterwards. Vectors of another width, of
    zeros or with a component that is null or not finite have no cosine.
    """
    rows, distinct, close = _close(vectors, least)
    close = stored(close, "close")
    ids = rows.select("key", "vec_id")
    of = lambda s: ids.select(F.col("key").alias(f"key_{s}"), F.col("vec_id").alias(s))
    apart = close.join(of("a"), "key_a").join(of("b"), "key_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine")
    same = distinct.select("key", cosine(F.col("vector"), F.col("vector")).alias("cosine")).where(F.col("cosine") >= least)
    same = same.join(ids.withColumnRenamed("vec_id", "a"), "key").join(ids.withColumnRenamed("vec_id", "b"), "key").select("a", "b", "cosine")
    # An id that stands at several vectors has its best cosine
    return apart.union(same).where("a < b").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def similar_links(vectors: DataFrame, least: float = 0.85) -> DataFrame:
    """a, b: links that join the same rows into groups as similar_facts, without all pairs of equal vectors."""
    rows, distinct, close = _close(vectors, least)
    of = lambda s: distinct.select(F.col("key").alias(f"key_{s}"), F.col("first").alias(s))
    apart = close.join(of("a"), "key_a").join(of("b"), "key_b").select("a", "b")
    same = distinct.where(cosine(F.col("vector"), F.col("vector")) >= least).select("key", F.col("first").alias("a"))
    return apart.union(same.join(rows, "key").select("a", F.col("vec_id").alias("b"))).where("a <> b")


def fact_clusters(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, cluster: connected groups by the smallest id reachable; nodes without a pair are their own."""
    both = pairs.select("a", "b").union(pairs.select("b", "a")).distinct()
    both = stored(both, "links")
    labels = stored(nodes.select(F.col("node"), F.col("node").alias("cluster")), "clusters")
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("cluster").alias("least"))
        step = labels.join(around, "node", "left").select("node", F.least("cluster", F.coalesce("least", "cluster")).alias("cluster"))
        # follow the label's own label, which halves the distance left
        via = step.select(F.col("node").alias("via"), F.col("cluster").alias("root"))
        new = step.join(via, step["cluster"] == via["via"]).select("node", F.col("root").alias("cluster"))
        new = stored(new, "clusters")
        changed = new.join(labels.withColumnRenamed("cluster", "old"), "node").where("cluster <> old").limit(1).count()
        labels = new
        if not changed:
            return labels


def centroids(clusters: DataFrame, vectors: DataFrame) -> DataFrame:
    """cluster, size and centroid: the mean vector of a cluster's members, component by component.

    clusters: node, cluster; vectors: vec_id, embedding. Vectors that have no cosine are left out, and so are those whose
    width differs from that of the cluster's first vector. Members are summed in parts before they are shuffled.
    """
    rows = clusters.join(_vectors(vectors), clusters["node"] == F.col("vec_id")).select("cluster", "node", "vector")
    width = rows.groupBy("cluster").agg(F.min(F.struct("node", F.size("vector").alias("w"))).alias("m")).select("cluster", F.col("m.w").alias("w"))
    rows = rows.join(width, "cluster").where(F.size("vector") == F.col("w"))
    each = rows.select("cluster", F.posexplode("vector").alias("at", "x")).groupBy("cluster", "at").agg(F.avg("x").alias("mean"), F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "mean")))  # as many as a vector has components
    return each.groupBy("cluster").agg(F.max("n").alias("size"), ordered.alias("l")).select("cluster", "size", F.col("l.mean").alias("centroid"))


def _vectors(vectors: DataFrame) -> DataFrame:
    """One vector of each vec_id: the least that has a cosine."""
    return usable(vectors).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def medoids(clusters: DataFrame, vectors: DataFrame) -> DataFrame:
    """cluster, size, centroid, medoid, distance: the member nearest to the centroid (the smallest id of several, up to rounding)."""
    centres = stored(centroids(clusters, vectors), "centroids")
    rows = clusters.join(_vectors(vectors), clusters["node"] == F.col("vec_id")).select("cluster", "node", "vector").join(centres, "cluster")
    square = F.aggregate(F.zip_with("vector", "centroid", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    rows = rows.where(F.size("vector") == F.size("centroid")).withColumn("distance", F.round(F.sqrt(square), 9))
    best = rows.groupBy("cluster").agg(F.min(F.struct("distance", "node")).alias("m"))
    return centres.join(best, "cluster").select("cluster", "size", "centroid", F.col("m.node").alias("medoid"), F.col("m.distance").alias("distance"))


def consensus_facts(runs: DataFrame, instances: int, least: float = 0.8) -> DataFrame:
    """Claims by document with support_count, support and whether enough runs agree; a null claim is none.

    fact_no, source_location and evidence_quote are those of the representative: the surest fact, then the first, then that
    of the first run.
    """
    seen = runs.where("claim is not null").groupBy("doc_id", "claim")
    surest = F.min(F.struct((-F.col("confidence")).alias("c"), "fact_no", "instance_id", "source_location", "evidence_quote")).alias("r")
    rows = seen.agg(F.countDistinct("instance_id").alias("support_count"), F.max("confidence").alias("confidence"), surest)
    rows = rows.select("doc_id", "claim", "support_count", "confidence", "r.fact_no", "r.source_location", "r.evidence_quote")
    rows = rows.withColumn("support", F.col("support_count") / instances)
    return rows.withColumn("is_consensus", F.col("support") >= least)


def outlier_facts(consensus: DataFrame) -> DataFrame:
    return consensus.where("not is_consensus")


def measured(facts: DataFrame) -> DataFrame:
    """doc_id, fact_no, claim, value, scale, low, high: the quantities in claims that have a place on a scale; repeats of a value count once."""
    found = facts.select("doc_id", "fact_no", "claim", F.explode(F.array_distinct(quantities(F.col("claim")))).alias("q"))
    rows = found.withColumn("m", measure(F.col("q.value"), F.col("q.type"))).where("m is not null")
    return rows.select("doc_id", "fact_no", "claim", F.col("q.value").alias("value"), "m.scale", "m.low", "m.high").distinct()


def subject(claim: Column) -> Column:
    """The words of a claim, sorted, without numbers and what counts, so that claims of one thing meet whatever they say of it."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(claim, F.lit(""))), r"[^a-z]+"))
    return F.array_sort(F.filter(words, lambda w: (w != "") & ~w.isin(*MEASURES)))


# Words that state or introduce a quantity.
MEASURES = (
    "daily weekly monthly quarterly annually yearly continuous continuously ongoing real time every each per times at least within than more less greater fewer over above below"
    " approximately exceeds percent second seconds minute minutes hour hours day days week weeks month months quarter quarters year years business and for with"
).split()


def contradictions(facts: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, scale, group_claim, facts, statements, low, high, low_value, high_value: claims of a document about one subject
    whose quantities on a scale have nothing in common.

    Claims are of one subject if their words without quantities (see subject) are near duplicates, as in semantic_dedup,
    linked directly or through others; group_claim is the least claim. Within a group and scale the quantities contradict if the
    greatest lower end is above the least upper end. low_value is the value of the least upper end, high_value that of the
    greatest lower end; of several the least. facts counts facts, statements different values.
    """
    said = stored(measured(facts), "measured")
    words = said.select("doc_id", "claim", subject(F.col("claim")).alias("words")).distinct()
    groups = _near_groups(words, percent)
    rows = said.join(groups, ["doc_id", "claim"])
    # struct comparison takes the value along with its end
    found = rows.groupBy("doc_id", "_group", "scale").agg(
        F.min("claim").alias("group_claim"),
        F.countDistinct("fact_no").alias("facts"),
        F.countDistinct("value").alias("statements"),
        F.min(F.struct("high", "value")).alias("least"),
        F.min(F.struct((-F.col("low")).alias("low"), "value")).alias("most"),
    )
    found = found.select(
        "doc_id", "scale", "group_claim", "facts", "statements", F.col("least.high").alias("low"), (-F.col("most.low")).alias("high"),
        F.col("least.value").alias("low_value"), F.col("most.value").alias("high_value"),
    )
    return found.where(F.col("low") < F.col("high"))


#: Buckets of words that are counted for each document.
BUCKETS = 512


def _near_groups(sets: DataFrame, percent: int) -> DataFrame:
    """doc_id, claim, _group for rows of doc_id, claim and words (a sorted set): sets of a document that links reach.

    Sets are linked if 100 * |A and B| >= percent * |A or B|; only sets that share one of their rarest words can be, so
    only they are compared. Equal sets are one; empty ones are one group of a document.

    How rare a word is goes by counts of buckets of words, one array of a fixed size for each document, so that words
    aren't shuffled one by one. Words are compared by hashes where they meet; what passes is compared by words.
    """
    doc = F.coalesce(F.concat(F.lit("+"), F.col("doc_id").cast("string")), F.lit("-"))
    key = F.substring(F.unhex(F.sha2(F.concat_ws("\n", doc, F.array_join("words", " ")), 256)), 1, 16)
    named = stored(sets.select("doc_id", "claim", doc.alias("doc"), key.alias("_node"), "words"), "claims")
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    distinct = named.groupBy("_node").agg(F.first("doc").alias("doc"), F.first(hashes).alias("words"))
    distinct = stored(distinct, "sets")
    bucket = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    counts = distinct.select("doc", F.explode("words").alias("h")).groupBy("doc", bucket(F.col("h")).alias("at")).agg(F.count("*").alias("c"))
    counts = counts.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("at", "c"))).alias("m"))  # at most BUCKETS
    counts = counts.select("doc", F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0))).alias("counts"))
    ranked = F.array_sort(F.transform("words", lambda h: F.struct(F.get("counts", bucket(h)).alias("c"), h.alias("h"))))
    n = F.size("words")
    first = F.slice("ranked", 1, F.greatest(F.lit(0), n - F.expr(f"({percent} * size(words) + 99) div 100").cast("int") + 1))
    rows = distinct.join(counts, "doc").select("doc", "_node", "words", ranked.alias("ranked"))
    rows = rows.select("doc", "_node", "words", n.alias("n"), F.posexplode(first).alias("at", "rare")).where("rare.c > 1")
    rows = stored(rows.select("doc", F.col("rare.h").alias("word"), "_node", "n", "at", "words"), "rare")
    other = rows.select("doc", "word", *(F.col(c).alias(f"{c}_b") for c in ("_node", "n", "at", "words")))
    pairs = rows.join(other, ["doc", "word"]).where(f"_node < _node_b and 100 * least(n, n_b) >= {percent} * greatest(n, n_b)")
    # at the first word that two sets share, what follows it bounds what they can share
    pairs = pairs.where(f"(100 + {percent}) * (least(n - at, n_b - at_b)) >= {percent} * (n + n_b)")
    met = F.size(F.array_intersect("words", "words_b"))
    pairs = pairs.where((100 + percent) * met >= percent * (F.col("n") + F.col("n_b"))).select(F.col("_node").alias("a"), F.col("_node_b").alias("b")).distinct()
    # words come back only for these
    shared = F.size(F.array_intersect("words_a", "words_b"))
    pairs = stored(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("_node")).union(pairs.select("b")).distinct()
    meant = stored(named.join(ends, "_node", "left_semi").groupBy("_node").agg(F.first("words").alias("words")), "words")
    held = lambda s: meant.select(F.col("_node").alias(s), F.col("words").alias(f"words_{s}"))
    links = pairs.join(held("a"), "a").join(held("b"), "b").where(100 * shared >= percent * (F.size("words_a") + F.size("words_b") - shared))
    links = stored(links.select("a", "b"), "near")
    linked = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    groups = fact_clusters(links, linked).select(F.col("node").alias("_node"), F.col("cluster").alias("_group"))
    rows = named.join(groups, "_node", "left").withColumn("_group", F.coalesce("_group", "_node"))
    return rows.select("doc_id", "claim", "_group").distinct()


def semantic_dedup(facts: DataFrame, percent: int = 80) -> DataFrame:
    """One fact of each document and group of near-duplicate claims: the surest, then the first.

    Claims are linked if 100 * |A and B| >= percent * |A or B| for their sets of lower-case words, and
    a group is what links reach. A null claim counts as empty; claims without words are one group.
    """
    claim = F.coalesce("claim", F.lit(""))
    words = F.array_remove(F.array_sort(F.array_distinct(F.split(F.lower(claim), r"\W+"))), "")
    sets = facts.select("doc_id", claim.alias("claim"), words.alias("words")).distinct()
    groups = _near_groups(sets, percent).select(F.col("doc_id").alias("_doc"), F.col("claim").alias("_claim"), "_group")
    rows = facts.join(groups, F.col("doc_id").eqNullSafe(F.col("_doc")) & (claim == F.col("_claim")), "left")
    best = Window.partitionBy("_group").orderBy(F.desc("confidence"), "fact_no")
    return rows.withColumn("_turn", F.row_number().over(best)).where("_turn = 1").drop("_doc", "_claim", "_group", "_turn")


def control_graph(facts: DataFrame) -> DataFrame:
    """doc_id, control_id, facts, first_fact, last_fact: facts meet at the controls they name (a star for each control)."""
    return control_links(facts).groupBy("doc_id", "control_id").agg(F.count("*").alias("facts"), F.min("fact_no").alias("first_fact"), F.max("fact_no").alias("last_fact"))


def control_links(facts: DataFrame) -> DataFrame:
    """doc_id, fact_no, control_id: the edges of the graph of facts and controls, each once."""
    return facts.select("doc_id", "fact_no", F.explode(F.array_distinct("related_control_ids")).alias("control_id")).where("control_id is not null").distinct()


def related_facts(starts: DataFrame, links: DataFrame, hops: int = 2) -> DataFrame:
    """doc_id, start_fact, fact_no, hops: the facts that a start reaches through controls that facts share, with the least
    number of hops (a hop is a control); a start itself has 0.

    starts: doc_id, fact_no. links: see control_links. The frontier goes from facts to controls and on to facts; a control
    is expanded once for each start, when it is first reached, so no control yields pairs of all its facts.
    """
    seen = stored(starts.select("doc_id", F.col("fact_no").alias("start_fact"), "fact_no", F.lit(0).alias("hops")).distinct(), "reached")
    frontier, used = seen, None
    for hop in range(1, hops + 1):
        controls = frontier.join(links, ["doc_id", "fact_no"]).select("doc_id", "start_fact", "control_id").distinct()
        if used is not None:
            controls = controls.join(used, ["doc_id", "start_fact", "control_id"], "left_anti")
        controls = stored(controls, "controls")
        used = controls if used is None else used.union(controls)
        found = controls.join(links, ["doc_id", "control_id"]).select("doc_id", "start_fact", "fact_no").distinct()
        frontier = stored(found.join(seen, ["doc_id", "start_fact", "fact_no"], "left_anti").withColumn("hops", F.lit(hop)), "frontier")
        seen = seen.union(frontier)
    return seen


def answer_report(consensus: DataFrame, contradicted: DataFrame) -> DataFrame:
    """By document: claims, how many agree, mean support, contradictions."""
    rows = consensus.groupBy("doc_id").agg(
        F.count("*").alias("claims"), F.sum(F.col("is_consensus").cast("int")).alias("agreed"), F.avg("support").alias("mean_support")
    )
    against = contradicted.groupBy("doc_id").agg(F.count("*").alias("contradictions"))
    return rows.join(against, "doc_id", "left").withColumn("contradictions", F.coalesce("contradictions", F.lit(0)))
