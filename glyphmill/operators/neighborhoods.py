"""Soft cluster membership, related buckets, and the searches that route by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.functions import tokens
from glyphmill.functions.lexicon import GENERAL, SLOT_WEIGHTS
from glyphmill.functions.storage import settle
from glyphmill.operators.bm25 import ranked
from glyphmill.operators.search import ZONE, clustered, slots

#: Words of a centroid, memberships of a text, and the weight of the general pool.
CENTROID_WORDS, TOP, GENERAL_WEIGHT = 20, 3, 0.05
RELATED, MIN_JACCARD, BUCKET_WORDS = 3, 0.03, 30


def _clustered_words(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(tokens.words(F.col(text))).alias("pos", "word")).where(F.length("word") > 2)


def centroids(docs: DataFrame, clusters: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = CENTROID_WORDS) -> DataFrame:
    """(cid, words): the most frequent words of the texts whose most frequent cluster it is; ties by word."""
    w = _clustered_words(docs, doc_id, text)
    votes = w.join(F.broadcast(clusters), "word").groupBy("doc_id", "cid").agg(F.count("*").alias("n"), F.min("pos").alias("at"))
    home = votes.groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("less"), "at", "cid")).alias("b")).select("doc_id", F.col("b.cid").alias("cid"))
    counts = w.groupBy("doc_id", "word").agg(F.count("*").alias("n")).join(home, "doc_id").groupBy("cid", "word").agg(F.sum("n").alias("n"))
    top = counts.withColumn("rk", F.row_number().over(W.partitionBy("cid").orderBy(F.desc("n"), "word"))).where(F.col("rk") <= k)
    return top.groupBy("cid").agg(F.array_sort(F.collect_set("word")).alias("words"))


def memberships(docs: DataFrame, centroids_: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = TOP) -> DataFrame:
    """(doc_id, cid, weight): the k clusters of largest Jaccard similarity, scaled to a sum of 1, and the general pool.

    Overlaps come from an equi-join on the centroids' words, so clusters without a common word cost nothing.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.array_distinct(F.filter(tokens.words(F.col(text)), lambda x: F.length(x) > 2)).alias("w"))
    d = d.select("doc_id", F.size("w").alias("size"), F.explode_outer("w").alias("word"))
    c = F.broadcast(centroids_.select("cid", F.size("words").alias("c_size"), F.explode("words").alias("word")))
    common = d.join(c, "word").groupBy("doc_id", "size", "cid", "c_size").agg(F.count("*").alias("both"))
    sim = common.select("doc_id", "cid", (F.col("both") / (F.col("size") + F.col("c_size") - F.col("both"))).alias("sim"))
    top = sim.withColumn("rk", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc(F.round("sim", 12)), "cid"))).where(F.col("rk") <= k)
    scaled = top.select("doc_id", "cid", (F.col("sim") / F.sum("sim").over(W.partitionBy("doc_id"))).alias("weight"))
    return scaled.union(docs.select(F.col(doc_id), F.lit(-1), F.lit(GENERAL_WEIGHT)))


def bucket_relations(docs: DataFrame, tagged: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = RELATED, min_jaccard: float = MIN_JACCARD, top: int = BUCKET_WORDS) -> DataFrame:
    """(bucket, related): for each bucket the k others of most similar frequent words, made symmetric. tagged: (doc_id, cid)."""
    w = _clustered_words(docs, doc_id, text).join(tagged, "doc_id").groupBy("cid", "word").agg(F.count("*").alias("n"))
    first = w.withColumn("rk", F.row_number().over(W.partitionBy("cid").orderBy(F.desc("n"), "word"))).where(F.col("rk") <= top)
    sizes = first.groupBy("cid").agg(F.count("*").alias("size"))
    a, b = (first.select(F.col("cid").alias(x), "word") for x in ("a", "b"))
    both = a.join(b, "word").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("both"))
    sim = both.join(sizes.toDF("a", "sa"), "a").join(sizes.toDF("b", "sb"), "b").select("a", "b", (F.col("both") / (F.col("sa") + F.col("sb") - F.col("both"))).alias("sim"))
    near = sim.withColumn("rk", F.row_number().over(W.partitionBy("a").orderBy(F.desc(F.round("sim", 12)), F.desc("b")))).where((F.col("rk") <= k) & (F.col("sim") >= min_jaccard))
    return near.select(F.col("a").alias("bucket"), F.col("b").alias("related")).union(near.select("b", "a")).distinct()


def related_search(queries: DataFrame, docs: DataFrame, relations: DataFrame, k: int = 20, threshold: float = 100.0, radius: int = ZONE, excluded: DataFrame | None = None) -> DataFrame:
    """The clustered search with weighted distance, over the query's bucket, its related ones and the general pool."""
    return clustered(queries, docs, k, threshold, radius, excluded, weighted=True, related=settle(relations))


def five_part_search(queries: DataFrame, docs: DataFrame, idf: DataFrame, query_texts: DataFrame, doc_texts: DataFrame, k: int = 10, excluded: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score): alignment, rare terms, interaction, activation and conflict of pairs that share a slot.

    Every text belongs to the general pool, so routing by neighbourhood keeps all documents; only the slot join narrows. Texts are
    (query_id, query_text) and (doc_id, text). Fixed values: the parts' weights 2, 1.5, 1, 0.5 and -1, their scales 225, 10, 200, 100.
    """
    spark = docs.sparkSession
    weights = F.broadcast(spark.createDataFrame([(d, s, w) for d, ws in SLOT_WEIGHTS.items() for s, w in enumerate(ws)], "common string, slot int, w double"))
    q = slots(queries, "query_id", "domain", "signature").toDF("query_id", "slot", "q_value", "q_domain", "q_signature")
    both = q.join(slots(docs, "doc_id", "domain", "signature"), "slot")
    if excluded is not None:
        both = both.join(excluded.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    both = both.withColumn("common", F.when((F.col("q_domain") == F.col("domain")) & (F.col("domain") != GENERAL), F.col("domain"))).join(weights, ["common", "slot"], "left")
    w, gap = F.coalesce("w", F.lit(1.0)), F.abs(F.col("q_value") - F.col("value"))
    n = F.count("*")
    parts = both.groupBy("query_id", "doc_id", "q_signature", "signature").agg(
        n.alias("n"),
        (F.sum(F.exp(-(gap * gap) / 225.0) * w) / n).alias("alignment"),
        F.sum(gap).alias("gap"),
        F.exp(-F.min_by(gap, F.struct("q_value", "slot")) / 10.0).alias("activation"),
        F.least(F.sum(F.when(gap > 100, gap / 200.0 * w).otherwise(0.0)) / n, F.lit(1.0)).alias("conflict"),
    )
    q_words = query_texts.select("query_id", F.explode(F.array_distinct(tokens.raw_words(F.col("query_text")))).alias("term")).join(idf.select("term", "idf"), "term")
    d_words = doc_texts.select("doc_id", F.explode(F.array_distinct(tokens.raw_words(F.col("text")))).alias("term"))
    rare = d_words.join(q_words, "term").groupBy("query_id", "doc_id").agg(F.least(F.sum("idf") / 10.0, F.lit(1.0)).alias("rare"))
    union = F.bit_count(F.col("q_signature").bitwiseOR(F.col("signature")))
    interaction = F.greatest(F.lit(0.0), F.least(F.col("n") / union * (1.0 - F.col("gap") / (F.col("n") * 200.0)), F.lit(1.0)))
    total = F.col("alignment") * 2.0 + F.coalesce("rare", F.lit(0.0)) * 1.5 + interaction + F.col("activation") * 0.5 - F.col("conflict")
    scored = parts.join(rare, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.round(total, 3).alias("score"))
    return ranked(scored, k).select("query_id", "rank", "doc_id", "score")
