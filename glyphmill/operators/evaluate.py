"""Retrieval metrics over ranked results (query_id, rank, doc_id) and judgments (query_id, doc_id, rel)."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.functions.storage import near_all, settle

#: The thresholds of the sweep.
SWEEP = [50, 100, 200, 300, 500, 800, 1500, 3000, 9000]


def judged(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """Results with rel, 0 where there is no judgment. Judgments are narrowed down to the results before they are dealt."""
    found = settle(results.select("query_id", "rank", "doc_id"))
    about = qrels.select("query_id", "doc_id", "rel").join(near_all(found), ["query_id", "doc_id"], "left_semi")
    return found.join(about, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def per_query(results: DataFrame, qrels: DataFrame, k: int = 10, recall_at: int = 100, graded: bool = True) -> DataFrame:
    """(query_id, ndcg, ap, rr, precision, recall) of every query with a positive judgment, in one plan.

    NDCG has linear gain, or that of rel > 0 without graded; precision is over what was returned. A query without results scores 0.
    """
    gain = F.col("rel") if graded else F.when(F.col("rel") > 0, 1).otherwise(0)
    # judgments are counted by degree: the best order needs no more of them
    degrees = settle(qrels.groupBy("query_id", "rel").agg(F.count("*").alias("n")))
    positive = degrees.where("rel > 0").groupBy("query_id").agg(F.sum("n").alias("n_relevant"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("query_id").orderBy(F.desc("rel")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ideal = degrees.withColumn("before", before).where(F.col("before") < k)
    ideal = ideal.select("query_id", "rel", F.explode(F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("n"), F.lit(k)))).alias("rank"))
    ideal = ideal.groupBy("query_id").agg(F.sum(gain / F.log2(F.col("rank") + 1.0)).alias("idcg"))
    hit = F.when(F.col("rel") > 0, 1).otherwise(0)
    j = judged(results, qrels).withColumn("hits", F.sum(hit).over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)))
    r = j.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, gain / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("rel") > 0, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("ap_sum"),
        F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("first"),
        F.avg(F.when(F.col("rank") <= k, hit.cast("double"))).alias("precision"),
        F.sum(F.when(F.col("rank") <= recall_at, hit).otherwise(0)).alias("found"),
    )
    out = positive.join(ideal, "query_id", "left").join(r, "query_id", "left")
    zero = F.lit(0.0)
    return out.select(
        "query_id",
        F.coalesce(F.try_divide("dcg", "idcg"), zero).alias("ndcg"),
        F.coalesce(F.col("ap_sum") / F.col("n_relevant"), zero).alias("ap"),
        F.coalesce(1.0 / F.col("first"), zero).alias("rr"),
        F.coalesce("precision", zero).alias("precision"),
        F.coalesce(F.col("found") / F.col("n_relevant"), zero).alias("recall"),
    )


def macro(metrics: DataFrame) -> DataFrame:
    """Means over queries."""
    return metrics.agg(F.count("*").alias("n_queries"), *[F.avg(c).alias(c) for c in ("ndcg", "ap", "rr", "precision", "recall")])


def set_metrics(found: DataFrame, truth: DataFrame, single: bool = False) -> DataFrame:
    """(query_id, tp, fp, fn, precision, recall, f1) of sets of documents.

    Sizes are counted by query, and only pairs that were found are looked up; with single, the truth has each pair once and isn't dealt.
    """
    a = settle(found.select("query_id", "doc_id").distinct())
    b = truth.select("query_id", "doc_id") if single else settle(truth.select("query_id", "doc_id").distinct())
    marked = b.join(near_all(a).withColumn("f", F.lit(1)), ["query_id", "doc_id"], "left")
    sizes = marked.groupBy("query_id").agg(F.lit(0).alias("m"), F.count("*").alias("n"), F.count("f").alias("hit"))
    sizes = sizes.unionByName(a.groupBy("query_id").agg(F.count("*").alias("m"), F.lit(0).alias("n"), F.lit(0).alias("hit")))
    n = sizes.groupBy("query_id").agg(*[F.sum(c).alias(c) for c in ("m", "n", "hit")])
    n = n.select("query_id", F.col("hit").alias("tp"), (F.col("m") - F.col("hit")).alias("fp"), (F.col("n") - F.col("hit")).alias("fn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    n = n.withColumn("precision", F.coalesce(p, F.lit(0.0))).withColumn("recall", F.coalesce(r, F.lit(0.0)))
    return n.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def threshold_sweep(scored: DataFrame, truth: DataFrame, thresholds: list[int] | None = None) -> DataFrame:
    """(threshold, returned, relevant): what each threshold lets through of (query_id, doc_id, distance). One plan for all thresholds."""
    t = scored.sparkSession.createDataFrame([(float(x),) for x in thresholds or SWEEP], "threshold double")
    flagged = scored.join(truth.select("query_id", "doc_id").distinct().withColumn("t", F.lit(1)), ["query_id", "doc_id"], "left")
    # counted by the first threshold that lets a pair through, then summed up
    steps = F.expr(" ".join(["CASE", *[f"WHEN distance <= {float(x)} THEN {float(x)}" for x in sorted(thresholds or SWEEP)], "END"]))
    n = flagged.groupBy(steps.alias("first")).agg(F.count("*").alias("n"), F.count("t").alias("r"))
    return t.join(F.broadcast(n), F.col("first") <= F.col("threshold"), "left").groupBy("threshold").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("returned"), F.coalesce(F.sum("r"), F.lit(0)).alias("relevant"))


def agreement(found: DataFrame, reference: DataFrame) -> DataFrame:
    """(both, only_found, only_reference): how an indexed search agrees with a linear one."""
    a = found.select("query_id", "doc_id").distinct().withColumn("f", F.lit(1))
    b = reference.select("query_id", "doc_id").distinct().withColumn("r", F.lit(1))
    return a.join(b, ["query_id", "doc_id"], "full").agg(F.count_if(F.expr("f = 1 AND r = 1")).alias("both"), F.count_if(F.expr("r IS NULL")).alias("only_found"), F.count_if(F.expr("f IS NULL")).alias("only_reference"))


def compare(systems: dict[str, Callable[[], DataFrame]], qrels: DataFrame, k: int = 10) -> DataFrame:
    """(system, n_queries, ndcg, ap, rr, precision, recall, seconds) of several systems; each is run once."""
    rows = []
    for name, run in systems.items():
        began = time.perf_counter()
        results = run().cache()
        results.count()
        seconds = time.perf_counter() - began
        rows.append(macro(per_query(results, qrels, k)).select(F.lit(name).alias("system"), "*", F.lit(seconds).alias("seconds")))
    return reduce(DataFrame.unionByName, rows)


def ratios(compared: DataFrame, base: str) -> DataFrame:
    """Each system's means over those of the base system."""
    names = ("ndcg", "ap", "rr", "precision", "recall")
    b = compared.where(F.col("system") == base).select(*[F.col(c).alias(f"_{c}") for c in names])
    return compared.crossJoin(F.broadcast(b)).select("system", *[F.try_divide(c, f"_{c}").alias(c) for c in names])


def sweep(settings: list[dict], run: Callable[..., DataFrame], qrels: DataFrame, k: int = 10) -> DataFrame:
    """Means of a search under each of several settings, one row each with the setting as text."""
    rows = [macro(per_query(run(**s), qrels, k)).select(F.lit(str(sorted(s.items()))).alias("setting"), "*") for s in settings]
    return reduce(DataFrame.unionByName, rows)


def explain_ranks(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, doc_id, rel, rank): where each relevant document was ranked; null where it wasn't."""
    found = near_all(settle(results.select("query_id", "doc_id", "rank")))
    return qrels.where("rel > 0").join(found, ["query_id", "doc_id"], "left").select("query_id", "doc_id", "rel", "rank")
