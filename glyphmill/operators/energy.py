"""Concept graphs, energy diffusion and the searches by energy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.functions import tokens
from glyphmill.functions.storage import settle
from glyphmill.operators import dots
from glyphmill.operators.bm25 import ranked

#: Number of hops, damping, energies of injected concepts and the number above which one counts as rare.
ITERATIONS, DAMPING = 3, 0.7
RARE, COMMON, RARE_ABOVE = 2.0, 1.0, 7


def document_concepts(docs: DataFrame, clusters: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, cid): distinct word clusters of each text; words longer than two characters before they are stripped."""
    long = F.filter(tokens.raw_words(F.col(text)), lambda x: F.length(x) > 2)
    words = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.array_distinct(F.transform(long, tokens.strip_edges))).alias("word"))
    return words.join(F.broadcast(clusters), "word").select("doc_id", "cid").distinct()


def concept_graph(concepts: DataFrame) -> DataFrame:
    """(src, dst, n, w): documents that hold both, as a share of those of all of src's pairs. At most one edge for each pair of clusters."""
    held = concepts.groupBy("doc_id").agg(F.array_sort(F.collect_set("cid")).alias("cids"))
    # the generator keeps the array as a column for the second explode
    one = held.select("cids", F.explode("cids").alias("src"))
    pairs = one.select("src", F.explode("cids").alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    return pairs.withColumn("w", F.col("n") / F.sum("n").over(W.partitionBy("src")))


def concept_frequencies(concepts: DataFrame) -> DataFrame:
    """(cid, df): documents that hold each cluster."""
    return concepts.groupBy("cid").agg(F.countDistinct("doc_id").alias("df"))


def concept_weights(frequencies: DataFrame, n_docs: int) -> DataFrame:
    """(cid, df, idf, genericity): smoothed idf, and the penalty of clusters that most documents hold."""
    share = F.col("df") / F.lit(float(max(1, n_docs)))
    idf = F.log((n_docs + 1.0) / (F.col("df") + 1.0)) + 1
    return frequencies.select("cid", "df", idf.alias("idf"), genericity(share).alias("genericity"))


def genericity(share: Column) -> Column:
    """1 up to a share of 5 %, 0.1 above 50 %, on a line between."""
    return F.when(share < 0.05, 1.0).when(share > 0.5, 0.1).otherwise(1.0 - (share - 0.05) / 0.45 * 0.9)


def diffuse(energy: DataFrame, graph: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING, dangling: bool = True) -> DataFrame:
    """(query_id, cid, energy) after so many hops over (src, dst, w).

    A node sends its energy along its edges, damped, and keeps half of what damping takes. With dangling, a node without edges keeps
    its energy damped; else it loses it but for the kept half. The hops are unrolled into one plan; the graph is bounded by the
    square of the number of clusters.
    """
    edges = graph.select("src", "dst", "w")
    sources = edges.select(F.col("src").alias("cid")).distinct().withColumn("sends", F.lit(True))
    e = energy.select("query_id", "cid", "energy")
    for _ in range(iterations):
        flagged = e.join(F.broadcast(sources), "cid", "left")
        sent = flagged.where("sends").join(F.broadcast(edges), F.col("cid") == F.col("src")).select("query_id", F.col("dst").alias("cid"), (F.col("energy") * F.col("w") * damping).alias("energy"))
        kept = F.when(F.col("sends") | F.lit(not dangling), F.col("energy") * ((1 - damping) * 0.5)).otherwise(F.col("energy") * damping)
        e = sent.union(flagged.select("query_id", "cid", kept.alias("energy"))).groupBy("query_id", "cid").agg(F.sum("energy").alias("energy"))
    return e


def inject(values: DataFrame) -> DataFrame:
    """(query_id, cid, energy) of (query_id, value): the energies of a query's slot values, summed by value."""
    each = F.when(F.col("value") > RARE_ABOVE, RARE).otherwise(COMMON)
    return values.groupBy("query_id", F.col("value").alias("cid")).agg(F.sum(each).alias("energy"))


def inject_words(queries: DataFrame, clusters: DataFrame, query_id: str = "query_id", text: str = "query_text") -> DataFrame:
    """(query_id, cid, energy): one unit for each word of a cluster."""
    w = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens.letters(F.col(text))).alias("word"))
    return w.join(F.broadcast(clusters), "word").groupBy("query_id", "cid").agg(F.count("*").cast("double").alias("energy"))


def above_mean(energy: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Concepts of at least the mean energy of their query; the tolerance keeps equal energies together."""
    return energy.where(F.lit(True)).withColumn("mean", F.avg("energy").over(W.partitionBy("query_id"))).where(F.col("energy") >= F.col("mean") - tolerance).drop("mean")


def score(energy: DataFrame, concepts: DataFrame, k: int = 10, weights: DataFrame | None = None, excluded: DataFrame | None = None, digits: int = 3) -> DataFrame:
    """(query_id, rank, doc_id, score): energies of a document's concepts summed; with weights times idf times genericity."""
    e = energy
    if weights is not None:
        e = e.join(F.broadcast(weights), "cid", "left").select("query_id", "cid", (F.col("energy") * F.coalesce("idf", F.lit(1.0)) * F.coalesce("genericity", F.lit(1.0))).alias("energy"))
    most = 0
    if excluded is not None:
        # no more than that many of a query's best can fall out
        excluded = settle(excluded.select("query_id", "doc_id").distinct())
        most = excluded.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    held = dots.vectors(concepts.select("doc_id", "cid", F.lit(1.0).alias("w")), "doc_id", "cid", "w")
    found = dots.top(dots.vectors(e, "query_id", "cid", "energy"), held, k + most, digits)
    if most:
        found = found.join(excluded, ["query_id", "doc_id"], "left_anti")
    scored = found.withColumn("score", F.round("score", digits)).where("score > 0")
    return ranked(scored, k).select("query_id", "rank", "doc_id", "score")


def row_concepts(rows: DataFrame) -> DataFrame:
    """(doc_id, cid) of an index: its distinct slot values."""
    return rows.select("doc_id", F.explode("row").alias("s")).select("doc_id", F.col("s.value").alias("cid")).distinct()


def energy_search(queries: DataFrame, docs: DataFrame, graph: DataFrame, k: int = 10, pruned: bool = False, excluded: DataFrame | None = None) -> DataFrame:
    """Search of indexed queries over indexed documents: injection, diffusion, [pruning,] sum over shared values."""
    values = queries.select("query_id", F.explode("row").alias("s")).select("query_id", F.col("s.value").alias("value"))
    e = diffuse(inject(values), graph)
    return score(above_mean(e) if pruned else e, row_concepts(docs), k, excluded=excluded)


def directed_search(queries: DataFrame, docs: DataFrame, graph: DataFrame, weights: DataFrame, k: int = 10) -> DataFrame:
    """As energy_search, with injection and scores weighted by the clusters' idf and genericity."""
    values = queries.select("query_id", F.explode("row").alias("s")).select("query_id", F.col("s.value").alias("cid"))
    e = values.join(F.broadcast(weights), "cid", "left").groupBy("query_id", "cid").agg(F.sum(F.coalesce("idf", F.lit(1.0))).alias("energy"))
    return score(diffuse(e, graph), row_concepts(docs), k, weights)


def direct_search(queries: DataFrame, docs: DataFrame, clusters: DataFrame, k: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Energy over learned word clusters themselves: a unit for each clustered word of the query, diffused over the concept graph."""
    words = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.array_distinct(tokens.letters(F.col(text)))).alias("word"))
    concepts = settle(words.join(F.broadcast(clusters), "word").select("doc_id", "cid").distinct())
    return score(diffuse(inject_words(queries, clusters), concept_graph(concepts)), concepts, k)
