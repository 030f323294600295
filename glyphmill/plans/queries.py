"""The registered queries: each operator over the driver's tables. Conversations and documents are corpora, benchmark items are queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import distances, tokens
from glyphmill.functions.lexicon import Lexicon
from glyphmill.functions.storage import settle, shared_folder
from glyphmill.operators import bm25, encode, energy, evaluate, factor, neighborhoods, search, stats
from glyphmill.sources import ndjson, synthetic

LEXICON = Lexicon()
N_CLUSTERS = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of conversations, one for each turn."""
    return _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query_text) of benchmark items."""
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def _as_docs(queries: DataFrame) -> DataFrame:
    return queries.select(F.col("query_id").alias("doc_id"), F.col("query_text").alias("text"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search(documents(spark, sf_dir), items(spark, sf_dir), 10).withColumn("score", F.round("score", 4))


def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.statistics(documents(spark, sf_dir)).select("n_docs", F.round("avg_length", 6).alias("avg_length"))


def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.idf(documents(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


def sentence_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return stats.sentence_weights(d, stats.idf(d)).withColumn("weight", F.round("weight", 5))


def query_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.query_word_weights(items(spark, sf_dir), stats.idf(documents(spark, sf_dir))).withColumn("weight", F.round("weight", 6))


def domain_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.domain_hints(_marked(spark, sf_dir), LEXICON)


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by name and type: short texts in which words of the lexicon occur, put in front by key."""
    words = sorted(LEXICON.votes)
    pick = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("p_partkey") % len(words) + 1).cast("int"))
    other = F.element_at(F.array(*[F.lit(w) for w in words]), ((F.col("p_partkey") * 7) % len(words) + 1).cast("int"))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat_ws(" ", pick, other, other, "p_name").alias("text"))


def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cooccurrence(turns(spark, sf_dir)).select("w1", "w2", "n")


def word_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.word_totals(documents(spark, sf_dir)).select("word", "total")


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(stats.word_clusters(turns(spark, sf_dir), N_CLUSTERS))


def word_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir)


def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cluster_labels(_clusters(spark, sf_dir), stats.word_totals(turns(spark, sf_dir))).select("cid", F.concat_ws(" ", "labels").alias("labels"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.tags(turns(spark, sf_dir), _clusters(spark, sf_dir))


def bucket_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bucket_sizes(tags(spark, sf_dir))


def vocabulary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.vocabulary_report(LEXICON, encode.clusters_table(spark))


def encode_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.tokens(turns(spark, sf_dir), LEXICON)


def encode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = encode.tokens(documents(spark, sf_dir), LEXICON)
    return t.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count_if(F.expr("cluster IS NULL")).alias("n_unknown"), F.sum("id").alias("id_sum"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.register(encode.unknown_words(encode.tokens(_as_docs(items(spark, sf_dir)), LEXICON)), LEXICON)


def _unknown_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(encode.register(encode.unknown_words_of(turns(spark, sf_dir), LEXICON), LEXICON))


def _registries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What the turns make, and what the items add to that."""
    first = _unknown_of_all(spark, sf_dir)
    return first, settle(encode.register(encode.unknown_words_of(_as_docs(items(spark, sf_dir)), LEXICON), LEXICON, first))


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Tokens of turns and of items, each made once, and the registries: what the turns make, and what the items add to that."""
    docs, queries = settle(encode.tokens(turns(spark, sf_dir), LEXICON)), settle(encode.tokens(_as_docs(items(spark, sf_dir)), LEXICON))
    first = settle(encode.register(encode.unknown_words(docs), LEXICON))
    return docs, queries, first, settle(encode.register(encode.unknown_words(queries), LEXICON, first))


def _traced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Traces of turns and of items, with the registry that the turns make and the items add to."""
    docs, queries, first, both = _split(spark, sf_dir)
    return encode.trace(turns(spark, sf_dir), LEXICON, first, split=docs), encode.trace(_as_docs(items(spark, sf_dir)), LEXICON, both, split=queries), both


def blueprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.blueprints(_traced(spark, sf_dir)[0])


def _indexes(spark: SparkSession, sf_dir: str, learned: bool = False) -> tuple[DataFrame, DataFrame]:
    """Indexes of turns and items; with `learned`, weights, domains and clusters too."""
    d, q = turns(spark, sf_dir), _as_docs(items(spark, sf_dir))
    first, both = _registries(spark, sf_dir)
    idf_ = settle(stats.idf(d)) if learned else None
    clusters = _clusters(spark, sf_dir) if learned else None
    docs = settle(search.index(d, LEXICON, first, idf_, clusters))
    queries = settle(search.as_queries(search.index(q, LEXICON, both, idf_, clusters)))
    return queries, docs


def signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexes(spark, sf_dir)[1].select("doc_id", "signature", F.size("row").alias("n_slots"))


def slot_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blueprints of turns with the slots' names."""
    return _indexes(spark, sf_dir)[1].select("doc_id", F.explode(distances.slot_names(F.col("blueprint"))).alias("slot", "value"))


def shared_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many slots each pair in a zone has in common, by its signatures."""
    q, d = _indexes(spark, sf_dir)
    pairs = search.zone_candidates(q, d).join(q.select("query_id", F.col("signature").alias("q_signature")), "query_id").join(d.select("doc_id", "signature"), "doc_id")
    return pairs.select("query_id", "doc_id", distances.shared_slots(F.col("q_signature"), F.col("signature")).cast("int").alias("n"))


def semantic_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.groups(turns(spark, sf_dir), LEXICON, _unknown_of_all(spark, sf_dir))


def decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded texts of items; every token's number is the first of its own, so a text comes back but for shared numbers."""
    q = _as_docs(items(spark, sf_dir))
    reg = registry(spark, sf_dir)
    return encode.decode(encode.encode(q, LEXICON, reg), LEXICON, reg)


def semantic_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token distances of all pairs of items by their known tokens' numbers."""
    t = encode.tokens(_as_docs(items(spark, sf_dir)), LEXICON).where("id IS NOT NULL")
    ids = t.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))
    q = ids.select(F.col("doc_id").alias("query_id"), "ids")
    out = search.semantic(q, ids, 1e9)
    return out.select("query_id", "doc_id", F.round("distance", 3).alias("distance"), distances.semantic_label(F.col("distance")).alias("label"))


def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token distances within 50 of items to turns, by the numbers of all tokens, those of the registry included."""
    out = search.semantic(*_indexes(spark, sf_dir))
    return out.select("query_id", "doc_id", F.round("distance", 3).alias("distance"), distances.semantic_label(F.col("distance")).alias("label"))


def blueprint_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d = _indexes(spark, sf_dir)
    return search.blueprint(q, d).withColumn("distance", F.round("distance", 3))


def blueprint_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d = _indexes(spark, sf_dir)
    return search.blueprint(q, d, radius=None).withColumn("distance", F.round("distance", 3))


def slot_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.slot_filter(_indexes(spark, sf_dir)[1], 1, "Actions: Management").select("doc_id")


def range_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.range_query(_indexes(spark, sf_dir)[1], "People: General").select("doc_id")


def zone_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.zone_candidates(*_indexes(spark, sf_dir))


def matrix_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.linear(*_indexes(spark, sf_dir)).withColumn("distance", F.round("distance", 4))


def matrix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.matrix(*_indexes(spark, sf_dir))


def weighted_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.weighted_linear(*_indexes(spark, sf_dir, True)).withColumn("distance", F.round("distance", 2))


def clustered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.clustered(*_indexes(spark, sf_dir, True))


def store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.clustered(*_indexes(spark, sf_dir, True), k=10, weighted=True)


def search_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_statistics(*_indexes(spark, sf_dir, True))


def excluded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session's second page: what the first search gave is excluded."""
    q, d = _indexes(spark, sf_dir, True)
    first = settle(search.clustered(q, d, k=5, weighted=True))
    return search.clustered(q, d, k=5, weighted=True, excluded=first)


def related_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d = _indexes(spark, sf_dir, True)
    relations = neighborhoods.bucket_relations(turns(spark, sf_dir), d.select("doc_id", "cid"))
    return neighborhoods.related_search(q, d, relations)


def bucket_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighborhoods.bucket_relations(turns(spark, sf_dir), tags(spark, sf_dir))


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = turns(spark, sf_dir)
    c = neighborhoods.centroids(d, _clusters(spark, sf_dir))
    return neighborhoods.memberships(d, c).withColumn("weight", F.round("weight", 6))


def five_part_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d = _indexes(spark, sf_dir, True)
    return neighborhoods.five_part_search(q, d, stats.idf(turns(spark, sf_dir)), items(spark, sf_dir), turns(spark, sf_dir))


def _concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return energy.document_concepts(turns(spark, sf_dir), _clusters(spark, sf_dir))


def concept_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return energy.concept_graph(_concepts(spark, sf_dir)).select("src", "dst", "n", F.round("w", 6).alias("w"))


def concept_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = turns(spark, sf_dir).count()
    w = energy.concept_weights(energy.concept_frequencies(_concepts(spark, sf_dir)), n)
    return w.select("cid", "df", F.round("idf", 6).alias("idf"), F.round("genericity", 6).alias("genericity"))


def diffuse_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = _clusters(spark, sf_dir)
    graph = energy.concept_graph(energy.document_concepts(turns(spark, sf_dir), clusters))
    e = energy.diffuse(energy.inject_words(items(spark, sf_dir), clusters), graph)
    return e.select("query_id", "cid", F.round("energy", 6).alias("energy"))


def energy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d = _indexes(spark, sf_dir)
    return energy.energy_search(q, d, energy.concept_graph(_concepts(spark, sf_dir)))


def pruned_energy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d = _indexes(spark, sf_dir)
    return energy.energy_search(q, d, energy.concept_graph(_concepts(spark, sf_dir)), pruned=True)


def directed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d = _indexes(spark, sf_dir)
    concepts = _concepts(spark, sf_dir)
    weights = energy.concept_weights(energy.concept_frequencies(concepts), turns(spark, sf_dir).count())
    return energy.directed_search(q, d, energy.concept_graph(concepts), weights)


def direct_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return energy.direct_search(items(spark, sf_dir), turns(spark, sf_dir), _clusters(spark, sf_dir), k=20)


def direct_energy_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As direct_energy, on clusters of 10,000 words and with 100 results."""
    d = turns(spark, sf_dir)
    clusters = settle(stats.word_clusters(d, N_CLUSTERS, top_words=10_000))
    return energy.direct_search(items(spark, sf_dir), d, clusters)


def _qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each item the labelled documents, relevant to a degree of 2 if toxic, 1 if of good quality, else 0."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") > 0, 2).otherwise(F.col("quality")).cast("int").alias("rel"))
    return items(spark, sf_dir).select("query_id").crossJoin(labels)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search(documents(spark, sf_dir), items(spark, sf_dir), 100)


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.per_query(_results(spark, sf_dir), _qrels(spark, sf_dir))
    return m.select("query_id", *[F.round(c, 5).alias(c) for c in ("ndcg", "ap", "rr", "precision", "recall")])


def metrics_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.macro(evaluate.per_query(_results(spark, sf_dir), _qrels(spark, sf_dir)))
    return m.select("n_queries", *[F.round(c, 5).alias(c) for c in ("ndcg", "ap", "rr", "precision", "recall")])


def binary_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.per_query(_results(spark, sf_dir), _qrels(spark, sf_dir), graded=False)
    return m.select("query_id", F.round("ndcg", 5).alias("ndcg"))


def _keyword_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = items(spark, sf_dir).select("query_id", F.filter(tokens.raw_words(F.col("query_text")), lambda x: F.length(x) >= 9).alias("keywords"))
    return search.keyword_relevance(documents(spark, sf_dir), q)


def keyword_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyword_truth(spark, sf_dir)


def set_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25.search(documents(spark, sf_dir), items(spark, sf_dir), 10)
    m = evaluate.set_metrics(found, _keyword_truth(spark, sf_dir), single=True)
    return m.select("query_id", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = search.linear(*_indexes(spark, sf_dir), threshold=1e9)
    q = items(spark, sf_dir).select("query_id", F.filter(tokens.raw_words(F.col("query_text")), lambda x: F.length(x) >= 5).alias("keywords"))
    return evaluate.threshold_sweep(scored, search.keyword_relevance(turns(spark, sf_dir), q))


def index_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d = _indexes(spark, sf_dir)
    return evaluate.agreement(search.matrix(q, d), search.linear(q, d))


def explain_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.explain_ranks(_results(spark, sf_dir), _qrels(spark, sf_dir))


def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    v = settle(factor.vocabulary(d, max_features=2000))
    return factor.tfidf(d, v).join(F.broadcast(v.select("term_id", "term")), "term_id").select("doc_id", "term", F.round("w", 5).alias("w"))


def tfidf_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As tfidf, with the operator's own vocabulary of 10,000 terms."""
    d = documents(spark, sf_dir)
    v = settle(factor.vocabulary(d))
    return factor.tfidf(d, v).join(F.broadcast(v.select("term_id", "term")), "term_id").select("doc_id", "term", F.round("w", 5).alias("w"))


def _vector_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, rnk, atom, value): the eight largest positive entries of each vector, as if they were its codes."""
    v = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("atom", "value")).where("value > 0").withColumn("value", F.col("value").cast("double"))
    from pyspark.sql import Window as W

    return v.withColumn("rnk", F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("value"), "atom"))).where("rnk <= 8")


def top_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector_atoms(spark, sf_dir).select("vec_id", "rnk", "atom", F.round("value", 6).alias("value"))


def _fixed_atoms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, int]:
    atoms = settle(_vector_atoms(spark, sf_dir))
    n = _table(spark, sf_dir, "embeddings").count()
    docs = atoms.select(F.col("vec_id").alias("doc_id"), "rnk", "atom", "value")
    queries = atoms.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "atom", "value")
    side = spark.range(64).select(F.col("id").cast("int").alias("a"))
    pairs = side.crossJoin(side.select(F.col("a").alias("b"))).select("a", "b", (1.0 / (1.0 + F.abs(F.col("a") - F.col("b")))).alias("sim"))
    return queries, docs, pairs, factor.atom_idf(docs, n), n


def maxsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d, a, idf_, _ = _fixed_atoms(spark, sf_dir)
    return factor.maxsim(q, d, a, idf_).withColumn("score", F.round("score", 4))


def gated_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d, _, idf_, _ = _fixed_atoms(spark, sf_dir)
    return factor.gated_dot(factor.gate(q, 5), factor.above_document_mean(d, 64), idf_).withColumn("score", F.round("score", 4))


def diffused_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d, _, idf_, n = _fixed_atoms(spark, sf_dir)
    return factor.diffused_dot(q, d, idf_, n).withColumn("score", F.round("score", 4))


def atom_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixed_atoms(spark, sf_dir)[3].withColumn("idf", F.round("idf", 6))


def dictionary_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factor.Retriever().fit(turns(spark, sf_dir)).search(items(spark, sf_dir))


def nmf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factor.Retriever(n_atoms=128, method="nmf").fit(turns(spark, sf_dir)).search(items(spark, sf_dir), ranking="gated")


def ndjson_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of turns written as newline-delimited JSON and read back."""
    d = turns(spark, sf_dir)
    reg = _unknown_of_all(spark, sf_dir)
    recs = ndjson.records(encode.encode(d, LEXICON, reg), d, encode.groups(d, LEXICON, reg))
    path = f"{shared_folder(spark)}/ndjson-{uuid.uuid4().hex}"
    ndjson.append(recs, path)
    return ndjson.read(spark, path).select("id", "len", "hash")


def synthetic_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.corpus(spark, 1000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_stats, idf, sentence_weight, query_weights, domain_hint, cooccurrence, word_totals, word_clusters, cluster_labels, tags,
        bucket_sizes, vocabulary_report, encode_tokens, encode_counts, registry, blueprint, signature, slot_names, shared_slots, semantic_group, decode_roundtrip,
        semantic_distance, semantic_search, blueprint_distance, blueprint_scan, slot_filter, range_query, zone_candidates, matrix_linear, matrix_search,
        weighted_linear, clustered_search, store_search, search_statistics, excluded_search, related_search, bucket_relations, memberships,
        five_part_search, concept_graph, concept_weights, diffuse_energy, energy_search, pruned_energy_search, directed_search, direct_energy, direct_energy_full,
        metrics, metrics_macro, binary_ndcg, keyword_relevance, set_metrics, threshold_sweep, index_agreement, explain_ranks, tfidf, tfidf_full, top_atoms,
        maxsim, gated_dot, diffused_dot, atom_idf, dictionary_topk, nmf_topk, ndjson_roundtrip, synthetic_corpus,
    )
}
