"""BM25 for batches of queries: postings of the queries' terms only, scored in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.functions import tokens
from glyphmill.functions.storage import settle
from glyphmill.operators import dots

K1, B = 1.5, 0.75


def ranked(scored: DataFrame, k: int, by: str = "score", descending: bool = True, digits: int = 6) -> DataFrame:
    """The k best of each query_id with their rank; scores equal to so many digits are in order of doc_id."""
    best = F.round(by, digits)
    order = W.partitionBy("query_id").orderBy(best.desc() if descending else best.asc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def query_terms(queries: DataFrame, query_id: str = "query_id", text: str = "query_text") -> DataFrame:
    """(query_id, term, repeats): a query's terms, each as often as it occurs."""
    return queries.select(F.col(query_id).alias("query_id"), F.explode(tokens.words(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("repeats"))


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row: n_docs, avg_length."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.size(tokens.words(F.col(text)))).alias("avg_length"))


def search(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, doc_id: str = "doc_id", text: str = "text", query_id: str = "query_id", query_text: str = "query_text") -> DataFrame:
    """(query_id, rank, doc_id, score). A query's repeated terms count again; documents without a term of the query don't appear.

    The documents are read once and keep the queries' terms only; no row is formed for a pair of query and document. The driver holds
    the queries' terms.
    """
    asked = settle(query_terms(queries, query_id, query_text))
    vocabulary = asked.select("term").distinct().orderBy("term").toArrow()["term"].combine_chunks()
    held = settle(term_frequencies(docs.select(F.col(doc_id).alias("doc_id"), tokens.words(F.col(text)).alias("words")), vocabulary))
    n_docs, avg_length = held.agg(F.count("*"), F.avg("length")).first()
    if held.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        # rows of one id and length are one document, as their words are counted together
        one = held.select("doc_id", "length", F.explode(F.arrays_zip("ids", "tfs")).alias("x")).groupBy("doc_id", "length", F.col("x.ids").alias("id")).agg(F.sum("x.tfs").alias("tf"))
        held = settle(one.groupBy("doc_id", "length").agg(F.collect_list(F.struct("id", "tf")).alias("x")).select("doc_id", "length", F.col("x.id").alias("ids"), F.col("x.tf").alias("tfs")))
        merged = True
    else:
        merged = False
    df = held.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df"))
    idf = F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    numbers = docs.sparkSession.createDataFrame(pa.table({"term": vocabulary, "id": pa.array(range(len(vocabulary)), pa.int32())}))
    terms = asked.join(numbers, "term").join(df, "id").select("query_id", "id", (idf * F.col("repeats")).alias("weight"))
    size = k1 * (1 - b + b * F.col("length") / (avg_length or 1.0))
    parts = held.select("doc_id", "ids", F.transform("tfs", lambda tf: tf * (k1 + 1) / (tf + size)).alias("ws"))
    if merged:
        parts = parts.groupBy("doc_id").agg(F.flatten(F.collect_list("ids")).alias("ids"), F.flatten(F.collect_list("ws")).alias("ws"))
    return ranked(dots.top(dots.vectors(terms, "query_id", "id", "weight"), parts, k), k).select("query_id", "rank", "doc_id", "score")


def counts_in(words: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in known, count) of the known words of each list, ascending."""
    place = pa.compute.index_in(words.flatten(), value_set=known)
    at = pa.compute.is_valid(place).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(words), dtype=np.int64), np.diff(words.offsets.to_numpy()))[at]
    keys, counts = np.unique(row * max(1, len(known)) + place.drop_null().to_numpy(), return_counts=True)
    return (*np.divmod(keys, max(1, len(known))), counts)


def term_frequencies(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """(doc_id, length, ids, tfs) of (doc_id, words): number of words, and which of the vocabulary occur how often, by place in it."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            words, n = batch.column(1), batch.num_rows
            sizes = np.diff(words.offsets.to_numpy())
            row, ids, tfs = counts_in(words, known)
            offsets = pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((ids, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), *lists], ["doc_id", "length", "ids", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, length int, ids array<int>, tfs array<bigint>")
