"""Corpus statistics: inverse document frequency, sentence weights, domain votes, co-occurrence, word clusters and tags."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.functions import tokens
from glyphmill.functions.lexicon import COOCCURRENCE_STOP_WORDS, GENERAL, STOP_WORDS, Lexicon
from glyphmill.functions.storage import settle

WINDOW = 6
#: Words of a task that are counted at once.
WORDS = 1 << 20


def idf(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df, idf): ln(N / df) of stripped words longer than two characters. Counts are combined on the map side."""
    n = docs.agg(F.count("*").alias("n"))
    terms = docs.select(F.explode(F.array_distinct(F.filter(tokens.words(F.col(text)), lambda x: F.length(x) > 2))).alias("term"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.log(F.col("n") / F.col("df")).alias("idf"))


def sentence_weights(docs: DataFrame, idf_: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, weight): mean idf of content words, repeats counted, unseen words 0; 1 without any."""
    words = docs.select(F.col(doc_id).alias("doc_id"), tokens.content_words(F.col(text), STOP_WORDS).alias("words"))
    counted = words.select("doc_id", F.explode("words").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    sums = counted.join(idf_.select("term", "idf"), "term", "left").groupBy("doc_id").agg((F.sum(F.col("n") * F.coalesce("idf", F.lit(0.0))) / F.sum("n")).alias("weight"))
    return docs.select(F.col(doc_id).alias("doc_id")).join(sums, "doc_id", "left").select("doc_id", F.coalesce("weight", F.lit(1.0)).alias("weight"))


def query_word_weights(queries: DataFrame, idf_: DataFrame, query_id: str = "query_id", text: str = "query_text") -> DataFrame:
    """(query_id, term, weight) of the distinct content words of each query; here the stripped word must be longer than two."""
    t = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens.words(F.col(text)))).alias("term")).where((F.length("term") > 2) & ~F.col("term").isin(*STOP_WORDS))
    return t.join(idf_.select("term", "idf"), "term", "left").select("query_id", "term", F.coalesce("idf", F.lit(0.0)).alias("weight"))


def _majority(votes: DataFrame, key: str, choice: str) -> DataFrame:
    """(key, choice): most votes; of equals the one seen first. votes: (key, pos, choice)."""
    n = votes.groupBy(key, choice).agg(F.count("*").alias("n"), F.min("pos").alias("at"))
    return n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("less"), "at", F.col(choice))).alias("b")).select(key, F.col(f"b.{choice}").alias(choice))


def domain_hints(docs: DataFrame, lexicon: Lexicon, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, domain): the domain that most words vote for, the first seen of equals."""
    table = F.broadcast(docs.sparkSession.createDataFrame([*lexicon.votes.items()], "word string, domain string"))
    votes = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(tokens.words(F.col(text))).alias("pos", "word")).join(table, "word")
    won = _majority(votes, "doc_id", "domain")
    return docs.select(F.col(doc_id).alias("doc_id")).join(won, "doc_id", "left").select("doc_id", F.coalesce("domain", F.lit(GENERAL)).alias("domain"))


def _content(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    w = docs.select(F.col(doc_id).alias("doc_id"), tokens.content_words(F.col(text), COOCCURRENCE_STOP_WORDS).alias("words"))
    # the generator keeps the array as a column; a reference to it inside the lambdas then costs nothing
    return w.select("doc_id", F.explode(F.array("words")).alias("words"))


class _Words:
    """The words of some rows: codes into known ones, their rows, places and numbers of words, and an order of rows by doc_id."""

    def __init__(self, ids: pa.Array, words: pa.Array) -> None:
        sizes = np.diff(words.offsets.to_numpy())
        coded = words.flatten().dictionary_encode()
        self.known, self.codes = coded.dictionary, coded.indices.to_numpy()
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.size = sizes.astype(np.int64)[self.row]
        self.place = np.arange(len(self.row)) - np.repeat(np.cumsum(sizes, dtype=np.int64) - sizes, sizes)
        self.longest = int(sizes.max(initial=1))
        rank = pa.compute.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64) - 1
        self.ids, self.at = ids, rank[self.row] * self.longest + self.place  # in the order of (doc_id, place)
        self.first_of = np.zeros(len(sizes), np.int64)
        self.first_of[rank] = np.arange(len(sizes))

    def seen(self, at: np.ndarray) -> list[pa.Array]:
        """doc_id and place of what at has."""
        rank, place = np.divmod(at, self.longest)
        return [self.ids.take(pa.array(self.first_of[rank])), pa.array(place, pa.int32())]


def _counted(words: DataFrame, count: Callable[[_Words], list[pa.Array]], columns: str) -> DataFrame:
    """What count makes of the words of each task, WORDS at once or one row; columns are its names and types. words: (doc_id, words)."""
    names = [c.split(" ")[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            ends, start = batch.column(1).offsets.to_numpy(), 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + WORDS, "right")) - 1)
                # a slice's flat values are its own, its offsets are not
                part = pa.concat_arrays([batch.column(1).slice(start, stop - start)])
                part = pa.ListArray.from_arrays(pa.array(part.offsets.to_numpy() - part.offsets[0].as_py(), pa.int32()), part.flatten())
                found = count(_Words(batch.column(0).slice(start, stop - start), part))
                yield from pa.Table.from_arrays(found, names).to_batches(50_000)
                start = stop

    return words.mapInArrow(run, columns)


def cooccurrence(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", heads: DataFrame | None = None) -> DataFrame:
    """(w1, w2, n, seen): ordered pairs of content words at most `window` apart; seen is the pair's first (doc, i, j).

    The pairs come from shifted copies of each text's own array, so nothing is joined; 2 * window rows a word are combined on the map
    side before the shuffle. With `heads` (word), a few words, only their pairs are counted, those with a head as w1, within the tasks.
    """
    words = _content(docs, doc_id, text)
    if heads is not None:
        return _near_heads(words, window, heads)
    at = words.select("doc_id", "words", F.posexplode("words").alias("i", "w1"))
    first = F.greatest(F.col("i") - window, F.lit(0))
    near = F.slice("words", first + 1, F.col("i") - first + 1 + window)
    pairs = at.select("doc_id", "i", "w1", first.alias("first"), F.posexplode(near).alias("k", "w2")).withColumn("j", F.col("first") + F.col("k")).where("i <> j")
    return pairs.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "i", "j")).alias("seen"))


def _near_heads(words: DataFrame, window: int, heads: DataFrame) -> DataFrame:
    asked = pa.array(sorted(r.word for r in heads.select("word").distinct().collect() if r.word is not None), pa.string())
    span = 2 * window + 1

    def count(w: _Words) -> list[pa.Array]:
        head = pa.compute.fill_null(pa.compute.index_in(w.known, value_set=asked), -1).to_numpy()[w.codes]
        one = np.nonzero(head >= 0)[0]
        pairs, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for apart in range(-window, window + 1):
            i = one[(w.place[one] + apart >= 0) & (w.place[one] + apart < w.size[one])] if apart else one[:0]
            pairs.append(head[i].astype(np.int64) * len(w.known) + w.codes[i + apart])
            at.append(w.at[i] * span + apart + window)
        pair, where, n = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
        first = np.full(len(pair), np.iinfo(np.int64).max)
        np.minimum.at(first, where, np.concatenate(at))
        h, c = np.divmod(pair, max(1, len(w.known)))
        first, apart = np.divmod(first, span)
        ids, i = w.seen(first)
        return [asked.take(pa.array(h)), w.known.take(pa.array(c)), pa.array(n, pa.int64()), ids, i, pa.array(i.to_numpy() + apart - window, pa.int32())]

    kind = words.schema["doc_id"].dataType.simpleString()
    found = _counted(words, count, f"w1 string, w2 string, n bigint, doc_id {kind}, i int, j int")
    return found.groupBy("w1", "w2").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "i", "j")).alias("seen"))


def word_totals(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, total, seen): co-occurrences of each word and where it came first, as the sums over cooccurrence() would give them.

    No pair is formed: the word at place i of n has min(i, window) neighbours before it and min(n - 1 - i, window) after it, and its
    first pair is with the first of them. Words are counted within the tasks, so no row is made for an occurrence.
    """

    def count(w: _Words) -> list[pa.Array]:
        near = np.minimum(w.place, window) + np.minimum(w.size - 1 - w.place, window)
        total = np.bincount(w.codes, near, len(w.known)).astype(np.int64)
        first = np.full(len(w.known), np.iinfo(np.int64).max)
        np.minimum.at(first, w.codes, w.at)
        return [w.known, pa.array(total), *w.seen(first)]

    words = _content(docs, doc_id, text).where(F.size("words") > 1)
    kind = words.schema["doc_id"].dataType.simpleString()
    found = _counted(words, count, f"word string, total bigint, doc_id {kind}, i int")
    totals = found.groupBy("word").agg(F.sum("total").alias("total"), F.min(F.struct("doc_id", "i")).alias("at"))
    j = F.when(F.col("at.i") == 0, 1).otherwise(F.greatest(F.col("at.i") - window, F.lit(0)))
    return totals.select("word", "total", F.struct(F.col("at.doc_id").alias("doc_id"), F.col("at.i").alias("i"), j.alias("j")).alias("seen"))


def word_clusters(docs: DataFrame, n_clusters: int, top_words: int = 150, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, cid): the most connected words around seeds.

    Seeds are the first of the 40 best words in order of the largest overlap of their first eight neighbours with those of the 30
    best; other words join the seed they co-occur with most, of equals the earlier one. Totals are taken without forming pairs, and
    pairs are formed of the 40 best words only. top_words bounds what follows.
    """
    if n_clusters < 2:
        raise ValueError("n_clusters must be at least 2")
    totals = word_totals(docs, window, doc_id, text).where(F.length("word") > 2)
    best = totals.orderBy(F.desc("total"), "seen", "word").limit(top_words)
    best = settle(best.withColumn("rk", F.row_number().over(W.orderBy(F.desc("total"), "seen", "word"))))
    best = best.withColumn("of", F.count("*").over(W.partitionBy()))
    n = F.when(F.col("of") < n_clusters, F.greatest(F.lit(2), F.floor(F.col("of") / 3))).otherwise(n_clusters)
    best = best.withColumn("n_seeds", n)
    heads = best.where("rk <= 40").select("word", "rk", "n_seeds")
    cooc = settle(cooccurrence(docs, window, doc_id, text, heads))
    near = cooc.join(F.broadcast(heads), cooc["w1"] == heads["word"]).select("word", "rk", "n_seeds", "w2", "seen")
    near = near.withColumn("k", F.row_number().over(W.partitionBy("word").orderBy("seen"))).where("k <= 8")
    first = near.groupBy("word", "rk", "n_seeds").agg(F.collect_set("w2").alias("eight"))
    others = F.broadcast(first.where("rk <= 30").select(F.col("word").alias("other"), F.col("eight").alias("their")))
    overlap = first.join(others, F.col("word") != F.col("other"), "left").groupBy("word", "rk", "n_seeds").agg(F.sum(F.coalesce(F.size(F.array_intersect("eight", "their")), F.lit(0))).alias("overlap"))
    seeds = overlap.withColumn("cid", F.row_number().over(W.orderBy(F.desc("overlap"), "rk")) - 1).where("cid < n_seeds").select(F.col("word").alias("seed"), "cid")
    rest = best.join(F.broadcast(seeds), F.col("word") == F.col("seed"), "left_anti").select("word")
    ties = cooc.select(F.col("w2").alias("word"), F.col("w1").alias("seed"), "n")  # a pair counts the same in either order
    ties = ties.join(F.broadcast(seeds), "seed").join(F.broadcast(rest), "word").groupBy("word", "cid").agg(F.sum("n").alias("n"))
    joined = ties.groupBy("word").agg(F.min(F.struct((-F.col("n")).alias("less"), "cid")).alias("b")).select("word", F.col("b.cid").alias("cid"))
    others_ = rest.join(joined, "word", "left").select("word", F.coalesce("cid", F.lit(0)).alias("cid"))
    return seeds.select(F.col("seed").alias("word"), "cid").union(others_).select("word", F.col("cid").cast("int").alias("cid"))


def cluster_labels(clusters: DataFrame, totals: DataFrame, k: int = 5) -> DataFrame:
    """(cid, labels): the words of largest (total, word) of each cluster."""
    t = clusters.join(totals.select("word", "total"), "word", "left").select("cid", "word", F.coalesce("total", F.lit(0)).alias("total"))
    t = t.withColumn("rk", F.row_number().over(W.partitionBy("cid").orderBy(F.desc("total"), F.desc("word")))).where(F.col("rk") <= k)
    return t.groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "word"))), lambda x: x["word"]).alias("labels"))


def tags(docs: DataFrame, clusters: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, cid): the cluster of most words of each text, the first seen of equals; -1 for the general pool."""
    votes = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(tokens.words(F.col(text))).alias("pos", "word")).join(F.broadcast(clusters), "word")
    won = _majority(votes, "doc_id", "cid")
    return docs.select(F.col(doc_id).alias("doc_id")).join(won, "doc_id", "left").select("doc_id", F.coalesce("cid", F.lit(-1)).alias("cid"))


def bucket_sizes(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("cid").agg(F.count("*").alias("n"))


def vocabulary_report(lexicon: Lexicon, clusters: DataFrame) -> DataFrame:
    """(cluster, n_words, capacity) of the word list."""
    spark = clusters.sparkSession
    words = spark.createDataFrame([(w, n) for w, n in lexicon.words.items()], "word string, id int")
    inside: Column = F.col("id").between(F.col("lo"), F.col("hi"))
    return clusters.join(F.broadcast(words), inside, "left").groupBy("cluster", "lo", "hi").agg(F.count("word").alias("n_words")).select("cluster", "n_words", (F.col("hi") - F.col("lo") + 1).alias("capacity"))
