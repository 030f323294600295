"""The semantic encoder: text to numbered tokens, to a slot blueprint, to a slot row. All of it is expressions and equi-joins."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.functions import distances
from glyphmill.functions.lexicon import CLUSTERS, FALLBACK, PREFIXES, RANGES, SLOT_OF, SUFFIXES, Lexicon
from glyphmill.functions.storage import settle

REGISTRY = "word string, id int, cluster string, method string"
#: Unknown words that a task resolves.
WORDS_A_TASK = 2_000
#: More words of a cluster than there are numbers can't get one, so no more are ranked.
CAPACITY = max(hi - lo + 1 for lo, hi in RANGES.values())


def _one_of(words: list[str]) -> str:
    """A pattern of the longest of the words, tried letter by letter along their common beginnings instead of word by word."""
    tails: dict[str, list[str]] = {}
    for w in words:
        if w:
            tails.setdefault(w[0], []).append(w[1:])
    branches = [re.escape(c) + (_one_of(rest) if any(rest) else "") for c, rest in sorted(tails.items())]
    return "(?:" + "|".join(branches) + ")" + ("?" if "" in words else "")


def pattern(lexicon: Lexicon) -> str:
    """One pattern whose alternatives are the encoder's cases in order: a run of letters that is a known token as a whole; the longest
    known token of two or more characters; the rest of the run, unknown; a single character."""
    whole = _one_of([t for t in lexicon.lookup if t.isalpha()])
    part = _one_of([t for t in lexicon.lookup if len(t) > 1])
    return f"{whole}(?!\\p{{L}})|{part}|\\p{{L}}+|(?s:.)"


def surfaces(text: Column, lexicon: Lexicon) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern(lexicon)), F.lit(0))


def cluster_of(number: Column) -> Column:
    """The cluster whose range holds the number, or null. A chain of comparisons, generated into the scan's code."""
    out = F.when(number.between(CLUSTERS[0][1], CLUSTERS[0][2]), CLUSTERS[0][0])
    for name, lo, hi, _, _ in CLUSTERS[1:]:
        out = out.when(number.between(lo, hi), name)
    return out


def dictionary(spark: SparkSession, lexicon: Lexicon) -> DataFrame:
    """(surface, id, cluster) of every known token: a table of fixed size."""
    rows = [(t, n) for t, n in lexicon.lookup.items()]
    return spark.createDataFrame(rows, "surface string, id int").withColumn("cluster", F.coalesce(cluster_of(F.col("id")), F.lit("Low-Tier")))


def clusters_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, lo, hi, slot, rank) for n, lo, hi, slot, rank in CLUSTERS], "cluster string, lo int, hi int, slot int, rank int")


def _vocabulary(spark: SparkSession, lexicon: Lexicon) -> DataFrame:
    """One row: the word list as an array of (ord, known, cluster)."""
    rows = [(k, w, n) for k, (w, n) in enumerate(lexicon.words.items())]
    v = spark.createDataFrame(rows, "ord int, known string, id int").select("ord", "known", cluster_of(F.col("id")).alias("cluster"))
    return v.agg(F.array_sort(F.collect_list(F.struct("ord", "known", "cluster"))).alias("vocabulary"))


def _hint(word: Column, hints: dict[str, str], test: str, more: int) -> Column:
    out = None
    for hint, cluster in sorted(hints.items(), key=lambda x: -len(x[0])):
        holds = getattr(word, test)(hint) & (F.length(word) > len(hint) + more)
        out = F.when(holds, cluster) if out is None else out.when(holds, cluster)
    return out


def resolve(words: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(word, cluster, method) of distinct unknown words: by beginning, ending, nearest known word, shared character runs, or none.

    A projection: the word list, of fixed size, comes along as one broadcast array, and a later layer is only evaluated for words that
    the earlier ones left. Other columns of the input stay.
    """
    word, n = F.col("word"), F.length("word")
    known = F.col("vocabulary")
    l1, l2 = _hint(word, PREFIXES, "startswith", 2), _hint(word, SUFFIXES, "endswith", 1)
    # only a word within the threshold counts, so lengths further apart are passed over and a distance beyond it is -1
    most = "greatest(2, cast(floor(length(word) / 3) AS INT))"
    near = F.expr(
        f"array_min(filter(transform(filter(vocabulary, v -> abs(length(v.known) - length(word)) <= least(5, {most})), "
        f"v -> struct(levenshtein(word, v.known, {most}) AS d, v.ord AS ord, v.cluster AS cluster)), v -> v.d >= 0))"
    )
    l3 = F.when(F.col("_nearest.d").isNotNull(), F.col("_nearest.cluster"))

    def runs(k: int) -> Column:
        at = F.when(n >= k, F.sequence(F.lit(1), n - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(F.lit(k).alias("k"), i.alias("i"), F.substring(word, i, F.lit(k)).alias("run")))

    usable = F.filter(known, lambda v: v["cluster"].isNotNull() & (v["cluster"] != FALLBACK))
    votes = F.flatten(
        F.transform(F.concat(runs(3), runs(4)), lambda g: F.transform(F.filter(usable, lambda v: F.contains(v["known"], g["run"])), lambda v: F.struct(v["cluster"].alias("cluster"), g["k"].alias("k"), g["i"].alias("i"), v["ord"].alias("ord"))))
    )
    out = words.crossJoin(F.broadcast(_vocabulary(words.sparkSession, lexicon)))
    out = out.withColumn("_hinted", F.coalesce(l1, l2)).withColumn("_by", F.when(l1.isNotNull(), "prefix").otherwise("suffix"))
    out = out.select("*", F.explode(F.array(F.when(F.col("_hinted").isNull(), near))).alias("_nearest")).withColumn("_near", l3)
    # a generator keeps the votes as a column: inside the lambdas below the expression would be evaluated again and again
    out = out.select("*", F.explode(F.array(F.when(F.col("_hinted").isNull() & F.col("_near").isNull(), votes))).alias("_votes"))
    # a vote of a run of k characters counts 1/k: in twelfths 4 or 3; of equals the cluster that got its first vote first wins
    mine = lambda c: F.filter("_votes", lambda x: x["cluster"] == c)
    total = lambda c: F.aggregate(mine(c), F.lit(0), lambda a, x: a + F.when(x["k"] == 3, 4).otherwise(3))
    first = lambda c: F.array_min(F.transform(mine(c), lambda x: F.struct(x["k"].alias("k"), x["i"].alias("i"), x["ord"].alias("ord"))))
    ranked = F.transform(F.array_distinct(F.transform("_votes", lambda x: x["cluster"])), lambda c: F.struct((-total(c)).alias("less"), first(c).alias("seen"), c.alias("cluster")))
    out = out.withColumn("_best", F.array_min(ranked)).withColumn("_voted", F.when(F.col("_best.less") <= -6, F.col("_best.cluster")))
    method = F.when(F.col("_hinted").isNotNull(), F.col("_by")).when(F.col("_near").isNotNull(), "edit_distance").when(F.col("_voted").isNotNull(), "ngram_voting").otherwise("fallback")
    return out.select(*[F.col(c) for c in words.columns], F.coalesce("_hinted", "_near", "_voted", F.lit(FALLBACK)).alias("cluster"), method.alias("method"))


def _bases(spark: SparkSession, lexicon: Lexicon, registry: DataFrame | None) -> DataFrame:
    base = spark.createDataFrame([(c, top, RANGES[c][1]) for c, top in lexicon.used.items()], "cluster string, top int, hi int")
    if registry is None:
        return base
    held = registry.groupBy("cluster").agg(F.max("id").alias("held"))
    return base.join(held, "cluster", "left").select("cluster", F.greatest("top", F.coalesce("held", "top")).alias("top"), "hi")


def register(unknown: DataFrame, lexicon: Lexicon, registry: DataFrame | None = None, unbounded: bool = False) -> DataFrame:
    """The registry (word, id, cluster, method) with new words added, numbered in order of arrival.

    unknown: (word, seen), seen being where the word came first; anything that sorts. Words of the registry keep their entries. A word
    whose cluster has no number left goes to the fallback cluster, behind the words of that cluster that came before it; once that is
    full too, its id is null. With unbounded, such a word keeps its cluster and a null id. The resolved words are checkpointed, since
    numbering reads them several times; they are as many as there are distinct unknown words.
    """
    spark = unknown.sparkSession
    new = unknown if registry is None else unknown.join(registry.select("word"), "word", "left_anti")
    base = _bases(spark, lexicon, registry)
    # resolving a word is much work on few bytes, so partitions go by the number of words; ranks beyond a cluster's numbers aren't
    # needed, so the window's limit drops them before the shuffle
    new = settle(new.select("word", "seen"))
    found = settle(resolve(new.repartition(max(1, -(-new.count() // WORDS_A_TASK)), "word"), lexicon))
    own = W.partitionBy("cluster").orderBy("seen", "word")
    ranked = found.withColumn("rn", F.row_number().over(own)).where(F.col("rn") <= CAPACITY).join(F.broadcast(base), "cluster")
    fits = ranked.where((F.col("cluster") != FALLBACK) & (F.col("top") + F.col("rn") <= F.col("hi"))).select("word", (F.col("top") + F.col("rn")).cast("int").alias("id"), "cluster", "method")
    over = found.join(fits.select("word"), "word", "left_anti")
    if unbounded:
        late = over.select("word", F.lit(None).cast("int").alias("id"), "cluster", "method")
    else:
        moved = over.select("word", "seen", F.lit(FALLBACK).alias("cluster"), F.when(F.col("cluster") == FALLBACK, F.col("method")).otherwise("fallback_cluster_full").alias("method"))
        first = moved.withColumn("rn", F.row_number().over(own)).where(F.col("rn") <= CAPACITY).join(F.broadcast(base), "cluster")
        numbered = first.where(F.col("top") + F.col("rn") <= F.col("hi")).select("word", (F.col("top") + F.col("rn")).cast("int").alias("id"))
        late = moved.join(numbered, "word", "left").select("word", "id", "cluster", "method")
    out = fits.unionByName(late)
    return out if registry is None else registry.select("word", "id", "cluster", "method").unionByName(out)


def tokens(docs: DataFrame, lexicon: Lexicon, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, surface, id, cluster): id and cluster are null for unknown words; other characters have their code point."""
    t = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(surfaces(F.col(text), lexicon)).alias("pos", "surface"))
    known = F.broadcast(dictionary(docs.sparkSession, lexicon))
    joined = t.join(known, "surface", "left")
    letter = F.col("surface").rlike(r"^\p{L}")
    return joined.select("doc_id", "pos", "surface", F.coalesce("id", F.when(~letter, F.ascii("surface"))).alias("id"), F.coalesce("cluster", F.when(~letter, F.lit("ASCII"))).alias("cluster"))


def unknown_words(tokens_: DataFrame) -> DataFrame:
    """(word, seen): distinct unknown words and the first (doc_id, pos) of each."""
    return tokens_.where("id IS NULL").groupBy(F.col("surface").alias("word")).agg(F.min(F.struct("doc_id", "pos")).alias("seen"))


def trace(docs: DataFrame, lexicon: Lexicon, registry: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", split: DataFrame | None = None) -> DataFrame:
    """(doc_id, pos, surface, id, cluster, method, unknown) of every token; without a registry the documents make one of their own.

    `split` are the documents' tokens(), where the caller has settled them.
    """
    t = tokens(docs, lexicon, doc_id, text) if split is None else split
    reg = register(unknown_words(t), lexicon) if registry is None else registry
    # known tokens get keys of their own that match no word, so that they are spread over the join's partitions
    key = F.when(F.col("cluster").isNull(), F.col("surface")).otherwise(F.concat(F.lit("\0"), (F.col("pos") % 64).cast("string")))
    names = reg.select(F.col("word").alias("_key"), F.col("id").alias("_id"), F.col("cluster").alias("_cluster"), F.col("method").alias("_method"))
    j = t.withColumn("_key", key).join(names, "_key", "left")
    method = F.when(F.col("cluster") == "ASCII", "ascii_fallback").when(F.col("cluster").isNull(), F.col("_method")).when(F.length("surface") > 1, F.lit("vocab")).otherwise("vocab_exact")
    return j.select("doc_id", "pos", "surface", F.coalesce("id", F.when(F.col("cluster").isNull(), F.col("_id"))).alias("id"), F.coalesce("cluster", "_cluster").alias("cluster"), method.alias("method"), F.col("cluster").isNull().alias("unknown"))


def blueprints(traced: DataFrame) -> DataFrame:
    """(doc_id, slot, value): of each slot's tokens that of the highest rank, the first of equals; short tokens and fallbacks fill none."""
    clusters = F.broadcast(clusters_table(traced.sparkSession).where("slot IS NOT NULL").select("cluster", "slot", "rank"))
    long = traced.where((F.length(F.trim("surface")) >= 4) & F.col("cluster").isin(*SLOT_OF) & F.col("id").isNotNull())
    best = long.join(clusters, "cluster").groupBy("doc_id", "slot").agg(F.min(F.struct((-F.col("rank")).alias("less"), "pos", "id")).alias("best"))
    return best.select("doc_id", "slot", F.col("best.id").alias("value"))


def encode(docs: DataFrame, lexicon: Lexicon, registry: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", split: DataFrame | None = None) -> DataFrame:
    """(doc_id, ids, blueprint, row, signature), a row for each document. `split` as in trace()."""
    if split is None and single(docs, doc_id):
        reg = register(unknown_words_of(docs, lexicon, doc_id, text), lexicon) if registry is None else registry
        out = numbered(docs, lexicon, reg, doc_id, text).select("doc_id", "ids", "blueprint").withColumn("row", distances.slot_row(F.col("blueprint")))
        return out.withColumn("signature", distances.signature(F.col("row")))
    t = settle(trace(docs, lexicon, registry, doc_id, text, split))
    ids = t.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))
    slots = blueprints(t).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot", "value")))).alias("blueprint"))
    empty = F.create_map().cast("map<int,int>")
    out = docs.select(F.col(doc_id).alias("doc_id")).join(ids, "doc_id", "left").join(slots, "doc_id", "left")
    out = out.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"), F.coalesce("blueprint", empty).alias("blueprint"))
    out = out.withColumn("row", distances.slot_row(F.col("blueprint")))
    return out.withColumn("signature", distances.signature(F.col("row")))


def decode(encoded: DataFrame, lexicon: Lexicon, registry: DataFrame | None = None, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text): of each number the registry's word, else the first known token, else the character, else a mark."""
    spark = encoded.sparkSession
    rev = F.broadcast(spark.createDataFrame(list(lexicon.reverse.items()), "id int, token string"))
    e = encoded.select(F.col(doc_id).alias("doc_id"), F.posexplode_outer(ids).alias("pos", "id")).join(rev, "id", "left")
    if registry is not None:
        e = e.join(registry.where("id IS NOT NULL").groupBy("id").agg(F.max("word").alias("word")), "id", "left")
    else:
        e = e.withColumn("word", F.lit(None).cast("string"))
    said = F.when(F.col("pos").isNull(), F.lit("")).otherwise(F.coalesce("word", "token", F.when(F.col("id").between(32, 126), F.char(F.col("id"))), F.concat(F.lit("<UNK:"), F.coalesce(F.col("id").cast("string"), F.lit("None")), F.lit(">"))))
    return e.withColumn("said", said).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("pos", F.lit(0)).alias("pos"), "said"))), lambda x: x["said"]), "").alias("text"))


def semantic_group(traced: DataFrame) -> DataFrame:
    """(doc_id, sem_group, sem_score): the cluster of most tokens but the fallback, the first seen of equals, and its range."""
    c = traced.where("id IS NOT NULL").select("doc_id", "pos", cluster_of(F.col("id")).alias("c")).where(F.col("c").isNotNull() & (F.col("c") != FALLBACK))
    n = c.groupBy("doc_id", "c").agg(F.count("*").alias("n"), F.min("pos").alias("at"))
    best = n.groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("less"), "at", "c")).alias("b")).select("doc_id", F.col("b.c").alias("cluster"))
    ranges = F.broadcast(clusters_table(traced.sparkSession))
    named = best.join(ranges, "cluster").select("doc_id", F.replace(F.replace(F.lower("cluster"), F.lit(" "), F.lit("_")), F.lit("&"), F.lit("and")).alias("sem_group"), F.concat_ws("-", F.col("lo").cast("string"), F.col("hi").cast("string")).alias("sem_score"))
    return traced.select("doc_id").distinct().join(named, "doc_id", "left").select("doc_id", F.coalesce("sem_group", F.lit("miscellaneous")).alias("sem_group"), F.coalesce("sem_score", F.lit("4901-9999")).alias("sem_score"))


def single(docs: DataFrame, doc_id: str = "doc_id") -> bool:
    """Whether each row has a doc_id of its own: then a document's tokens stay in its row, and none needs a row of its own."""
    return not docs.groupBy(doc_id).agg(F.count("*").alias("n")).where(F.col(doc_id).isNull() | (F.col("n") > 1)).limit(1).count()


def _listed(docs: DataFrame, lexicon: Lexicon, doc_id: str, text: str) -> DataFrame:
    """(doc_id, surfaces, letters): all tokens of a row, and its letters beyond ASCII, as Java knows them."""
    beyond = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x00-\x7F]|\P{L}", "")
    return docs.select(F.col(doc_id).alias("doc_id"), surfaces(F.col(text), lexicon).alias("surfaces"), beyond.alias("letters"))


def _distinct(b: pa.RecordBatch, known: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of _listed(): each token's place among the distinct ones, those, their place in `known` or -1, which of the others are
    words, and each token's row."""
    coded = b.column(1).flatten().dictionary_encode()
    said = coded.dictionary.to_pylist()
    at = pa.compute.index_in(coded.dictionary, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
    letters = set("".join(b.column(2).to_pylist()))
    word = np.array([k < 0 and (len(t) > 1 or "a" <= t <= "z" or t in letters) for t, k in zip(said, at, strict=True)], bool)
    return coded.indices.to_numpy(), said, at, word, np.repeat(np.arange(b.num_rows), np.diff(b.column(1).offsets.to_numpy()))


def unknown_words_of(docs: DataFrame, lexicon: Lexicon, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As unknown_words() of the documents' tokens; each task hands on one row for each word of a batch."""
    if not single(docs, doc_id):
        return unknown_words(tokens(docs, lexicon, doc_id, text))
    sent, kind = docs.sparkSession.sparkContext.broadcast(pa.array(list(lexicon.lookup))), docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, said, _, word, row = _distinct(b, sent.value)
            order = pa.compute.sort_indices(b.column(0)).to_numpy()
            rank = np.empty(b.num_rows, np.int64)
            rank[order] = np.arange(b.num_rows)
            pos = np.arange(len(row)) - b.column(1).offsets.to_numpy()[row]
            first = np.full(len(said), np.iinfo(np.int64).max)
            np.minimum.at(first, codes, (rank[row] << 32) + pos)
            kept = np.nonzero(word)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([said[k] for k in kept], pa.string()), b.column(0).take(pa.array(order[first[kept] >> 32])), pa.array((first[kept] & 0xFFFFFFFF).astype(np.int32))], ["word", "doc_id", "pos"]
            )

    found = _listed(docs, lexicon, doc_id, text).mapInArrow(run, f"word string, doc_id {kind}, pos int")
    return found.groupBy("word").agg(F.min(F.struct("doc_id", "pos")).alias("seen"))


def numbered(docs: DataFrame, lexicon: Lexicon, registry: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, blueprint, sem_group, sem_score), a row for each document with an id of its own: what trace(), blueprints() and
    semantic_group() make, without a row for a token. A document without tokens has no group.

    The registry's words with a number, as many as there are numbers at most, go to every task.
    """
    spark = docs.sparkSession
    given = registry.where("id IS NOT NULL").select("word", "id", "cluster").toArrow()
    base = dictionary(spark, lexicon).toArrow()
    listed = {c: (slot, rank) for c, _, _, slot, rank in CLUSTERS if slot is not None and c in SLOT_OF}
    names = [c for c, *_ in CLUSTERS if c != FALLBACK]

    def ready(t: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        slot_rank = [listed.get(c, (-1, 0)) for c in t.column("cluster").to_pylist()]
        return t.column(0).combine_chunks(), t.column(1).to_numpy(), *(np.array([x[k] for x in slot_rank], np.int64) for k in (0, 1))

    bounds = np.array([RANGES[c] for c in names])
    said_of = [[c.lower().replace(" ", "_").replace("&", "and") for c in names] + ["miscellaneous"], [f"{lo}-{hi}" for lo, hi in bounds.tolist()] + ["4901-9999"]]
    sent = spark.sparkContext.broadcast((ready(base), ready(given)))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sent.value
        for b in batches:
            codes, said, at, word, row = _distinct(b, tables[0][0])
            at_given = pa.compute.index_in(pa.array(said, pa.string()), value_set=tables[1][0]).fill_null(-1).to_numpy(zero_copy_only=False)
            number, slot, rank = np.full(len(said), -1, np.int64), np.full(len(said), -1, np.int64), np.zeros(len(said), np.int64)
            other = (at < 0) & ~word
            number[other] = [ord(said[k][0]) for k in np.nonzero(other)[0]]
            for place, (_, ids, slots_, ranks) in ((np.where(word, at_given, -1), tables[1]), (at, tables[0])):
                held = place >= 0
                number[held], slot[held], rank[held] = ids[place[held]], slots_[place[held]], ranks[place[held]]
            short = np.array([len(t.strip(" ")) < 4 for t in said], bool)
            slot[short | (number < 0)] = -1
            group = np.full(len(said), -1, np.int64)
            for k in reversed(range(len(names))):
                group[(number >= bounds[k][0]) & (number <= bounds[k][1])] = k
            offsets = b.column(1).offsets
            ids = pa.ListArray.from_arrays(offsets, pa.array(number[codes], pa.int32(), mask=number[codes] < 0))
            # of each slot's tokens that of the highest rank, the first of equals
            t = np.nonzero(slot[codes] >= 0)[0]
            t = t[np.lexsort((t, -rank[codes[t]], slot[codes[t]], row[t]))]
            key = row[t] * 1024 + slot[codes[t]]
            t = t[np.append(True, key[1:] != key[:-1])] if len(t) else t
            blueprint = pa.MapArray.from_arrays(pa.array(np.searchsorted(row[t], np.arange(b.num_rows + 1)), pa.int32()), pa.array(slot[codes[t]], pa.int32()), pa.array(number[codes[t]], pa.int32()))
            # the cluster of most tokens, the first seen of equals
            t = np.nonzero(group[codes] >= 0)[0]
            key, first, n = np.unique(row[t] * len(names) + group[codes[t]], return_index=True, return_counts=True)
            order = np.lexsort((first, -n, key // len(names)))
            rows, lead = np.unique(key[order] // len(names), return_index=True)
            best = np.full(b.num_rows, len(names))
            best[rows] = key[order][lead] % len(names)
            empty = np.diff(offsets.to_numpy()) == 0
            groups = [pa.array([x[k] for k in best], pa.string(), mask=empty) for x in said_of]
            yield pa.RecordBatch.from_arrays([b.column(0), ids, blueprint, *groups], ["doc_id", "ids", "blueprint", "sem_group", "sem_score"])

    return _listed(docs, lexicon, doc_id, text).mapInArrow(run, f"doc_id {kind}, ids array<int>, blueprint map<int,int>, sem_group string, sem_score string")


def groups(docs: DataFrame, lexicon: Lexicon, registry: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """semantic_group() of the documents' trace."""
    if not single(docs, doc_id):
        return semantic_group(trace(docs, lexicon, registry, doc_id, text))
    return numbered(docs, lexicon, registry, doc_id, text).where("sem_group IS NOT NULL").select("doc_id", "sem_group", "sem_score")
