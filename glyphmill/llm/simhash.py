"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most two bits differ in at most two of their eight bytes, so they share at least six
positional bytes. Postings of a single positional byte would hold n/256 fingerprints each; the index therefore keys its postings
on every set of six positions with their bytes (28 postings a fingerprint). A pair meets in such a list exactly if its tally of
shared positional bytes can reach the guaranteed minimum. All members of a list agree on six bytes: a list has at most 65,536 distinct
members whatever the corpus holds. Candidates of a list, found by a look-up of each member's neighbours, have their shared positional
bytes tallied; those of the minimum or more are verified by Hamming distance, and only a spanning star of each linked group leaves the
list, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.rows import map_batches, parts_of, pick, positional, raw_of, settle

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SEED = 42
SHINGLE = 3
BYTES = 8
MAX_BITS = 2
MIN_SHARED = BYTES - MAX_BITS
#: Positions that a posting's members may differ in.
FREE = [c for c in combinations(range(BYTES), MAX_BITS)]

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_LANE = (np.arange(BYTES) * 256)[None, :]
_SHIFTS = np.arange(0, 64, 8, dtype=np.uint64)[None, :]
_WEIGHTS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_FLIPS = np.array([0] + [1 << a for a in range(16)] + [1 << a | 1 << b for a, b in combinations(range(16), 2)], np.int64)[1:]


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of lower-cased (A-Z) words of non-white-space; no words: zero."""
    words = raw.translate(LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    counts = np.zeros(BYTES * 256, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8", copy=False).view(np.uint8).reshape(-1, BYTES)
        counts += np.bincount((part + _LANE).ravel(), minlength=BYTES * 256)
    ones = (counts.reshape(BYTES, 256) @ _BITS.astype(np.int64)).ravel()
    return int(_WEIGHTS[2 * ones > n].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp BIGINT, seal BIGINT): the fingerprint's 64 bits as a signed number, and a hash of the text; a row for each input row."""
    df = pick(docs, doc_id, text)
    df = df.withColumn("_seal", F.xxhash64(text))
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts_of(batches, 1):
            fp = np.fromiter((fingerprint(x, shingle) for x in raw_of(b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), b.column(2)], ["doc_id", "fp", "seal"])

    return map_batches(df, run, f"doc_id {kind}, fp bigint, seal bigint")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def postings(fps: DataFrame) -> DataFrame:
    """(slot, key, members): lists of two or more distinct fingerprints that share six positional bytes."""
    full = (1 << 64) - 1
    entries = [
        F.struct(F.lit(k).cast("byte").alias("slot"), F.col("fp").bitwiseAND(F.lit(_signed(full ^ (255 << 8 * a) ^ (255 << 8 * b)))).alias("key"))
        for k, (a, b) in enumerate(FREE)
    ]
    lists = fps.select("fp", F.explode(F.array(*entries)).alias("e")).groupBy("e.slot", "e.key").agg(F.collect_list("fp").alias("members"))
    return lists.where(F.size("members") > 1)


def star_links(members: np.ndarray, slot: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of one posting as stars: each member that links with another, and the smallest member it reaches."""
    members = np.unique(members)
    bits = members.view(np.uint64)
    a, b = FREE[slot]
    rest = (((bits >> np.uint64(8 * a)) & np.uint64(255)) | (((bits >> np.uint64(8 * b)) & np.uint64(255)) << np.uint64(8))).astype(np.int64)
    if len(members) <= 64:
        i, j = np.triu_indices(len(members), 1)
    else:
        at = np.full(1 << 16, -1, np.int64)
        at[rest] = np.arange(len(rest))
        near = [(k := at[rest ^ flip], np.nonzero(k >= 0)[0]) for flip in _FLIPS]
        i = np.concatenate([here for _, here in near])
        j = np.concatenate([k[here] for k, here in near])
    shared = BYTES - ((bits[i] ^ bits[j])[:, None] >> _SHIFTS & np.uint64(255) > 0).sum(1)
    i, j = i[shared >= MIN_SHARED], j[shared >= MIN_SHARED]
    close = np.bitwise_count(bits[i] ^ bits[j]) <= MAX_BITS
    i, j = i[close], j[close]
    label = np.arange(len(members))
    while True:
        was = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == was).all():
            break
    moved = np.nonzero(label != np.arange(len(members)))[0]
    return members[moved], members[label[moved]]


def links(fps: DataFrame) -> DataFrame:
    """(u, v): links among distinct fingerprints at two or fewer differing bits, enough to keep every component whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for slot, members in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                u, v = star_links(members.values.to_numpy(zero_copy_only=False).astype(np.int64), slot)
                us.append(u)
                vs.append(v)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return map_batches(postings(fps).select("slot", "members"), run, "u bigint, v bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each linked group, for every node that has a link.

    Alternating large-star and small-star rounds; each round is two aggregates with map-side combine, and ends in a reliable
    checkpoint. A node with very many links is dealt with by minima and by joins whose hot partitions Spark can split.
    """
    seen = None
    e = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if now.n == 0 or (now.n, now.s) == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v"))).distinct()
        seen = (now.n, now.s)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = settle(small.select("x.u", "x.v").where("u <> v").distinct())


#: Fingerprints whose postings a task makes.
ROWS_A_TASK = 25_000


def rooted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, seal) of every row, and (fp, first, root) of every distinct fingerprint: its smallest doc_id, and the smallest
    fingerprint of its component."""
    fp = settle(fingerprints(docs, doc_id, text, shingle))
    classes = settle(fp.groupBy("fp").agg(F.min("doc_id").alias("first")))
    # each fingerprint becomes 28 postings, so few small partitions would make a few long tasks
    spread = classes.select("fp").repartition(max(1, -(-classes.count() // ROWS_A_TASK)), "fp")
    roots = components(links(spread)).withColumnRenamed("node", "fp")
    return fp, classes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each input row.

    component_id is the smallest doc_id that links of two or fewer differing bits reach, itself included. Null or wordless texts
    have fingerprint zero, and link like any other. Null ids get a row and are passed over when the smallest id is taken; a
    component of null ids only has a null component_id. Repeated rows stay.
    """
    fp, classes = rooted(docs, doc_id, text, shingle)
    lowest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    of = classes.join(lowest, "root").select("fp", "component_id")
    return fp.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row of each component: that of the smallest doc_id, null last; all columns stay, whatever their names.

    Of rows that repeat this doc_id the one whose text has the smallest hash stays, and of rows that repeat both any one.
    """
    fp, classes = rooted(docs, doc_id, text, shingle)
    rank = F.struct(F.col("doc_id").isNull().alias("_last"), "doc_id", "seal")
    tally = settle(fp.join(classes.select("fp", "root"), "fp").groupBy("root", "doc_id", "seal").agg(F.count("*").alias("n")))
    best = tally.groupBy("root").agg(F.min(rank).alias("b"))
    # a doc_id and a text have one fingerprint, hence one component
    judged = tally.join(best, "root").select(F.col("doc_id").alias("_id"), F.col("seal").alias("_of"), "n", (rank == F.col("b")).alias("stays"))
    judged = settle(judged.where("NOT stays OR n > 1").select("_id", "_of", "stays"))
    plain, (key, body) = positional(docs, doc_id, text)
    same = F.col(key).eqNullSafe(F.col("_id")) & (F.xxhash64(body) == F.col("_of"))
    kept = plain.join(judged, same, "left_anti")
    repeated = judged.where("stays")
    if not repeated.isEmpty():
        kept = kept.union(plain.join(repeated, same, "left_semi").withColumn("_of", F.xxhash64(body)).dropDuplicates([key, "_of"]).drop("_of"))
    return kept.toDF(*docs.columns)
