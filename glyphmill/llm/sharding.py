"""Proportional stratified interleaving of documents into shards, by DataFrame operations only.

Rows of each source are put in the order of a seeded digest; a row's fractional rank is its place in that order over the rows of its
source. Sorted by fractional rank, any stretch of rows holds the sources in proportion, and the sequence is cut into shards of equal
count. No source is ranked in one task: both orders are split into buckets of digest or rank ranges of about BUCKET_ROWS rows,
whose counts are summed up before.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.llm.rows import pick

SHARDS = 24
SEED = "glyphmill"
#: About so many rows are ranked together, and so many neighbouring buckets are summed up together.
BUCKET_ROWS, COARSE = 2_000, 4_096


def _with_before(counts: DataFrame, keys: list[str], place: str) -> DataFrame:
    """counts (keys, place, n) with `before`, the rows at smaller places of the same keys, and `of`, the rows of the keys.

    Sums are taken over groups of COARSE places, then over the groups, so neither window grows with the rows.
    """
    counts = counts.withColumn("coarse", F.floor(F.col(place) / COARSE))
    groups = counts.groupBy(*keys, "coarse").agg(F.sum("n").alias("m"))
    over = W.partitionBy(*keys)
    groups = groups.select(*keys, "coarse", (F.sum("m").over(over.orderBy("coarse")) - F.col("m")).alias("ahead"), F.sum("m").over(over).alias("of"))
    inner = F.sum("n").over(W.partitionBy(*keys, "coarse").orderBy(place)) - F.col("n")
    return counts.withColumn("inner", inner).join(groups, [*keys, "coarse"]).select(*keys, place, (F.col("ahead") + F.col("inner")).alias("before"), "of")


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, source), a row for each input row; the law is `rows`.

    Counts of shards differ by one at most; slots of a shard have no gap. Rows with a null source are a stratum of their own. Null
    texts have size 8 and the checksum of an empty text. The digest is of doc_id, checksum and size, so rows that repeat or lack an
    id are spread like others. Repeated rows get places of their own; ties of the digest are put in order by id, checksum and size.
    Only rows equal in all of these share a digest and are ranked in one task. An empty table gives no rows.
    """
    d = pick(docs, doc_id, text, source).toDF("doc_id", "text", "source")
    raw = F.coalesce("text", F.lit(""))
    d = d.select(
        "doc_id",
        "source",
        (F.octet_length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("stratum"),
    )
    d = d.withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"), F.col("text_crc32").cast("string"), F.col("size").cast("string")).cast("binary")))
    total = docs.count()
    digits = min(6, max(1, math.ceil(math.log(max(1, total / BUCKET_ROWS), 16))))
    buckets = 16**digits
    d = d.withColumn("bucket", F.conv(F.substring("h", 1, digits), 16, 10).cast("long"))
    counts = _with_before(d.groupBy("stratum", "bucket").agg(F.count("*").alias("n")), ["stratum"], "bucket")
    in_bucket = F.row_number().over(W.partitionBy("stratum", "bucket").orderBy("h", "doc_id", "text_crc32", "size"))
    d = d.join(counts, ["stratum", "bucket"]).withColumn("rank", F.col("before") + in_bucket).drop("before")
    d = d.withColumn("share", (2 * F.col("rank") - 1) / (2 * F.col("of"))).withColumn("span", F.floor(F.col("share") * buckets))
    spans = _with_before(d.groupBy("span").agg(F.count("*").alias("n")), [], "span")
    place = F.col("before") + F.row_number().over(W.partitionBy("span").orderBy("share", "stratum", "rank")) - 1
    d = d.drop("of").join(spans, "span").withColumn("place", place)
    # place * shards / total, and its inverse rounded up, in whole numbers
    d = d.withColumn("shard", F.expr(f"(place * {shards}) DIV {max(1, total)}"))
    first = F.expr(f"(shard * {total} + {shards - 1}) DIV {shards}")
    return d.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("place") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source")
