"""Encoding of streams: with a registry that stands still, encoding is a projection and joins with static tables, row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.lexicon import Lexicon
from glyphmill.operators import encode


def classified(stream: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """The stream with the tokens' surfaces and the domain of most votes (ties by name), without state.

    Votes are counted inside the row, so nothing is shuffled and any output mode will do.
    """
    domains = sorted(set(lexicon.votes.values()))
    found = F.array(*[F.array(*[F.lit(w) for w, d in sorted(lexicon.votes.items()) if d == domain]) for domain in domains])
    out = stream.withColumn("surfaces", encode.surfaces(F.col(text), lexicon))
    counts = F.zip_with(F.array(*[F.lit(d) for d in domains]), found, lambda d, ws: F.struct((-F.size(F.filter("surfaces", lambda s: F.array_contains(ws, s)))).alias("less"), d.alias("domain")))
    best = F.array_min(counts)
    return out.withColumn("domain", F.when(best["less"] < 0, best["domain"]).otherwise("general"))


#: Batches after which the registry is written as one table.
COMPACT_AFTER = 32


def _parts(path: str, number: int) -> list[str]:
    """The folders that hold the registry before batch `number`: the last whole table and the batches from there on."""
    whole = number - number % COMPACT_AFTER
    return [f"{path}/upto-{whole}"] * (whole > 0) + [f"{path}/{k}" for k in range(whole, number)]


def stored_registry(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The registry that growing_registry() has written by the end of batch number - 1."""
    parts = _parts(path, number)
    return spark.read.schema(encode.REGISTRY).parquet(*parts) if parts else spark.createDataFrame([], encode.REGISTRY)


def growing_registry(stream: DataFrame, lexicon: Lexicon, path: str, checkpoint: str):
    """A query that adds each batch's unknown words to the registry at `path`/<batch>, numbered after all earlier batches.

    stream: (doc_id, text). A batch that is run again overwrites its own folder, so each word gets one number. Every COMPACT_AFTER
    batches all words so far are written as one table, so a batch reads a bounded number of folders.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        if number and number % COMPACT_AFTER == 0:
            before = number - COMPACT_AFTER
            earlier = [f"{path}/upto-{before}"] * (before > 0) + [f"{path}/{k}" for k in range(before, number)]
            spark.read.schema(encode.REGISTRY).parquet(*earlier).write.mode("overwrite").parquet(f"{path}/upto-{number}")
        registry = stored_registry(spark, path, number)
        words = encode.unknown_words(encode.tokens(batch, lexicon))
        new = encode.register(words, lexicon, registry).join(registry.select("word"), "word", "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/{number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
