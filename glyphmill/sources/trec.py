"""Tagged test collections: documents, topics and judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _between(block: Column, tag: str) -> Column:
    return F.regexp_extract(block, rf"(?is)<{tag}>(.*?)</{tag}>", 1)


def _blocks(spark: SparkSession, path: str, tag: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.regexp_extract_all("value", F.lit(rf"(?is)<{tag}>(.*?)</{tag}>"), F.lit(1))).alias("pos", "block"))


def documents(spark: SparkSession, path: str, with_title: bool = True) -> DataFrame:
    """(doc_id, text) of <doc> blocks: title and text, white space squeezed. Blocks without a number drop out; of a repeated one the last stays."""
    b = F.col("block")
    text = F.concat_ws(" ", _between(b, "title"), _between(b, "text")) if with_title else _between(b, "text")
    d = _blocks(spark, path, "doc").select("pos", F.trim(_between(b, "docno")).alias("doc_id"), _squeeze(text).alias("text")).where("doc_id <> ''")
    return d.groupBy("doc_id").agg(F.max_by("text", "pos").alias("text"))


def topics(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """(query_id, query_text) of <top> blocks; the number is the block's place from 1, or what its <num> says."""
    b = F.col("block")
    number = F.regexp_extract(b, r"(?is)<num>\D*(\d+)", 1) if numbered else (F.col("pos") + 1).cast("string")
    text = F.regexp_extract(b, r"(?is)<title>(.*?)(?:</title>|<|$)", 1)
    return _blocks(spark, path, "top").select(number.alias("query_id"), _squeeze(text).alias("query_text")).where("query_id <> ''")


def qrels(spark: SparkSession, path: str, keep_negative: bool = False) -> DataFrame:
    """(query_id, doc_id, rel) of lines of four columns or more; negative judgments are 0 unless kept; of a repeated pair the last counts."""
    parts = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") >= 4)
    rel = F.col("p")[3].cast("int")
    r = parts.select("at", F.col("p")[0].alias("query_id"), F.col("p")[2].alias("doc_id"), (rel if keep_negative else F.greatest(F.lit(0), rel)).alias("rel"))
    return r.groupBy("query_id", "doc_id").agg(F.max_by("rel", "at").alias("rel"))
