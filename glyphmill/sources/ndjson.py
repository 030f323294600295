"""Records of encoded texts as newline-delimited JSON, and the registry of unknown words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.functions.storage import exists, settle
from glyphmill.operators.encode import REGISTRY

RECORD = "id bigint, ts string, e array<int>, bp map<string,int>, len int, hash string, chk string, sem_group string, sem_score string"
TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss"


def records(encoded: DataFrame, texts: DataFrame, groups: DataFrame, first_id: int = 1, with_blueprint: bool = False) -> DataFrame:
    """Records of an index (doc_id, ids, blueprint), texts (doc_id, text) and groups (doc_id, sem_group, sem_score), numbered in order of doc_id.

    Ranges of doc_id are numbered apart, each from where the ranges before it end. Of a batch that is appended to others, first_id is
    next_id() of those; append() sees to that itself.
    """
    r = encoded.join(texts, "doc_id").join(groups, "doc_id")
    r = settle(r.repartitionByRange("doc_id").withColumn("_part", F.spark_partition_id()))
    sizes = r.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each task, so one window will do
    r = r.join(F.broadcast(sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))), "_part")
    listed = F.concat(F.lit("["), F.array_join(F.transform("ids", lambda x: x.cast("string")), ", ", "None"), F.lit("]"))
    short = lambda c: F.substring(F.md5(c.cast("binary")), 1, 8)
    bp = F.transform_keys("blueprint", lambda k, _: k.cast("string")) if with_blueprint else F.lit(None).cast("map<string,int>")
    return r.select(
        (F.col("_before") + F.row_number().over(W.partitionBy("_part").orderBy("doc_id")) + (first_id - 1)).cast("bigint").alias("id"),
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), TIMESTAMP).alias("ts"),
        F.col("ids").alias("e"),
        bp.alias("bp"),
        F.size("ids").alias("len"),
        short(F.coalesce("text", F.lit(""))).alias("hash"),
        F.lit(None).cast("string").alias("chk") if with_blueprint else short(listed).alias("chk"),
        "sem_group",
        "sem_score",
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records at the path; blank lines are passed over."""
    return spark.read.schema(RECORD).json(path).where("id IS NOT NULL")


def next_id(stored: DataFrame) -> int:
    """One more than the largest number in use."""
    return (stored.agg(F.max("id")).first()[0] or 0) + 1


def append(recs: DataFrame, path: str) -> None:
    """Adds records, numbered from 1, behind those that are at the path. One writer at a time."""
    held = next_id(read(recs.sparkSession, path)) - 1 if exists(recs.sparkSession, path) else 0
    recs.withColumn("id", F.col("id") + held).write.mode("append").json(path)


def blueprints(stored: DataFrame) -> DataFrame:
    """(doc_id, ids, blueprint) of stored records."""
    return stored.select(F.col("id").alias("doc_id"), F.col("e").alias("ids"), F.transform_keys(F.coalesce("bp", F.create_map().cast("map<string,int>")), lambda k, _: k.cast("int")).alias("blueprint"))


def read_registry(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON objects of word to entry, one in each file or, with lines, in each line, as (word, id, cluster, method)."""
    entry = "map<string,struct<id:int,cluster:string,method:string,word:string>>"
    m = spark.read.text(path, wholetext=not lines).select(F.explode(F.from_json("value", entry)).alias("word", "e"))
    return m.select("word", "e.id", "e.cluster", "e.method")


def write_registry(registry: DataFrame, path: str) -> None:
    """A JSON object of word to entry in each line, for read_registry(lines=True); what was at the path is replaced."""
    told = F.to_json(F.create_map("word", F.struct("id", "cluster", "method", "word")))
    registry.select(told.alias("value")).write.mode("overwrite").text(path)


def empty_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], REGISTRY)
