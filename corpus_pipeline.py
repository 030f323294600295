"""A corpus made ready for training, stage by stage: each stage's result is written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.storage import remove, shared_folder
from glyphmill.llm import fmindex, packing, rules, secrets, simhash
from glyphmill.llm.rows import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go.

    Null, empty and wordless texts go, by the base rule; long ones are judged whole. Repeated rows stay or go together, null ids count
    as any other. Without usable labels the base rule alone decides. Columns of other names stay.
    """
    return rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: that of the smallest doc_id, null last.

    Wordless and null texts are copies of one another. Of rows that repeat the doc_id that with the smallest hash of its text stays, and
    of rows that repeat both any one. An empty table stays empty.
    """
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside a passage of the benchmark are cut from the texts, and n_chars is counted anew.

    No row goes: a text that is all passage becomes empty, a null stays null with a null n_chars. Without a benchmark nothing is cut.
    """
    return fmindex.decontaminate(docs, table(spark, sf_dir, "benchmark")).withColumn("n_chars", F.length("text").cast("long"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, overlapping ones by one mark, and n_chars is counted anew.

    No row goes; nulls stay null with a null n_chars. Where no text holds a pattern match, nothing is learned and nothing changes.
    """
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents, each with its place in a sequence.

    Null and empty texts are one end token; repeated rows are packed as often as they occur, null ids stay null. An empty table
    has no piece.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("packing", pack),
]

#: Learned models, connected components and a tokenizer are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir; their results are in a folder of their own below the shared one.

    A stage's result is removed once the next one's is written; the last one's stays, since it is what is returned.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
