"""Seeded synthetic corpora: templates with fills, and word swaps, as expressions over a range of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOMAINS: dict[str, tuple[list[str], dict[str, list[str]]]] = {
    "messaging": (["The {tool} {part} {event} during {time}", "Our {part} on {tool} {event} after the {time} release"], {"tool": ["kafka", "redis", "queue"], "part": ["broker", "consumer", "producer"], "event": ["failed", "lagged", "restarted"], "time": ["deployment", "backup", "migration"]}),
    "finance": (["A {event} {thing} was flagged on the {owner} account", "The {owner} asked about a {event} {thing}"], {"event": ["suspicious", "failed", "large"], "thing": ["transaction", "payment", "refund"], "owner": ["customer", "client", "team"]}),
    "people": (["The {role} scheduled a {thing} about {topic}", "Feedback on {topic} came from the {role} before the {thing}"], {"role": ["manager", "engineer", "analyst"], "thing": ["meeting", "interview", "review"], "topic": ["salary", "hiring", "training"]}),
    "security": (["An {event} hit the {thing} at night", "The {thing} showed signs of an {event}"], {"event": ["attack", "intrusion", "exploit"], "thing": ["server", "database", "network"]}),
    "support": (["The {who} opened a {thing} on {topic}", "A {thing} on {topic} upset the {who}"], {"who": ["customer", "user", "client"], "thing": ["ticket", "complaint", "question"], "topic": ["delivery", "billing", "subscription"]}),
    "cloud": (["The {thing} in the {place} region went {state}", "We moved the {thing} to the {place} region, and it is {state}"], {"thing": ["cluster", "pipeline", "database"], "place": ["east", "west", "north"], "state": ["down", "slow", "stable"]}),
}


def _chosen(of: list[str], *seed: object) -> Column:
    """One of the values, by the first 32 bits of the digest of id and seeds."""
    digest = F.md5(F.concat_ws(":", F.col("id").cast("string"), *[F.lit(str(s)) for s in seed]).cast("binary"))
    k = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % len(of)
    return F.array(*[F.lit(x) for x in of])[k.cast("int")]


def corpus(spark: SparkSession, n: int = 5000, seed: int = 42) -> DataFrame:
    """(doc_id, text, domain): templates of six domains with fills, by the hash of id, field and seed."""
    names = list(DOMAINS)
    text = None
    for name in names:
        templates, fills = DOMAINS[name]
        filled = _chosen(templates, seed, name)
        for field, values in fills.items():
            filled = F.replace(filled, F.lit("{" + field + "}"), _chosen(values, seed, name, field))
        text = F.when(F.col("domain") == name, filled) if text is None else text.when(F.col("domain") == name, filled)
    return spark.range(n).withColumn("domain", _chosen(names, seed, "domain")).select(F.col("id").alias("doc_id"), text.alias("text"), "domain")


def queries(spark: SparkSession, n: int = 100, seed: int = 42) -> DataFrame:
    """(query_id, query_text, keywords): two fills of a domain each."""
    names = list(DOMAINS)
    words = {name: [v for vs in DOMAINS[name][1].values() for v in vs] for name in names}
    first = second = None
    for name in names:
        here = F.col("domain") == name
        a, b = _chosen(words[name], seed, name, "first"), _chosen(words[name], seed, name, "second")
        first = F.when(here, a) if first is None else first.when(here, a)
        second = F.when(here, b) if second is None else second.when(here, b)
    q = spark.range(n).withColumn("domain", _chosen(names, seed, "query")).select("id", first.alias("a"), second.alias("b"))
    return q.select(F.col("id").alias("query_id"), F.concat_ws(" ", "a", "b").alias("query_text"), F.array_distinct(F.array("a", "b")).alias("keywords"))


def swapped(base: DataFrame, swaps: dict[str, list[str]], n: int, seed: int = 42) -> DataFrame:
    """(doc_id, text): n sentences of `base` (k, text), k from 0, with at most one word replaced by one of its swaps, each with chance 1/2 in turn."""
    spark = base.sparkSession
    size = base.count()
    picked = spark.range(n).withColumn("k", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(size))).join(base, "k")
    text = F.col("text")
    coins = [text.contains(w) & (F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(w)), F.lit(2)) == 0) for w in swaps]
    out = None
    for (w, others), coin in zip(swaps.items(), coins, strict=True):
        new = F.replace(text, F.lit(w), _chosen(others, seed, w, "swap"))
        out = F.when(coin, new) if out is None else out.when(coin, new)
    return picked.select(F.col("id").alias("doc_id"), (text if out is None else out.otherwise(text)).alias("text"))
