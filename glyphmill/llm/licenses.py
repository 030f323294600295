"""License scans by DataFrame operations only: sparse TF-IDF cosine of notices to templates, then inheritance along paths.

A template's cues are its heaviest terms, common words last, without which no passage can reach the threshold. Where two of a template's
cues, or its only one, stand in a text as far apart as in the template, wherever lines end, there is a seed: the place at which the
template would begin. A seed's passages run from that place, or from its first cue, to where the template would end, a quarter of its
length further, or to its last cue; each is cut to begin and end with a term of the template, and the best cosine counts. Seeds are
found and scored beside each text's terms, so nothing but (file, template, cosine) leaves a task. Weights are of term frequency times
inverse frequency over the templates; terms of no template weigh the most.
A file without a licence of its own takes that of the nearest directory above it with a licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.license_templates import TEMPLATES
from glyphmill.llm.rows import pick, settle

THRESHOLD = 0.75
TERM = "[a-z0-9]+(?:\\.[0-9]+)*"
#: Common words, which serve as cues only where nothing else is left.
COMMON = "a all an and any are as at be by for from if in is it its may not of on or that the this to use with you".split()
#: A base name that makes a file's licence that of its directory.
LICENCE_FILE = "(?i)^(licen[cs]e|copying|unlicense)([._-].*)?$"


def terms_of(text: str) -> list[str]:
    return re.findall(TERM, re.sub("[A-Z]+", lambda m: m[0].lower(), text))


class Templates:
    """Unit vectors of the templates over their own vocabulary."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [name for name, _ in templates]
        counts = [Counter(terms_of(text)) for _, text in templates]
        df = Counter(t for c in counts for t in c)
        self.idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in df.items()}
        self.idf_else = math.log(1 + len(counts)) + 1
        self.terms = [terms_of(text) for _, text in templates]
        self.vectors = []
        for c in counts:
            v = {t: n * self.idf[t] for t, n in c.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            self.vectors.append({t: x / norm for t, x in v.items()})

    def cues(self, template: int, threshold: float) -> list[str]:
        """Terms of which a passage that reaches the threshold holds at least one, those of most weight first and common words last."""
        out, left = [], 1.0
        for t, x in sorted(self.vectors[template].items(), key=lambda p: (p[0] in COMMON, -p[1], p[0])):
            if math.sqrt(max(0.0, left)) < threshold - 1e-9:
                break
            out.append(t)
            left -= x * x
        return out


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Cues that must agree on a place, where a template has so many, and by which part of its length a passage may be longer.
AGREEING, LONGER = 2, 0.25


def passages(files: DataFrame, templates: Templates, threshold: float) -> DataFrame:
    """(key, template, cosine) of passages that reach the threshold, the best of each seed."""
    cues = [templates.cues(k, threshold) for k in range(len(templates.names))]
    places: dict[str, list[Column]] = {c: [] for c in sorted(set().union(*cues))}
    for k, terms in enumerate(templates.terms):
        for q, t in enumerate(terms):
            if t in cues[k]:
                places[t].append(F.struct(F.lit(k).alias("template"), F.lit(q).alias("q")))
    if not places:
        return files.select("key", F.lit(0).alias("template"), F.lit(0.0).alias("cosine")).limit(0)
    wanted = F.array(*map(F.lit, places))
    places_of = F.create_map(*[x for c, at in places.items() for x in (F.lit(c), F.array(*at))])
    length = F.array(*[F.lit(len(t)) for t in templates.terms])
    agreeing = F.array(*[F.lit(min(AGREEING, len(c))) for c in cues])
    weights = F.array(*[F.create_map(*[x for t, w in sorted(v.items()) for x in (F.lit(t), F.lit(w))]) for v in templates.vectors])
    idf = F.create_map(*[x for t, w in sorted(templates.idf.items()) for x in (F.lit(t), F.lit(w))])

    def kept(c: Column, name: str, df: DataFrame, *more: str) -> DataFrame:
        """With a column that later expressions use but don't compute anew: a generator stands between."""
        return df.select("key", *more, F.explode(F.array(c)).alias(name))

    cue = "(?<![a-z0-9])(?:" + "|".join(re.escape(c) for c in places) + ")(?![a-z0-9])"
    low = kept(lower_ascii(F.col("text")), "low", files).where(F.col("low").rlike(cue))
    terms = kept(F.regexp_extract_all("low", F.lit(TERM), F.lit(0)), "terms", low)
    found = kept(F.array_intersect("terms", wanted), "found", terms, "terms").where(F.size("found") > 0)
    anchors = F.filter(F.transform("terms", lambda t, i: F.when(F.array_contains("found", t), F.struct(t.alias("cue"), i.alias("i")))), lambda a: a.isNotNull())
    placed = F.flatten(F.transform(anchors, lambda a: F.transform(places_of[a["cue"]], lambda p: F.struct(p["template"].alias("template"), (a["i"] - p["q"]).alias("start"), a["i"].alias("i"), a["cue"].alias("cue")))))
    # cues that agree on a place stand together once sorted; a run of them is closed when the next place begins
    ordered = kept(F.array_append(F.array_sort(placed), F.struct(F.lit(-1).alias("template"), F.lit(0).alias("start"), F.lit(0).alias("i"), F.lit("").alias("cue"))), "placed", found, "terms")
    none = F.struct(
        F.lit(-1).alias("template"), F.lit(0).alias("start"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(0).alias("n"),
        F.array().cast("array<struct<template:int,start:int,first:int,last:int>>").alias("seeds"),
    )

    def step(s: Column, p: Column) -> Column:
        same = (s["template"] == p["template"]) & (s["start"] == p["start"])
        done = (s["template"] >= 0) & (s["n"] >= agreeing[F.greatest(s["template"], F.lit(0))])
        seeds = F.when(done, F.array_append(s["seeds"], F.struct(s["template"].alias("template"), s["start"].alias("start"), s["first"].alias("first"), s["last"].alias("last")))).otherwise(s["seeds"])
        return F.when(same, F.struct(s["template"].alias("template"), s["start"].alias("start"), s["first"].alias("first"), p["i"].alias("last"), (s["n"] + 1).alias("n"), s["seeds"].alias("seeds"))).otherwise(
            F.struct(p["template"].alias("template"), p["start"].alias("start"), p["i"].alias("first"), p["i"].alias("last"), F.lit(1).alias("n"), seeds.alias("seeds"))
        )

    seeds = ordered.select("key", "terms", F.explode(F.aggregate("placed", none, step, lambda s: s["seeds"])).alias("seed"))
    seeds = seeds.select("key", "terms", F.col("seed.*"), length[F.col("seed.template")].alias("length"), weights[F.col("seed.template")].alias("weights"))
    starts = F.array_distinct(F.array(F.greatest("start", F.lit(0)), F.col("first")))
    ends = F.array_distinct(F.transform(F.array(F.col("start") + F.col("length"), F.col("start") + F.ceil(F.col("length") * (1 + LONGER)).cast("int"), F.col("last") + 1), lambda e: F.least(e, F.size("terms"))))
    spans = F.flatten(F.transform(starts, lambda s: F.transform(ends, lambda e: F.slice("terms", s + 1, e - s))))
    runs = seeds.select("key", "template", "weights", F.explode(F.array_distinct(spans)).alias("run"))
    inside = F.transform("run", lambda t: F.col("weights")[t].isNotNull())
    trimmed = F.slice("run", F.array_position(inside, True).cast("int"), (F.size("run") + 2 - F.array_position(inside, True) - F.array_position(F.reverse(inside), True)).cast("int"))
    runs = runs.select("key", "template", "weights", F.explode(F.array(trimmed)).alias("run"))
    dot = F.aggregate("run", F.lit(0.0), lambda a, t: a + F.coalesce(F.col("weights")[t] * F.coalesce(idf[t], F.lit(templates.idf_else)), F.lit(0.0)))
    size = F.aggregate(F.array_distinct("run"), F.lit(0.0), lambda a, t: a + F.pow(F.size(F.filter("run", lambda x: x == t)) * F.coalesce(idf[t], F.lit(templates.idf_else)), F.lit(2.0)))
    return runs.select("key", "template", F.round(dot / F.sqrt(size), 9).alias("cosine")).where(F.col("cosine") >= threshold)


def own_licences(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(key, licence, cosine) of the files (key, text) that hold a passage like a template: the best, by cosine, then by name."""
    t = Templates(templates)
    names = files.sparkSession.createDataFrame(list(enumerate(t.names)), "template int, licence string")
    scored = settle(passages(files, t, threshold).groupBy("key", "template").agg(F.max("cosine").alias("cosine"))).join(F.broadcast(names), "template")
    best = scored.groupBy("key").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "licence")).alias("best"))
    return best.select("key", F.col("best.licence").alias("licence"), (-F.col("best.less")).alias("cosine"))


def scan(files: DataFrame, path: str = "path", text: str = "text", doc_id: str = "doc_id", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, path, own_licence, cosine, licence, licensed_by), a row for each input row.

    licensed_by is `own`, or the directory that the licence comes from, or null without any. Null, empty and blank texts have no
    licence of their own. A null path has no directory and inherits nothing; rows of equal path are one file with several
    texts: they share the best licence. Of several licence files in a directory the one of largest cosine counts, then by name.
    """
    f = pick(files, doc_id, path, text).toDF("doc_id", "path", "text")
    # rows of a null path stand for themselves
    f = f.withColumn("key", F.coalesce(F.concat(F.lit("p"), "path"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(":"), F.xxhash64("text").cast("string")), F.lit("-")))
    own = own_licences(f.select("key", F.coalesce("text", F.lit("")).alias("text")), templates, threshold)
    rows = f.select("doc_id", "path", "key")
    parts = F.split("path", "/")
    depth = F.size(parts) - 1  # 0: the root
    named = rows.where(F.element_at(parts, -1).rlike(LICENCE_FILE)).select("key", F.array_join(F.slice(parts, 1, depth), "/").alias("dir")).distinct()
    granted = named.join(own, "key").groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "licence")).alias("g")).select("dir", F.col("g.licence").alias("granted"))
    with_own = rows.join(own, "key", "left")
    bare = with_own.where("licence IS NULL AND path IS NOT NULL").select("key", F.col("path")).distinct()
    ancestors = bare.select("key", F.explode(F.transform(F.sequence(F.lit(0), depth), lambda k: F.struct(k.alias("depth"), F.when(k == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, 1, F.greatest(k, F.lit(1))), "/")).alias("dir")))).alias("a")).select("key", "a.depth", "a.dir")
    heir = ancestors.join(granted, "dir").groupBy("key").agg(F.max(F.struct("depth", "dir", "granted")).alias("h"))
    out = with_own.join(heir.select("key", "h"), "key", "left")
    return out.select("doc_id", "path", F.col("licence").alias("own_licence"), "cosine", F.coalesce("licence", "h.granted").alias("licence"), F.when(F.col("licence").isNotNull(), F.lit("own")).otherwise(F.col("h.dir")).alias("licensed_by"))


def laid_out(documents: DataFrame) -> DataFrame:
    """The documents with a path, since they carry none: source/<id div 4096>/<id div 64>/<id>.txt.

    Every 64th is the LICENSE file of that directory, every 4096th that of the directory above.
    """
    k = F.col("doc_id")
    name = F.when(k % 64 == 0, F.lit("LICENSE")).otherwise(F.concat(k.cast("string"), F.lit(".txt")))
    inner = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(k / 4096).cast("string"), F.floor(k / 64).cast("string"), name)
    outer = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(k / 4096).cast("string"), F.lit("LICENSE"))
    return documents.withColumn("path", F.when(k % 4096 == 0, outer).otherwise(inner))
