"""Parts of the engine that no registered query reaches, and numbers that must not come from the engine's own tables."""

import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import distances
from glyphmill.functions.lexicon import Lexicon
from glyphmill.functions.storage import shared_folder
from glyphmill.operators import bm25, encode, evaluate, factor, search, stats
from glyphmill.sources import ndjson, synthetic, trec

LEX = Lexicon()


def test_numbers_of_words():
    """Numbers that the word list gives last, before and after its overrides."""
    raw = {"when": 3840, "training": 5073, "cloud": 4076, "region": 4055, "before": 4821, "refund": 5129, "good": 4531, "search": 3556, "review": 3562, "queue": 3553, "pipeline": 3640, "test": 4339, "commit": 3628}
    known = {"good": 3116, "search": 3318, "review": 3562, "queue": 3403, "pipeline": 3474, "test": 3537, "commit": 3578, "when": 3840, "cloud": 4076}
    assert {w: LEX.words[w] for w in raw} == raw and {w: LEX.lookup[w] for w in known} == known


def test_a_full_size_word_list(spark, tmp_path):
    words = {f"{a}{b}{c}word": 3000 + 5 * k for k, (a, b, c) in enumerate((a, b, c) for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyzabc")}
    path = tmp_path / "words.json"
    path.write_text(str(words).replace("'", '"'))
    lexicon = Lexicon.from_json(str(path))
    assert len(lexicon.words) == 900
    text = "The akuword met the BKVWORD, and akuwordx; jtcword's"
    got = [(r.surface, r.id) for r in encode.tokens(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), lexicon).orderBy("pos").collect()]
    assert {s: n for s, n in got if s in words} == {w: words[w] for w in ("akuword", "bkvword", "jtcword")}
    assert "".join(s for s, _ in got) == text.lower()


def test_longest_known_tokens(spark):
    lexicon = Lexicon({"ab": 3001, "abc": 3002, "abcd": 3003, "b-c": 3004})
    known = sorted(lexicon.lookup, key=lambda t: (-len(t), t))
    plain = re.compile("(?:" + "|".join(re.escape(t) for t in known if t.isalpha()) + r")(?![^\W\d_])|" + "|".join(re.escape(t) for t in known if len(t) > 1) + r"|[^\W\d_]+|(?s:.)")
    for text in ("abc abcde ab-c xab b-c-b abcd!", "aab b-cb-c the they andand"):
        got = spark.createDataFrame([(text,)], "t string").select(encode.surfaces(F.col("t"), lexicon).alias("s")).first().s
        assert got == plain.findall(text)


def test_slot_names_and_shared_slots(spark):
    row = spark.range(1).select(distances.slot_names(F.create_map(F.lit(0), F.lit(5), F.lit(9), F.lit(6))).alias("n"), distances.shared_slots(F.lit(0b1011), F.lit(0b0011)).alias("s")).first()
    assert row.n == {"WHO": 5, "DOMAIN": 6} and row.s == 2


def test_appended_records_are_numbered_on(spark, tmp_path):
    path = str(tmp_path / "records")
    for k in range(3):
        docs = spark.createDataFrame([(1000 * k + i, f"kafka text {i}") for i in range(40)], "doc_id bigint, text string")
        ndjson.append(ndjson.records(encode.encode(docs, LEX), docs, encode.semantic_group(encode.trace(docs, LEX))), path)
        stored = ndjson.read(spark, path)
        assert sorted(r.id for r in stored.collect()) == list(range(1, 40 * (k + 1) + 1)) and ndjson.next_id(stored) == 40 * (k + 1) + 1


def test_numbers_follow_doc_id(spark):
    docs = spark.createDataFrame([(i * 7919 % 1009, f"t {i}") for i in range(1009)], "doc_id bigint, text string").repartition(5)
    recs = ndjson.records(encode.encode(docs, LEX), docs, encode.semantic_group(encode.trace(docs, LEX)), first_id=11)
    texts = {r.doc_id: r.text for r in docs.collect()}
    short = {r.id: r.hash for r in recs.collect()}
    want = {r.id: r.hash for r in spark.createDataFrame([(11 + k, texts[d]) for k, d in enumerate(sorted(texts))], "id bigint, t string").select("id", F.substring(F.md5(F.col("t").cast("binary")), 1, 8).alias("hash")).collect()}
    assert short == want


def test_registry_round_trip(spark, tmp_path):
    registry = spark.createDataFrame([("wörd", 3005, "Greetings", "prefix"), ('q"uote', None, "Tech", "fallback")], encode.REGISTRY)
    ndjson.write_registry(registry, str(tmp_path / "r"))
    assert sorted(map(tuple, ndjson.read_registry(spark, str(tmp_path / "r"), lines=True).collect()), key=str) == sorted(map(tuple, registry.collect()), key=str)
    (tmp_path / "one.json").write_text('{\n "a": {"id": 1, "cluster": "c", "method": "m", "word": "a"},\n "b": {"id": 2, "cluster": "c", "method": "m"}}')
    assert sorted(map(tuple, ndjson.read_registry(spark, str(tmp_path / "one.json")).collect())) == [("a", 1, "c", "m"), ("b", 2, "c", "m")]
    assert ndjson.empty_registry(spark).count() == 0


def test_documents_without_titles(spark, tmp_path):
    (tmp_path / "d.xml").write_text("<DOC><DOCNO>7</DOCNO><TITLE>no</TITLE><TEXT>only\n this</TEXT></DOC>")
    assert [tuple(r) for r in trec.documents(spark, str(tmp_path / "d.xml"), with_title=False).collect()] == [("7", "only this")]


def test_negative_judgments_can_stay(spark, tmp_path):
    (tmp_path / "r.txt").write_text("1 0 2 -1\n1 0 3 1\n")
    assert {tuple(r) for r in trec.qrels(spark, str(tmp_path / "r.txt"), keep_negative=True).collect()} == {("1", "2", -1), ("1", "3", 1)}


def test_word_swaps(spark):
    base = spark.createDataFrame([(0, "the red door"), (1, "a blue car")], "k bigint, text string")
    got = [r.text for r in synthetic.swapped(base, {"red": ["green"], "blue": ["black", "white"]}, 200).collect()]
    assert len(got) == 200 and set(got) == {"the red door", "the green door", "a blue car", "a black car", "a white car"}
    assert got == [r.text for r in synthetic.swapped(base, {"red": ["green"], "blue": ["black", "white"]}, 200).collect()]


def test_totals_are_the_sums_of_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).select("doc_id", "text").union(spark.createDataFrame([(9999, "alone"), (9998, None), (9997, "")], "doc_id bigint, text string"))
    pairs = stats.cooccurrence(docs).groupBy(F.col("w1").alias("word")).agg(F.sum("n").alias("total"), F.min("seen").alias("seen"))
    assert sorted(map(tuple, stats.word_totals(docs).collect())) == sorted(map(tuple, pairs.collect()))


def test_comparison_of_systems(spark):
    docs, q = synthetic.corpus(spark, 200), synthetic.queries(spark, 15)
    truth = search.keyword_relevance(docs, q).withColumn("rel", F.lit(1))
    half = lambda: bm25.search(docs, q).where("rank % 2 = 0").withColumn("rank", F.col("rank") / 2)
    both = evaluate.compare({"whole": lambda: bm25.search(docs, q), "half": half}, truth)
    ratios = {r.system: r for r in evaluate.ratios(both, "whole").collect()}
    assert ratios["whole"].ndcg == 1.0 and 0 < ratios["half"].recall < 1
    swept = evaluate.sweep([{"k1": 1.5}, {"k1": 0.0}], lambda k1: bm25.search(docs, q, k1=k1), truth)
    assert {r.setting for r in swept.collect()} == {"[('k1', 1.5)]", "[('k1', 0.0)]"}


# Learned atoms ----------------------------------------------------------------------------------------------------------------


def planted(n=300, width=40, k=5, seed=3):
    rng = np.random.default_rng(seed)
    atoms = np.abs(rng.normal(size=(k, width))) * (rng.random((k, width)) < 0.3)
    h = np.abs(rng.normal(size=(n, k))) * (rng.random((n, k)) < 0.5)
    return (h @ atoms).astype(np.float32)


def test_codes_are_optimal():
    rng = np.random.default_rng(1)
    x, atoms, alpha = np.abs(rng.normal(size=(30, 20))), np.abs(rng.normal(size=(8, 20))), 0.3
    h = factor.code(x, atoms, alpha, sweeps=3000, tolerance=1e-12)
    slope = (h @ atoms - x) @ atoms.T + alpha
    assert (h >= 0).all() and np.abs(slope[h > 1e-9]).max() < 1e-6 and slope[h <= 1e-9].min() > -1e-6


def test_factors_reconstruct():
    x = planted()
    w = factor.learn_factors(x, n_basis=5)
    h = factor.code(x.astype(np.float64), w, 0.0, sweeps=500, tolerance=1e-9)
    assert (w >= 0).all() and np.linalg.norm(x - h @ w) < 0.1 * np.linalg.norm(x)


def test_dictionaries_reconstruct():
    x = planted()
    d = factor.learn_dictionary(x, n_atoms=8, alpha=0.01, rounds=60)
    h = factor.code(x.astype(np.float64), d, 0.01, sweeps=300, tolerance=1e-8)
    assert (d >= 0).all() and np.linalg.norm(d, axis=1).max() <= 1 + 1e-9 and np.linalg.norm(x - h @ d) < 0.25 * np.linalg.norm(x)


def test_affinity_of_atoms():
    atoms = np.array([[1.0, 0, 0], [0.6, 0.8, 0], [0, 0, 2.0]])
    assert np.allclose(factor.affinity(atoms), [[1, 0.6, 0], [0.6, 1, 0], [0, 0, 1]])
    s = factor.atom_statistics(atoms)
    assert np.isclose(s["max"], 0.6) and np.isclose(s["mean"], 1.2 / 9) and np.isclose(s["share"], 2 / 9)


@pytest.mark.parametrize(("method", "ranking"), [("dictionary", "maxsim"), ("nmf", "maxsim"), ("nmf", "gated"), ("nmf", "diffused")])
def test_learned_searches_beside_bm25(spark, method, ranking):
    docs, q = synthetic.corpus(spark, 300), synthetic.queries(spark, 20)
    truth = search.keyword_relevance(docs, q).withColumn("rel", F.lit(1))
    mean = lambda found: evaluate.macro(evaluate.per_query(found, truth)).first()
    r = factor.Retriever(n_atoms=24, max_features=300, rounds=10, method=method).fit(docs)
    mine, base = mean(r.search(q, 10, ranking)), mean(bm25.search(docs, q))
    assert mine.precision > 0.5 * base.precision and mine.ndcg > 0.5 * base.ndcg


def test_shared_folder_of_this_machine(spark):
    assert Path(re.sub("^file:", "", shared_folder(spark))).exists()
