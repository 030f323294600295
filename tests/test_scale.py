"""What grows with the number of pairs or with the corpus is neither kept nor sent."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from glyphmill.functions import distances
from glyphmill.functions.lexicon import Lexicon
from glyphmill.operators import bm25, dots, encode, energy, evaluate, factor, search, stats


@pytest.fixture()
def ranked_rows(monkeypatch):
    """Numbers of rows that searches hand to the final ranking."""
    seen = []

    def watch(module):
        plain = module.ranked
        monkeypatch.setattr(module, "ranked", lambda scored, *a, **b: seen.append(scored.count()) or plain(scored, *a, **b))
        return seen

    return watch


def atoms(spark, n):
    rng = np.random.default_rng(1)
    rows = [(i, int(a), float(round(v, 2))) for i in range(n) for a, v in zip(rng.choice(16, 4, replace=False), rng.random(4) + 0.01, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, atom int, value double").repartition(4).cache()
    queries = docs.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    return rows, queries, docs, factor.atom_idf(docs, n)


def test_maxsim_forms_no_row_for_a_pair(spark, ranked_rows):
    seen = ranked_rows(factor)
    rows, queries, docs, idf = atoms(spark, 3000)
    sim = spark.createDataFrame([(a, b, 1 / (1 + abs(a - b))) for a in range(16) for b in range(16)], "a int, b int, sim double")
    found = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in factor.maxsim(queries, docs, sim, idf, 5).collect()}
    assert seen[0] <= 30 * 5 * 4  # 30 queries, at most 5 each from 4 tasks
    held, weight = {}, {r.atom: r.idf for r in idf.collect()}
    for d, a, v in rows:
        held.setdefault(d, []).append((a, v))
    for q in range(0, 3000, 100):
        scores = [(-round(sum(v * weight[a] * max(w / (1 + abs(a - b)) for b, w in held[d]) for a, v in held[q]), 6), d) for d in held]
        assert [found[q, r][0] for r in range(1, 6)] == [d for _, d in sorted(scores)[:5]]


def test_rounding_is_that_of_spark(spark):
    x = [0.0000005, 1.0000005, 2.5e-7, 0.1234565, 0.1234575, 7.0000015, 123456.7890125, 0.3333333, 1e-9, 5.0000004999999]
    want = [r.r for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v double").select("i", F.round("v", 6).alias("r")).orderBy("i").collect()]
    assert (dots.rounded(np.array(x), 6) / 1e6).tolist() == want


@pytest.mark.parametrize("block", [2, 4096])
def test_blocks_and_ties(spark, monkeypatch, block):
    monkeypatch.setattr(dots, "BLOCK", block)
    docs = spark.createDataFrame([(f"d{i:03}", [1, 2], [0.5, 0.0 if i % 2 else 0.25]) for i in range(300)], "doc_id string, ids array<int>, ws array<double>").repartition(3)
    queries = spark.createDataFrame([(1, [1], [2.0]), (2, [2, 9], [1.0, 1.0]), (3, [9], [1.0]), (4, [1, 2], [1.0, 1.0])], "query_id int, ids array<int>, ws array<double>")
    got = {}
    for r in factor.ranked(dots.top(queries, docs, 3), 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert got == {1: [("d000", 1.0), ("d001", 1.0), ("d002", 1.0)], 2: [("d000", 0.25), ("d002", 0.25), ("d004", 0.25)], 4: [("d000", 0.75), ("d002", 0.75), ("d004", 0.75)]}


def test_floors_are_found_once(monkeypatch):
    cut, plain = [], np.partition
    monkeypatch.setattr(dots.np, "partition", lambda *a, **b: cut.append(1) or plain(*a, **b))
    rng = np.random.default_rng(5)
    scores = np.round(rng.random((40, 600)), 2)
    scores[:3, 4:] = 0  # fewer than k documents
    scores[5] = -scores[5]
    best = dots.Best(40, 10, 6)
    for start in range(0, 600, 50):
        best.add(scores[:, start : start + 50], pa.array(range(start, start + 50)))
    assert len(cut) == 1
    got = {}
    for r in best.table().to_pylist():
        got.setdefault(r["q"], []).append(r["doc_id"])
    assert got == {q: want for q in range(40) if (want := [d for s, d in sorted((-s, d) for d, s in enumerate(scores[q]) if s > 0)[:10]])}


def test_many_above_the_floor_raise_it():
    scores = np.repeat(np.arange(1.0, 5001.0)[None], 50, axis=0)  # each document is better than those before it
    best = dots.Best(50, 3, 6)
    for start in range(0, 5000, 500):
        best.add(scores[:, start : start + 500], pa.array(range(start, start + 500)))
        assert best.waiting <= 50 * 3 * 4 * (start // 500 + 1)
    assert best.table().column("doc_id").to_pylist() == [4999, 4998, 4997] * 50


def test_vectors_are_cut_to_atoms_once(spark, sf_dir):
    plan = entry.queries()["diffused_dot"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "embedding" not in plan  # all that follows reads the settled atoms


def test_bm25_forms_no_row_for_a_pair(spark, ranked_rows):
    seen = ranked_rows(bm25)
    docs = spark.createDataFrame([(i, "common " * (i % 7) + f"word{i}") for i in range(2000)], "doc_id long, text string").repartition(4)
    queries = spark.createDataFrame([(q, f"common word{q * 10}") for q in range(20)], "query_id long, query_text string")
    found = bm25.search(docs, queries, 3).where("rank = 1").collect()
    assert seen[0] <= 20 * 3 * 4
    assert {(r.query_id, r.doc_id) for r in found} == {(q, q * 10) for q in range(20)}


def test_bm25_counts_rows_of_one_id_together(spark):
    q = spark.createDataFrame([(1, "apple pear")], "query_id long, query_text string")
    twice = spark.createDataFrame([(1, "apple fig"), (1, "apple fig"), (2, "pear"), (None, "apple")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in bm25.search(twice, q, 9).collect()}
    n, average = 4, 6 / 4
    part = lambda tf, length: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / average))
    apple, pear = np.log((n - 2 + 0.5) / 2.5 + 1), np.log((n - 1 + 0.5) / 1.5 + 1)
    assert {d: round(s, 9) for d, s in got.items()} == {1: round(apple * part(2, 2), 9), 2: round(pear * part(1, 1), 9), None: round(apple * part(1, 1), 9)}


def test_metrics_sort_no_judgments(spark):
    qrels = spark.createDataFrame([(1, d, None if d == 5 else d % 3) for d in range(40)] + [(2, 1, 0)], "query_id long, doc_id long, rel int")
    results = spark.createDataFrame([(1, 1, 2), (1, 2, 99), (1, 3, 4)], "query_id long, rank int, doc_id long")
    m = evaluate.per_query(results, qrels)
    assert "NULLS LAST, doc_id" not in re.sub(r"#\d+L?", "", m._jdf.queryExecution().optimizedPlan().toString())
    ideal = sum(2 / np.log2(r + 1) for r in range(1, 11))
    (r,) = m.collect()
    assert (round(r.ndcg, 9), round(r.recall, 9)) == (round((2 + 1 / 2) / ideal, 9), round(2 / 25, 9))


def test_energy_forms_no_row_for_a_pair(spark, ranked_rows):
    seen = ranked_rows(energy)
    concepts = spark.createDataFrame([(d, c) for d in range(2000) for c in (1, 2 + d % 3)], "doc_id long, cid int").repartition(4)
    e = spark.createDataFrame([(q, c, float(c)) for q in range(20) for c in (1, 2, 4)], "query_id long, cid int, energy double")
    given = spark.createDataFrame([(q, 2 + 3 * i) for q in range(20) for i in range(2)], "query_id long, doc_id long")
    assert {(r.query_id, r["rank"], r.doc_id, r.score) for r in energy.score(e, concepts, 3, excluded=given).collect()} == {(q, i + 1, 8 + 3 * i, 5.0) for q in range(20) for i in range(3)}
    assert seen[0] <= 20 * 5 * 4


def slot_rows(spark, n, key, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, [(int(s), int(v)) for s, v in zip(sorted(rng.choice(6, 3, replace=False)), rng.integers(0, 3000, 3), strict=True)] if i % 50 else [], i % 4 - 1) for i in range(n)]
    return rows, spark.createDataFrame(rows, f"{key} long, row array<struct<slot:int,value:int>>, cid int").repartition(3)


def test_zones_deal_no_pairs(spark):
    asked, q = slot_rows(spark, 30, "query_id", 1)
    held, d = slot_rows(spark, 400, "doc_id", 2)
    near = lambda a, b: any(s == t and abs(v - w) <= 150 for s, v in a for t, w in b)
    out = search.zone_candidates(q, d, measured=True).cache()
    assert "Exchange" not in search.zone_candidates(q, d.coalesce(2).localCheckpoint())._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.query_id, r.doc_id) for r in out.collect()) == [(i, j) for i, a, _ in asked for j, b, _ in held if near(a, b)]
    apart = {(i, j): [abs(v - w) for s, v in a for t, w in b if s == t] for i, a, _ in asked for j, b, _ in held}
    assert all((r.n_shared, r.gap) == (len(apart[r.query_id, r.doc_id]), sum(apart[r.query_id, r.doc_id])) for r in out.collect())
    same = search.zone_candidates(q, d, on=("cid",), more=("cid",))
    assert sorted((r.query_id, r.doc_id, r.cid) for r in same.collect()) == [(i, j, c) for i, a, c in asked for j, b, e in held if c == e and near(a, b)]


def test_related_clusters_are_routes(spark):
    """The pool of a related search is never formed; routes are clusters, each once, the nearer kind first."""
    q = spark.createDataFrame([(1, 5), (2, -1), (3, 6)], "query_id long, cid int")
    related = spark.createDataFrame([(5, 6), (5, -1), (5, 5), (6, 5)], "bucket int, related int")
    assert {(r.query_id, r.cid, r.pool) for r in search._routed(q, related).collect()} == {(1, 5, 0), (1, -1, 1), (1, 6, 2), (2, -1, 1), (3, 6, 0), (3, -1, 1), (3, 5, 2)}


def weighted_rows(spark, x, parts=5):
    rows = [(i, [int(j) for j in np.nonzero(r)[0]], [float(v) for v in r[r > 0]]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "doc_id long, ids array<int>, ws array<double>").repartition(parts)


def test_fits_sum_over_every_document(spark, monkeypatch):
    """No sample: sums over blocks in the cluster are those over the whole matrix, and so are the atoms that come of them."""
    monkeypatch.setattr(factor, "BLOCK", 32)
    rng = np.random.default_rng(3)
    x = ((np.abs(rng.normal(size=(300, 5))) * (rng.random((300, 5)) < 0.5)) @ (np.abs(rng.normal(size=(5, 40))) * (rng.random((5, 40)) < 0.3))).astype(np.float32)
    spread = factor.Spread(weighted_rows(spark, x), 40)
    plain = lambda x, w: np.concatenate([[len(x)], (x.T @ x).ravel(), w])
    got = spread.total(plain, np.zeros(20))
    assert got[0] == 300 and np.allclose(got[1:1601], (x.T @ x).ravel(), rtol=1e-4)
    w = factor.learn_factors(spread, n_basis=5)
    h = factor.code(x.astype(np.float64), w, 0.0, sweeps=500, tolerance=1e-9)
    assert (w >= 0).all() and np.linalg.norm(x - h @ w) < 0.1 * np.linalg.norm(x)
    assert np.allclose(w, factor.learn_factors(x, n_basis=5), atol=0.05 * w.max())
    d = factor.learn_dictionary(spread, n_atoms=8, alpha=0.01)
    h = factor.code(x.astype(np.float64), d, 0.01, sweeps=300, tolerance=1e-8)
    assert np.linalg.norm(d, axis=1).max() <= 1 + 1e-6 and np.linalg.norm(x - h @ d) < 0.25 * np.linalg.norm(x)


def test_fits_hold_atoms_and_sums_only(spark, monkeypatch):
    """The driver gets a row for each piece of the sums and, to begin with, one for each atom."""
    seen, plain = [], type(spark.range(1)).toArrow
    monkeypatch.setattr(type(spark.range(1)), "toArrow", lambda self: seen.append(plain(self)) or seen[-1])
    docs = spark.createDataFrame([(i, f"common word{i % 40} word{i % 7} other{i % 11}") for i in range(2000)], "doc_id long, text string").repartition(4)
    for method in ("dictionary", "nmf"):
        factor.Retriever(n_atoms=6, method=method, rounds=3).fit(docs)
    assert seen and max(t.num_rows for t in seen) <= 58  # the vocabulary


def test_tfidf_deals_no_terms(spark):
    docs = spark.createDataFrame([(1, "apple apple fig"), (2, "apple pear"), (3, "pear fig zz"), (4, "yy"), (5, None)], "doc_id long, text string")
    v = factor.vocabulary(docs, min_df=2).localCheckpoint()
    assert [(r.term_id, r.term) for r in v.orderBy("term_id").collect()] == [(0, "apple"), (1, "fig"), (2, "pear")]
    out = factor.tfidf(docs.coalesce(1).localCheckpoint(), v)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    same = np.log(6 / 3) + 1
    part = {(1, 0): (np.log(2) + 1) * same, (1, 1): same, (2, 0): same, (2, 2): same, (3, 1): same, (3, 2): same}
    length = {d: sum(x * x for (e, _), x in part.items() if e == d) ** 0.5 for d in (1, 2, 3)}
    assert {(r.doc_id, r.term_id): round(r.w, 9) for r in out.collect()} == {k: round(x / length[k[0]], 9) for k, x in part.items()}


def test_tfidf_counts_rows_of_one_id_together(spark):
    twice = spark.createDataFrame([(1, "apple fig"), (1, "apple"), (None, "fig"), (None, "fig")], "doc_id long, text string")
    v = factor.vocabulary(twice, min_df=1, max_df=1.0).localCheckpoint()
    assert {(r.term, r.df, r.total) for r in factor.term_totals(twice).collect()} == {("apple", 1, 2), ("fig", 2, 3)}
    w = {(r.doc_id, r.term_id): r.w for r in factor.tfidf(twice, v).collect()}
    assert set(w) == {(1, 0), (1, 1), (None, 1)} and w[None, 1] == 1 and w[1, 0] > w[1, 1]


def odd_texts(spark, repeated=False):
    said = ["Kafka qqqzz lag, the zzyyx!", None, "", "ﬁ ÄÖ ßtraße 日本語 qqqzz", "😀😀 é ǅungla ​", "  error fraud  Fraud refund zzyyx", "123 __ --", "Kafka qqqzx lag error \t\n wwvvu", "ancient login_page x"]
    rows = [((k * 7) % 9, t) for k, t in enumerate(said)] + ([(0, "again kafka"), (None, "nothing")] if repeated else [])
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("repeated", [False, True])
def test_encoding_needs_no_row_for_a_token(spark, repeated):
    """The same as by tokens, one a row, on odd texts; nothing is dealt where ids are single."""
    lex, docs = Lexicon(), odd_texts(spark, repeated)
    words = encode.unknown_words(encode.tokens(docs, lex))
    assert sorted(map(str, encode.unknown_words_of(docs, lex).collect())) == sorted(map(str, words.collect()))
    registry = encode.register(words, lex).withColumn("id", F.expr("if(word = 'wwvvu', null, id)")).localCheckpoint()
    split = encode.tokens(docs, lex)
    plain = encode.encode(docs, lex, registry, split=split)
    show = lambda df: sorted(str((r[0], r[1], sorted(r.blueprint.items()), r.row, r.signature)) for r in df.collect())
    assert show(encode.encode(docs, lex, registry)) == show(plain)
    assert sorted(map(str, encode.groups(docs, lex, registry).collect())) == sorted(map(str, encode.semantic_group(encode.trace(docs, lex, registry)).collect()))
    if not repeated:
        plan = encode.numbered(docs.coalesce(2).localCheckpoint(), lex, registry)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Generate" not in plan


@pytest.mark.parametrize("threshold", [50.0, 1e9])
def test_semantic_distances_need_no_cross_join(spark, threshold):
    rng = np.random.default_rng(5)
    lists = lambda n: [(i, [None if rng.random() < 0.1 else int(v) for v in rng.integers(0, 120, rng.integers(0, 9))]) for i in range(n)]
    q = spark.createDataFrame(lists(20), "query_id int, ids array<int>")
    d = spark.createDataFrame([*lists(300), (999, list(range(5000)))], "doc_id long, ids array<int>").repartition(3)
    got = search.semantic(q, d, threshold)
    assert "CartesianProduct" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    want = d.crossJoin(q.withColumnRenamed("ids", "q_ids")).withColumn("distance", distances.semantic_distance(F.col("q_ids"), F.col("ids"))).where(F.col("distance") <= threshold)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("query_id", "doc_id", "distance").collect()))


def test_keyword_truth_deals_no_pairs(spark):
    docs = spark.createDataFrame([(1, "Apple fig fig"), (2, "pear"), (3, None), (4, "apple PEAR x"), (None, "fig")], "doc_id long, text string")
    q = spark.createDataFrame([(1, ["apple", "fig", "fig"]), (2, ["pear"]), (3, []), (4, ["apple", "none"]), (None, ["x"])], "query_id int, keywords array<string>")
    want = {(1, 1), (4, 1), (2, 2), (1, 4), (4, 4), (2, 4), (None, 4), (1, None)}
    assert sorted(map(str, map(tuple, search.keyword_relevance(docs, q).collect()))) == sorted(map(str, want))
    assert sorted(map(str, map(tuple, search.keyword_relevance(docs.union(docs), q).collect()))) == sorted(map(str, want))
    one = docs.where("doc_id > 0").localCheckpoint()
    assert "Exchange" not in search.keyword_relevance(one, q)._jdf.queryExecution().executedPlan().toString()
    assert search.keyword_relevance(docs, q.where("query_id = 3")).count() == 0
    found = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 4), (5, 1)], "query_id int, doc_id long")
    m = lambda truth, **k: {r.query_id: (r.tp, r.fp, r.fn) for r in evaluate.set_metrics(found, truth, **k).collect()}
    truth = search.keyword_relevance(one, q.where("query_id > 0"))
    assert m(truth, single=True) == m(truth.union(truth)) == {1: (1, 1, 1), 2: (1, 0, 1), 4: (0, 0, 2), 5: (0, 1, 0)}


@pytest.mark.parametrize("words", [1, 25, 1 << 20])
def test_words_are_counted_in_their_tasks(spark, monkeypatch, words):
    monkeypatch.setattr(stats, "WORDS", words)
    rng = np.random.default_rng(3)
    texts = [None, "", "single", "same same", *(" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "élan", "omega", "(kappa)"], n)) for n in (2, 3, 7, 8, 30, 30, 41))]
    rows = [(f"d{(i * 7) % 5}" if i % 6 else None, t) for i, t in enumerate(texts * 2)]  # ids repeat, one is null
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3).cache()
    heads = spark.createDataFrame([("alpha",), ("same",), ("absent",)], "word string")
    totals, near = stats.word_totals(docs), stats.cooccurrence(docs, heads=heads)
    for found in (totals, near):
        assert "posexplode" not in found._jdf.queryExecution().optimizedPlan().toString()  # no row for a word or a pair
    pairs = stats.cooccurrence(docs)
    rows = lambda found: sorted(map(repr, found.collect()))
    assert rows(near) == rows(pairs.where("w1 IN ('alpha', 'same')")) and near.schema["seen"].dataType.names == ["doc_id", "i", "j"]
    assert rows(totals) == rows(pairs.groupBy(F.col("w1").alias("word")).agg(F.sum("n").alias("total"), F.min("seen").alias("seen")))


def test_concepts_of_documents_are_found_once(spark, sf_dir):
    plan = entry.queries()["direct_energy_full"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "conv_id" not in plan  # graph and scores read the settled concepts
