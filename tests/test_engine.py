"""The retrieval engine against plain restatements, hand-made cases and its DuckDB forms."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from glyphmill.functions import distances, lexicon, tokens
from glyphmill.functions.lexicon import Lexicon
from glyphmill.operators import bm25, encode, energy, evaluate, factor, search, stats
from glyphmill.sources import ndjson, synthetic, trec

LEX = Lexicon()
TEXTS = [
    (1, "Kafka consumer lag detected during deployment"),
    (2, "The customer was frustrated with the refund process!"),
    (3, "what is the best approach to fraud detection"),
    (4, "A suspicious transaction on the account; the team resolved it."),
    (5, "engineers monitor the kubernetes cluster in real-time"),
    (6, ""),
    (7, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id bigint, text string")


def plain_tokens(text):
    lower, out, pos = (text or "").lower(), [], 0
    known = sorted(LEX.lookup, key=lambda t: (-len(t), t))
    while pos < len(lower):
        if lower[pos].isalpha():
            end = pos
            while end < len(lower) and lower[end].isalpha():
                end += 1
            run = lower[pos:end]
            part = next((t for t in known if lower.startswith(t, pos) and len(t) > 1), None)
            t = run if run in LEX.lookup else part or run
            out.append((t, LEX.lookup.get(t)))
            pos += len(t)
        else:
            out.append((lower[pos], LEX.lookup.get(lower[pos], ord(lower[pos]))))
            pos += 1
    return out


def test_tokens(docs):
    got = {}
    for r in encode.tokens(docs, LEX).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.surface, r.id))
    assert got == {k: plain_tokens(t) for k, t in TEXTS if t}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def plain_resolve(word):
    for p, c in sorted(lexicon.PREFIXES.items(), key=lambda x: -len(x[0])):
        if word.startswith(p) and len(word) > len(p) + 2:
            return c, "prefix"
    for s, c in sorted(lexicon.SUFFIXES.items(), key=lambda x: -len(x[0])):
        if word.endswith(s) and len(word) > len(s) + 1:
            return c, "suffix"
    near = [(levenshtein(word, w), k, lexicon.cluster_of(n)) for k, (w, n) in enumerate(LEX.words.items()) if abs(len(w) - len(word)) <= 5]
    if near and min(near)[0] <= max(2, len(word) // 3) and min(near)[2]:
        return min(near)[2], "edit_distance"
    votes = {}
    for n in (3, 4):
        for i in range(len(word) - n + 1):
            for w, k in LEX.words.items():
                c = lexicon.cluster_of(k)
                if word[i : i + n] in w and c and c != lexicon.FALLBACK:
                    votes[c] = votes.get(c, 0) + 12 // n
    if votes and max(votes.values()) >= 6:
        return max(votes, key=votes.get), "ngram_voting"
    return lexicon.FALLBACK, "fallback"


def test_resolver_and_numbers(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abdeginorstuyé") for _ in range(rng.randrange(1, 12))) for _ in range(200)} - set(LEX.lookup))
    df = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "word string, seen int")
    reg = {r.word: r for r in encode.register(df, LEX).collect()}
    assert {w: (reg[w].cluster, reg[w].method) for w in words if reg[w].method != "fallback_cluster_full"} == {w: plain_resolve(w) for w in words if reg[w].method != "fallback_cluster_full"}
    for name, (lo, hi) in lexicon.RANGES.items():
        ids = [reg[w].id for w in words if reg[w].cluster == name]
        assert all(lo <= x <= hi for x in ids) and len(set(ids)) == len(ids)
    again = {r.word: r.id for r in encode.register(spark.createDataFrame([("qqqzzzqqq", 1), (words[0], 2)], "word string, seen int"), LEX, encode.register(df, LEX)).collect()}
    assert again.items() >= {w: reg[w].id for w in words}.items() and len(again) == len(words) + 1


def test_slots(docs):
    rows = {r.doc_id: r for r in encode.encode(docs, LEX).collect()}
    assert rows[1].blueprint[2] == 3401 and 3 in rows[2].blueprint and 6 in rows[3].blueprint and 9 in rows[3].blueprint
    assert rows[6].ids == [] and rows[7].signature == 0 and all(0 <= k <= 9 and v > 0 for r in rows.values() for k, v in r.blueprint.items())
    assert all(r.signature == sum(1 << s.slot for s in r.row) for r in rows.values())


def test_distances(spark):
    one = spark.range(1)
    arr = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<int>")
    bp = lambda d: F.create_map(*[F.lit(v) for kv in d.items() for v in kv]).cast("map<int,int>")
    r = one.select(
        distances.semantic_distance(arr(1, 2), arr(4)).alias("a"),
        distances.semantic_distance(arr(), arr()).alias("b"),
        distances.blueprint_distance(bp({1: 10, 2: 5}), bp({1: 12, 3: 7})).alias("c"),
        distances.blueprint_distance(bp({}), bp({})).alias("d"),
        distances.semantic_label(F.lit(20.0)).alias("e"),
        distances.row_distance(F.lit(1), F.lit(10)).alias("f"),
        distances.weighted_distance(F.lit(2), F.lit(30.0), F.lit(3.0), F.lit(7), F.lit(3), F.lit(0.1), F.lit(9.0)).alias("g"),
    ).first()
    assert r.a == (3 + 30) / 2 and r.b is None and r.c == round((2 + 200 + 200) / 3, 4) and r.d == 0 and r.e == "Very similar" and r.f == 9999.0
    assert math.isclose(r.g, round(10 / (2 * 0.5 * 5 / 5.5) + 30 / 3, 4))


def test_bm25(spark):
    d = spark.createDataFrame([("d1", "Kafka consumer lag, kafka!"), ("d2", "database lag"), ("d3", "nothing here at all")], "doc_id string, text string")
    q = spark.createDataFrame([(1, "kafka lag lag"), (2, "absent")], "query_id int, query_text string")
    rows = bm25.search(d, q).collect()
    assert [r.doc_id for r in rows] == ["d1", "d2"]
    texts = {k: [w.strip(tokens.EDGE) for w in t.lower().split()] for k, t in d.collect()}
    avg = sum(map(len, texts.values())) / 3
    idf = lambda t: math.log((3 - (n := sum(t in x for x in texts.values())) + 0.5) / (n + 0.5) + 1)
    want = sum(idf(t) * texts["d1"].count(t) * 2.5 / (texts["d1"].count(t) + 1.5 * (0.25 + 0.75 * len(texts["d1"]) / avg)) for t in ("kafka", "lag", "lag"))
    assert math.isclose(rows[0].score, want)


def test_metrics(spark):
    results = spark.createDataFrame([(1, 1, "d1"), (1, 2, "d3"), (1, 3, "d2")], "query_id int, rank int, doc_id string")
    qrels = spark.createDataFrame([(1, "d1", 1), (1, "d2", 0), (1, "d3", 1), (2, "d1", 1), (3, "d1", 0)], "query_id int, doc_id string, rel int")
    m = {r.query_id: r for r in evaluate.per_query(results, qrels).collect()}
    assert set(m) == {1, 2} and m[1].ndcg == m[1].ap == m[1].rr == m[1].recall == 1 and math.isclose(m[1].precision, 2 / 3) and m[2].ndcg == 0


def test_store(spark, docs):
    store = search.Store(LEX, 2)
    q = spark.createDataFrame([(1, "kafka consumer failure"), (2, "fraud on the customer account")], "query_id int, query_text string")
    with pytest.raises(RuntimeError):
        store.search(q)
    store.add(docs)
    assert len(store) == 7
    store.build()
    found, linear = store.search(q, k=3).collect(), {(r.query_id, r.doc_id) for r in store.linear_search(q).collect()}
    assert found and {(r.query_id, r.doc_id) for r in found} <= linear
    for k in (1, 2):
        d = [r.distance for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == k]
        assert d == sorted(d)
    given = spark.createDataFrame([(r.query_id, r.doc_id) for r in found], "query_id int, doc_id bigint")
    assert not {(r.query_id, r.doc_id) for r in store.search(q, k=3, excluded=given).collect()} & {(r.query_id, r.doc_id) for r in found}


def test_diffusion(spark):
    e = spark.createDataFrame([(1, 0, 2.0), (1, 9, 1.0)], "query_id int, cid int, energy double")
    graph = spark.createDataFrame([(0, 1, 1.0), (1, 0, 0.5), (1, 2, 0.5)], "src int, dst int, w double")
    now = {0: 2.0, 9: 1.0}
    edges = {0: {1: 1.0}, 1: {0: 0.5, 2: 0.5}}
    for _ in range(3):
        new = {}
        for node, x in now.items():
            for to, w in edges.get(node, {}).items():
                new[to] = new.get(to, 0) + x * w * 0.7
            new[node] = new.get(node, 0) + (x * 0.3 * 0.5 if node in edges else x * 0.7)
        now = new
    got = {r.cid: r.energy for r in energy.diffuse(e, graph).collect()}
    assert got.keys() == now.keys() and all(math.isclose(got[k], now[k]) for k in now)


def test_retriever(spark):
    corpus = synthetic.corpus(spark, 300)
    q = synthetic.queries(spark, 20)
    truth = search.keyword_relevance(corpus, q).withColumn("rel", F.lit(1))
    r = factor.Retriever(n_atoms=24, max_features=300, rounds=10).fit(corpus)
    for ranking in ("maxsim", "gated", "diffused"):
        m = evaluate.macro(evaluate.per_query(r.search(q, 10, ranking), truth)).first()
        assert m.precision > 0.5, ranking
    assert evaluate.macro(evaluate.per_query(bm25.search(corpus, q), truth)).first().precision > 0.9
    with pytest.raises(RuntimeError):
        factor.Retriever().search(q)


def test_collections(spark, tmp_path):
    (tmp_path / "d.xml").write_text("<doc><docno> 1 </docno><title>A\n b</title><text>c  d</text></doc><doc><text>no number</text></doc><doc><docno>1</docno><text>again</text></doc><doc><docno>2</docno><text>x</text></doc>")
    (tmp_path / "q.xml").write_text("<top><num>17</num><title> what\n is</title></top><top><num>4</num><title>it</title></top>")
    (tmp_path / "r.txt").write_text("1 0 2 3\n1 0 5 -1\nbad line\n2  0 2  1 x\n")
    assert {(r.doc_id, r.text.strip()) for r in trec.documents(spark, str(tmp_path / "d.xml")).collect()} == {("1", "again"), ("2", "x")}
    assert {tuple(r) for r in trec.topics(spark, str(tmp_path / "q.xml")).collect()} == {("1", "what is"), ("2", "it")}
    assert {r.query_id for r in trec.topics(spark, str(tmp_path / "q.xml"), True).collect()} == {"17", "4"}
    assert {tuple(r) for r in trec.qrels(spark, str(tmp_path / "r.txt")).collect()} == {("1", "2", 3), ("1", "5", 0), ("2", "2", 1)}


def test_records(spark, docs, tmp_path):
    t = encode.trace(docs, LEX)
    recs = ndjson.records(encode.encode(docs, LEX), docs, encode.semantic_group(t), with_blueprint=True)
    ndjson.append(recs, str(tmp_path / "x"))
    back = ndjson.read(spark, str(tmp_path / "x"))
    assert ndjson.next_id(back) == recs.count() + 1
    assert {r.doc_id: r.ids for r in ndjson.blueprints(back).collect()}.keys() == set(range(1, recs.count() + 1))


def test_cooccurrence(docs):
    got = {(r.w1, r.w2): r.n for r in stats.cooccurrence(docs).collect()}
    want = {}
    for _, t in TEXTS:
        ws = [w for raw in (t or "").lower().split() if len(raw) > 2 and (w := raw.strip(tokens.EDGE)) not in lexicon.COOCCURRENCE_STOP_WORDS]
        for i, a in enumerate(ws):
            for j in range(max(0, i - 6), min(len(ws), i + 7)):
                if i != j:
                    want[a, ws[j]] = want.get((a, ws[j]), 0) + 1
    assert got == want


FAST = ["bm25_topk", "idf", "sentence_weight", "domain_hint", "word_clusters", "tags", "encode_tokens", "registry", "blueprint", "store_search", "memberships", "concept_graph", "metrics", "tfidf", "maxsim"]


@pytest.mark.parametrize("name", FAST)
def test_against_duckdb(spark, sf_dir, name):
    con = duckdb.connect()
    for t in "documents embeddings benchmark labels conversations part".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    frame = entry.queries()[name](spark, sf_dir)
    names = sorted(frame.columns)
    found = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    show = lambda row: tuple(f"{x:.4f}" if isinstance(x, float) else "" if x is None else re.sub(r"\.0+$", "", str(x)) for x in row)
    mine = sorted(show(r[c] for c in names) for r in frame.collect())
    other = sorted(show(r[columns.index(c)] for c in names) for r in found.fetchall())
    assert mine == other


def test_whole_vocabularies(spark, sf_dir, monkeypatch):
    queries = entry.queries()
    docs = {r.doc_id: Counter(re.findall(r"\w{2,}", (r.text or "").lower())) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    df = Counter(t for c in docs.values() for t in c)
    usable = sum(2 <= n <= 0.95 * len(docs) for n in df.values())
    got = queries["tfidf_full"](spark, sf_dir).select("term").distinct().count()
    assert 2000 < got and abs(got - min(usable, 10_000)) <= 0.01 * got
    assert queries["direct_energy_full"](spark, sf_dir).agg(F.max("rank")).first()[0] > 20
    made = []
    monkeypatch.setattr(factor.Retriever, "fit", lambda self, docs: made.append(self) or self)
    monkeypatch.setattr(factor.Retriever, "search", lambda self, *a, **b: None)
    for name in ("dictionary_topk", "nmf_topk"):
        queries[name](spark, sf_dir)
    assert [(r.n_atoms, r.max_features) for r in made] == [(256, 10_000), (128, 10_000)] and made[0].rounds == 100


def test_semantic_search_of_turns(spark, tmp_path):
    said = ["kafka qqqzz lag", "zzyyx the account", "Kafka qqqzx lag!", "unrelated wwvvu"]
    asked = ["kafka qqqzz lag", "zzyyx the account", "newword xxkkq"]
    spark.createDataFrame([(k, 0, t) for k, t in enumerate(said)], "conv_id bigint, turn bigint, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame(list(enumerate(asked)), "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(r.query_id, r.doc_id): r.distance for r in entry.queries()["semantic_search"](spark, str(tmp_path)).collect()}
    docs = spark.createDataFrame([(k * 1000, t) for k, t in enumerate(said)], "doc_id bigint, text string")
    first = encode.register(encode.unknown_words(encode.tokens(docs, LEX)), LEX)
    q = spark.createDataFrame(list(enumerate(asked)), "doc_id bigint, text string")
    both = encode.register(encode.unknown_words(encode.tokens(q, LEX)), LEX, first)
    number = LEX.lookup | {r.word: r.id for r in both.collect()}
    ids = lambda t: [number.get(w, x) for w, x in plain_tokens(t)]
    want = {}
    for i, a in enumerate(asked):
        for k, b in enumerate(said):
            x, y = ids(a), ids(b)
            n = max(len(x), len(y))
            x, y = x + [32] * (n - len(x)), y + [32] * (n - len(y))
            if (d := sum(abs(u - v) for u, v in zip(x, y, strict=True)) / n) <= 50:
                want[i, k * 1000] = d
    assert {(0, 0), (1, 1000)} <= got.keys() == want.keys() and got[0, 0] == got[1, 1000] == 0
    assert all(math.isclose(got[k], want[k], abs_tol=1e-3) for k in want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
