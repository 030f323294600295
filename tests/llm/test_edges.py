"""Nulls, empty and long texts, repeated rows, empty tables and clashing names, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import fmindex, licenses, packing, quality, rules, secrets, sharding, simhash, tokencount, warc

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, Text string, score double, fp bigint, _n_words bigint, hits string, items int, path string, `seal` string, `n words` int, `a.b` int"
LONG = "The quick brown fox. " * 20_000


@pytest.fixture(scope="module")
def docs(spark):
    extra = ("x", 1.0, 1, 1, "h", 1, None, "s", 1, 1)
    texts = [(1, "one two three four five"), (1, "one two three four five"), (2, None), (3, ""), (4, " \n\t "), (None, "one two three four six"), (5, LONG), (6, "é" * 50_000), (7, "password=abcdefgh12345 \x00   x")]
    return spark.createDataFrame([(k, t, None, None if k == 3 else "s", None, *extra) for k, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (5, None, None), (None, 1, 0), (7, 0, 0), (7, 1, 0)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "One, two THREE"), (2, None), (3, ""), (None, "five"), (1, "One, two THREE")], "item_id bigint, text string")


def table(df):
    return sorted(map(tuple, df.collect()), key=str)


OPERATORS = {
    "quality": lambda d, la, be: quality.score(d, la),
    "decontaminate": lambda d, la, be: fmindex.contamination(d, be),
    "simhash": lambda d, la, be: simhash.near_duplicates(d),
    "packing": lambda d, la, be: packing.pack(d, TOKENIZER),
    "licenses": lambda d, la, be: licenses.scan(d),
    "sharding": lambda d, la, be: sharding.interleave(d),
    "tokencount": lambda d, la, be: tokencount.count_tokens(d, tokencount.from_sentencepiece(PIECES)),
    "secrets": lambda d, la, be: secrets.find(d),
    "rules": lambda d, la, be: rules.judge(d, la),
    "keep_good": lambda d, la, be: rules.keep_good(d, la),
    "keep_first": lambda d, la, be: simhash.keep_first(d),
    "cut": lambda d, la, be: fmindex.decontaminate(d, be),
    "redact": lambda d, la, be: secrets.redact(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows(name, docs, labels, benchmark):
    rows = OPERATORS[name](docs, labels, benchmark).collect()
    if name == "keep_good":
        assert {r[0] for r in rows} <= {5, 6}
    elif name == "keep_first":
        assert len(rows) < 9 and {r[0] for r in rows} >= {None, 1, 2}
    elif name == "packing":
        assert {r.doc_id for r in rows} == {None, 1, 2, 3, 4, 5, 6, 7}
    else:
        assert len(rows) == 9


@pytest.mark.parametrize("name", OPERATORS)
def test_empty(name, empty, labels, benchmark, spark):
    assert OPERATORS[name](empty, labels, benchmark).count() == 0
    none = spark.createDataFrame([], labels.schema)
    if name in ("quality", "rules"):
        d = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
        assert OPERATORS[name](d, none, benchmark).count() == 1


def test_empty_benchmark(docs, spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert {r.contaminated for r in fmindex.contamination(docs, none).collect()} == {False}


def test_names_stay(docs, labels, benchmark):
    for name in ("keep_good", "keep_first", "cut", "redact"):
        assert OPERATORS[name](docs, labels, benchmark).columns == docs.columns


def test_defined_results(docs, labels, benchmark):
    by = {r.doc_id: r for r in OPERATORS["decontaminate"](docs, labels, benchmark).collect()}
    assert (by[2].n_words, by[2].contaminated, by[1].n_hit, by[1].n_items) == (0, False, 4, 2)
    fp = {r.doc_id: r for r in OPERATORS["simhash"](docs, labels, benchmark).collect()}
    assert fp[2].fingerprint == fp[3].fingerprint == fp[4].fingerprint == "0" * 16 and {fp[k].component_id for k in (2, 3, 4)} == {2}
    tokens = {r.doc_id: r for r in OPERATORS["tokencount"](docs, labels, benchmark).collect()}
    assert tokens[2].n_tokens == tokens[3].n_tokens == 0
    found = {r.doc_id: r for r in OPERATORS["secrets"](docs, labels, benchmark).collect()}
    assert found[7].n_assign == 1 and found[7].spans.startswith("assign:0:22") and found[2].spans == ""
    redacted = {r[0]: r[1] for r in OPERATORS["redact"](docs, labels, benchmark).collect()}
    assert redacted[7].startswith("[secret] ") and redacted[2] is None
    shards = OPERATORS["sharding"](docs, labels, benchmark)
    assert {r.size for r in shards.collect() if r.doc_id in (2, 3)} == {8}


def test_pages(spark):
    schema = "page_id bigint, url string, html string, page string, seal string, keeper int"
    big = "<p>é</p>" * 300
    rows = [(1, "http://a/\r\nb", big), (2, None, big), (2, None, big), (3, "u", None), (4, "u", ""), (None, "u", big), (5, "u", "small"), (6, "u", "small")]
    back = table(warc.round_trip(spark.createDataFrame([(*r, "p", "s", 1) for r in rows], schema)))
    kinds = {(r[0], r[3], r[4]) for r in back}
    assert len(back) == 8
    assert kinds == {(1, "revisit", 2), (2, "response", None), (3, "response", None), (4, "response", None), (None, "revisit", 2), (5, "response", None), (6, "response", None)}
    assert warc.round_trip(spark.createDataFrame([], schema)).count() == 0
    assert dict((r[0], r[1]) for r in back)[1] == len(big.encode()) and F is not None


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "alpha beta gamma delta"), (1, "alpha beta gamma delta"), (1, "zeta eta theta iota"), (2, "alpha beta gamma delta"), (None, "alpha beta gamma delta"), (None, "kappa lambda mu nu"), (None, "kappa lambda mu nu"), (5, None), (6, ""), (None, " ")]
    got = table(simhash.keep_first(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, fp int, stays int")))
    assert got == sorted([(*r, 1, 2) for r in [rows[0], rows[2], rows[5], rows[7]]], key=str)


def test_defined_results_of_learned_operators(docs, labels, benchmark):
    quality_of = {r.doc_id: r for r in OPERATORS["quality"](docs, labels, benchmark).collect()}
    assert all(quality_of[k].good_share == 0 for k in (2, 3, 4)) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in quality_of.values())
    judged = {r.doc_id: r for r in OPERATORS["rules"](docs, labels, benchmark).collect()}
    assert all((judged[k].n_words, judged[k].base_failed, judged[k].kept) == (0, True, False) for k in (2, 3, 4)) and judged[5].base_failed
    licensed = {r.doc_id: r for r in OPERATORS["licenses"](docs, labels, benchmark).collect()}
    assert all(r.licence is None and r.licensed_by is None for r in licensed.values())
    shards = OPERATORS["sharding"](docs, labels, benchmark).collect()
    assert sorted((r.shard, r.slot) for r in shards) == sorted((k * 24 // 9, 0) for k in range(9))
    packed = {r.doc_id: r for r in OPERATORS["packing"](docs, labels, benchmark).collect()}
    assert packed[2].doc_tokens == packed[3].doc_tokens == packed[4].doc_tokens == 1


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    words = lambda a, n=80: " ".join(f"word{a}x{i}" for i in range(n))
    secret = "0123456789abcdef" * 3
    rows = [(1, words("a")), (1, words("a")), (2, words("a")), (3, None), (4, ""), (None, words("b")), (5, f"{words('c')} token = {secret} {words('d')}"), (6, words("e", 9000)), (7, f"{words('f')} {words('q', 12)} {words('g')}"), (8, "same " * 90)]
    spark.createDataFrame([(k, t, "en", "s", None, 1, "h") for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, fp int, hits string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, words("q", 12)), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
    got = {r.doc_id: r.text for r in docs.collect()}
    assert docs.count() == 5 and got.keys() == {1, None, 5, 6, 7} and got[1] == words("a") and len(got[6].split()) == 9000
    assert secret not in got[5] and got[5].startswith(words("c")) and "wordqx" not in got[7] and "wordgx79" in got[7]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == got.keys()
